"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

from gridloom.operators import association, cleaning, columns, learning, rollup, series
from gridloom.operators.series import SeriesKey
from gridloom.plans.features import add_history
from gridloom.sources import tables
from workloads.base import BY_USER, readings

SLICED = SeriesKey((), ("ts", "event_id"), plain_rows=0, slice_rows=100)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def row_exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


def test_short_series_need_one_exchange(spark, data_dir):
    out = add_history(readings(spark, data_dir), BY_USER, "value", [1, 5], [60, 360])
    assert row_exchanges(plan(out)) == 1


def test_lags_need_one_sort(spark, data_dir):
    text = plan(add_history(readings(spark, data_dir), BY_USER, "value", [1, 5], [60]))
    assert len(re.findall(r"Sort \[", text)) == 1


def test_days_are_hash_aggregates(spark, data_dir):
    hours = rollup.hourly_rollup(readings(spark, data_dir), "household_id", "ts", "value")
    assert "SortAggregate" not in plan(rollup.daily_rollup(hours))


def test_long_series_never_meet_in_one_task(spark, data_dir):
    log = readings(spark, data_dir)
    placed = series.with_look_back(log, SLICED, 20)
    assert "Window" in plan(placed)
    counts = placed.groupBy("_bucket").count().collect()
    assert len(counts) > 5 and max(r["count"] for r in counts) <= 100 + 20
    text = plan(add_history(log, SLICED, "value", [1, 5], [20]))
    for line in text.splitlines():
        if "Exchange SinglePartition" in line:
            below = text[text.index(line):]
            assert "_rows" in below


def test_bucket_windows_share_one_exchange(spark, data_dir):
    lags_only = add_history(readings(spark, data_dir), SLICED, "value", [5, 20], [])
    with_stats = add_history(readings(spark, data_dir), SLICED, "value", [5, 20], [20, 18], frame_limit=0)
    assert row_exchanges(plan(with_stats)) == row_exchanges(plan(lags_only))


def test_slices_are_bounded_on_a_hot_household(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("household_id"), F.col("id").alias("event_id"), F.lit(0).alias("ts"), F.lit(1.0).alias("v")
    )
    key = SeriesKey(("household_id",), ("ts", "event_id"), plain_rows=0, slice_rows=300)
    sizes = [r["count"] for r in series.slice_rows(df, key, 3000).groupBy("_slice").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 900


def test_rollup_combines_before_the_shuffle(spark, data_dir):
    text = plan(rollup.hourly_rollup(readings(spark, data_dir), "household_id", "ts", "value"))
    assert "partial_sum" in text and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_first_copy_is_an_aggregate(spark, data_dir):
    text = plan(cleaning.keep_first(readings(spark, data_dir), ["household_id", "ts"], ["event_id"]))
    assert "partial_min" in text and "Window" not in text


def test_limits_reach_the_scan(spark, data_dir):
    events = spark.read.parquet(f"{data_dir}/events.parquet").select("event_id", "value")
    text = plan(columns.within_limits(events, {"value": (0.0, 400.0)}))
    assert "GreaterThanOrEqual(value,0.0)" in text and "LessThanOrEqual(value,400.0)" in text


def test_time_borders_reach_the_scan(spark, data_dir):
    events = spark.read.parquet(f"{data_dir}/events.parquet").select("event_id", "ts")
    train, test = learning.chronological_split(events, ["ts", "event_id"])
    assert "LessThanOrEqual(ts," in plan(train) or "LessThan(ts," in plan(train)


def test_few_values_are_broadcast_when_ranked(spark, data_dir):
    lines = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    assert "BroadcastHashJoin" in plan(association.with_ranks(lines, ["l_tax", "l_discount"]))


def test_upsert_reads_only_touched_dates(spark, data_dir, tmp_path):
    hours = rollup.hourly_rollup(readings(spark, data_dir), "household_id", "ts", "value")
    tables.upsert(hours, str(tmp_path / "t"), rollup.HOURLY_KEYS)
    stored = spark.read.parquet(str(tmp_path / "t"))
    touched = tables.on_dates_of(stored, hours.where("date = DATE'2024-01-03'"))
    assert re.search(r"PartitionFilters: \[.*2024-01-03", plan(touched))


def test_slices_stay_schedulable(spark):
    key = SeriesKey((), ("ts",))
    for total in (10**4, 10**9, 10**13):
        assert total / series.rows_per_slice(spark.range(1), key, total) <= 20_000
