"""Properties that must hold on the given tables."""

from pyspark.sql import functions as F

from gridloom.operators import cleaning, rollup, statistics
from gridloom.operators.series import SeriesKey
from gridloom.plans.features import feature_table, lag_offsets, leakage_report, window_sizes
from workloads.base import BY_USER, ONE_SERIES, readings


def test_features_do_not_see_the_future(spark, data_dir):
    log = readings(spark, data_dir).select("event_id", "ts", "household_id", "value")
    cut = log.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    changed = log.withColumn("value", F.when(F.col("event_id") >= cut, F.lit(1e6)).otherwise(F.col("value")))
    for key in (BY_USER, ONE_SERIES):
        before = feature_table(log, key, "ts", "value", drop_incomplete=False)
        after = feature_table(changed, key, "ts", "value", drop_incomplete=False)
        history = [c for c in before.columns if c.startswith("target_")]
        safe = F.col("event_id") <= cut
        left = before.where(safe).select("event_id", *history)
        assert left.exceptAll(after.where(safe).select("event_id", *history)).isEmpty()


def test_horizon_rules():
    assert lag_offsets(1) == [1, 2, 3, 5, 10, 60, 120, 360, 720, 1440, 10080]
    assert lag_offsets(60) == [60, 120, 360, 720, 1440, 10080]
    assert lag_offsets(1, 99) == [1, 2, 3, 5, 10, 60]
    assert window_sizes(100) == [360, 1440]


def test_horizon_shifts_trailing_statistics(spark, data_dir):
    log = readings(spark, data_dir).select("event_id", "ts", "household_id", "value")
    out = feature_table(log, ONE_SERIES, "ts", "value", horizon=30, drop_incomplete=False)
    rows = out.orderBy("ts", "event_id").collect()
    raw = [r["value"] for r in rows]
    assert rows[29]["target_rolling_mean_60"] is None
    assert abs(rows[200]["target_rolling_mean_60"] - sum(raw[111:171]) / 60) < 1e-9


def test_cleaning_leaves_no_missing_values_and_is_stable(spark, data_dir):
    log = readings(spark, data_dir).select("event_id", "ts", "household_id", "reading")
    filled = cleaning.interpolate_by_time(log, BY_USER, "ts", ["reading"])
    assert filled.where(F.col("reading").isNull()).isEmpty()
    once = cleaning.keep_first(filled, ["household_id", "ts"], ["event_id"])
    again = cleaning.keep_first(once, ["household_id", "ts"], ["event_id"])
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


def test_days_hold_the_energy_of_their_hours(spark, data_dir):
    hours = rollup.hourly_rollup(readings(spark, data_dir), "household_id", "ts", "value")
    days = rollup.daily_rollup(hours)
    a = hours.agg(F.sum("total_energy")).first()[0]
    assert abs(a - days.agg(F.sum("total_energy")).first()[0]) < 1e-6


def test_wide_correlation_path_agrees(spark, data_dir):
    log = readings(spark, data_dir).select("event_id", "ts", "household_id", "value")
    table = feature_table(log, SeriesKey(("household_id",), ("ts", "event_id")), "ts", "value")
    names = [f.name for f in table.schema.fields if f.dataType.simpleString() in ("int", "double", "bigint")][:14]
    pairs = statistics.upper_pairs(names)
    assert len(pairs) > statistics.WIDE_PAIRS
    wide = {(r["var1"], r["var2"]): r["r"] for r in statistics.pearson_pairs(table, pairs).collect()}
    for chunk in (pairs[:50], pairs[50:]):
        for r in statistics.pearson_pairs(table, chunk).collect():
            other = wide[(r["var1"], r["var2"])]
            assert (r["r"] is None) == (other is None)
            assert r["r"] is None or abs(r["r"] - other) < 1e-9


def test_leakage_report_names_the_copy(spark, data_dir):
    log = readings(spark, data_dir).select("event_id", "ts", "household_id", "value")
    table = feature_table(log, BY_USER, "ts", "value").withColumn("copy", F.col("value") * 2 + 1)
    assert [r["feature"] for r in leakage_report(table, BY_USER, "value").collect()] == ["copy"]
