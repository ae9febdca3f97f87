"""Small hand-made tables with known results."""

import math
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.distributions import f_tail, t_two_sided
from gridloom.functions.numeric import clip_low, nan_to_null
from gridloom.operators import association, charts, cleaning, columns, evaluation, learning, profiles, rollup, statistics
from gridloom.operators.series import SeriesKey
from gridloom.plans.features import rolling_features
from gridloom.sources import logs
from workloads import REGISTRY

START = datetime(2024, 1, 1)
KEY = SeriesKey(("household_id",), ("ts", "seq"))


def minutes(spark, values, at=None, household=1):
    at = at or range(len(values))
    rows = [(household, i, START + timedelta(minutes=m), v) for i, (m, v) in enumerate(zip(at, values))]
    return spark.createDataFrame(rows, "household_id BIGINT, seq BIGINT, ts TIMESTAMP_NTZ, v DOUBLE")


def values(df, column="v", order="seq"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_interpolation_weights_time_and_extends_the_ends(spark):
    df = minutes(spark, [None, 1.0, None, 5.0, None], at=[0, 1, 4, 5, 6])
    assert values(cleaning.interpolate_by_time(df, KEY, "ts", ["v"])) == [1.0, 1.0, 4.0, 5.0, 5.0]


def test_interpolation_by_row_ignores_time(spark):
    df = minutes(spark, [None, 1.0, None, 5.0, None], at=[0, 1, 4, 5, 6])
    assert values(cleaning.interpolate_by_row(df, KEY, ["v"])) == [1.0, 1.0, 3.0, 5.0, 5.0]


def test_interpolation_without_any_value(spark):
    df = minutes(spark, [None, None])
    assert values(cleaning.interpolate_by_time(df, KEY, "ts", ["v"])) == [None, None]


def test_forward_fill_stops_after_sixty_rows(spark):
    df = minutes(spark, [7.0] + [None] * 61)
    filled = values(cleaning.forward_fill(df, KEY, ["v"]))
    assert filled[:61] == [7.0] * 61 and filled[61] is None


def test_fill_missing_strategies(spark):
    df = minutes(spark, [1.0, None, 3.0])
    assert values(cleaning.fill_missing(df, KEY, "ts", ["v"])) == [1.0, 2.0, 3.0]
    assert values(cleaning.fill_missing(df, KEY, "ts", ["v"], "forward_fill")) == [1.0, 1.0, 3.0]
    assert values(cleaning.fill_missing(df, KEY, "ts", strategy="drop")) == [1.0, 3.0]
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, KEY, "ts", strategy="guess")


def test_time_of_day_and_flags(spark):
    hours = spark.range(24).select((F.lit(START) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    rows = calendar.add_calendar(hours, "ts").orderBy("ts").collect()
    assert [r["time_of_day"] for r in rows] == [0] * 7 + [1] * 6 + [2] * 6 + [3] * 5
    assert [r["hour"] for r in rows if r["is_night"]] == [0, 1, 2, 3, 4, 5, 6, 23]
    assert [r["hour"] for r in rows if r["is_morning_peak"]] == [7, 8, 9]
    assert [r["hour"] for r in rows if r["is_evening_peak"]] == [18, 19, 20, 21]


def test_seasons_and_iso_week(spark):
    days = spark.createDataFrame([(datetime(2024, m, 1),) for m in range(1, 13)] + [(datetime(2024, 12, 30),)], "ts TIMESTAMP_NTZ")
    rows = calendar.add_calendar(days, "ts").orderBy("ts").collect()
    assert [r["season"] for r in rows] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0, 0]
    assert (rows[-1]["weekofyear"], rows[-1]["quarter"], rows[0]["dayofweek"]) == (1, 4, 0)


def test_calendar_adds_24_columns(spark):
    assert len(calendar.calendar_columns("ts")) == 24


def test_rolling_excludes_the_current_row(spark):
    out = rolling_features(minutes(spark, [1.0, 2.0, 3.0]), KEY, "v", windows=[3])
    assert values(out, "target_rolling_mean_3") == [None, 1.0, 1.5]
    assert values(out, "target_rolling_std_3") == [None, None, pytest.approx(math.sqrt(0.5))]


def test_moments_and_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 20)], "v DOUBLE")
    found = {r["metric"]: r["value"] for r in statistics.statistical_summary(df, ["v"]).collect()}
    assert (found["25%"], found["50%"], found["75%"]) == (2.0, 4.0, 9.0)
    assert found["std"] == pytest.approx(7.791020472312982)
    assert found["skewness"] == pytest.approx(1.4901199696128797)
    assert found["kurtosis"] == pytest.approx(1.8954319322348585)


def test_moments_of_equal_values(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "v DOUBLE")
    found = {r["metric"]: r["value"] for r in statistics.statistical_summary(df, ["v"]).collect()}
    assert (found["std"], found["skewness"], found["kurtosis"]) == (0.0, 0.0, 0.0)


def test_log_dates_are_day_first(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(
        "Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3\n"
        "6/2/2007;17:24:00;4.216;?;234.840;18.400;0.000;1.000;17.000\n"
        "16/12/2006;17:25:00;?;;x;1;2;3;\n"
    )
    rows = logs.read_log(spark, str(path)).orderBy("timestamp").collect()
    assert rows[1]["timestamp"] == datetime(2007, 2, 6, 17, 24)
    assert rows[1]["Global_active_power"] == 4.216 and rows[1]["Global_reactive_power"] is None
    assert rows[0]["Global_active_power"] is None and rows[0]["Voltage"] is None and rows[0]["Sub_metering_3"] is None


def test_first_copy_in_file_order(spark, tmp_path):
    path = tmp_path / "log.txt"
    header = "Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3\n"
    lines = [f"1/1/2007;00:0{i % 5}:00;{i}.0;0;240;1;0;0;0\n" for i in range(20)]
    path.write_text(header + "".join(lines))
    log = logs.read_log(spark, str(path), file_order=True).repartition(7)
    kept = cleaning.keep_first(log, ["timestamp"], logs.FILE_ORDER)
    assert sorted(r["Global_active_power"] for r in kept.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_keep_first_keeps_a_missing_reading(spark):
    df = minutes(spark, [None, 7.0], at=[0, 0])
    assert values(cleaning.keep_first(df, ["household_id", "ts"], ["seq"])) == [None]
    texts = df.withColumn("note", F.lit("x"))
    assert values(cleaning.keep_first(texts, ["household_id", "ts"], ["seq"])) == [None]


def test_outlier_rules(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in [*range(1, 21), 500]] + [(None, 5.0)], "v DOUBLE, c DOUBLE")
    for options in ({}, {"mode": "joint"}, {"exact": False}):
        kept = cleaning.drop_iqr_outliers(df, ["v", "absent", "c"], **options)
        assert sorted(r["v"] for r in kept.collect()) == [float(v) for v in range(1, 21)]
    assert cleaning.drop_zscore_outliers(df, ["v"]).count() == 20
    assert cleaning.drop_zscore_outliers(df, ["c"]).count() == 0


def test_keep_first_by_sequence(spark):
    df = minutes(spark, [5.0, 7.0, 8.0], at=[0, 0, 1])
    assert values(cleaning.keep_first(df, ["household_id", "ts"], ["seq"])) == [5.0, 8.0]


def test_peak_hour_tie_and_unweighted_day(spark):
    rows = [(START + timedelta(hours=1, minutes=m), 1.0) for m in range(60)] + [(START + timedelta(hours=3), 3.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "household_id BIGINT, ts TIMESTAMP_NTZ, v DOUBLE")
    day = rollup.daily_rollup(rollup.hourly_rollup(df, "household_id", "ts", "v")).first()
    assert (day["avg_power"], day["peak_hour"], day["total_energy"]) == (2.0, 3, pytest.approx(1.05))
    flat = rollup.hourly_rollup(df.withColumn("v", F.lit(1.0)), "household_id", "ts", "v")
    assert rollup.daily_rollup(flat).first()["peak_hour"] == 1


def test_rank_correlations(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 3), (3, 9)], "x INT, y INT")
    assert association.spearman_pairs(df, [("x", "y")]).first()["r"] == pytest.approx(0.892217816219194)
    quad = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4)], "x INT, y INT")
    assert association.kendall_pairs(quad, [("x", "y")]).first()["r"] == pytest.approx(4 / 6)


def test_constant_columns_have_no_scores(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "y DOUBLE, c DOUBLE")
    assert statistics.pearson_pairs(df, [("c", "y")]).first()["r"] is None
    assert statistics.f_test(df, ["c"], "y").first()["f_score"] is None
    assert association.kendall_pairs(df, [("c", "y")]).first()["r"] is None
    assert statistics.normality(df, ["c"]).first()["p_value"] is None


def test_constant_columns_of_several_parts_have_no_correlation(spark):
    # 49 * (1 / 49) is not 1, so the merged average of each part misses the next one's by a rounding error.
    ids = F.col("id").cast("double")
    df = spark.range(0, 98, 1, 2).select(
        ids.alias("y"), F.lit(1.0).alias("c"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 49, ids).alias("half"), F.when(F.col("id") != 97, F.lit(2024)).alias("known"),
    )
    assert df.agg(F.stddev_pop("c")).first()[0] > 0
    pairs = [("c", "y"), ("c", "c"), ("c", "half"), ("known", "y"), ("none", "y")]
    found = {(r["var1"], r["var2"]): r["r"] for r in statistics.pearson_pairs(df, [*pairs, ("y", "half")]).collect()}
    assert [found[pair] for pair in pairs] == [None] * len(pairs) and found["y", "half"] == pytest.approx(1.0)
    direct = df.agg(statistics.pearson("c", "y").alias("all"), statistics.pearson("known", "y").alias("known")).first()
    assert direct["all"] is None and direct["known"] is None
    scored = statistics.f_test(df, ["c"], "y").first()
    assert scored["f_score"] is None and scored["p_value"] is None and not scored["significant"]


@pytest.mark.parametrize(("years", "rows"), [((2024, 2024), 1), ((2024, None), 1), ((2023, 2024), 0), ((None, None), 0), ((), 0)])
def test_constant_year_query_on_other_years(spark, tmp_path, years, rows):
    times = [(None if y is None else datetime(y, 5, 1), float(i)) for i, y in enumerate(years)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(times, "ts TIMESTAMP_NTZ, value DOUBLE").write.parquet(path)
    query = REGISTRY["st3_pearson_constant_column"]
    found = sorted(tuple(r) for r in query.run(spark, str(tmp_path)).collect())
    oracle = duckdb.connect()
    oracle.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert found == oracle.sql(query.sql).fetchall() == [("value", "year", None)] * rows


def test_pairwise_correlation_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.5), (4.0, 8.0)], "a DOUBLE, b DOUBLE")
    known = df.dropna()
    wanted = statistics.pearson_pairs(known, [("a", "b")]).first()["r"]
    assert statistics.pearson_pairs(df, [("a", "b")]).first()["r"] == pytest.approx(wanted)


def test_tolerance_and_mape(spark):
    rows = [("m", 10.0, 11.0), ("m", 10.0, 11.5), ("m", 0.0, 0.0)]
    scores = evaluation.evaluate(spark.createDataFrame(rows, "model_name STRING, y DOUBLE, y_hat DOUBLE")).first()
    assert scores["accuracy"] == pytest.approx(200 / 3) and scores["f1"] == scores["accuracy"]
    zero = spark.createDataFrame([("m", 0.0, 1.0), ("m", 1.0, 1.0)], "model_name STRING, y DOUBLE, y_hat DOUBLE")
    assert 1e9 < evaluation.evaluate(zero).first()["mape"] < 1e11


def test_stratified_sample_takes_whole_shares(spark):
    df = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("y"))
    sample = learning.stratified_sample(df, "y", 33, ["id"])
    assert sample.count() == 30
    assert sorted(r["y"] for r in sample.collect()) == sorted(
        r["y"] for r in learning.stratified_sample(df, "y", 33, ["id"]).collect()
    )


def test_stratified_sample_of_copies(spark):
    """One row repeated for most of the table: quotas stay exact, copies are not listed."""
    df = spark.range(1000).select(F.when(F.col("id") < 700, 5.0).otherwise(F.col("id") * 1.0).alias("y"))
    assert learning.stratified_sample(df, "y", 100, ["y"]).count() == pytest.approx(100, abs=10)


def test_submeter_balance(spark):
    df = spark.createDataFrame([(0.25, 100.0, 200.0, None)], "p DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE")
    row = profiles.submeter_balance(df, "p", ["a", "b", "c"]).first()
    assert (row["total_submeters"], row["other_consumption"]) == (pytest.approx(0.3), 0.0)


def test_histogram_keeps_the_maximum_in_the_last_bin(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    bins = charts.histogram(df, "v").orderBy("bin").collect()
    assert (len(bins), bins[-1]["bin"], bins[-1]["n"], sum(b["n"] for b in bins)) == (50, 50, 3, 101)
    same = charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v DOUBLE"), "v").where("n > 0").collect()
    assert [b["n"] for b in same] == [2]


def test_upsert_merge(spark):
    schema = "date DATE, household_id BIGINT, v INT"
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    old = spark.createDataFrame([(d1, 1, 1), (d1, 2, 2), (d2, 2, 3)], schema)
    merged = rollup.merge_by_key(old, spark.createDataFrame([(d1, 1, 9)], schema), ["date", "household_id"])
    assert sorted(r["v"] for r in merged.collect()) == [2, 3, 9]


def test_limits_count_sequentially(spark):
    df = spark.createDataFrame([(1.0, 1.0), (9.0, 9.0), (1.0, 9.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    limits = {"a": (0.0, 5.0), "b": (0.0, 5.0)}
    found = {r["rule"]: r["invalid"] for r in columns.limit_violations(df, limits).collect()}
    assert found == {"a": 2, "b": 1} and columns.within_limits(df, limits).count() == 1


def test_clip_and_nan(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (-1.0,), (2.0,)], "v DOUBLE"))
    assert [r[0] for r in df.select(clip_low(F.col("v"))).collect()] == [None, 0.0, 2.0]


def test_tail_probabilities():
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert f_tail(4.0, 1, 1e6) == pytest.approx(math.erfc(math.sqrt(2.0)), abs=1e-5)
    assert f_tail(161.4476, 1, 1) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(0.0, 1, 5) == 1.0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="voltage"):
        columns.require_columns(spark.range(1), ["id", "voltage"])


def test_time_grid(spark):
    key = SeriesKey(("household_id",), ("ts", "seq"))
    filled = cleaning.fill_time_grid(minutes(spark, [1.0, 2.0, 3.0], at=[0, 1, 5]), key, "ts")
    assert [r["ts"].minute for r in filled.orderBy("ts").collect()] == [0, 1, 2, 3, 4, 5]
    assert filled.where(F.col("v").isNull()).count() == 3
    long = cleaning.fill_time_grid(minutes(spark, [1.0, 2.0], at=[0, 5000]), key, "ts")
    assert long.count() == 5001 == long.select("ts").distinct().count()
