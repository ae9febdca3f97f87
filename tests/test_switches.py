"""Both sides of every size-based choice give the same rows, with NULL keys, NaN, infinity and one hot value."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import association, cleaning, learning, quantiles, series, statistics
from gridloom.operators.series import SeriesKey
from gridloom.plans.features import feature_table
from gridloom.session import scratch_folder, scratch_scope
from gridloom.sources import tables

SHORT = SeriesKey(("home",), ("ts", "seq"))
LONG = SeriesKey(("home",), ("ts", "seq"), plain_rows=0, slice_rows=30)


@pytest.fixture(scope="module")
def rows(spark):
    """Homes 0 (hot), 1, 2 and NULL; some times NULL; values repeat, a few are NULL, NaN or infinite."""
    rng = random.Random(4)
    out = []
    for seq in range(700):
        home = rng.choice([0] * 6 + [1, 2, None, None])
        ts = None if seq % 83 == 0 else f"2024-01-{1 + seq // 40:02d} {seq % 24:02d}:00:00"
        v = rng.choice([5.0] * 5 + [rng.random() * 100] * 4 + [None])
        w = rng.choice([float("nan"), math.inf, -math.inf, 7.0, 7.0, rng.random(), rng.random(), None])
        out.append((seq, home, ts, v, w))
    df = spark.createDataFrame(out, "seq BIGINT, home BIGINT, t STRING, v DOUBLE, w DOUBLE")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").repartition(7).cache()


def table_of(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_positions_and_windows(rows):
    runs = {
        "pos": lambda key: table_of(series.with_positions(rows, key), "seq", "_pos"),
        "time": lambda key: table_of(cleaning.interpolate_by_time(rows, key, "ts", ["v"]).withColumn("v", F.round("v", 9)), "seq", "v"),
        "row": lambda key: table_of(cleaning.interpolate_by_row(rows, key, ["v"]).withColumn("v", F.round("v", 9)), "seq", "v"),
        "fill": lambda key: table_of(cleaning.forward_fill(rows, key, ["v"], 3), "seq", "v"),
        "gaps": lambda key: table_of(cleaning.find_gaps(rows, key, "ts", 3600), "seq", "missing_steps"),
    }
    for name, run in runs.items():
        assert run(SHORT) == run(LONG), name


def test_lags_and_statistics(rows):
    def run(key):
        placed = series.with_look_back(rows, key, 12)
        out = series.drop_halo(series.history(placed, key, "v", {"lag": 7}, {11: ("mean", "std")}, frame_limit=4))
        return table_of(out.withColumns({c: F.round(c, 9) for c in ("mean", "std")}), "seq", "lag", "mean", "std")

    assert run(SHORT) == run(LONG)
    assert len(run(LONG)) == 700


@pytest.mark.parametrize("group", [[], ["home"]])
@pytest.mark.parametrize("column", ["v", "w"])
def test_quantiles(rows, group, column):
    def run(limit):
        found = quantiles.grouped_quantiles(rows, group, column, [0.0, 0.3, 0.5, 0.97, 1.0], limit)
        return sorted(((repr(r[group[0]]) if group else ""), r["rows"], [round(x, 9) for x in r["q"]]) for r in found.collect())

    assert run(10**9) == run(0) == run(100)
    assert quantiles.column_quantiles(rows, [column], [0.25, 0.5], 0) == quantiles.column_quantiles(rows, [column], [0.25, 0.5])


def test_quantiles_of_many_groups_of_which_one_is_large(spark):
    many = spark.range(30_000).select(F.when(F.col("id") < 15_000, F.col("id") % 10_000).otherwise(-1).alias("g"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    fast = {r["g"]: (r["rows"], r["q"]) for r in quantiles.grouped_quantiles(many, ["g"], "v", [0.5]).collect()}
    mixed = {r["g"]: (r["rows"], r["q"]) for r in quantiles.grouped_quantiles(many, ["g"], "v", [0.5], exact_rows=1_000).collect()}
    assert len(mixed) == 10_001 and mixed == fast


def test_quantiles_of_many_large_groups(spark):
    """20,000 groups that all count as large, one with a third of the rows: equal to percentile, in few jobs."""
    value = F.expr("CASE WHEN id % 997 = 0 THEN double('NaN') WHEN id % 991 = 0 THEN double('inf') WHEN id % 983 = 0 THEN NULL ELSE double(id * 7919 % 10007) END")
    group = F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 20000 END")
    many = spark.range(120_000).select(group.alias("g"), value.alias("v"))
    probs = [0.0, 0.3, 0.5, 1.0]
    context = spark.sparkContext
    context.setJobGroup("many groups", "")
    found = {r["g"]: (r["rows"], r["q"]) for r in quantiles.grouped_quantiles(many, ["g"], "v", probs, exact_rows=0).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("many groups"))
    context.setLocalProperty("spark.jobGroup.id", None)
    wanted = {r["g"]: (r["rows"], r["q"]) for r in quantiles.grouped_quantiles(many, ["g"], "v", probs).collect()}
    assert len(found) > 13_000 and found.keys() == wanted.keys() and jobs < 25
    for g, (rows, q) in wanted.items():
        assert found[g][0] == rows
        # percentile counts on 0 x infinity where a quantile falls on a value beside an infinity
        assert found[g][1] == pytest.approx(q) or any(math.isnan(x) for x in q)


def test_order_statistics_end_on_infinities(rows):
    known = sorted(r["w"] for r in rows.collect() if r["w"] is not None and not math.isnan(r["w"]))
    ranks = [0, 5, len(known) // 2, len(known) - 1]
    found = quantiles.order_statistics(rows, [], "w", {(): ranks})
    assert [found[((), r)].value for r in ranks] == [known[r] for r in ranks]
    assert all(found[((), r)].smaller == sum(x < known[r] for x in known) for r in ranks)


@pytest.mark.parametrize("slices", [1, 6])
def test_ranks(rows, slices):
    known = sorted(r["w"] for r in rows.collect() if r["w"] is not None and not math.isnan(r["w"]))
    found = {r["value"]: (r["n"], r["rank"], r["position"]) for r in quantiles.value_ranks(rows, "w", slices).collect()}
    distinct = sorted(set(known))
    assert found == {x: (known.count(x), known.index(x) + (known.count(x) + 1) / 2, i) for i, x in enumerate(distinct)}


def test_rank_plan_has_no_single_task_over_values(spark, data_dir):
    lines = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    plan = quantiles.value_ranks(lines, "l_extendedprice")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the totals of the slices


def test_rank_correlations(rows):
    pairs = [("v", "w"), ("v", "seq"), ("w", "seq")]
    small = [r["r"] for r in association.kendall_pairs(rows, pairs).collect()]
    striped = [r["r"] for r in association.kendall_pairs(rows, pairs, stripe_rows=40).collect()]
    assert small == pytest.approx(striped, abs=1e-12)


def test_wide_correlations(rows, monkeypatch):
    columns = ["v", "seq", "x1", "x2"]
    wide = rows.withColumns({"x1": F.col("seq") % 13, "x2": F.coalesce("v", F.lit(0.0)) * F.col("seq")}).dropna(subset=columns)
    run = lambda: sorted((r["var1"], r["var2"], round(r["r"], 9)) for r in statistics.pearson_matrix(wide, columns).collect())
    plain = run()
    monkeypatch.setattr(statistics, "WIDE_PAIRS", 1)
    assert run() == plain


def test_keep_first_with_missing_orders(spark):
    df = spark.createDataFrame([(1, None, 7.0, "a"), (2, None, 8.0, "b"), (2, 3, 9.0, "c"), (None, 4, 1.0, "d"), (None, 2, None, "e")], "k BIGINT, seq BIGINT, v DOUBLE, s STRING")
    fixed = cleaning.keep_first(df.drop("s"), ["k"], ["seq"])
    texts = cleaning.keep_first(df, ["k"], ["seq"])
    assert sorted(map(repr, map(tuple, fixed.collect()))) == sorted(["(1, None, 7.0)", "(2, None, 8.0)", "(None, 2, None)"])
    assert sorted(r["s"] for r in texts.collect()) == ["a", "b", "e"]


def test_sample_needs_an_identity(spark, monkeypatch):
    monkeypatch.setattr(learning, "MOST_TIED", 50)
    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("v"), F.lit(1).alias("same"), "id")
    with pytest.raises(ValueError, match="identity"):
        learning.stratified_sample(df, "v", 100, ["same"]).collect()


def _listed(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(folder)} if files.exists(folder) else set()


def test_scratch_is_emptied(spark, rows, tmp_path):
    before = _listed(spark)
    with scratch_scope(spark):
        cleaned = cleaning.clean_readings(rows, LONG, "ts", ["v"], limits={"v": (0.0, 90.0)}, outlier_columns=["v"])
        cleaned.write.parquet(str(tmp_path / "cleaned"))
        feature_table(cleaned.select("seq", "home", "ts", "v"), LONG, "ts", "v", drop_incomplete=False).write.parquet(str(tmp_path / "features"))
    days = rows.select(F.to_date("ts").alias("date"), "home", "v")
    for _ in range(2):
        tables.upsert(days.groupBy("date", "home").agg(F.max("v").alias("v")), str(tmp_path / "days"), ["date", "home"])
    assert {n for n in _listed(spark) - before if n.startswith("gridloom-")} == set()
    assert spark.read.parquet(str(tmp_path / "days")).count() == days.select("date", "home").distinct().count()
