"""The scalable layouts against plain windows and brute force, also on skewed data."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from gridloom.functions.pairs import crossed_weight
from gridloom.operators import association, cleaning, learning, quantiles, series
from gridloom.operators.series import SeriesKey
from gridloom.plans.features import add_history

PLAIN = SeriesKey(("household_id",), ("ts", "seq"))
SLICED = SeriesKey(("household_id",), ("ts", "seq"), plain_rows=0, slice_rows=40)
ONE = SeriesKey((), ("ts", "seq"), plain_rows=0, slice_rows=37)
ONE_PLAIN = SeriesKey((), ("ts", "seq"))


@pytest.fixture(scope="module")
def skewed(spark):
    """Household 0 holds a third of the rows, and a fifth of all rows share one time."""
    rng = random.Random(7)
    rows = []
    for seq in range(900):
        household = 0 if seq % 3 == 0 else rng.randrange(1, 12)
        ts = 500 if rng.random() < 0.2 else rng.randrange(1000)
        value = None if rng.random() < 0.3 else round(rng.gauss(50, 20), 2)
        rows.append((household, seq, ts, value))
    df = spark.createDataFrame(rows, "household_id BIGINT, seq BIGINT, minute INT, v DOUBLE")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("ts", start + F.make_dt_interval(mins=F.col("minute"))).drop("minute").cache()


def by_seq(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("seq").collect()]


def close(a, b):
    assert len(a) == len(b)
    for left, right in zip(a, b):
        for x, y in zip(left, right):
            assert (x is None) == (y is None)
            if x is not None:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("key,plain", [(SLICED, PLAIN), (ONE, ONE_PLAIN)])
def test_positions(skewed, key, plain):
    expected = skewed.withColumn("_pos", F.row_number().over(plain.forward()) - 1)
    assert by_seq(series.with_positions(skewed, key), "_pos") == by_seq(expected, "_pos")


@pytest.mark.parametrize("key,plain", [(SLICED, PLAIN), (ONE, ONE_PLAIN)])
def test_lags_and_trailing_statistics(skewed, key, plain):
    names = ["target_lag_1", "target_lag_7", "target_rolling_mean_20", "target_rolling_std_20"]
    out = add_history(skewed, key, "v", [1, 7], [20, 5], frame_limit=0)
    frame = plain.forward().rowsBetween(-20, -1)
    expected = skewed.withColumns(
        {
            "target_lag_1": F.lag("v", 1).over(plain.forward()),
            "target_lag_7": F.lag("v", 7).over(plain.forward()),
            "target_rolling_mean_20": F.avg("v").over(frame),
            "target_rolling_std_20": F.stddev_samp("v").over(frame),
        }
    )
    close(by_seq(out, *names), by_seq(expected, *names))


@pytest.mark.parametrize("rows", [1, 2, 3, 16])
@pytest.mark.parametrize("shift", [1, 4])
def test_blocks_equal_frames(skewed, rows, shift):
    names = [f"target_rolling_mean_{rows}", f"target_rolling_std_{rows}"]
    blocks = add_history(skewed, ONE, "v", [], [rows], shift, frame_limit=0)
    frames = add_history(skewed, ONE_PLAIN, "v", [], [rows], shift, frame_limit=10_000)
    close(by_seq(blocks, *names), by_seq(frames, *names))


def test_trailing_deviation_survives_huge_values(spark):
    """A spike in the same bucket must not cost digits of later frames."""
    rows = [(1, i, 1e12 if i == 3 else 1.0 + (i % 2) * 1e-3) for i in range(200)]
    df = spark.createDataFrame(rows, "household_id BIGINT, seq BIGINT, v DOUBLE").withColumn("ts", F.col("seq"))
    last = add_history(df, PLAIN, "v", [], [20], frame_limit=0).orderBy("seq").collect()[-1]
    assert last["target_rolling_std_20"] == pytest.approx(1e-3 / 2 * (20 / 19) ** 0.5, rel=1e-9)


@pytest.mark.parametrize("key,plain", [(SLICED, PLAIN), (ONE, ONE_PLAIN)])
def test_interpolation(skewed, key, plain):
    for fill in (
        lambda k: cleaning.interpolate_by_time(skewed, k, "ts", ["v"]),
        lambda k: cleaning.interpolate_by_row(skewed, k, ["v"]),
        lambda k: cleaning.forward_fill(skewed, k, ["v"], 3),
    ):
        close(by_seq(fill(key), "v"), by_seq(fill(plain), "v"))


def test_interpolation_against_numpy(skewed):
    rows = skewed.orderBy("ts", "seq").collect()
    x = np.array([r["ts"].timestamp() for r in rows])
    known = np.array([r["v"] is not None for r in rows])
    filled = {r["seq"]: r["v"] for r in cleaning.interpolate_by_time(skewed, ONE, "ts", ["v"]).collect()}
    unique_known = {}
    for r, t in zip(rows, x):
        if r["v"] is not None:
            unique_known.setdefault(t, []).append(r["v"])
    single = {t for t, vs in unique_known.items() if len(vs) == 1}
    kx, kv = x[known], np.array([r["v"] for r in rows if r["v"] is not None])
    checked = 0
    for r, t in zip(rows, x):
        at = np.searchsorted(kx, t)
        if r["v"] is None and 0 < at < len(kx) and kx[at - 1] in single and kx[at] in single:
            assert filled[r["seq"]] == pytest.approx(np.interp(t, kx, kv), abs=1e-9)
            checked += 1
    assert checked > 50


@pytest.mark.parametrize("group", [[], ["household_id"]])
def test_narrowed_quantiles(skewed, group):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    fast = quantiles.grouped_quantiles(skewed, group, "v", probs)
    slow = quantiles.grouped_quantiles(skewed, group, "v", probs, exact_rows=0)
    order = lambda df: sorted((tuple(r[g] for g in group), r["rows"], r["q"]) for r in df.collect())
    for a, b in zip(order(fast), order(slow), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-12)


def test_narrowing_extreme_ranges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 4)
    numbers = [10.0**e for e in range(-300, 300, 7)] + [-(10.0**e) for e in range(-300, 300, 11)] + [0.0] * 50
    df = spark.createDataFrame([(v,) for v in numbers], "v DOUBLE")
    ranks = list(range(0, len(numbers), 9))
    found = quantiles.order_statistics(df, [], "v", {(): ranks})
    assert [found[((), r)].value for r in ranks] == [sorted(numbers)[r] for r in ranks]
    for r in ranks:
        value = sorted(numbers)[r]
        assert found[((), r)][1:] == (sum(n < value for n in numbers), numbers.count(value))


def test_value_ranks(skewed):
    known = skewed.where(F.col("v").isNotNull())
    whole = Window.orderBy("v")
    ties = Window.partitionBy("v")
    expected = known.select(
        F.col("v").alias("value"), (F.rank().over(whole) + (F.count("*").over(ties) - 1) / 2.0).alias("rank")
    ).distinct()
    for slices in (1, 5):
        found = quantiles.value_ranks(skewed, "v", slices).select("value", "rank")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_first_rows_and_split(skewed):
    everything = sorted((r["ts"], r["seq"]) for r in skewed.collect())
    for n in (1, 150, 899, 900, 2000):
        found = sorted((r["ts"], r["seq"]) for r in quantiles.first_rows(skewed, ["ts", "seq"], n).collect())
        assert found == everything[:n]
    train, test = learning.chronological_split(skewed, ["ts", "seq"])
    assert (train.count(), test.count()) == (720, 180)
    assert train.agg(F.max(F.struct("ts", "seq"))).first() < test.agg(F.min(F.struct("ts", "seq"))).first()


def test_sample_equals_smallest_hashes(spark, skewed):
    import hashlib

    rows = skewed.dropna().select("seq", "v").collect()
    sample = learning.stratified_sample(skewed.dropna().select("seq", "v"), "v", 200, ["seq"])
    edges = quantiles.column_quantiles(skewed, ["v"], [i / 10 for i in range(11)])["v"][1:-1]
    bins = {}
    for r in rows:
        bins.setdefault(sum(r["v"] > e for e in edges), []).append(r)
    wanted = set()
    for members in bins.values():
        members.sort(key=lambda r: hashlib.md5(str(r["seq"]).encode()).hexdigest())
        wanted |= {r["seq"] for r in members[: int(len(members) * (200 / len(rows)))]}
    assert {r["seq"] for r in sample.collect()} == wanted


def brute_force_crossed(points):
    return sum(
        p[2] * q[2] for p, q in itertools.combinations(points, 2) if (p[0] - q[0]) * (p[1] - q[1]) < 0
    )


def test_crossed_weight():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randrange(0, 40)
        points = [(rng.randrange(8), rng.randrange(8), rng.randrange(1, 5)) for _ in range(n)]
        x, y, w = (np.array(c) for c in zip(*points)) if points else (np.array([]),) * 3
        assert crossed_weight(x, y, w) == brute_force_crossed(points)
    huge = crossed_weight(np.array([1, 2]), np.array([2, 1]), np.array([2**40, 2**40]))
    assert huge == 2**80


@pytest.mark.parametrize("shape", ["even", "heavy"])
def test_striped_pair_counting(spark, shape, monkeypatch):
    monkeypatch.setattr(association.math, "isqrt", lambda n: 0)
    rng = random.Random(11)
    points = {}
    for _ in range(400):
        x = rng.randrange(60) if shape == "even" or rng.random() < 0.6 else 30
        y = rng.randrange(60) if shape == "even" or rng.random() < 0.7 else 10
        points[(x, y)] = points.get((x, y), 0) + rng.randrange(1, 4)
    rows = [(x, y, w) for (x, y), w in points.items()]
    df = spark.createDataFrame(rows, "x INT, y INT, w BIGINT")
    assert association.discordant_weight(df, stripe_rows=60) == brute_force_crossed(rows)


def test_kendall_small_and_large_paths_agree(spark, skewed):
    pairs = [("v", "seq"), ("v", "household_id")]
    one_task = [r["r"] for r in association.kendall_pairs(skewed, pairs).collect()]
    striped = [r["r"] for r in association.kendall_pairs(skewed, pairs, stripe_rows=150).collect()]
    assert one_task == pytest.approx(striped, abs=1e-12)
