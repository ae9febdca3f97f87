"""Normality on ranks: edges, and the approximations it rests on."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from gridloom.functions.numeric import normal_score, normal_share
from gridloom.operators import statistics


def test_scores_and_shares(spark):
    p = [1e-9, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.8, 0.99, 0.9999]
    for r in spark.createDataFrame([(v,) for v in p], "p DOUBLE").select("p", normal_score(F.col("p")).alias("z")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-8, abs=1e-8)
    z = [-5.0, -1.3, 0.0, 0.4, 2.5]
    for r in spark.createDataFrame([(v,) for v in z], "z DOUBLE").select("z", normal_share(F.col("z")).alias("s")).collect():
        assert r["s"] == pytest.approx(NormalDist().cdf(r["z"]), abs=2e-7)


def test_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(float(i % 7), 0.1, float(i), nan, None) for i in range(30)] + [(nan, 0.1, inf, nan, None)]
    df = spark.createDataFrame(rows, "a DOUBLE, same DOUBLE, endless DOUBLE, missing DOUBLE, none DOUBLE")
    found = {r["feature"]: r for r in statistics.rank_normality(df, df.columns).collect()}
    assert {c: r["n"] for c, r in found.items()} == {"a": 30, "same": 31, "endless": 31, "missing": 0, "none": 0}
    assert 0 < found["a"]["shapiro_francia"] <= 1 and 0 < found["a"]["largest_gap"] < 1
    assert all(found[c]["shapiro_francia"] is None and found[c]["largest_gap"] is None for c in found if c != "a")
    assert statistics.rank_normality(spark.createDataFrame([(1.0,)], "a DOUBLE"), ["a"]).first()["largest_gap"] is None
