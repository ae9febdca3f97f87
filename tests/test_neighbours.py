"""Nearest-neighbour mutual information against all pairs."""

import math

import numpy as np
import pytest

from gridloom.operators import neighbours


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def by_all_pairs(x, y, k):
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    reach = np.sort(joint, axis=1)[:, k - 1]
    near = (reach * neighbours.INSIDE)[:, None]
    nx, ny = (((v >= v[:, None] - near) & (v <= v[:, None] + near)).sum(axis=1) for v in (x, y))
    copies = (np.maximum(dx, dy) == 0).sum(axis=1)
    total = sum(psi(c if r == 0 else k) - psi(a) - psi(b) for c, r, a, b in zip(copies, reach, nx, ny))
    return max(0.0, total / len(x) + psi(len(x)))


def cases():
    rng = np.random.default_rng(5)
    n = 1500
    x = rng.normal(size=n)
    features = {
        "line": x,
        "independent": rng.normal(size=n),
        "frequent": np.where(rng.random(n) < 0.4, 0.0, x),
        "whole": rng.integers(0, 6, n).astype(float),
        "heavy_tail": np.exp(3 * x),
        "constant": np.ones(n),
    }
    noisy = x + 0.3 * rng.normal(size=n)
    return features, {"noisy": noisy, "tied": np.floor(4 * noisy), "tailed": np.exp(2 * noisy)}


@pytest.mark.parametrize("target", ["noisy", "tied", "tailed"])
def test_equals_all_pairs_with_narrow_stripes(spark, monkeypatch, target):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 50)
    features, targets = cases()
    columns = [*features.values(), targets[target]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns)], [*features, target])
    found = neighbours.neighbour_information(df, list(features), target, stripe_points=64).collect()
    assert len(found) == len(features)
    for row in found:
        expected = by_all_pairs(features[row["feature"]], targets[target], 5)
        assert row["mi_score"] == pytest.approx(expected, abs=1e-9), row["feature"]


def test_missing_infinite_and_few_rows(spark):
    rows = [(float(i), float(i * i % 17)) for i in range(40)]
    extra = [(None, 1.0), (math.nan, 2.0), (3.0, math.inf)]
    schema = "a DOUBLE, b DOUBLE"
    clean = neighbours.neighbour_information(spark.createDataFrame(rows, schema), ["a"], "b").first()
    mixed = neighbours.neighbour_information(spark.createDataFrame(rows + extra, schema), ["a"], "b").first()
    assert clean["mi_score"] == pytest.approx(mixed["mi_score"], abs=1e-12)
    few = neighbours.neighbour_information(spark.createDataFrame(rows[:5], schema), ["a"], "b").first()
    assert few["feature"] == "a" and few["mi_score"] is None
    assert neighbours.neighbour_information(spark.createDataFrame([], schema), ["a"], "b").first()["mi_score"] is None


def test_digamma(spark):
    for row in spark.range(1, 30).select("id", neighbours.digamma(neighbours.F.col("id")).alias("d")).collect():
        assert row["d"] == pytest.approx(psi(row["id"]), abs=1e-9)
