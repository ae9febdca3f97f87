"""Forests on cells: splits as by hand, large nodes as small ones, Spark ML's quality, few jobs."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gridloom.operators import forests, learning


def table(spark, n=3000, noise=0.3, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.randrange(5), rng.gauss(0, 1)
        rows.append((i, a, float(b), c, math.sin(6 * a) + b * (c > 0) + rng.gauss(0, noise)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def by_hand(rows, depth, least, values):
    """(feature, threshold) of the best split and both sides, from all (features, weight, y), or the mean."""
    weight = sum(w for _, w, _ in rows)
    mean = sum(w * y for _, w, y in rows) / weight
    best = None
    for f in range(len(values)):
        for t in values[f]:
            left, right = [r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]
            wl, wr = sum(r[1] for r in left), sum(r[1] for r in right)
            if wl < least or wr < least:
                continue
            sl, sr = (sum(w * y for _, w, y in side) for side in (left, right))
            gain = sl * sl / wl + sr * sr / wr - mean * mean * weight
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, t, left, right
    if depth == 0 or best is None:
        return mean
    _, f, t, left, right = best
    return f, t, by_hand(left, depth - 1, least, values), by_hand(right, depth - 1, least, values)


def unfolded(tree, node=0):
    if tree.left[node] == node:
        return tree.value[node]
    child = tree.left[node]
    return int(tree.feature[node]), int(tree.cut[node]), unfolded(tree, child), unfolded(tree, child + 1)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b)


def test_tree_as_by_hand():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 6, (300, 3)).astype(np.uint8)
    weight, y = rng.integers(1, 4, 300).astype(float), rng.normal(size=300) + (bins[:, 1] > 2) * bins[:, 0]
    rules = forests.Rules(depth=4, least_rows=8, features_per_node=3, seed=1, least_gain=1e-9, widest=6)
    tree, gains = forests.grow_node(bins, weight, weight * y, 0, rules, 0, 0)
    rows = list(zip(bins.tolist(), weight.tolist(), y.tolist()))
    assert same(unfolded(tree), by_hand(rows, 4, 8, [range(6)] * 3))
    assert gains.argmax() in (0, 1) and (gains >= 0).all()
    again = forests.Tree.from_bytes(tree.to_bytes())
    assert np.array_equal(again.leaves(bins), tree.leaves(bins))


def test_draws_are_poisson_and_repeatable():
    keys = forests._mix(np.arange(400_000, dtype=np.uint64))
    draws = forests.Draws(0.8, 42)
    drawn = draws.of(keys, 3)
    assert np.array_equal(drawn[1000:2000], forests.Draws(0.8, 42).of(keys[1000:2000], 3))
    for k in range(5):
        share = math.exp(-0.8) * 0.8**k / math.factorial(k)
        assert abs((drawn == k).mean() - share) < 5 * math.sqrt(share / len(keys))
    assert abs(np.corrcoef(drawn, draws.of(keys, 4))[0, 1]) < 0.01


def fitted(df, **options):
    return forests.ForestRegressor("features", "y", "y_hat", **({"trees": 6, "depth": 6, "least_rows": 3} | options)).fit(df)


def test_large_nodes_as_small_ones(spark, monkeypatch):
    """Upper levels from histograms of all tasks, some trees at a time: the same forest."""
    df = table(spark)
    plain = fitted(df)
    for name, value in (("NODE_CELLS", 60), ("PIECE_ROWS", 500), ("SENT_CELLS", 8000)):
        monkeypatch.setattr(forests, name, value)
    parted = fitted(df)
    assert parted.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray())
    assert all(same(unfolded(a), unfolded(b)) for a, b in zip(plain.trees, parted.trees))
    assert len(parted.trees) == 6


def test_features_by_node_in_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(forests, "NODE_CELLS", 200)
    model = fitted(table(spark), features_per_node="sqrt", row_share=0.8)
    firsts = {int(t.feature[0]) for t in model.trees}
    assert len(firsts) > 1
    assert model.featureImportances.toArray().sum() == pytest.approx(1)


def test_predictions_follow_the_trees_and_match_spark_ml(spark):
    df = table(spark, 6000)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    model = fitted(train, trees=30, depth=10, least_rows=5)
    rows = model.transform(test).select("a", "b", "c", "y", "y_hat").collect()
    values = [np.array([r[c] for r in rows]) for c in "abc"]
    assert np.array([r["y_hat"] for r in rows]) == pytest.approx(model.predict(values))
    other = RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="y_hat", numTrees=30, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="all", seed=1)
    error = F.sqrt(F.avg((F.col("y") - F.col("y_hat")) * (F.col("y") - F.col("y_hat"))))
    theirs = other.fit(train)
    ours, reference = (m.transform(test).agg(error).first()[0] for m in (model, theirs))
    assert ours < 1.03 * reference
    assert model.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.05)


def test_predictions_keep_columns(spark):
    """Vectors, times, nulls and odd names pass; an older prediction is replaced; no rows give no rows."""
    df = table(spark, 300).withColumns({"odd.name": F.lit(None).cast("string"), "at": F.timestamp_seconds("id"), "y_hat": F.lit("old")})
    model = fitted(df)
    scored = model.transform(df)
    assert dict(scored.dtypes) == dict(df.dtypes) | {"y_hat": "double"}
    kept = [c for c in df.columns if c != "y_hat"]
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    assert sorted(map(str, scored.select(quoted).collect())) == sorted(map(str, df.select(quoted).collect()))
    assert model.transform(df.limit(0)).collect() == []
    assert "ArrowEvalPython" not in scored._jdf.queryExecution().toString()


def test_few_jobs_however_deep_and_many(spark):
    """Spark ML's forest runs a job a level, and several where a level of all trees is too wide."""
    df = table(spark, 2000).cache()
    jobs = []
    for trees, depth in ((2, 2), (40, 12)):
        group = f"forest-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        learning.forest_model("y", trees, depth).fit(df)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    assert abs(jobs[1] - jobs[0]) <= 3 and max(jobs) < 30


def test_repeated_rows_weigh_more(spark):
    """A cell that fills several tasks is one cell."""
    df = spark.createDataFrame([(1.0, 5.0)] * 900 + [(2.0, 1.0)] * 100, "x double, y double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = fitted(df, trees=20)
    assert model.predict([np.array([0.0, 1.0, 2.0, 9.0])]) == pytest.approx([5, 5, 1, 1])


def test_constant_target_and_missing_labels(spark):
    df = table(spark, 200)
    model = fitted(df.withColumn("y", F.lit(0.1)))
    assert all(len(t.left) == 1 for t in model.trees) and model.featureImportances.toArray().sum() == 0
    assert model.predict([np.zeros(1)] * 3) == pytest.approx([0.1])
    for bad in (None, math.nan, math.inf):
        with pytest.raises(ValueError, match="labels"):
            fitted(df.withColumn("y", F.when(F.col("id") == 3, F.lit(bad)).otherwise(F.col("y"))))
    with pytest.raises(ValueError, match="rows"):
        fitted(df.limit(0))


def test_selection_forest_in_few_jobs(spark):
    """Every feature may split a node, so each tree's first split is the same where one feature explains all."""
    df = spark.createDataFrame([(float(i % 40), float(i % 7), float(i % 40 > 19)) for i in range(2000)], "a double, b double, y double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
    spark.sparkContext.setJobGroup("selection", "selection")
    model = learning.selection_forest("y", 40, 12).fit(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("selection"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    assert jobs < 30
    assert {int(t.feature[0]) for t in model.trees} == {0} and model.featureImportances.toArray() == pytest.approx([1, 0])
