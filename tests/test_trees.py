"""Binned trees: a plain grower on small rows, patience, pruning, draws and edges."""

import math
import random

import pytest

from gridloom.operators import learning, trees
from gridloom.operators.trees import Growth, Nodes
from gridloom.plans.training import train_and_evaluate


def plain_tree(rows, rules, columns):
    """(feature, cut, gain, value, n) of each node in pre-order, from (bins, g, h)."""

    def kept(g):
        return math.copysign(max(abs(g) - rules.l1, 0.0), g)

    def score(part):
        h = sum(r[2] for r in part) + rules.l2
        return kept(sum(r[1] for r in part)) ** 2 / h if h else 0.0

    def one(part, depth):
        h = sum(r[2] for r in part) + rules.l2
        value = -kept(sum(r[1] for r in part)) / h if h else 0.0
        best = None
        for f in columns if depth < rules.depth and len(part) >= rules.split_rows else ():
            for cut in sorted({r[0][f] for r in part}):
                sides = [r for r in part if r[0][f] <= cut], [r for r in part if r[0][f] > cut]
                weights = [sum(r[2] for r in side) for side in sides]
                if min(map(len, sides)) < max(1, rules.leaf_rows) or min(weights) < rules.leaf_weight:
                    continue
                gain = score(sides[0]) + score(sides[1]) - score(part)
                if gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, cut, sides
        if best is None:
            return [(-1, -1, 0.0, value, len(part))]
        below = one(best[3][0], depth + 1), one(best[3][1], depth + 1)
        if len(below[0]) == len(below[1]) == 1 and best[0] < rules.least_gain:
            return [(-1, -1, 0.0, value, len(part))]
        return [(best[1], best[2], best[0], value, len(part)), *below[0], *below[1]]

    return one(rows, 0)


def listed(nodes, node):
    here = (nodes.feature[node], nodes.cut[node], nodes.gain[node], nodes.value[node], nodes.rows[node])
    child = nodes.left[node]
    return [here, *listed(nodes, child), *listed(nodes, child + 1)] if child >= 0 else [here]


@pytest.mark.parametrize(
    "rules, columns",
    [
        (Growth(depth=4), [0, 1, 2]),
        (Growth(depth=3, l1=3.0, l2=1.0, leaf_weight=6.0, least_gain=40.0), [0, 2]),
        (Growth(depth=3, split_rows=40, leaf_rows=11), [0, 1, 2]),
        (Growth(depth=0), [0]),
    ],
)
def test_equals_plain_grower(spark, rules, columns):
    draw = random.Random(5)
    # The second feature repeats the first, so their gains tie; one bin holds a third of the rows.
    rows = []
    for i in range(240):
        a = 1 if i % 3 == 0 else draw.randrange(0, 7)
        bins = [a, a, draw.randrange(0, 4)]
        rows.append((bins, i % 2, draw.gauss(a - 3 * (bins[2] == 2), 1.5), float(draw.choice([1, 1, 2]))))
    df = spark.createDataFrame(rows, "bins ARRAY<INT>, root INT, g DOUBLE, h DOUBLE")
    nodes = trees.grow(df, 3, rules, columns)
    for root in (0, 1):
        wanted = plain_tree([(b, g, h) for b, r, g, h in rows if r == root], rules, columns)
        found = listed(nodes, root)
        assert [(*f[:2], f[4]) for f in found] == [(*w[:2], w[4]) for w in wanted]
        assert [f[2:4] for f in found] == [pytest.approx(w[2:4], rel=1e-9, abs=1e-9) for w in wanted]
    assert listed(nodes, 2) == [(-1, -1, 0.0, 0.0, 0)]


def test_prune_goes_upwards():
    nodes = Nodes()
    for _ in range(5):
        nodes.add(1.0, 1)
    nodes.left[0], nodes.gain[0], nodes.left[1], nodes.gain[1] = 1, 0.5, 3, 2.0
    nodes.prune(1.0)
    assert nodes.left[:2] == [1, 3]  # a poor split stays above a good one
    nodes.prune(3.0)
    assert nodes.left == [-1] * 5


def curve(spark, turned):
    """Training follows x; the held-out part follows it too, or the other way round."""
    rows = [(i, float(i % 10), float(i % 10), False) for i in range(200)]
    rows += [(i, float(i % 10), 9.0 - i % 10 if turned else float(i % 10), True) for i in range(200, 260)]
    return spark.createDataFrame(rows, "id LONG, x DOUBLE, target DOUBLE, is_validation BOOLEAN")


def test_patience_keeps_the_best_round(spark):
    rules = Growth(depth=2, l2=1.0)
    found = trees.fit_boosted(curve(spark, True), ["x"], "target", ["id"], rounds=12, patience=3, rules=rules)
    assert len(found.history) == 4 and len(found.nodes.roots) == 1
    assert found.history == sorted(found.history)
    # More rounds than wait beside the rows, so that sums are written in between.
    longer = trees.fit_boosted(curve(spark, False), ["x"], "target", ["id"], rounds=10, patience=3, rules=rules, row_share=1.0)
    assert len(longer.nodes.roots) == len(longer.history) == 10
    assert longer.history == sorted(longer.history, reverse=True)
    scored = longer.transform(curve(spark, False).where("is_validation")).collect()
    error = math.sqrt(sum((r["target"] - r["y_hat"]) ** 2 for r in scored) / len(scored))
    assert error == pytest.approx(longer.history[-1], rel=1e-9)


def test_forest_draws_are_repeatable_and_do_not_depend_on_the_batch(spark, monkeypatch):
    df = curve(spark, False).selectExpr("id", "x", "target", "x % 3 as z")
    rules = Growth(depth=2, split_rows=15, leaf_rows=10)
    together = trees.fit_forest(df, ["x", "z"], "target", ["id"], trees=3, rules=rules)
    monkeypatch.setattr(trees, "WIDEST_LEVEL", 1)
    one_by_one = trees.fit_forest(df.repartition(7), ["x", "z"], "target", ["id"], trees=3, rules=rules)
    assert [sorted(listed(together.nodes, r)) for r in together.nodes.roots] == [
        [pytest.approx(n) for n in sorted(listed(one_by_one.nodes, r))] for r in one_by_one.nodes.roots
    ]
    # A tree sees the rows drawn at least once: 1 - exp(-0.8) of them.
    assert all(0.4 < together.nodes.rows[r] / 260 < 0.7 for r in together.nodes.roots)
    assert len({together.nodes.rows[r] for r in together.nodes.roots}) > 1
    assert sum(together.weights()) == pytest.approx(1.0)
    shares = learning.importances(df, {"forest": together}, ["x", "z"]).collect()
    assert [r["feature"] for r in shares] == ["x", "z"] and shares[0]["importance_pct"] > 90


def test_features_per_node(spark):
    # Only x splits; nodes must find it although one feature is drawn, since constants cannot split.
    df = curve(spark, False).selectExpr("id", "x", "target", "1.0D as c", "cast(null as double) as none")
    rules = Growth(depth=2, features_per_node=1)
    model = trees.fit_forest(df, ["c", "none", "x"], "target", ["id"], trees=2, row_share=None, rules=rules)
    assert model.weights() == [0.0, 0.0, 1.0]


def test_edges(spark):
    schema = "id LONG, bins DOUBLE, node DOUBLE, y DOUBLE, y_hat STRING"
    nan = math.nan
    rows = [(i, nan if i % 2 else None, float(i % 4), 5.0 if i % 4 == 1 else 1.0, "old") for i in range(40)]
    rows += [(50 + i, 1.0, 1.0, 9.0, None) for i in range(40)] + [(99, 1.0, 1.0, nan, None), (100, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, schema)
    model = trees.fit_boosted(df, ["bins", "node"], "y", ["id"], None, rounds=1, step=1.0, row_share=1.0, column_share=1.0, rules=Growth(depth=3))
    assert model.nodes.rows[0] == 80  # rows without a target do not train
    assert model.nodes.feature[0] == 0 and model.splits(df).orderBy("node").first()["threshold"] is None
    scored = model.transform(df)
    assert scored.columns == df.columns
    assert all(r["y_hat"] == pytest.approx(r["y"]) for r in scored.where("y is not null and not isnan(y)").collect())
    for nothing in (df.limit(0), df.where("id >= 99")):
        for empty in (
            trees.fit_boosted(nothing, ["bins"], "y", ["id"], None, rounds=2),
            trees.fit_forest(nothing, ["bins"], "y", ["id"], trees=2),
        ):
            assert empty.transform(df).first()["y_hat"] is None and empty.weights() == [0.0]
    constant = trees.fit_forest(df.selectExpr("id", "node", "7D as y"), ["node"], "y", ["id"], trees=1)
    assert {r["y_hat"] for r in constant.transform(df).collect()} == {7.0}


def test_training_run_with_own_trees(spark):
    # The target is a step in x that a line cannot follow; z is noise.
    rows = [(i, float(i * 37 % 20), float(i * 11 % 7), 10.0 if i * 37 % 20 in (3, 4, 5, 11) else 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, "id LONG, x DOUBLE, z DOUBLE, y DOUBLE")
    run = train_and_evaluate(df, ["x", "z"], "y", ["id"], trees=4, rounds=4, own_trees=True)
    errors = {r["model_name"]: r["rmse"] for r in run.scores.collect()}
    assert errors.keys() == {"Linear Regression", "Random Forest", "Gradient Boosting"}
    assert max(errors["Random Forest"], errors["Gradient Boosting"]) < 0.8 * errors["Linear Regression"]
    shares = {(r["model_name"], r["feature"]): r["importance_pct"] for r in run.importances.collect()}
    assert shares["Random Forest", "x"] > shares["Random Forest", "z"]
    assert run.predictions.where("y_hat is null").count() == 0
