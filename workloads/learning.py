"""Samples, splits and models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridloom.functions.calendar import add_calendar
from gridloom.operators import evaluation, learning, trees
from gridloom.operators.series import drop_halo, lags, with_look_back
from gridloom.plans.training import train_and_evaluate
from gridloom.session import settle
from workloads.base import BY_USER, READINGS, query, readings, table

ORDER = ["ts", "event_id"]

SAMPLE_SQL = """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])))[2:-2] AS edges,
  count(*) AS total FROM events),
b AS (SELECT event_id, value, total, len(list_filter(edges, lambda q: q < value)) AS bin FROM events, e),
r AS (SELECT *, count(*) OVER (PARTITION BY bin) AS size,
  row_number() OVER (PARTITION BY bin ORDER BY md5(event_id::VARCHAR)) AS place FROM b)
SELECT event_id, value FROM r WHERE place <= floor(size * (300::DOUBLE / total))"""


@query("ml1_stratified_sample", SAMPLE_SQL)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return learning.stratified_sample(events, "value", 300, ["event_id"])


SPLIT_SQL = """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) > floor(count(*) OVER () * 0.8::DOUBLE) AS is_test FROM events"""


@query("ml2_chronological_split", SPLIT_SQL)
def _(spark, sf):
    train, test = learning.chronological_split(table(spark, sf, "events").select(*ORDER), ORDER)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))).select(
        "event_id", "is_test"
    )


@query(
    "ml3_standard_scores",
    f"""WITH s AS ({SPLIT_SQL}), j AS (SELECT event_id, value, is_test FROM events JOIN s USING (event_id)),
m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM j WHERE NOT is_test)
SELECT event_id, (value - m) / s AS value_z FROM j, m""",
    value_z=6,
)
def _(spark, sf):
    events = table(spark, sf, "events").select(*ORDER, "value")
    train, _ = learning.chronological_split(events, ORDER)
    return learning.standard_scores(events, train, ["value"]).select("event_id", "value_z")


@query(
    "ml4_linear_one_feature",
    "SELECT regr_slope(l_extendedprice, l_extendedprice * (1 - l_discount)) AS slope, "
    "regr_intercept(l_extendedprice, l_extendedprice * (1 - l_discount)) AS intercept FROM lineitem",
    slope=8, intercept=3,
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("x", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(lines)
    model = learning.linear_model("l_extendedprice").fit(vectors)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope DOUBLE, intercept DOUBLE")


@query(
    "ml10_validation_flag",
    f"""WITH t AS (SELECT event_id, ts FROM events JOIN ({SPLIT_SQL}) USING (event_id) WHERE NOT is_test)
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - floor(count(*) OVER () * 0.1::DOUBLE) AS is_validation FROM t""",
)
def _(spark, sf):
    train, _ = learning.chronological_split(table(spark, sf, "events").select(*ORDER), ORDER)
    return learning.flag_validation(train, ORDER).select("event_id", "is_validation")


FEATURES = ["hour", "dayofweek", "hour_sin", "hour_cos", "lag_1", "lag_2"]


def _training_table(spark, sf):
    """Readings of all households with calendar and lag columns."""
    log = readings(spark, sf)
    seen = drop_halo(lags(with_look_back(log, BY_USER, 2), BY_USER, "value", {"lag_1": 1, "lag_2": 2}))
    return settle(add_calendar(seen.select("event_id", "ts", "value", "lag_1", "lag_2"), "ts").dropna())


def _fitted(spark, sf, model):
    data = _training_table(spark, sf)
    train, test = learning.chronological_split(data, ORDER)
    train = learning.flag_validation(train, ORDER)
    return data, test, learning.fit(train, FEATURES, model)


TEST_SQL = f"""(SELECT event_id, value, lag_1, is_test FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) > floor(count(*) OVER () * 0.8::DOUBLE) AS is_test
  FROM (SELECT * FROM (SELECT event_id, ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2
    FROM {READINGS} WINDOW w AS (PARTITION BY household_id ORDER BY ts, event_id)) WHERE lag_2 IS NOT NULL AND value IS NOT NULL)))"""


def _agreement(scored):
    """Metrics of ``evaluate`` beside the same ones from plain sums over the scored rows, per model."""
    scored = settle(scored)  # read three times
    y, e = F.col("y"), F.col("y") - F.col("y_hat")
    mean = scored.agg(F.avg("y")).first()[0]
    rows = F.count(F.lit(1))
    plain = scored.groupBy("model_name").agg(
        rows.alias("n"),
        (1 - F.sum(e * e) / F.sum((y - F.lit(mean)) * (y - F.lit(mean)))).alias("r2"),
        F.sqrt(F.sum(e * e) / rows).alias("rmse"),
        (F.sum(F.abs(e)) / rows).alias("mae"),
    )
    both = plain.unionByName(evaluation.evaluate(scored).select(*plain.columns)).groupBy("model_name")
    same = [F.max(m) - F.min(m) < 1e-6 * (1 + F.max(F.abs(m))) for m in ("r2", "rmse", "mae")]
    return both.agg(F.max("n").alias("rows"), (same[0] & same[1] & same[2]).alias("metrics_agree"))


def _checked(name: str) -> str:
    return f"SELECT '{name}' AS model_name, count(*) AS rows, true AS metrics_agree FROM {TEST_SQL} WHERE is_test"


@query("ml5_random_forest", _checked("Random Forest"))
def _(spark, sf):
    _, test, model = _fitted(spark, sf, learning.forest_model("value"))
    return _agreement(learning.score({"Random Forest": model}, test, "value", ["event_id"]))


@query("ml6_gradient_boosting", _checked("Gradient Boosting"))
def _(spark, sf):
    _, test, model = _fitted(spark, sf, learning.boosted_model("value"))
    return _agreement(learning.score({"Gradient Boosting": model}, test, "value", ["event_id"]))


TREE_FEATURES = ["lag_1", "lag_2", "hour"]
TREE_BINS = 16
# Depth 3 keeps the SQL short; all other rules are those of the defaults.
SHALLOW_BOOSTED = replace(trees.BOOSTED, depth=3)
SHALLOW_FOREST = replace(trees.FOREST, depth=3)
SHALLOW_SELECTION = replace(trees.SELECTION, depth=3)


def _tree_ctes(turn: int, rules: trees.Growth) -> str:
    """The tree of a round from the gradients ``grad{turn}``: nodes of all rows by level, and facts of all nodes.

    Neither tree loses a split to pruning on the given tables, so the SQL leaves it out.
    """

    def kept(g):
        return f"greatest(abs({g}) - {rules.l1!r}::DOUBLE, 0::DOUBLE)"

    def score(g, h):
        return f"({kept(g)} * {kept(g)} / ({h} + {rules.l2!r}::DOUBLE))"

    parts = [f"at{turn}_0 AS (SELECT event_id, 0 AS node FROM r)"]
    for level in range(rules.depth + 1):
        at, facts, best = f"at{turn}_{level}", f"facts{turn}_{level}", f"best{turn}_{level}"
        parts.append(
            f"""{facts} AS (SELECT node, -sign(sum(g)) * {kept("sum(g)")} / (count(*) + {rules.l2!r}::DOUBLE) AS value, count(*) AS n_rows
  FROM grad{turn} JOIN {at} USING (event_id) WHERE NOT is_test GROUP BY node)"""
        )
        if level == rules.depth:
            break
        parts.append(
            f"""cells{turn}_{level} AS (SELECT node, f, bin, sum(g) AS g, count(*) AS n FROM grad{turn} JOIN {at} USING (event_id) JOIN b USING (event_id)
  WHERE NOT is_test GROUP BY ALL),
sums{turn}_{level} AS (SELECT *, sum(g) OVER whole AS ga, sum(n) OVER whole AS na, sum(g) OVER up_to AS gl, sum(n) OVER up_to AS nl FROM cells{turn}_{level}
  WINDOW whole AS (PARTITION BY node, f), up_to AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)),
gains{turn}_{level} AS (SELECT *, {score("gl", "nl")} + {score("(ga - gl)", "(na - nl)")} - {score("ga", "na")} AS gain FROM sums{turn}_{level}
  WHERE nl < na AND na >= {rules.split_rows} AND least(nl, na - nl) >= {max(rules.leaf_rows, rules.leaf_weight)}),
{best} AS (SELECT node, f, bin AS cut, gain FROM gains{turn}_{level} WHERE gain > 1e-6::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain::FLOAT DESC, f, bin) = 1),
at{turn}_{level + 1} AS (SELECT b.event_id, 2 * node + 1 + (b.bin > cut)::INT AS node FROM {at} JOIN {best} USING (node) JOIN b USING (event_id, f))"""
        )
    each = range(rules.depth)
    parts.append(f"splits{turn} AS ({' UNION ALL '.join(f'SELECT * FROM best{turn}_{level}' for level in each)})")
    parts.append(f"facts{turn} AS ({' UNION ALL '.join(f'SELECT * FROM facts{turn}_{level}' for level in (*each, rules.depth))})")
    parts.append(
        f"""leaves{turn} AS (SELECT event_id, value FROM ({' UNION ALL '.join(f'SELECT * FROM at{turn}_{level}' for level in (*each, rules.depth))})
  JOIN facts{turn} USING (node) WHERE node NOT IN (SELECT node FROM splits{turn}))"""
    )
    return ",\n".join(parts)


TREE_ROWS_SQL = f"""WITH r AS (SELECT event_id, value AS y, lag_1, lag_2, hour(ts)::DOUBLE AS hour,
  row_number() OVER (ORDER BY ts, event_id) > floor(count(*) OVER () * 0.8::DOUBLE) AS is_test
  FROM (SELECT event_id, ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2
    FROM {READINGS} WINDOW w AS (PARTITION BY household_id ORDER BY ts, event_id)) WHERE lag_2 IS NOT NULL AND value IS NOT NULL),
m AS (SELECT avg(y) AS base FROM r WHERE NOT is_test),
tall AS ({" UNION ALL ".join(f"SELECT event_id, is_test, {i} AS f, {c} AS x FROM r" for i, c in enumerate(TREE_FEATURES))}),
e AS (SELECT f, list_sort(list_distinct(list_transform(quantile_cont(x, {[i / TREE_BINS for i in range(TREE_BINS + 1)]}),
  lambda q: format('{{:.12g}}', q)::DOUBLE)))[1:-2] AS edges FROM tall WHERE NOT is_test GROUP BY f),
b AS (SELECT event_id, f, 1 + len(list_filter(edges, lambda edge: edge < x)) AS bin FROM tall JOIN e USING (f)),
grad1 AS (SELECT event_id, is_test, base - y AS g FROM r, m)"""


def _splits_sql(rules: trees.Growth, step: float) -> str:
    names = f"{TREE_FEATURES}[f + 1]"
    return f"""{TREE_ROWS_SQL},
{_tree_ctes(1, rules)}
SELECT 0::BIGINT AS tree, node::BIGINT AS node, {names} AS feature, edges[cut] AS threshold, gain, value * {step!r}::DOUBLE AS value, n_rows
FROM facts1 LEFT JOIN splits1 USING (node) LEFT JOIN e USING (f)"""


def _tree_split(spark, sf):
    return learning.chronological_split(_training_table(spark, sf), ORDER)


@query("ml6_penalised_tree", _splits_sql(SHALLOW_BOOSTED, 0.1), threshold=6, gain=3, value=6)
def _(spark, sf):
    train, _ = _tree_split(spark, sf)
    whole = {"row_share": 1.0, "column_share": 1.0, "rules": SHALLOW_BOOSTED, "bins": TREE_BINS}
    return trees.fit_boosted(train, TREE_FEATURES, "value", ORDER, None, rounds=1, **whole).splits(train)


@query(
    "ml6_penalised_boosting",
    f"""{TREE_ROWS_SQL},
{_tree_ctes(1, SHALLOW_BOOSTED)},
grad2 AS (SELECT event_id, is_test, g + 0.1::DOUBLE * value AS g FROM grad1 JOIN leaves1 USING (event_id)),
{_tree_ctes(2, SHALLOW_BOOSTED)}
SELECT event_id, y, base + 0.1::DOUBLE * (leaves1.value + leaves2.value) AS y_hat
FROM r JOIN leaves1 USING (event_id) JOIN leaves2 USING (event_id), m WHERE is_test""",
    y_hat=6,
)
def _(spark, sf):
    train, test = _tree_split(spark, sf)
    whole = {"row_share": 1.0, "column_share": 1.0, "rules": SHALLOW_BOOSTED, "bins": TREE_BINS}
    model = trees.fit_boosted(train, TREE_FEATURES, "value", ORDER, None, rounds=2, **whole)
    return learning.score({"Gradient Boosting": model}, test, "value", ["event_id"]).select("event_id", "y", "y_hat")


def _whole_tree(train, rules=SHALLOW_FOREST):
    return trees.fit_forest(train, TREE_FEATURES, "value", ORDER, trees=1, row_share=None, rules=rules, bins=TREE_BINS)


@query("ml5_forest_tree", _splits_sql(SHALLOW_FOREST, 1.0), threshold=6, gain=3, value=6)
def _(spark, sf):
    train, _ = _tree_split(spark, sf)
    return _whole_tree(train).splits(train)


@query("ml8_selection_tree", _splits_sql(SHALLOW_SELECTION, 1.0), threshold=6, gain=3, value=6)
def _(spark, sf):
    train, _ = _tree_split(spark, sf)
    return _whole_tree(train, SHALLOW_SELECTION).splits(train)


@query(
    "ml7_gain_shares",
    f"""{TREE_ROWS_SQL},
{_tree_ctes(1, SHALLOW_FOREST)}
SELECT 'Random Forest' AS model_name, {TREE_FEATURES}[e.f + 1] AS feature, 100 * coalesce(sum(gain), 0) / (SELECT sum(gain) FROM splits1) AS importance_pct
FROM e LEFT JOIN splits1 USING (f) GROUP BY e.f""",
    importance_pct=6,
)
def _(spark, sf):
    train, _ = _tree_split(spark, sf)
    found = learning.importances(train, {"Random Forest": _whole_tree(train)}, TREE_FEATURES)
    return found.select("model_name", "feature", "importance_pct")


WEIGHTS_SQL = "SELECT 'Random Forest' AS model_name, count(*) * 0 + 6 AS features, 100.0::DOUBLE AS total_pct FROM events"


def _weights(weights):
    """All features are there and their shares make a hundred."""
    return weights.groupBy("model_name").agg(F.count("feature").alias("features"), F.sum("importance_pct").alias("total_pct"))


@query("ml7_importances", WEIGHTS_SQL, total_pct=6)
def _(spark, sf):
    data, _, model = _fitted(spark, sf, learning.forest_model("value"))
    return _weights(learning.importances(data, {"Random Forest": model}, FEATURES))


@query("ml8_selection_forest", WEIGHTS_SQL, total_pct=6)
def _(spark, sf):
    data, _, model = _fitted(spark, sf, learning.selection_forest("value"))
    return _weights(learning.importances(data, {"Random Forest": model}, FEATURES))


@query(
    "ml9_score_linear",
    f"""SELECT event_id, value AS y, (SELECT regr_intercept(value, lag_1) FROM {TEST_SQL} WHERE NOT is_test)
  + (SELECT regr_slope(value, lag_1) FROM {TEST_SQL} WHERE NOT is_test) * lag_1 AS y_hat FROM {TEST_SQL} WHERE is_test""",
    y_hat=5,
)
def _(spark, sf):
    train, test = learning.chronological_split(_training_table(spark, sf), ORDER)
    model = learning.fit(train, ["lag_1"], learning.linear_model("value"))
    return learning.score({"Linear Regression": model}, test, "value", ["event_id"]).select("event_id", "y", "y_hat")


@query("ml9_score_models", " UNION ALL ".join(_checked(m) for m in ("Linear Regression", "Random Forest", "Gradient Boosting")))
def _(spark, sf):
    run = train_and_evaluate(_training_table(spark, sf), FEATURES, "value", ORDER)
    return _agreement(run.predictions)


@query(
    "ev10_training_report",
    f"""WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE is_test)::DOUBLE AS test FROM {TEST_SQL})
SELECT 'dataset' AS section, 'total_samples' AS name, n AS value FROM n UNION ALL SELECT 'dataset', 'test_samples', test FROM n
UNION ALL SELECT 'dataset', 'train_samples', n - test FROM n UNION ALL SELECT 'dataset', 'n_features', 6.0::DOUBLE FROM n""",
)
def _(spark, sf):
    run = train_and_evaluate(_training_table(spark, sf), FEATURES, "value", ORDER)
    return run.report.where("section = 'dataset'")
