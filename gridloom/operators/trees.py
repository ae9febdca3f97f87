"""Regression trees on binned features: boosting with penalties and patience, forests with node rules.

Rows are binned once. Each level of all trees in work is one map-side combined aggregate of gradient
and weight by (node, feature, bin), whose cells Spark turns into the best split of each node. Only
splits reach the driver, at most one for each open node; rows never do. Trees travel as literal arrays, and
rows find their node by walking them, so no pass rewrites the rows.

A missing feature (NULL or NaN) ranks below all values. Rows whose target is missing do not train.
Gains that agree as 32-bit floats are ties: the earlier feature wins, then the smaller threshold.
Row samples follow a hash of the identity columns, so a lost task draws the same rows again.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.numeric import nan_to_null
from gridloom.operators.quantiles import column_quantiles
from gridloom.session import settle

SEED = 42
BINS = 128
#: Gains at or below this are no gain.
LEAST_STEP = 1e-6
#: Trees grown at once have at most so many nodes on their last level.
WIDEST_LEVEL = 2**15
#: Boosted trees that may wait before their sum is written beside the rows.
MOST_PENDING = 8
HELD_BINS = "_bins_of_row"


@dataclass(frozen=True)
class Growth:
    """Rules of one tree. ``least_gain`` prunes upwards from the leaves once the tree is grown;
    ``features_per_node`` draws so many of the features that can split the node at all."""

    depth: int = 5
    split_rows: int = 2
    leaf_rows: int = 1
    leaf_weight: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    least_gain: float = 0.0
    features_per_node: int | None = None


#: ML6, ML5 and ML8 with the original's settings.
BOOSTED = Growth(depth=5, leaf_weight=3.0, l1=0.1, l2=1.0, least_gain=0.1)
FOREST = Growth(depth=15, split_rows=15, leaf_rows=10)
SELECTION = Growth(depth=15, split_rows=10)


@dataclass
class Nodes:
    """Trees as parallel lists by node id; ``left`` is -1 at a leaf and the right child follows the left."""

    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, start in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.gain, 0.0)):
            column.append(start)
        self.value.append(value)
        self.rows.append(rows)
        return len(self.left) - 1

    def extend(self, other: Nodes, scale: float = 1.0) -> None:
        """Take over the trees of ``other``, their values multiplied by ``scale``."""
        start = len(self.left)
        self.roots += [start + r for r in other.roots]
        self.left += [start + child if child >= 0 else -1 for child in other.left]
        self.feature += other.feature
        self.cut += other.cut
        self.gain += other.gain
        self.value += [v * scale for v in other.value]
        self.rows += other.rows

    def prune(self, least_gain: float) -> None:
        """Undo splits into two leaves that gain too little, from the last node to the first."""
        for node in reversed(range(len(self.left))):
            child = self.left[node]
            if child >= 0 and self.left[child] < 0 and self.left[child + 1] < 0 and self.gain[node] < least_gain:
                self.left[node] = self.feature[node] = self.cut[node] = -1
                self.gain[node] = 0.0

    def reached(self, root: int) -> list[int]:
        """Nodes of one tree, parents first."""
        found = [root]
        for node in found:
            if self.left[node] >= 0:
                found += [self.left[node], self.left[node] + 1]
        return found


def _constant(values: list, kind: str) -> str:
    """A list as one literal, which the optimizer folds once."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)"


def _node_of(bins: str, root: str, nodes: Nodes, depth: int) -> str:
    """The node where a row ends, walking down from a root."""
    left, feature, cut = (_constant(v, "int") for v in (nodes.left, nodes.feature, nodes.cut))
    right = f"cast(get({bins}, get({feature}, node)) > get({cut}, node) as int)"
    step = f"if(get({left}, node) < 0, node, get({left}, node) + {right})"
    return f"aggregate(sequence(1, {max(depth, 1)}), {root}, (node, level) -> {step})"


def _sum_of_leaves(bins: str, nodes: Nodes, depth: int) -> str:
    if not nodes.roots:
        return "0D"
    leaf = f"get({_constant(nodes.value, 'double')}, {_node_of(bins, 'root', nodes, depth)})"
    return f"aggregate({_constant(nodes.roots, 'int')}, 0D, (total, root) -> total + {leaf})"


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct quantiles of each feature but the largest: a split at any of them leaves rows on both sides.

    They are rounded to 12 digits, since interpolation between equal values may lose the last bit and
    would put these values above their own quantile.
    """
    found = column_quantiles(df, features, [i / bins for i in range(bins + 1)])
    return {c: sorted({float(f"{v:.12g}") for v in values if v is not None})[:-1] for c, values in found.items()}


def _binned(features: list[str], edges: dict[str, list[float]]) -> Column:
    """The bin of each feature: 0 where it is missing, else one more than the number of edges below it."""

    def one(feature: str) -> Column:
        value = F.col(feature).cast("double")
        sorted_edges = F.expr(_constant(edges[feature], "double")) if edges[feature] else F.array().cast("array<double>")
        below = F.size(F.filter(sorted_edges, lambda edge: edge < value))
        return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(below + F.lit(1))

    return F.array(*map(one, features))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _poisson(mean: float, u: Column) -> Column:
    """How often a row is drawn, from a uniform number."""
    term = total = math.exp(-mean)
    drawn, k = F.lit(0), 0
    while total < 1 - 1e-12:
        drawn = drawn + (u >= F.lit(total)).cast("int")
        k += 1
        term *= mean / k
        total += term
    return drawn


def _leaf(g: float, h: float, rules: Growth) -> float:
    below = h + rules.l2
    return -math.copysign(max(abs(g) - rules.l1, 0.0), g) / below if below > 0 else 0.0


def best_splits(cells: DataFrame, rules: Growth, seed: int) -> DataFrame:
    """(node, g, h, n, best) from the sums of (node, feature, bin); ``best`` is NULL where nothing splits.

    Cells of a node, at most features times bins, share a partition for all windows and the last aggregate.
    """
    def score(g: str, h: str) -> str:
        kept = f"greatest(abs({g}) - {rules.l1!r}D, 0D)"
        return f"coalesce(try_divide({kept} * {kept}, {h} + {rules.l2!r}D), 0D)"

    sums = [f"sum({c}) over whole as {c}" for c in "ghn"] + [f"sum({c}) over up_to as {c}l" for c in "ghn"]
    draw = "cast(null as int)"
    if rules.features_per_node:
        draw = f"dense_rank() over (partition by node order by fits desc, xxhash64({seed}, node, feature), feature)"
    return cells.sparkSession.sql(
        f"""WITH cells AS (SELECT /*+ REPARTITION(node) */ * FROM {{cells}}),
sums AS (SELECT node, feature, bin, {", ".join(sums)} FROM cells
  WINDOW whole AS (PARTITION BY node, feature),
    up_to AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gains AS (SELECT *, {score("gl", "hl")} + {score("(g - gl)", "(h - hl)")} - {score("g", "h")} AS gain FROM sums),
judged AS (SELECT *, gain > {LEAST_STEP!r}D AND n >= {rules.split_rows} AND nl < n
  AND nl >= {rules.leaf_rows} AND n - nl >= {rules.leaf_rows}
  AND hl >= {rules.leaf_weight!r}D AND h - hl >= {rules.leaf_weight!r}D AS fits FROM gains),
drawn AS (SELECT *, {draw} AS place FROM judged)
SELECT node, min_by(g, feature) AS g, min_by(h, feature) AS h, min_by(n, feature) AS n,
  max(struct(cast(gain AS float) AS rank, -feature AS feature, -bin AS cut, gain, gl, hl, nl))
    FILTER (WHERE fits AND coalesce(place <= {rules.features_per_node or 0}, true)) AS best
FROM drawn GROUP BY node""",
        cells=cells,
    )


def grow(rows: DataFrame, roots: int, rules: Growth, columns: list[int], seed: int = SEED) -> Nodes:
    """Grow trees together, level by level, from (bins, root, g, h), one row for each row of each tree.

    A leaf's value is minus its gradient over its weight, with the penalties of ``rules``. Trees
    without rows are single leaves of value 0.
    """
    nodes = Nodes(roots=list(range(roots)))
    for _ in range(roots):
        nodes.add(0.0, 0)
    first = 0
    for level in range(max(rules.depth, 1)):  # a tree of depth 0 still needs its root's value
        walked = rows.selectExpr("bins", "g", "h", f"{_node_of('bins', 'root', nodes, level)} as node")
        cells = (
            walked.where(f"node >= {first}")
            .selectExpr("node", "g", "h", "posexplode(bins) as (feature, bin)")
            .where(f"feature in ({', '.join(map(str, columns))})")
            .groupBy("node", "feature", "bin")
            .agg(F.expr("sum(g) as g"), F.expr("sum(h) as h"), F.expr("count(1) as n"))
        )
        found = best_splits(cells, rules, seed).collect()
        first = len(nodes.left)
        for r in sorted(found, key=lambda r: r["node"]):
            node, best = r["node"], r["best"]
            if level == 0:
                nodes.value[node], nodes.rows[node] = _leaf(r["g"], r["h"], rules), r["n"]
            if best is None or rules.depth == 0:
                continue
            nodes.feature[node], nodes.cut[node], nodes.gain[node] = -best["feature"], -best["cut"], best["gain"]
            nodes.left[node] = nodes.add(_leaf(best["gl"], best["hl"], rules), best["nl"])
            nodes.add(_leaf(r["g"] - best["gl"], r["h"] - best["hl"], rules), r["n"] - best["nl"])
        if len(nodes.left) == first:
            break
    nodes.prune(rules.least_gain)
    return nodes


@dataclass
class BinnedTrees:
    """A fitted model: ``base`` plus the leaf values of all trees; ``transform`` adds it as ``y_hat``.

    ``history`` holds the validation error after each round that was tried.
    """

    features: list[str]
    edges: dict[str, list[float]]
    base: float | None
    nodes: Nodes
    depth: int
    mean_gain: bool
    history: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """NULL predictions if no row with a target was there to learn from."""
        if self.base is None:
            return df.withColumn("y_hat", F.lit(None).cast("double"))
        # A lambda variable holds the bins, so that a row is binned once and not at every step.
        binned = df.withColumn(HELD_BINS, F.array(_binned(self.features, self.edges)))
        total = f"{self.base!r}D + {_sum_of_leaves('bins', self.nodes, self.depth)}"
        return binned.withColumn("y_hat", F.expr(f"transform({HELD_BINS}, bins -> {total})[0]")).drop(HELD_BINS)

    def weights(self) -> list[float]:
        """ML7: shares of the features. Boosting: mean gain of a feature's splits. Forest: each tree's
        gains as shares, averaged over the trees that split at all."""
        total = [0.0] * len(self.features)
        count = [0] * len(self.features)
        for root in self.nodes.roots:
            splits = [i for i in self.nodes.reached(root) if self.nodes.left[i] >= 0]
            of_tree = 1.0 if self.mean_gain else sum(self.nodes.gain[i] for i in splits)
            for i in splits:
                total[self.nodes.feature[i]] += self.nodes.gain[i] / of_tree
                count[self.nodes.feature[i]] += 1
        if self.mean_gain:
            total = [t / c if c else 0.0 for t, c in zip(total, count)]
        whole = sum(total)
        return [t / whole if whole else 0.0 for t in total]

    def splits(self, df: DataFrame) -> DataFrame:
        """(tree, node, feature, threshold, gain, value, n_rows), one row for each node; a node's children are
        2 node + 1 and 2 node + 2. Rows up to the threshold and missing ones go to the first child; a
        NULL threshold sends the missing ones alone there. Leaves have no feature."""
        listed = []
        for tree, root in enumerate(self.nodes.roots):
            number = {root: 0}
            for i in self.nodes.reached(root):
                child, at = self.nodes.left[i], number[i]
                feature = threshold = gain = None
                if child >= 0:
                    number[child], number[child + 1] = 2 * at + 1, 2 * at + 2
                    feature, gain = self.features[self.nodes.feature[i]], self.nodes.gain[i]
                    threshold = self.edges[feature][self.nodes.cut[i] - 1] if self.nodes.cut[i] > 0 else None
                listed.append((tree, at, feature, threshold, gain, self.nodes.value[i], self.nodes.rows[i]))
        schema = "tree INT, node LONG, feature STRING, threshold DOUBLE, gain DOUBLE, value DOUBLE, n_rows LONG"
        return df.sparkSession.createDataFrame(listed, schema)


def _prepared(train: DataFrame, features: list[str], target: str, identity: list[str], bins: int, flag: str | None):
    """(edges, base, rows) of the rows with a finite target; edges and base come from those not held out."""
    clean = nan_to_null(train.withColumn("_y", F.col(target).cast("double")), ["_y"]).where(F.abs("_y") < F.lit(math.inf))
    held = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    clean = clean.withColumn("_held", held)
    learning = clean.where(~F.col("_held"))
    base = learning.agg(F.avg("_y")).first()[0]
    if base is None:
        return {c: [] for c in features}, None, clean
    edges = bin_edges(learning, features, bins)
    rows = clean.select(
        _binned(features, edges).alias("bins"), F.xxhash64(*identity).alias("key"), F.col("_y").alias("y"),
        F.col("_held").alias("held"), F.lit(base).alias("past"),
    )
    return edges, base, settle(rows)


def fit_boosted(
    train: DataFrame,
    features: list[str],
    target: str,
    identity: list[str],
    validation_flag: str | None = "is_validation",
    rounds: int = 300,
    step: float = 0.1,
    patience: int = 30,
    row_share: float = 0.8,
    column_share: float = 0.8,
    rules: Growth = BOOSTED,
    bins: int = BINS,
    seed: int = SEED,
) -> BinnedTrees:
    """ML6: second-order boosting of the squared error.

    Each round draws rows and features, grows one tree on what is left to explain, and adds ``step``
    times its leaves. It ends after ``patience`` rounds without a lower validation error and keeps the
    rounds up to the best; without validation rows all rounds are kept. Sums of several trees are written
    beside the rows now and then, so that plans stay short.
    """
    edges, base, rows = _prepared(train, features, target, identity, bins, validation_flag)
    model = BinnedTrees(features, edges, base, Nodes(), rules.depth, True)
    if base is None:
        return model
    draw = random.Random(seed)
    trees: list[Nodes] = []
    pending = Nodes()
    best, best_error = 0, math.inf
    for turn in range(rounds):
        columns = sorted(draw.sample(range(len(features)), max(1, int(column_share * len(features)))))
        learning = rows.where("not held")
        if row_share < 1:
            learning = learning.where(_uniform(F.lit(seed), F.lit(turn), F.col("key")) < F.lit(row_share))
        now = f"past + {_sum_of_leaves('bins', pending, rules.depth)}"
        left_over = learning.selectExpr("bins", "0 as root", f"{now} - y as g", "1D as h")
        tree = grow(left_over, 1, rules, columns, seed + turn)
        scaled = Nodes()
        scaled.extend(tree, step)
        trees.append(scaled)
        pending.extend(scaled)
        now = f"past + {_sum_of_leaves('bins', pending, rules.depth)}"
        if validation_flag:
            error = rows.where("held").agg(F.expr(f"sqrt(avg(power({now} - y, 2)))")).first()[0]
            if error is not None:
                model.history.append(error)
                if error < best_error:
                    best, best_error = turn, error
                if turn - best >= patience:
                    break
        if len(pending.roots) >= MOST_PENDING:
            rows, pending = settle(rows.withColumn("past", F.expr(now))), Nodes()
    for tree in trees[: best + 1] if model.history else trees:
        model.nodes.extend(tree)
    return model


def fit_forest(
    train: DataFrame,
    features: list[str],
    target: str,
    identity: list[str],
    trees: int = 100,
    row_share: float | None = 0.8,
    rules: Growth = FOREST,
    bins: int = BINS,
    seed: int = SEED,
) -> BinnedTrees:
    """ML5 and ML8: the mean of trees grown on rows drawn with repetition, ``row_share`` times as many as there
    are; None grows every tree on all rows. As many trees grow at once as ``WIDEST_LEVEL`` allows.

    Draws are Poisson counts by row and tree; node rules count rows drawn at least once.
    """
    edges, base, rows = _prepared(train, features, target, identity, bins, None)
    model = BinnedTrees(features, edges, base, Nodes(), rules.depth, False)
    if base is None:
        return model
    at_once = max(1, WIDEST_LEVEL >> rules.depth)
    columns = list(range(len(features)))
    for first in range(0, trees, at_once):
        some = min(at_once, trees - first)
        dealt = rows.withColumn("root", F.explode(F.sequence(F.lit(0), F.lit(some - 1))))
        drawn = F.lit(1.0)
        if row_share is not None:
            drawn = _poisson(row_share, _uniform(F.lit(seed), F.col("root") + F.lit(first), F.col("key"))).cast("double")
        dealt = dealt.withColumn("h", drawn).where("h > 0")
        weighted = dealt.select("bins", "root", (F.col("h") * (F.col("past") - F.col("y"))).alias("g"), "h")
        model.nodes.extend(grow(weighted, some, rules, columns, seed + first), 1.0 / trees)
    return model
