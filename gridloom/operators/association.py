"""Rank correlations and mutual information."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.pairs import crossed_in_group
from gridloom.operators.quantiles import column_quantiles, ordered_values, small_side, value_ranks
from gridloom.operators.statistics import pearson_pairs, target_correlations, upper_pairs
from gridloom.session import settle

STRIPE_ROWS = 200_000


def with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its average rank; complete rows only.

    The values of all columns are counted and ordered together. A column's rank table holds
    one row per distinct value. A table counted to be small is broadcast, so a column of few
    values does not send its rows to as few tasks; for the others AQE splits a frequent value.
    """
    known = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    values = ordered_values(known.unpivot([], columns, "feature", "value"), ["feature"], "value")
    ranks = settle(values.select("feature", "value", (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank")))
    distinct = {r["feature"]: r["n"] for r in ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = known
    for c in columns:
        own = ranks.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_rank_{c}"))
        ranked = ranked.join(small_side(own, distinct.get(c, 0)), c)
    return ranked.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """ST5: (var1, var2, r); ties share their average rank."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    return pearson_pairs(with_ranks(df, columns), pairs, complete_rows=True)


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    upper = spearman_pairs(df, [(c, c) for c in columns] + upper_pairs(columns))
    return _mirrored(upper)


def _mirrored(upper: DataFrame) -> DataFrame:
    lower = upper.where(F.col("var1") != F.col("var2")).select(
        F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"
    )
    return upper.unionByName(lower)


def _stripes(points: DataFrame, axis: str, size: int) -> DataFrame:
    """Cut an axis into ordered stripes of about ``size`` points.

    A value with more points than that gets a stripe of its own (odd number): its points
    are tied, so nothing inside the stripe has to be counted.
    """
    ranks = value_ranks(points, axis)
    before = F.col("rank") - (F.col("n") + 1) / 2.0
    heavy = (F.col("n") > size).cast("long")
    stripes = ranks.select(F.col("value").alias(axis), (2 * F.floor(before / size) + heavy).alias(f"_s{axis}"))
    return small_side(stripes, points.agg(F.approx_count_distinct(axis)).first()[0])


def discordant_weight(points: DataFrame, stripe_rows: int = STRIPE_ROWS) -> int:
    """Discordant pairs among weighted points (x, y, w).

    Both axes are cut into stripes. A discordant pair either shares the x stripe, or
    shares only the y stripe, or differs in both. The first two kinds are counted stripe
    by stripe (bounded tasks); the third is the same question about the stripe cells,
    which are far fewer points, and is asked again.
    """
    n = points.count()
    size = max(stripe_rows, 4 * math.isqrt(n))
    if n <= size:
        whole = points.withColumn("_all", F.lit(0)).groupBy("_all")
        whole = whole.applyInPandas(crossed_in_group("x", "y"), "crossed DECIMAL(38,0)")
        row = whole.first()
        return int(row["crossed"]) if row else 0
    placed = settle(points.join(_stripes(points, "x", size), "x").join(_stripes(points, "y", size), "y"))
    same_x = (
        placed.where(F.col("_sx") % 2 == 0)
        .groupBy("_sx")
        .applyInPandas(crossed_in_group("x", "y"), "crossed DECIMAL(38,0)")
    )
    same_y = (
        placed.where(F.col("_sy") % 2 == 0)
        .groupBy("_sy")
        .applyInPandas(crossed_in_group("_sx", "y"), "crossed DECIMAL(38,0)")
    )
    inside = same_x.unionAll(same_y).agg(F.sum("crossed")).first()[0] or 0
    cells = settle(
        placed.groupBy(F.col("_sx").alias("x"), F.col("_sy").alias("y")).agg(F.sum("w").alias("w"))
    )
    return int(inside) + discordant_weight(cells, stripe_rows)


def _pairs_of(weight: Column) -> Column:
    w = weight.cast("decimal(19,0)")
    return F.sum(w * (w - 1) / 2).cast("decimal(38,0)")


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """ST6: (var1, var2, r) with tau-b over rows complete in all named columns.

    Exact for any number of rows. Only distinct points with their counts are kept, so
    copies cost nothing; all pairs share the passes over them. A pair with few points is
    one task, the others are counted stripe by stripe.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    known = df.select(*columns).dropna()
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    points = settle(
        known.select(F.inline(listed)).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    )
    facts = {
        r["pair"]: r
        for r in points.groupBy("pair")
        .agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("points"), _pairs_of(F.col("w")).alias("tied"))
        .collect()
    }

    def tied_on(axis: str) -> DataFrame:
        equal = points.groupBy("pair", axis).agg(F.sum("w").alias("w"))
        return equal.groupBy("pair").agg(_pairs_of(F.col("w")).alias("tied")).withColumn("axis", F.lit(axis))

    tied = {(r["pair"], r["axis"]): int(r["tied"]) for r in tied_on("x").unionByName(tied_on("y")).collect()}
    small = [i for i, f in facts.items() if f["points"] <= stripe_rows]
    counted = (
        points.where(F.col("pair").isin(small))
        .groupBy("pair")
        .applyInPandas(crossed_in_group("x", "y", "pair"), "pair INT, crossed DECIMAL(38,0)")
    )
    discordant = {r["pair"]: int(r["crossed"]) for r in counted.collect()} if small else {}
    rows = []
    for i, (a, b) in enumerate(pairs):
        tau = None
        if i in facts:
            n, both = facts[i]["n"], int(facts[i]["tied"])
            every, tied_x, tied_y = n * (n - 1) // 2, tied[(i, "x")], tied[(i, "y")]
            if every not in (tied_x, tied_y):
                if i not in discordant:
                    own = points.where(F.col("pair") == i).select("x", "y", "w")
                    discordant[i] = discordant_weight(own, stripe_rows)
                concordant = every - tied_x - tied_y + both - discordant[i]
                tau = (concordant - discordant[i]) / math.sqrt((every - tied_x) * (every - tied_y))
        rows.append((a, b, tau))
    return df.sparkSession.createDataFrame(rows, "var1 STRING, var2 STRING, r DOUBLE")


def kendall_matrix(df: DataFrame, columns: list[str], stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    upper = kendall_pairs(df, upper_pairs(columns), stripe_rows)
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], upper.schema)
    return _mirrored(upper.unionByName(ones))


def target_association(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """ST7, JN4: Pearson, Spearman and Kendall of every feature against the target."""
    known = df.select(*features, target).dropna()
    pairs = [(f, target) for f in features]
    by_rank = spearman_pairs(known, pairs).select(F.col("var1").alias("feature"), F.col("r").alias("spearman"))
    by_order = kendall_pairs(known, pairs).select(F.col("var1").alias("feature"), F.col("r").alias("kendall"))
    return (
        target_correlations(known, features, target, True)
        .join(by_rank, "feature")
        .join(by_order, "feature")
        .orderBy(F.abs("pearson").desc_nulls_last(), "feature")
    )


def quantile_bin(value: Column, edges: list[float]) -> Column:
    """Number of edges below the value."""
    number: Column = F.lit(0)
    for edge in edges:
        number = number + (value > F.lit(edge)).cast("int")
    return number


def inner_edges(quantiles: list[float]) -> list[float]:
    """Distinct inner borders of quantile bins whose ends are the minimum and maximum."""
    return sorted(set(quantiles))[1:-1]


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """ST8: plug-in mutual information on quantile bins, with its share of the largest.

    The rows shrink to at most bins x bins counts per feature before the shuffle.
    """
    known = df.select(*features, target).dropna()
    probs = [i / bins for i in range(bins + 1)]
    edges = {c: inner_edges(q) for c, q in column_quantiles(known, [*features, target], probs).items()}
    binned = known.select(
        quantile_bin(F.col(target), edges[target]).alias("ty"),
        *[quantile_bin(F.col(f), edges[f]).alias(f) for f in features],
    )
    joint = binned.unpivot(["ty"], features, "feature", "fx").groupBy("feature", "fx", "ty").agg(
        F.count(F.lit(1)).alias("n")
    )
    whole, row, col = (Window.partitionBy("feature", *extra) for extra in ([], ["fx"], ["ty"]))
    n = F.sum("n").over(whole)
    share = joint.select(
        "feature",
        (F.col("n") / n).alias("p"),
        (F.sum("n").over(row) / n).alias("px"),
        (F.sum("n").over(col) / n).alias("py"),
    )
    scores = share.groupBy("feature").agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi_score")
    )
    best = F.max("mi_score").over(Window.partitionBy(F.lit(0)))
    return scores.withColumn("mi_normalized", F.try_divide(F.col("mi_score"), best))
