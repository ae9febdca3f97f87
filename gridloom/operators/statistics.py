"""Summary statistics, correlations, tests and redundancy checks in long form."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.distributions import f_tail, t_two_sided
from gridloom.functions.numeric import nan_to_null, normal_score, normal_share, ratio
from gridloom.operators.quantiles import EXACT_ROWS, column_quantiles, ordered_values

WIDE_PAIRS = 60
SUMMARY_COLUMNS = 12
SUMMARY_PROBS = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def corrected_skewness(n: Column, g1: Column) -> Column:
    """Sample skewness from the population one; needs three values, 0 for equal ones."""
    n = n.cast("double")
    return F.when(n > 2, F.coalesce(g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2), F.lit(0.0)))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis from the population one; needs four values, 0 for equal ones."""
    n = n.cast("double")
    corrected = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.coalesce(corrected, F.lit(0.0)))


def statistical_summary(df: DataFrame, columns: list[str], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """ST1: (feature, metric, value) for ten statistics per column; NaN is missing.

    The quantiles are found first and enter as literals: in one aggregate with the moments
    they would keep the whole aggregate out of code generation.
    """
    df = nan_to_null(df, columns)
    quantiles = column_quantiles(df, columns, list(SUMMARY_PROBS.values()), exact_rows)

    def described(c: str) -> list[Column]:
        n = F.count(c)
        varies = F.stddev_pop(c) > 0
        stats = {
            "count": n,
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(c),
            "max": F.max(c),
            "skewness": corrected_skewness(n, F.when(varies, F.skewness(c))),
            "kurtosis": corrected_kurtosis(n, F.when(varies, F.kurtosis(c))),
        }
        stats |= {name: F.lit(quantiles[c][i]) for i, name in enumerate(SUMMARY_PROBS)}
        return [
            F.struct(F.lit(c).alias("feature"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
            for metric, value in stats.items()
        ]

    return _in_parts(df, columns, SUMMARY_COLUMNS, described)


def _correlation(x: Column, y: Column) -> Column:
    """NULL where one of them is constant: told by the ends, since merged parts can leave equal values a tiny deviation."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation over rows where both are known; NULL where one of them is constant."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = a.isNotNull() & b.isNotNull()
    return _correlation(F.when(both, a.cast("double")), F.when(both, b.cast("double")))


def _bounded(r: Column) -> Column:
    """Within -1 and 1; greatest and least skip NULL, so a missing r is kept apart."""
    return F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]], complete_rows: bool = False) -> DataFrame:
    """(var1, var2, r) for the given pairs over rows where both are known; NaN is missing.

    A pair with an infinite value has no r. ``complete_rows`` promises that no value is NULL or NaN
    and saves the pass that looks. Columns without NULLs share their deviations between pairs. Many pairs of such
    columns go through the distributed Gramian of Spark ML, whose size per task is
    features squared.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    complete = set(columns)
    if not complete_rows:
        df = nan_to_null(df, columns)
        missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
        complete = {c for c in columns if not missing[c]}
    if len(pairs) > WIDE_PAIRS and len(complete) == len(columns):
        return _gramian_pairs(df, columns, pairs)

    def r(a: str, b: str) -> Column:
        if a in complete and b in complete:
            return _correlation(F.col(a).cast("double"), F.col(b).cast("double"))
        return pearson(a, b)

    return _in_parts(
        df,
        pairs,
        WIDE_PAIRS,
        lambda pair: [
            F.struct(F.lit(pair[0]).alias("var1"), F.lit(pair[1]).alias("var2"), _bounded(r(*pair)).alias("r"))
        ],
    )


def _in_parts(df: DataFrame, items: list, size: int, structs: Callable[..., list[Column]]) -> DataFrame:
    """One row per struct of aggregates, a bounded number of items per aggregate.

    Very wide aggregates outgrow code generation; each part reads only its own columns.
    """
    parts = []
    for start in range(0, len(items), size):
        rows = [row for item in items[start : start + size] for row in structs(item)]
        parts.append(df.agg(F.array(*rows).alias("s")).select(F.inline("s")))
    return reduce(DataFrame.unionByName, parts)


def _gramian_pairs(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    vectors = VectorAssembler(inputCols=columns, outputCol="_vector").transform(df.select(*columns))
    matrix = Correlation.corr(vectors.select("_vector"), "_vector").first()[0].toArray()
    constant = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns]).first()
    place = {c: i for i, c in enumerate(columns)}
    rows = [
        (a, b, None if constant[a] or constant[b] or math.isnan(matrix[place[a], place[b]]) else max(-1.0, min(1.0, float(matrix[place[a], place[b]]))))
        for a, b in pairs
    ]
    return df.sparkSession.createDataFrame(rows, "var1 STRING, var2 STRING, r DOUBLE")


def upper_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """ST3: the full matrix in long form; each pair is computed once."""
    upper = pearson_pairs(df, [(c, c) for c in columns] + upper_pairs(columns))
    mirrored = upper.where(F.col("var1") != F.col("var2")).select(
        F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"
    )
    return upper.unionByName(mirrored)


def strong_pairs(df: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """ST4: pairs whose |r| exceeds the threshold, by column position."""
    return pearson_pairs(df, upper_pairs(columns)).where(F.abs("r") > threshold)


def target_correlations(
    df: DataFrame, features: list[str], target: str, complete_rows: bool = False
) -> DataFrame:
    """(feature, pearson) for every feature against the target."""
    return pearson_pairs(df, [(f, target) for f in features], complete_rows).select(
        F.col("var1").alias("feature"), F.col("r").alias("pearson")
    )


def strongest(correlations: DataFrame, n: int, by: str = "pearson") -> DataFrame:
    """TOP1, SRT2: the n features with the largest |r|; names break ties."""
    return correlations.orderBy(F.abs(by).desc_nulls_last(), "feature").limit(n)


def leaking_features(df: DataFrame, features: list[str], target: str, threshold: float = 0.95) -> DataFrame:
    """ST13: features too close to the target to be honest inputs."""
    return target_correlations(df, features, target).where(F.abs("pearson") > threshold)


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """ST9 without p-values: (feature, n, r, f_score) over complete rows."""
    known = df.dropna("any", subset=[*features, target])
    rows = known.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    table = target_correlations(known, features, target, True).select(
        "feature", F.lit(rows).alias("n"), F.col("pearson").alias("r")
    )
    return table.withColumn("f_score", ratio(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")))


def f_test(df: DataFrame, features: list[str], target: str, alpha: float = 0.05) -> DataFrame:
    """ST9: F scores with p-values; one row per feature passes through the driver."""
    scored = []
    for row in f_scores(df, features, target).collect():
        f, n = row["f_score"], row["n"]
        if f is None and row["r"] is not None and n > 2:
            f, p = math.inf, 0.0
        else:
            p = f_tail(f, 1.0, float(n - 2)) if f is not None and n > 2 else None
        scored.append((row["feature"], f, p, p is not None and p < alpha))
    schema = "feature STRING, f_score DOUBLE, p_value DOUBLE, significant BOOLEAN"
    return df.sparkSession.createDataFrame(scored, schema)


def two_sample_t(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """ST10 without p-value: pooled two-sample t statistic from one aggregate.

    NaN is missing; with an infinite value there is no statistic.
    """
    df = nan_to_null(df, [value])
    a, b = F.when(in_first, F.col(value)), F.when(~in_first, F.col(value))
    facts = df.agg(
        F.count(a).alias("n1"),
        F.count(b).alias("n2"),
        F.avg(a).alias("mean1"),
        F.avg(b).alias("mean2"),
        F.var_samp(a).alias("var1"),
        F.var_samp(b).alias("var2"),
    )
    free = F.col("n1") + F.col("n2") - 2
    pooled = ratio((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), free)
    error = F.sqrt(pooled * (ratio(F.lit(1), F.col("n1")) + ratio(F.lit(1), F.col("n2"))))
    t = ratio(F.col("mean1") - F.col("mean2"), error)
    return facts.withColumn("dof", free).withColumn("t_statistic", F.when(~F.isnan(t), t))


def weekday_weekend_test(df: DataFrame, ts_col: str, value: str, alpha: float = 0.05) -> DataFrame:
    """ST10: do weekdays and weekends differ in their mean?"""
    row = two_sample_t(df, value, F.weekday(ts_col) < 5).first()
    t, dof = row["t_statistic"], row["dof"]
    p = t_two_sided(t, float(dof)) if t is not None else None
    result = [(row["mean1"], row["mean2"], t, dof, p, p is not None and p < alpha)]
    schema = (
        "weekday_mean DOUBLE, weekend_mean DOUBLE, t_statistic DOUBLE, dof BIGINT, "
        "p_value DOUBLE, significant_difference BOOLEAN"
    )
    return df.sparkSession.createDataFrame(result, schema)


def normality(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """ST11: Jarque-Bera over all rows; the p-value of a chi-square with 2 degrees is exp(-x/2).

    NaN is missing; a column with an infinite value has no score and no verdict.
    """
    df = nan_to_null(df, columns)
    rows = []
    for c in columns:
        varies = F.stddev_pop(c) > 0
        g1, g2 = F.when(varies, F.skewness(c)), F.when(varies, F.kurtosis(c))
        score = F.count(c) / F.lit(6.0) * (g1 * g1 + g2 * g2 / 4)
        rows.append(F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.when(~F.isnan(score), score).alias("jarque_bera")))
    table = df.agg(F.array(*rows).alias("s")).select(F.inline("s"))
    p = F.exp(-F.col("jarque_bera") / 2)
    return table.withColumn("p_value", p).withColumn("is_normal", p >= alpha)


def rank_normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """ST11: (feature, n, shapiro_francia, largest_gap) over all rows.

    ``shapiro_francia`` is the squared correlation of the values with the normal scores of their
    ranks, ties sharing their average rank; ``largest_gap`` the largest distance between the shares
    of rows and of the fitted normal distribution. Values are counted and ordered in slices, so no
    task sorts a column. NaN is missing; a constant column, or one with an infinite value, has neither.
    """
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    values = ordered_values(tall, ["feature"], "value")
    facts = values.groupBy("feature").agg(F.sum("n").alias("rows"), F.max(F.abs("value")).alias("far"), F.count(F.lit(1)).alias("distinct"))
    sums = values.join(facts.where((F.col("far") < math.inf) & (F.col("distinct") > 1)), "feature").groupBy("feature").agg(
        F.max("rows").alias("all_rows"), F.sum(F.col("value") / F.col("rows") * F.col("n")).alias("mean")
    )
    centred = values.join(sums, "feature").withColumn("c", F.col("value") - F.col("mean"))
    spread = centred.groupBy("feature").agg(F.sqrt(F.sum(F.col("n") * F.col("c") * F.col("c")) / (F.max("all_rows") - 1.0)).alias("sd"))
    placed = centred.join(spread.where(F.col("sd") > 0), "feature")
    score = normal_score((F.col("below") + (F.col("n") + 1) / 2.0 - 0.375) / (F.col("all_rows") + 0.25))
    share = normal_share(F.col("c") / F.col("sd"))
    low, high = F.col("below") / F.col("all_rows"), (F.col("below") + F.col("n")) / F.col("all_rows")
    placed = placed.select("feature", "n", "c", score.alias("m"), F.greatest(F.abs(share - low), F.abs(high - share)).alias("gap"))
    across, within = F.sum(F.col("n") * F.col("m") * F.col("c")), F.sum(F.col("n") * F.col("m") * F.col("m"))
    scores = placed.groupBy("feature").agg(
        ratio(across * across, within * F.sum(F.col("n") * F.col("c") * F.col("c"))).alias("shapiro_francia"), F.max("gap").alias("largest_gap")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature STRING")
    counted = names.join(facts, "feature", "left").join(scores, "feature", "left")
    return counted.select("feature", F.coalesce("rows", F.lit(0).cast("long")).alias("n"), "shapiro_francia", "largest_gap")


def explained_variance(df: DataFrame, features: list[str], components: int | None = None) -> DataFrame:
    """ST12: variance share and running share per principal component of standardized data."""
    known = df.select(*features).dropna()
    vectors = VectorAssembler(inputCols=features, outputCol="raw").transform(known)
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vectors)
    k = components or len(features)
    model = PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled.transform(vectors))
    rows = [(i + 1, f"PC{i + 1}", float(v)) for i, v in enumerate(model.explainedVariance)]
    table = df.sparkSession.createDataFrame(rows, "pc INT, name STRING, variance_explained DOUBLE")
    running = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.withColumn("cumulative_variance", F.sum("variance_explained").over(running))


def components_for(variance: DataFrame, share: float = 0.95) -> DataFrame:
    """ST12: how many components reach the share; 1 if none does, as an argmax over flags gives."""
    reached = F.min(F.when(F.col("cumulative_variance") >= share, F.col("pc")))
    return variance.agg(F.coalesce(reached, F.lit(1)).alias("n_components"))


def variance_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """ST14: diagonal of the inverse correlation matrix (features x features, on the driver)."""
    place = {f: i for i, f in enumerate(features)}
    matrix = np.eye(len(features))
    for row in pearson_pairs(df.dropna("any", subset=features), upper_pairs(features), True).collect():
        r = row["r"] if row["r"] is not None else 0.0
        matrix[place[row["var1"]], place[row["var2"]]] = r
        matrix[place[row["var2"]], place[row["var1"]]] = r
    singular = abs(np.linalg.det(matrix)) < 1e-12
    diagonal = np.full(len(features), np.inf) if singular else np.diag(np.linalg.inv(matrix))
    rows = [
        (f, float(v), "severe" if v >= 10 else "moderate" if v >= 5 else "none") for f, v in zip(features, diagonal)
    ]
    return df.sparkSession.createDataFrame(rows, "feature STRING, vif DOUBLE, multicollinearity STRING")
