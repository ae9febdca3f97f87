"""Samples, chronological splits, and forecasting models on Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.operators.association import inner_edges, quantile_bin
from gridloom.operators.forests import ForestRegressor
from gridloom.operators.quantiles import before_row, column_quantiles, order_statistics, row_at
from gridloom.operators.trees import BinnedTrees

SEED = 42
MOST_TIED = 100_000


def _hash_text(columns: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def stratified_sample(df: DataFrame, target: str, n: int, identity: list[str], bins: int = 10) -> DataFrame:
    """ML1: a sample that keeps the distribution of the target.

    Each quantile bin gives the rows with the smallest identity hashes, as many as its
    share of n. The hash of the last row taken is an order statistic, so no bin is ever
    sorted in one task; identical rows are counted rather than listed. ``identity`` must tell
    rows apart but for a few copies.
    """
    total = df.count()
    if total <= n:
        return df
    probs = [i / bins for i in range(bins + 1)]
    edges = inner_edges(column_quantiles(df, [target], probs)[target])
    binned = (
        df.where(F.col(target).isNotNull())
        .withColumn("_bin", quantile_bin(F.col(target), edges))
        .withColumn("_digest", _hash_text(identity))
        .withColumn("_hash", F.conv(F.substring("_digest", 1, 13), 16, 10).cast("long"))
    )
    sizes = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = {b: int(size * (n / total)) for b, size in sizes.items()}
    quota = {b: q for b, q in quota.items() if q > 0}
    if not quota:
        return df.limit(0)
    last = order_statistics(binned, ["_bin"], "_hash", {(b,): [q - 1] for b, q in quota.items()})

    def per_bin(values: dict[int, int]) -> Column:
        listed = F.array(*[F.lit(values.get(b)).cast("long") for b in range(len(edges) + 1)])
        return F.element_at(listed, F.col("_bin") + 1)

    found = {b: last[((b,), q - 1)] for b, q in quota.items()}
    if any(f.equal > MOST_TIED for f in found.values()):
        raise ValueError(f"{identity} is no identity: more than {MOST_TIED} rows of a bin share one value of it")
    border = per_bin({b: f.value for b, f in found.items()})
    if all(f.smaller + f.equal == quota[b] for b, f in found.items()):
        return binned.where(F.col("_hash") <= border).select(*df.columns)
    sure = binned.where(F.col("_hash") < border)
    tied = binned.where(F.col("_hash") == border)
    copies = tied.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_bin").orderBy("_digest", *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    room = per_bin({b: quota[b] - f.smaller for b, f in found.items()}) - F.coalesce(
        F.sum("_n").over(earlier), F.lit(0)
    )
    filled = (
        copies.withColumn("_take", F.least(F.col("_n"), room))
        .where(F.col("_take") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take"))))
    )
    return sure.select(*df.columns).unionByName(filled.select(*df.columns))


def quick_stratified_sample(df: DataFrame, strata: str, fractions: dict, seed: int = SEED) -> DataFrame:
    """ML1 in one pass, with approximate sizes."""
    return df.sampleBy(strata, fractions, seed)


def chronological_split(df: DataFrame, order: list[str], test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """ML2: the first rows train, the last rows test; ``order`` must identify a row.

    The shares are those of the rows with a known order. A row whose place cannot be told, since a
    column of its order is NULL, trains.
    """
    known = df.dropna("any", subset=order)
    total = known.count()
    cut = int(total * (1 - test_share))
    if cut >= total:
        return df, df.limit(0)
    earlier = before_row(df, order, row_at(known, order, cut), missing_first=True)
    return df.where(earlier), df.where(~earlier)


def flag_validation(train: DataFrame, order: list[str], share: float = 0.1, flag: str = "is_validation") -> DataFrame:
    """ML10: mark the last part of the training rows; rows whose place cannot be told are not marked."""
    known = train.dropna("any", subset=order)
    total = known.count()
    held = int(total * share)
    if held == 0:
        return train.withColumn(flag, F.lit(False))
    earlier = before_row(train, order, row_at(known, order, total - held))
    return train.withColumn(flag, F.coalesce(~earlier, F.lit(False)))


def standardizer(features: list[str]) -> list:
    """ML3: assemble and standardize; fitted on whatever the pipeline is fitted on."""
    return [
        VectorAssembler(inputCols=features, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
    ]


def linear_model(target: str) -> LinearRegression:
    """ML4: ordinary least squares by the normal equations."""
    return LinearRegression(featuresCol="features", labelCol=target, predictionCol="y_hat", solver="normal")


def forest_model(target: str, trees: int = 100, depth: int = 15) -> ForestRegressor:
    """ML5"""
    return ForestRegressor("features", target, "y_hat", trees, depth, least_rows=10, features_per_node="sqrt", row_share=0.8, seed=SEED)


def selection_forest(target: str, trees: int = 100, depth: int = 15) -> ForestRegressor:
    """ML8: every split may use every feature."""
    return ForestRegressor("features", target, "y_hat", trees, depth, least_rows=5, features_per_node="all", seed=SEED)


def boosted_model(
    target: str, rounds: int = 300, step: float = 0.1, depth: int = 5, validation_flag: str | None = "is_validation"
) -> GBTRegressor:
    """ML6: gradient boosting that stops once the validation error no longer falls."""
    model = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol="y_hat",
        maxIter=rounds,
        stepSize=step,
        maxDepth=depth,
        maxBins=128,
        subsamplingRate=0.8,
        minInstancesPerNode=3,
        featureSubsetStrategy="0.8",
        validationTol=0.0,
        seed=SEED,
    )
    return model.setValidationIndicatorCol(validation_flag) if validation_flag else model


def fit(train: DataFrame, features: list[str], model: Estimator) -> PipelineModel:
    return Pipeline(stages=[*standardizer(features), model]).fit(train)


def score(models: dict[str, PipelineModel | BinnedTrees], test: DataFrame, target: str, keep: list[str]) -> DataFrame:
    """ML9: (keep..., model_name, y, y_hat) for all models."""
    parts = [
        model.transform(test).select(*keep, F.lit(name).alias("model_name"), F.col(target).alias("y"), "y_hat")
        for name, model in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def importances(df: DataFrame, models: dict[str, PipelineModel | BinnedTrees], names: list[str]) -> DataFrame:
    """ML7: (model_name, feature, importance, importance_pct) of every tree model; ``names`` are the features of the pipelines."""
    rows = []
    for name, model in models.items():
        if isinstance(model, BinnedTrees):
            features, weights = model.features, model.weights()
        else:
            vector = getattr(model.stages[-1], "featureImportances", None)
            if vector is None:
                continue
            features, weights = names, vector.toArray()
        total = float(sum(weights)) or 1.0
        rows += [(name, f, float(w), 100.0 * float(w) / total) for f, w in zip(features, weights)]
    schema = "model_name STRING, feature STRING, importance DOUBLE, importance_pct DOUBLE"
    return df.sparkSession.createDataFrame(rows, schema)


def standard_scores(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """ML3 as columns: z-scores by the training mean and sample deviation."""
    facts = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns(
        {f"{c}_z": (F.col(c) - F.lit(facts[c]["m"])) / F.lit(facts[c]["s"] or 1.0) for c in columns}
    )
