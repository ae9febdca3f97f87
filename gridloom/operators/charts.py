"""The numbers behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.distributions import normal_quantile
from gridloom.functions.numeric import finite, nan_to_null
from gridloom.operators.learning import stratified_sample
from gridloom.operators.quantiles import column_quantiles, first_rows, grouped_quantiles
from gridloom.operators.statistics import strongest, target_correlations


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """CH1: equal-width bins of the finite readings, empty ones too; the maximum belongs to the last bin."""
    df = df.where(finite(column))
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin INT, low DOUBLE, high DOUBLE, n BIGINT")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    counted = df.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def centre_lines(df: DataFrame, column: str) -> DataFrame:
    """CH1: mean and median drawn over the histogram."""
    median = column_quantiles(df, [column], [0.5])[column][0]
    return df.agg(F.avg(column).alias("mean"), F.lit(median).cast("double").alias("median"))


def normal_plot(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """CH2: quantiles of the column against those of a normal distribution."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    found = column_quantiles(df, [column], probs)[column]
    rows = [(p, normal_quantile(p), q) for p, q in zip(probs, found)]
    return df.sparkSession.createDataFrame(rows, "probability DOUBLE, theoretical DOUBLE, observed DOUBLE")


def fitted_line(points: DataFrame, x: str, y: str) -> DataFrame:
    """CH2, CH4: straight line through points and its r."""
    return points.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.sqrt(F.regr_r2(y, x)).alias("abs_r"),
    )


def boxes(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """CH3: box-plot numbers per group, NaN missing; whiskers end at the last reading inside the fences."""
    known = nan_to_null(df.select(group, value), [value]).where(F.col(value).isNotNull())
    quartiles = grouped_quantiles(known, [group], value, [0.25, 0.5, 0.75]).select(
        group, *[F.col("q")[i].alias(name) for i, name in enumerate(["q1", "median", "q3"])]
    )
    step = F.lit(reach) * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - step, F.col("q3") + step)
    return (
        known.join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def strongest_fits(df: DataFrame, features: list[str], target: str, n: int = 4) -> DataFrame:
    """CH4: regression line and r of the n features closest to the target."""
    chosen = [r["feature"] for r in strongest(target_correlations(df, features, target), n).collect()]
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.regr_slope(target, f).alias("slope"),
            F.regr_intercept(target, f).alias("intercept"),
            F.corr(target, f).alias("r"),
        )
        for f in chosen
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def fit_points(
    df: DataFrame, features: list[str], target: str, identity: list[str], points: int = 1000, n: int = 4
) -> DataFrame:
    """CH4: (feature, x, y) of a sample that keeps the distribution of the target, for the n strongest features."""
    chosen = [r["feature"] for r in strongest(target_correlations(df, features, target), n).collect()]
    columns = list(dict.fromkeys([*identity, *chosen, target]))
    sample = stratified_sample(df.select(*columns), target, points, identity)
    wide = sample.select(F.col(target).alias("_y"), *[F.col(f).cast("double").alias(f) for f in chosen])
    return wide.unpivot(["_y"], chosen, "feature", "x").select("feature", "x", F.col("_y").alias("y"))


def information_vs_correlation(information: DataFrame, correlations: DataFrame) -> DataFrame:
    """CH5, JN4"""
    return information.select("feature", "mi_normalized").join(
        correlations.select("feature", F.abs("pearson").alias("abs_r")), "feature"
    ).dropna()


def opening_rows(predictions: DataFrame, order: list[str], n: int = 300) -> DataFrame:
    """CH6: the first n test rows, actual beside predicted."""
    return first_rows(predictions, order, n)


def value_range(predictions: DataFrame, actual: str = "y") -> DataFrame:
    """CH6: ends of the perfect-prediction diagonal."""
    return predictions.agg(F.min(actual).alias("low"), F.max(actual).alias("high"))
