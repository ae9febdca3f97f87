"""Forecast quality, computed in one aggregate per table of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.numeric import percent, ratio

# Goals of the model comparison.
GOALS = {"r2": 0.85, "rmse": 0.15, "mape": 5.0}
TOLERANCES = [0.05, 0.10, 0.15, 0.20]
# Verdicts with the R2 that must be exceeded.
VERDICTS = [("✓ Excellent", 0.90), ("✓ Bon", 0.85)]
LAST_VERDICT = "○ Acceptable"


def r2(y: Column, p: Column) -> Column:
    """EV1"""
    return 1 - ratio(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def rmse(y: Column, p: Column) -> Column:
    """EV2"""
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    """EV3"""
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    """EV4: the small constant keeps an exact zero finite."""
    return F.lit(100.0) * F.avg(F.abs(ratio(y - p, y + F.lit(1e-8))))


def explained_variance_score(y: Column, p: Column) -> Column:
    """EV5"""
    return 1 - ratio(F.var_pop(y - p), F.var_pop(y))


def within(y: Column, p: Column, tolerance: float) -> Column:
    """EV6: percentage of predictions inside the relative tolerance, border included."""
    hit = F.abs(p - y) <= F.lit(tolerance) * F.abs(y)
    return F.lit(100.0) * F.avg(hit.cast("double"))


def evaluate(
    df: DataFrame, by: str = "model_name", actual: str = "y", predicted: str = "y_hat", tolerance: float = 0.1
) -> DataFrame:
    """EV1-EV6 per model. A regression hit is both found and true, so the four hit rates agree."""
    y, p = F.col(actual), F.col(predicted)
    known = df.where(y.isNotNull() & p.isNotNull())
    scores = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        r2(y, p).alias("r2"),
        rmse(y, p).alias("rmse"),
        mae(y, p).alias("mae"),
        mape(y, p).alias("mape"),
        explained_variance_score(y, p).alias("evs"),
        within(y, p, tolerance).alias("accuracy"),
    )
    return scores.withColumns({name: F.col("accuracy") for name in ("precision", "recall", "f1")})


def accuracy_by_tolerance(
    df: DataFrame,
    by: str = "model_name",
    actual: str = "y",
    predicted: str = "y_hat",
    tolerances: list[float] = TOLERANCES,
) -> DataFrame:
    """EV7: all tolerances in one pass."""
    y, p = F.col(actual), F.col(predicted)
    known = df.where(y.isNotNull() & p.isNotNull())
    rows = [
        F.struct(F.lit(t).alias("tolerance"), within(y, p, t).alias("accuracy"), within(y, p, t).alias("f1"))
        for t in tolerances
    ]
    return known.groupBy(by).agg(F.array(*rows).alias("t")).select(by, F.inline("t"))


def compare(scores: DataFrame) -> DataFrame:
    """EV8, EV9: goal flags and the verdict per model."""
    verdict = F.lit(LAST_VERDICT)
    for label, limit in reversed(VERDICTS):
        verdict = F.when(F.col("r2") > limit, label).otherwise(verdict)
    return scores.withColumns(
        {
            "r2_goal": F.col("r2") > GOALS["r2"],
            "rmse_goal": F.col("rmse") < GOALS["rmse"],
            "mape_goal": F.col("mape") < GOALS["mape"],
            "verdict": verdict,
        }
    )


def best_model(scores: DataFrame, by: str = "model_name") -> DataFrame:
    """TOP3"""
    return scores.agg(F.max_by(by, "r2").alias("best_model"), F.max("r2").alias("r2"))


def run_report(scores: DataFrame, train: DataFrame, test: DataFrame, features: int, by: str = "model_name") -> DataFrame:
    """EV10: (section, name, value) with sample counts, scores and the best model."""
    sizes = [
        part.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("dataset").alias("section"), F.lit(name).alias("name"), "value"
        )
        for name, part in (("train_samples", train), ("test_samples", test))
    ]
    both = sizes[0].unionByName(sizes[1])
    total = both.agg(F.sum("value").alias("value")).select(
        F.lit("dataset").alias("section"), F.lit("total_samples").alias("name"), "value"
    )
    width = scores.sparkSession.createDataFrame(
        [("dataset", "n_features", float(features))], "section STRING, name STRING, value DOUBLE"
    )
    metrics = scores.unpivot([by], ["r2", "rmse", "mae", "mape", "accuracy", "f1"], "metric", "value").select(
        F.col(by).alias("section"), F.col("metric").alias("name"), "value"
    )
    best = best_model(scores, by).select(
        F.lit("best_model").alias("section"), F.col("best_model").alias("name"), F.col("r2").alias("value")
    )
    return both.unionByName(total).unionByName(width).unionByName(metrics).unionByName(best)


def prediction_facts(
    df: DataFrame, actual: str = "y", predicted: str = "y_hat", model: str = "model_name"
) -> DataFrame:
    """SNK5: the error columns of the predictions table."""
    error = F.abs(F.col(predicted) - F.col(actual))
    return df.withColumns(
        {
            "predicted_power": F.col(predicted),
            "actual_power": F.col(actual),
            "model_name": F.col(model),
            "error_abs": error,
            "error_pct": percent(error, F.abs(F.col(actual))),
        }
    )


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    """TOP2, CH7: the n largest importances per model; one row per feature goes in."""
    place = F.row_number().over(Window.partitionBy("model_name").orderBy(F.col("importance").desc(), "feature"))
    return importances.withColumn("place", place).where(F.col("place") <= n)
