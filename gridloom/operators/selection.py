"""Feature selection by agreement of several criteria."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def above_median(table: DataFrame, score: str) -> DataFrame:
    """Rows whose score exceeds the median score; the table holds one row per feature."""
    return table.where(F.col(score) > table.agg(F.median(score)).scalar())


def in_all(tables: list[DataFrame], column: str = "feature") -> DataFrame:
    """SET1"""
    return reduce(DataFrame.intersect, [t.select(column) for t in tables])


def consensus_features(
    correlations: DataFrame, information: DataFrame, importances: DataFrame, minimum_r: float = 0.5
) -> DataFrame:
    """ST15: features that correlate, inform and matter, with their evidence.

    Inputs: (feature, pearson), (feature, mi_score), (feature, importance).
    """
    agreed = in_all(
        [
            correlations.where(F.abs("pearson") > minimum_r),
            above_median(information, "mi_score"),
            above_median(importances, "importance"),
        ]
    )
    evidence = correlations.select("feature", "pearson").join(information.select("feature", "mi_score"), "feature")
    return agreed.join(evidence.join(importances.select("feature", "importance"), "feature"), "feature")


def pair_advice(pairs: DataFrame, importances: DataFrame) -> DataFrame:
    """ST16: which feature of each redundant pair to keep; the first wins a tie."""
    first = importances.select(F.col("feature").alias("var1"), F.col("importance").alias("importance1"))
    second = importances.select(F.col("feature").alias("var2"), F.col("importance").alias("importance2"))
    keep_first = F.col("importance1") >= F.col("importance2")
    return (
        pairs.join(first, "var1")
        .join(second, "var2")
        .withColumn("keep", F.when(keep_first, F.col("var1")).otherwise(F.col("var2")))
        .withColumn("drop", F.when(keep_first, F.col("var2")).otherwise(F.col("var1")))
    )
