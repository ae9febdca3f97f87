"""Projections, filters and schema checks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.numeric import numeric_columns, present
from gridloom.schemas import LEAKY_COLUMNS, PHYSICAL_LIMITS, STORAGE_NAMES


def drop_leaky(df: DataFrame, leaky: list[str] = LEAKY_COLUMNS) -> DataFrame:
    """PRJ1: remove columns that reveal the target."""
    return df.drop(*present(df, leaky))


def numeric_features(df: DataFrame, exclude: list[str]) -> DataFrame:
    """PRJ2: numeric columns outside the exclusion list."""
    return df.select(*numeric_columns(df, exclude))


def to_storage_names(df: DataFrame, names: dict[str, str] = STORAGE_NAMES) -> DataFrame:
    """PRJ3"""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def keep_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """PRJ4: the wanted columns that exist."""
    return df.select(*present(df, wanted))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """FLT3: fail before planning when a column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """FLT1, CLN4: rows without any NULL."""
    return df.dropna("any", subset=columns)


def _limit_rules(df: DataFrame, limits: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: F.col(c).between(low, high) for c, (low, high) in limits.items() if c in df.columns}


def within_limits(df: DataFrame, limits: dict[str, tuple[float, float]] = PHYSICAL_LIMITS) -> DataFrame:
    """FLT2: rows inside every limit, ends included; a NULL reading fails."""
    rules = _limit_rules(df, limits)
    return df.where(reduce(and_, rules.values())) if rules else df


def limit_violations(df: DataFrame, limits: dict[str, tuple[float, float]] = PHYSICAL_LIMITS) -> DataFrame:
    """FLT2: rows removed per column when the limits apply one after the other.

    Each row counts against the first limit it breaks, so one pass gives the same
    numbers as filtering column by column.
    """
    rules = _limit_rules(df, limits)
    earlier_hold: list[Column] = []
    counts = []
    for name, rule in rules.items():
        broken = ~F.coalesce(rule, F.lit(False))
        first_break = reduce(and_, [*earlier_hold, broken])
        counts.append(F.count_if(first_break).alias(name))
        earlier_hold.append(F.coalesce(rule, F.lit(False)))
    spark = df.sparkSession
    if not counts:
        return spark.createDataFrame([], "rule STRING, invalid BIGINT")
    return df.agg(*counts).unpivot([], list(rules), "rule", "invalid")


def weekdays(df: DataFrame, ts_col: str) -> DataFrame:
    """FLT4"""
    return df.where(F.weekday(ts_col) < 5)


def weekends(df: DataFrame, ts_col: str) -> DataFrame:
    return df.where(F.weekday(ts_col) >= 5)
