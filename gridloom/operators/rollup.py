"""Hourly and daily consumption tables, built from readings and kept up to date by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.joins import join_null_safe
from gridloom.functions.numeric import kw_minutes_to_kwh

HOURLY_KEYS = ["date", "hour", "household_id"]
DAILY_KEYS = ["date", "household_id"]


def hourly_rollup(
    df: DataFrame, household: str = "household_id", ts_col: str = "timestamp", power: str = "global_active_power"
) -> DataFrame:
    """AGG1: power and energy per household and hour; combines on the map side."""
    return df.groupBy(
        F.to_date(ts_col).alias("date"), F.hour(ts_col).alias("hour"), F.col(household).alias("household_id")
    ).agg(
        F.avg(power).alias("avg_power"),
        F.max(power).alias("max_power"),
        F.min(power).alias("min_power"),
        kw_minutes_to_kwh(F.sum(power)).alias("total_energy"),
        F.count(F.lit(1)).alias("record_count"),
    )


def peak(of: str, by: str) -> Column:
    """JN2, TOP4: the hour with the largest value; the earlier hour wins a tie."""
    return F.max_by(of, F.struct(F.col(by), -F.col(of)))


def trough(of: str, by: str) -> Column:
    return F.min_by(of, F.struct(F.col(by), F.col(of)))


def peak_of_day(hour: str, by: str) -> Column:
    """JN2 for hours 0 to 23: the first of 24 slots that equals the largest.

    Plain maxima stay a hash aggregate, where an argmax over a struct would need a sort.
    """
    slots = F.array(*[F.max(F.when(F.col(hour) == h, F.col(by))) for h in range(24)])
    return (F.array_position(slots, F.array_max(slots)) - 1).cast("int")


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """AGG2: days from hours. ``avg_power`` is the plain mean of the hourly means."""
    return hourly.groupBy(*DAILY_KEYS).agg(
        F.sum("total_energy").alias("total_energy"),
        F.avg("avg_power").alias("avg_power"),
        F.max("max_power").alias("max_power"),
        F.min("min_power").alias("min_power"),
        peak_of_day("hour", "avg_power").alias("peak_hour"),
    )


def merge_by_key(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """JN6, SNK3: fresh rows replace existing rows of the same key; NULL keys are equal."""
    kept = join_null_safe(existing, fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)


def with_household(facts: DataFrame, households: DataFrame, key: str = "household_id") -> DataFrame:
    """JN3: Catalyst broadcasts the dimension while it is small enough."""
    return facts.join(households, key, "inner")


def orphans(facts: DataFrame, households: DataFrame, key: str = "household_id") -> DataFrame:
    """JN3: facts without a household."""
    return facts.join(households.select(key), key, "left_anti")


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG11"""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    result = counted[0]
    for more in counted[1:]:
        result = result.unionAll(more)
    return result
