"""Rollups and cleaning over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.columns import within_limits
from gridloom.operators.rollup import HOURLY_KEYS
from gridloom.sources.tables import upsert

LATENESS = "2 hours"


def hourly_stream(readings: DataFrame, household: str, ts_col: str, power: str, lateness: str = LATENESS) -> DataFrame:
    """STR1: the hourly rollup with bounded state; watermarks need a zoned timestamp."""
    stamped = readings.withColumn("_ts", F.col(ts_col).cast("timestamp"))
    return (
        stamped.withWatermark("_ts", lateness)
        .groupBy(F.window("_ts", "1 hour"), F.col(household).alias("household_id"))
        .agg(
            F.avg(power).alias("avg_power"),
            F.max(power).alias("max_power"),
            F.min(power).alias("min_power"),
            (F.sum(power) / 60.0).alias("total_energy"),
            F.count(F.lit(1)).alias("record_count"),
        )
        .select(
            F.to_date("window.start").alias("date"),
            F.hour("window.start").alias("hour"),
            "household_id",
            "avg_power",
            "max_power",
            "min_power",
            "total_energy",
            "record_count",
        )
    )


def keep_hourly_table(rollup: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """STR1: upsert every changed hour; update mode also reports hours still open."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, table_path, HOURLY_KEYS)

    return (
        rollup.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def checked_stream(
    readings: DataFrame, entity: list[str], ts_col: str, limits: dict, lateness: str = LATENESS
) -> DataFrame:
    """STR2: readings inside their limits, one per household and time."""
    stamped = within_limits(readings, limits).withColumn("_ts", F.col(ts_col).cast("timestamp"))
    watermarked = stamped.withWatermark("_ts", lateness)
    return watermarked.dropDuplicatesWithinWatermark([*entity, "_ts"]).drop("_ts")


def first_of_stream(
    readings: DataFrame, entity: list[str], ts_col: str, order: list[str], lateness: str = LATENESS
) -> DataFrame:
    """STR2: per household and time the reading that comes first in ``order``, whenever it arrives.

    For append mode. State is one row per household and time; it leaves once the watermark has passed that time, so
    the result is CLN5's on all rows that are not later than ``lateness``. A NULL order comes first, and of
    rows with equal order the one with the least other columns. Rows without a time go, since no watermark
    ever passes them.
    """
    given = readings.columns
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in given if c not in order])
    stamped = readings.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(entity)], F.col(ts_col).cast("timestamp").alias("_ts"), whole.alias("_row")
    ).where("_ts is not null")
    firsts = stamped.withWatermark("_ts", lateness).groupBy(*[f"_key{i}" for i in range(len(entity))], "_ts").agg(F.min("_row").alias("_row"))
    return firsts.select(*[F.col("_row")[c].alias(c) for c in given])
