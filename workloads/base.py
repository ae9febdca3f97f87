"""Registry, table access and value normalisation for the registered queries.

Readings are played by ``events``: a household is a user, the sequence is ``event_id``,
and an ``error`` event is a missing reading. ``lineitem`` plays the wide numeric frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.calendar import epoch_micros
from gridloom.operators.series import SeriesKey


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

BY_USER = SeriesKey(("household_id",), ("ts", "event_id"))
ONE_SERIES = SeriesKey((), ("ts", "event_id"), plain_rows=0)

READINGS = """(SELECT event_id, ts, user_id AS household_id, event_type, value,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS reading FROM events)"""
FRAME = """(SELECT *, l_extendedprice * (1 - l_discount) AS disc_price FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("household_id"),
        "event_type",
        "value",
        F.when(F.col("event_type") != "error", F.col("value")).alias("reading"),
    )


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumn("disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))


# Means of two-decimal values often end in an exact half, where the last bits of a sum
# would decide how it rounds. This offset lies away from halves and whole numbers.
OFFSET = 0.318309886


def _cut(column: str, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(F.col(column).cast("double") * scale + OFFSET) / F.lit(scale)


def _plain_types(df: DataFrame) -> DataFrame:
    """64-bit integers, doubles, and text or microseconds for dates and times."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            out[f.name] = F.col(f.name).cast("long")
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            out[f.name] = F.col(f.name).cast("double")
        elif isinstance(kind, T.DateType):
            out[f.name] = F.col(f.name).cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = epoch_micros(f.name)
    return df.withColumns(out) if out else df


def query(name: str, sql: str | None = None, **digits: int):
    """Register a query; ``digits`` names the columns cut to decimals on both sides."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = _plain_types(run(spark, sf_dir))
            return df.withColumns({c: _cut(c, d) for c, d in digits.items()}) if digits else df

        text = sql
        if sql and digits:
            rounded = ", ".join(f"floor({c}::DOUBLE * 1e{d} + {OFFSET}::DOUBLE) / 1e{d} AS {c}" for c, d in digits.items())
            text = f"SELECT * REPLACE ({rounded}) FROM ({sql.strip().rstrip(';')}) AS checked"
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(plain, text)
        return run

    return register
