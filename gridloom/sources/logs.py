"""Reading meter logs and intermediate files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.numeric import nan_to_null
from gridloom.operators.quantiles import first_rows
from gridloom.schemas import LOG_SCHEMA, READING_COLUMNS

DAY_FIRST = "d/M/yyyy HH:mm:ss"


def _log_reader(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(LOG_SCHEMA)
        .option("sep", ";")
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "?")
        .csv(path)
    )


def parse_log(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SRC1, SRC2, SCL8: merge date and time (day first); text that is no number, NaN included, becomes NULL."""
    stamp = F.concat_ws(" ", F.trim("Date"), F.trim("Time"))
    parsed = raw.select(
        F.try_to_timestamp(stamp, F.lit(DAY_FIRST)).cast("timestamp_ntz").alias("timestamp"),
        *[F.trim(c).try_cast("double").alias(c) for c in READING_COLUMNS],
        *(keep or []),
    )
    return nan_to_null(parsed, READING_COLUMNS)


# Columns that put the rows of a log in file order.
FILE_ORDER = ["file", "block", "line"]


def read_log(spark: SparkSession, path: str, file_order: bool = False) -> DataFrame:
    """SRC1: the raw ``;`` log with ``?`` for missing readings.

    ``file_order`` adds the columns of FILE_ORDER: the file, where its split starts, and a
    number that grows inside the split. They decide which of two copies came first.
    """
    raw = _log_reader(spark, path)
    if not file_order:
        return parse_log(raw)
    placed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return parse_log(placed, FILE_ORDER)


def read_readings(spark: SparkSession, raw_path: str, cleaned_path: str) -> DataFrame:
    """SRC3: the raw log, or the cleaned table where there is no log; complete rows."""
    try:
        found = read_log(spark, raw_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = read_table(spark, cleaned_path, numeric=READING_COLUMNS)
    return found.dropna()


def read_table(
    spark: SparkSession, path: str, ts_col: str = "timestamp", numeric: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """SRC4: an intermediate table; a text timestamp becomes a real one.

    A CSV file holds text. Its ``numeric`` columns become numbers, NULL where they hold none;
    the others stay as they are.
    """
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        df = df.select(
            *[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns]
        )
    else:
        df = spark.read.parquet(path)
    return restore_timestamp(df, ts_col)


def restore_timestamp(df: DataFrame, ts_col: str) -> DataFrame:
    if ts_col in df.columns and isinstance(df.schema[ts_col].dataType, T.StringType):
        return df.withColumn(ts_col, F.col(ts_col).try_cast("timestamp_ntz"))
    return df


def read_first(df: DataFrame, order: list[str], n: int = 100_000) -> DataFrame:
    """SRC5"""
    return first_rows(df, order, n)
