"""Stored tables as partitioned Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.joins import join_null_safe
from gridloom.operators.columns import require_columns, to_storage_names
from gridloom.operators.reshape import submeter_rows
from gridloom.operators.rollup import merge_by_key
from gridloom.schemas import MEASUREMENT_COLUMNS, stored_schema
from gridloom.session import scratch_scope, settle
from gridloom.sources.ids import last_id, number_rows

FILE_ROWS = 5_000_000
HOUSEHOLD_KEYS = ["name", "location"]


def fit_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the stored types. A value that does not fit fails the job; nothing is lost silently.

    ``split_by_fit`` sets such rows aside first.
    """
    return df.select(*[_fitted(f) for f in schema.fields if f.name in df.columns])


def _fitted(field: T.StructField) -> Column:
    cast = F.col(field.name).try_cast(field.dataType)
    told = F.concat(F.lit(f"{field.name} does not fit {field.dataType.simpleString()}: "), F.col(field.name).cast("string"))
    return F.when(F.col(field.name).isNotNull() & cast.isNull(), F.raise_error(told)).otherwise(cast).alias(field.name)


def split_by_fit(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows whose values all fit the stored types, and the others with ``misfits``, the columns that do not."""
    bad = [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name))
        for f in schema.fields
        if f.name in df.columns
    ]
    told = df.withColumn("misfits", F.array_compact(F.array(*bad)))
    return told.where(F.size("misfits") == 0).drop("misfits"), told.where(F.size("misfits") > 0)


def write_dated(df: DataFrame, path: str, ts_col: str | None = None, mode: str = "overwrite", order: list[str] | None = None) -> None:
    """SNK1: one folder per date. The hint lets AQE split a heavy date and join light ones.

    With an ``order``, rows lie in it inside each file, so that readers skip row groups by its columns.
    """
    dated = df.withColumn("date", F.to_date(ts_col)) if ts_col else df
    dated = dated.hint("rebalance", "date")
    if order:
        dated = dated.sortWithinPartitions("date", *order)
    (
        dated.write.mode(mode)
        .option("maxRecordsPerFile", FILE_ROWS)
        .partitionBy("date")
        .parquet(path)
    )


def write_summary(df: DataFrame, path: str) -> None:
    """SNK1: a result table of a few rows as CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def measurement_rows(readings: DataFrame, household_id: int | Column | None = None) -> DataFrame:
    """SNK2: stamp the household, rename, check and project to the stored columns."""
    stamped = readings
    if household_id is not None:
        value = household_id if isinstance(household_id, Column) else F.lit(household_id)
        stamped = readings.withColumn("household_id", value.cast("long"))
    named = require_columns(to_storage_names(stamped), MEASUREMENT_COLUMNS)
    return named.select(*MEASUREMENT_COLUMNS)


def append_measurements(readings: DataFrame, path: str, household_id: int | None = None) -> None:
    """SNK2: append readings, numbered after the stored ones, and in files by household and time.

    One writer at a time: two appends at once would start from the same id.
    """
    spark, key = readings.sparkSession, ["household_id", "timestamp"]
    with scratch_scope(spark):
        rows = number_rows(measurement_rows(readings, household_id), key, last_id(read_or_none(spark, path)))
        typed = fit_schema(rows, stored_schema("energy_measurements"))
        write_dated(typed.withColumn("created_at", F.current_timestamp()), path, "timestamp", mode="append", order=key)


def append_submeters(readings: DataFrame, measurements: DataFrame, path: str) -> None:
    """RSH1 stored: one row per measurement and meter, linked by household and time."""
    spark = readings.sparkSession
    rows = submeter_rows(readings, measurements, ["household_id", "timestamp"])
    with scratch_scope(spark):
        numbered = number_rows(rows, ["measurement_id", "meter_type"], last_id(read_or_none(spark, path)))
        fit_schema(numbered, stored_schema("sub_meters")).write.mode("append").partitionBy("meter_type").parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def on_dates_of(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored partitions of the fresh rows' dates, chosen while planning.

    There are as many dates as days, so listing them is cheap, and the literal list prunes
    folders where a join might read and shuffle the whole table.
    """
    dates = [r["date"] for r in fresh.select("date").distinct().collect()]
    touched = F.col("date").isin([d for d in dates if d is not None])
    return stored.where(touched | F.col("date").isNull() if None in dates else touched)


def upsert(fresh: DataFrame, path: str, keys: list[str]) -> None:
    """SNK3: replace rows by key in a table partitioned by ``date``.

    Only the touched dates are read and rewritten. They are settled first, since a path
    cannot be overwritten while it is read; dynamic overwrite leaves other dates alone.
    """
    merged = fresh
    existing = read_or_none(fresh.sparkSession, path)
    with scratch_scope(fresh.sparkSession):
        if existing is not None:
            fresh = settle(fresh)
            touched = on_dates_of(existing, fresh)
            merged = settle(merge_by_key(touched.select(*fresh.columns), fresh, keys))
        (
            merged.hint("rebalance", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", FILE_ROWS)
            .partitionBy("date")
            .parquet(path)
        )


def household_rows(new: DataFrame) -> DataFrame:
    """SNK4: one row for each name and location; of several, the one whose other values come first."""
    require_columns(new, HOUSEHOLD_KEYS)
    others = [c for c in new.columns if c not in [*HOUSEHOLD_KEYS, "id"]]
    if not others:
        return new.select(*HOUSEHOLD_KEYS).distinct()
    return new.groupBy(*HOUSEHOLD_KEYS).agg(F.min(F.struct(*others)).alias("_rest")).select(*HOUSEHOLD_KEYS, "_rest.*")


def add_households(new: DataFrame, existing: DataFrame | None) -> DataFrame:
    """SNK4: the dimension with new households added once, numbered after the ones that keep their ids."""
    rows = household_rows(new)
    if existing is None:
        return number_rows(rows, HOUSEHOLD_KEYS)
    unseen = join_null_safe(rows, existing.select(*HOUSEHOLD_KEYS), HOUSEHOLD_KEYS, "left_anti")
    return existing.unionByName(number_rows(unseen, HOUSEHOLD_KEYS, last_id(existing)), allowMissingColumns=True)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """SNK5: append scored rows, one folder per model."""
    typed = fit_schema(predictions, stored_schema("predictions"))
    typed.withColumn("created_at", F.current_timestamp()).write.mode("append").partitionBy("model_name").parquet(path)
