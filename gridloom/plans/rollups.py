"""Readings to stored rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.joins import join_null_safe
from gridloom.operators.rollup import DAILY_KEYS, HOURLY_KEYS, daily_rollup, hourly_rollup, table_row_counts
from gridloom.schemas import stored_schema
from gridloom.session import scratch_scope, settle
from gridloom.sources.ids import last_id, with_stable_ids
from gridloom.sources.tables import append_measurements, fit_schema, on_dates_of, read_or_none, upsert


def _numbered(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rollup rows with the ids of the stored rows they replace, new keys numbered after all stored ones."""
    stored = read_or_none(rows.sparkSession, path)
    return with_stable_ids(rows, None if stored is None else on_dates_of(stored, rows), keys, last_id(stored))


def refresh_rollups(measurements: DataFrame, hourly_path: str, daily_path: str) -> None:
    """Upsert the hours of the given measurements, then the days of those hours."""
    spark = measurements.sparkSession
    with scratch_scope(spark):
        made = settle(hourly_rollup(measurements))
        hours = settle(fit_schema(_numbered(made, hourly_path, HOURLY_KEYS), stored_schema("hourly_consumption")))
        upsert(hours, hourly_path, HOURLY_KEYS)
        stored = on_dates_of(spark.read.parquet(hourly_path), hours)
        fresh = hours.select("date", "household_id").distinct()
        touched = join_null_safe(stored, fresh, ["date", "household_id"], "left_semi")
        days = fit_schema(_numbered(settle(daily_rollup(touched)), daily_path, DAILY_KEYS), stored_schema("daily_consumption"))
        upsert(days, daily_path, DAILY_KEYS)


def store_and_roll_up(spark: SparkSession, readings: DataFrame, folder: str, household_id: int | None = None) -> DataFrame:
    """Append readings, refresh both rollups on their dates, and count the stored rows."""
    paths = {name: f"{folder}/{name}" for name in ("energy_measurements", "hourly_consumption", "daily_consumption")}
    append_measurements(readings, paths["energy_measurements"], household_id)
    stored = spark.read.parquet(paths["energy_measurements"])
    touched = on_dates_of(stored, readings.select(F.to_date("timestamp").alias("date")))
    if household_id is not None:
        touched = touched.where(F.col("household_id") == household_id)
    refresh_rollups(touched, paths["hourly_consumption"], paths["daily_consumption"])
    return table_row_counts({name: spark.read.parquet(path) for name, path in paths.items()})
