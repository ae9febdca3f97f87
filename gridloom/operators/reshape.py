"""Wide to long and back, and the link from readings to stored measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.operators.columns import require_columns
from gridloom.schemas import METER_TYPES


def submeters_long(df: DataFrame, ids: list[str], meters: dict[str, str] = METER_TYPES) -> DataFrame:
    """RSH1, SET3: one row per reading and meter; missing values keep their row."""
    require_columns(df, [*ids, *meters])
    renamed = df.select(*ids, *[F.col(c).alias(label) for c, label in meters.items()])
    return renamed.unpivot(ids, list(meters.values()), "meter_type", "energy_consumed")


def attach_measurement_ids(readings: DataFrame, measurements: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """JN1: readings with the id of the stored measurement at the same key."""
    return readings.join(measurements.select(*keys, F.col(id_col).alias("measurement_id")), keys, "inner")


def submeter_rows(readings: DataFrame, measurements: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """JN1 then RSH1: the rows of the sub_meters table."""
    return submeters_long(attach_measurement_ids(readings, measurements, keys, id_col), ["measurement_id"])


def matrix_long(df: DataFrame, id_col: str, columns: list[str], name: str, value: str) -> DataFrame:
    """RSH2"""
    return df.unpivot([id_col], columns, name, value)
