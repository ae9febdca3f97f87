"""Unique, dense row ids without a sequence server."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.joins import join_null_safe
from gridloom.session import settle


def last_id(stored: DataFrame | None, id_col: str = "id") -> int:
    """The largest id in use, 0 for none."""
    return 0 if stored is None else stored.agg(F.max(id_col)).first()[0] or 0


def number_rows(rows: DataFrame, order: list[str], after: int = 0, id_col: str = "id", slices: int | None = None) -> DataFrame:
    """Rows with ids from ``after`` + 1 on, without gaps, in the given order; NULLs come first.

    Rows are range-partitioned into slices (by default the session's shuffle partitions) and settled. A
    slice numbers its own rows; where it starts comes from the sizes of the slices before, a table of
    one row a slice. A place in the input breaks ties, so many rows of one key fill several slices.
    """
    parts = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    ranged = settle(placed.repartitionByRange(parts, *order, "_place").withColumn("_slice", F.spark_partition_id()))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_slice").orderBy(*order, "_place"))
    numbered = ranged.withColumn("_number", number).join(starts, "_slice")
    return numbered.withColumn(id_col, F.lit(after).cast("long") + F.col("_before") + F.col("_number")).drop(
        "_place", "_slice", "_number", "_before"
    )


def with_stable_ids(fresh: DataFrame, stored: DataFrame | None, keys: list[str], last: int, id_col: str = "id") -> DataFrame:
    """Rows of keys that are stored keep their ids, the others are numbered after ``last``; NULL keys are equal."""
    if stored is None:
        return number_rows(fresh, keys, last, id_col)
    known = stored.select(*keys, id_col)
    kept = join_null_safe(fresh, known, keys)
    unseen = join_null_safe(fresh, known.select(*keys), keys, "left_anti")
    return kept.unionByName(number_rows(unseen, keys, last, id_col))
