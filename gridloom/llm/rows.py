"""Kept columns travel through an operator as one struct, so that no name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW = "_row"


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def with_row(df: DataFrame, keep: tuple[str, ...] | list[str], **columns: Column) -> DataFrame:
    """A struct of the ``keep`` columns beside the named columns that the operator reads."""
    columns_kept = [named(c) for c in dict.fromkeys(keep)]
    return df.select(F.struct(*columns_kept).alias(ROW), *(c.alias(name) for name, c in columns.items()))


def row_schema(df: DataFrame, more: str) -> T.StructType:
    """The schema of that struct and of the columns in ``more``."""
    return T.StructType([df.schema[ROW], *T.StructType.fromDDL(more).fields])


def opened(df: DataFrame) -> DataFrame:
    """The kept columns again, then the others; of two of one name the operator's own stays."""
    made = [c for c in df.columns if c != ROW]
    kept = [c for c in df.schema[ROW].dataType.names if c not in made]
    return df.select(*(F.col(ROW)[c].alias(c) for c in kept), *made)
