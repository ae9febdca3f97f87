"""Joins in which a NULL key matches a NULL key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` of both sides; the right side's keys are dropped.

    Catalyst plans ``<=>`` as an ordinary hash or merge key, so the join shuffles, broadcasts
    and splits skewed partitions like a plain one.
    """
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    renamed = right.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in right.columns])
    same: Column = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_key_{c}" for c in keys])
