"""Exact quantiles, order statistics and ranks that never gather a column in one task.

``percentile`` keeps every distinct value of a group in one buffer. That is fine for
a bounded number of rows; beyond it the wanted order statistics are found by narrowing:
count the rows in equal-width bins, keep the bin that holds the wanted rank, repeat
inside it. Every pass is a filter with literal limits plus an aggregate of at most
``BINS`` rows per target, and the last pass lists at most ``BINS`` distinct values.
Where many groups are that large, their distinct values are ordered together instead.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.calendar import epoch_micros
from gridloom.functions.joins import join_null_safe
from gridloom.session import settle

BINS = 2048
EXACT_ROWS = 500_000
SMALLEST_STEP = 1e-290
BROADCAST_VALUES = 100_000
#: Up to so many large groups are narrowed by the driver; more of them are ordered together.
MOST_NARROWED = 64


@dataclass(frozen=True)
class _Bracket:
    """Values of one group between two literals, and how many rows they have."""

    group: tuple
    low: float
    high: float
    rows: int


def _bin(value: Column, low, high) -> Column:
    """Monotone bin number; halves keep the width finite for the widest ranges."""
    start = float(low) / 2
    width = (float(high) / 2 - start) / BINS
    if width < SMALLEST_STEP:
        return F.when(value > F.lit(low), 1).otherwise(0)
    position = (value.cast("double") / 2 - F.lit(start)) / F.lit(width)
    return F.least(F.floor(position), F.lit(BINS - 1)).cast("int")


class Located(NamedTuple):
    """An order statistic with the numbers of smaller and of equal rows."""

    value: float
    smaller: int
    equal: int


def order_statistics(
    df: DataFrame,
    group: list[str],
    value: str,
    ranks: dict[tuple, list[int]],
    between: Callable[[float, float], Column] | None = None,
) -> dict[tuple, Located]:
    """Values at 0-based ranks per group: {(group key, rank): located value}.

    ``ranks`` maps a group key to its ranks; groups are few (features, hours, bins).
    Brackets of one group never overlap, so a row takes part in at most one of them.
    ``between`` may state the outer limits on a stored column, so later passes skip files.
    """
    if df.schema[value].dataType.typeName() in ("double", "float"):
        return _among_infinities(df, group, value, ranks, between)
    return _narrowed(df, group, value, ranks, between)


def _among_infinities(
    df: DataFrame, group: list[str], value: str, ranks: dict[tuple, list[int]], between: Callable | None
) -> dict[tuple, Located]:
    """Order statistics of floating values: NaN is missing, the infinities stand at the ends."""
    v = F.col(value)
    finite = F.abs(v) < F.lit(math.inf)
    low, high = F.count_if(v == F.lit(-math.inf)), F.count_if(v == F.lit(math.inf))
    counts = {tuple(r[:-3]): r[-3:] for r in df.groupBy(*group).agg(low, F.count_if(finite), high).collect()}
    found: dict[tuple, Located] = {}
    inner: dict[tuple, list[int]] = {}
    for g, listed in ranks.items():
        below, inside, above = counts[g]
        for rank in listed:
            if rank < below:
                found[(g, rank)] = Located(-math.inf, 0, below)
            elif rank < below + inside:
                inner.setdefault(g, []).append(rank - below)
            else:
                found[(g, rank)] = Located(math.inf, below + inside, above)
    for (g, rank), at in (_narrowed(df.where(finite), group, value, inner, between) if inner else {}).items():
        found[(g, rank + counts[g][0])] = at._replace(smaller=at.smaller + counts[g][0])
    return found


def _narrowed(
    df: DataFrame, group: list[str], value: str, ranks: dict[tuple, list[int]], between: Callable | None
) -> dict[tuple, Located]:
    v = F.col(value)
    between = between or (lambda low, high: v.between(F.lit(low), F.lit(high)))
    spans = {
        tuple(r[:-3]): _Bracket(tuple(r[:-3]), r[-3], r[-2], r[-1])
        for r in df.where(v.isNotNull()).groupBy(*group).agg(F.min(v), F.max(v), F.count(v)).collect()
    }
    wanted = {(g, rank): (spans[g], rank) for g, listed in ranks.items() for rank in listed}
    found: dict[tuple, Located] = {}

    def of_group(g: tuple) -> Column:
        match = F.lit(True)
        for name, part in zip(group, g):
            match = match & F.col(name).eqNullSafe(F.lit(part))
        return match

    def place(number: int, b: _Bracket) -> Column:
        listed = b.rows <= BINS
        return F.when(
            v.between(F.lit(b.low), F.lit(b.high)),
            F.struct(
                F.lit(number).alias("bracket"),
                (F.lit(0) if listed else _bin(v, b.low, b.high)).alias("bin"),
                F.when(F.lit(listed), v).alias("exact"),
            ),
        )

    while True:
        for name in [n for n, (b, _) in wanted.items() if b.low == b.high]:
            bracket, inside = wanted.pop(name)
            found[name] = Located(bracket.low, name[1] - inside, bracket.rows)
        if not wanted:
            return found
        brackets = list(dict.fromkeys(b for b, _ in wanted.values()))
        places = defaultdict(list)
        for i, b in enumerate(brackets):
            places[b.group].append(place(i, b))
        cases = [F.when(of_group(g), F.coalesce(*found_in)) for g, found_in in places.items()]
        # Rows outside every bracket become one group; a filter on the bracket would
        # repeat the expression behind the value once per bracket.
        reach = (min(b.low for b in brackets), max(b.high for b in brackets))
        counted = (
            df.where(between(*reach))
            .select(v.alias("_v"), F.coalesce(*cases).alias("h"))
            .groupBy("h.bracket", "h.bin", "h.exact")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            .collect()
        )
        parts = defaultdict(list)
        for r in counted:
            if r["bracket"] is not None:
                parts[brackets[r["bracket"]]].append((r["low"], r["high"], r["rows"]))
        for name, (b, rank) in wanted.items():
            below = 0
            for low, high, rows in sorted(parts[b]):
                if below + rows > rank:
                    wanted[name] = (_Bracket(b.group, low, high, rows), rank - below)
                    break
                below += rows
            if wanted[name][0] == b:
                raise RuntimeError(f"no progress between {b.low} and {b.high}; does {value} change between passes?")


def _ranks_for(rows: int, probs: list[float]) -> list[int]:
    wanted = set()
    for p in probs:
        at = p * (rows - 1)
        wanted |= {math.floor(at), min(math.floor(at) + 1, rows - 1)}
    return sorted(wanted)


def _interpolated(at: float, low: float, high: float) -> float:
    part = at - math.floor(at)
    if math.isinf(low) or math.isinf(high):
        return low if low == high or not part else (1 - part) * low + part * high
    return low + (high - low) * part


def _narrowed_quantiles(
    df: DataFrame, group: list[str], value: str, counts: dict[tuple, int], probs: list[float]
) -> dict[tuple, list[float] | None]:
    ranks = {g: _ranks_for(n, probs) for g, n in counts.items() if n}
    stats = order_statistics(df, group, value, ranks) if ranks else {}
    found: dict[tuple, list[float] | None] = {}
    for g, n in counts.items():
        found[g] = None
        if n:
            at = [p * (n - 1) for p in probs]
            lows = [float(stats[(g, math.floor(a))].value) for a in at]
            highs = [float(stats[(g, min(math.floor(a) + 1, n - 1))].value) for a in at]
            found[g] = [_interpolated(*ends) for ends in zip(at, lows, highs)]
    return found


def _known(df: DataFrame, column: str) -> Column:
    """The column with NaN as NULL."""
    floating = df.schema[column].dataType.typeName() in ("double", "float")
    return F.when(~F.isnan(column), F.col(column)) if floating else F.col(column)


def _ordered_quantiles(df: DataFrame, group: list[str], value: str, sizes: DataFrame, probs: list[float]) -> DataFrame:
    """Quantiles of all groups in ``sizes`` from one order of their distinct values.

    A value covers the ranks from the rows below it on; the two ranks around each quantile pick their
    values in one map-side combined aggregate, so neither plan nor driver grows with the groups.
    """
    values = ordered_values(df, group, value).withColumn("value", F.col("value").cast("double"))
    ranked = join_null_safe(values, sizes, group)
    # 0-based place of each quantile among the rows of its group
    at = [F.lit(float(p)) * (F.col("rows") - 1) for p in probs]

    def covering(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("value")))

    ends = [
        F.struct(
            covering(F.floor(a)).alias("low"),
            covering(F.least(F.floor(a) + 1, F.col("rows") - 1)).alias("high"),
            F.max(a - F.floor(a)).alias("part"),
        )
        for a in at
    ]

    def between(e: Column) -> Column:
        low, high, part = e["low"], e["high"], e["part"]
        endless = (F.abs(low) == F.lit(math.inf)) | (F.abs(high) == F.lit(math.inf))
        return (
            F.when((low == high) | (part == 0), low)
            .when(endless, (1 - part) * low + part * high)
            .otherwise(low + (high - low) * part)
        )

    picked = ranked.groupBy(*group).agg(F.max("rows").alias("rows"), F.array(*ends).alias("_ends"))
    return picked.select(*group, "rows", F.transform("_ends", between).alias("q"))


def grouped_quantiles(
    df: DataFrame, group: list[str], value: str, probs: list[float], exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """ST2 per group: ``group``, ``rows`` and an array ``q`` of linear-interpolated quantiles.

    NULL and NaN are missing. Groups of at most ``exact_rows`` rows, of which there may be any
    number, use ``percentile``. A few larger ones are narrowed without a shuffle; more than
    ``MOST_NARROWED`` are ordered together, unknown to the driver, in as many jobs as one would take.
    """
    df = df.select(*group, _known(df, value).alias(value))
    sizes = df.groupBy(*group).agg(F.count(value).alias("rows")).where(F.col("rows") > exact_rows)
    large = {tuple(r[:-1]): r[-1] for r in sizes.limit(MOST_NARROWED + 1).collect()}
    rest, many = df, None
    if len(large) > MOST_NARROWED:
        sizes = settle(sizes)
        rest = join_null_safe(df, sizes, group, "left_anti")
        many = join_null_safe(df, sizes, group, "left_semi")
    elif large:
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        keys = df.sparkSession.createDataFrame(list(large), ", ".join(f"`{name}` {types[name]}" for name in group)) if group else None
        rest = join_null_safe(df, keys, group, "left_anti") if group else df.limit(0)
        many = join_null_safe(df, keys, group, "left_semi") if group else df
    exact = rest.groupBy(*group).agg(
        F.count(value).alias("rows"),
        F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("q"),
    )
    if many is None:
        return exact
    if len(large) > MOST_NARROWED:
        return _ordered_quantiles(many, group, value, sizes, probs).unionByName(exact)
    found = _narrowed_quantiles(many, group, value, large, probs)
    schema = ", ".join([f"`{name}` {types[name]}" for name in group] + ["rows BIGINT", "q ARRAY<DOUBLE>"])
    table = df.sparkSession.createDataFrame([(*g, large[g], q) for g, q in found.items()], schema)
    return table.unionByName(exact) if group else table


def column_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], exact_rows: int = EXACT_ROWS
) -> dict[str, list[float | None]]:
    """ST2: the quantiles of several columns, computed together; NULL and NaN are missing."""
    unknown = [None] * len(probs)
    df = df.select(*[_known(df, c).alias(c) for c in dict.fromkeys(columns)])
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(sizes) <= exact_rows:
        grid = F.array(*[F.lit(p) for p in probs])
        row = df.agg(*[F.percentile(c, grid).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else unknown for c in columns}
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    found = _narrowed_quantiles(tall, ["feature"], "value", {(c,): sizes[c] for c in columns}, probs)
    return {c: found[(c,)] or unknown for c in columns}


def approximate_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 10_000) -> dict:
    """ST2 in one pass, with a bounded rank error."""
    row = df.agg(*[F.percentile_approx(c, list(probs), accuracy).alias(c) for c in columns]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}


def _as_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    return epoch_micros(column) if kind.startswith("timestamp") else F.col(column)


def row_at(df: DataFrame, order: list[str], index: int) -> list:
    """The order columns of the row at a 0-based index, found column by column.

    Stops at the first column that leaves a single row, so the list may be shorter.
    """
    rest = df.select(*order)
    boundary: list = []
    for c in order:
        numbered = rest.withColumn("_number", _as_number(rest, c))

        def between(low, high, c=c) -> Column:
            return F.col(c).between(_literal(df, c, low), _literal(df, c, high))

        found = order_statistics(numbered, [], "_number", {(): [index]}, between)[((), index)]
        boundary.append(found.value)
        if found.equal == 1:
            break
        index -= found.smaller
        rest = rest.where(F.col(c) == _literal(df, c, found.value))
    return boundary


def _literal(df: DataFrame, column: str, value) -> Column:
    """The boundary as a literal of the column's own type, so the comparison reaches the scan."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.timestamp_micros(F.lit(value))
    if kind == "timestamp_ntz":
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=value))).cast("timestamp_ntz")
    return F.lit(value)


def before_row(df: DataFrame, order: list[str], boundary: list, missing_first: bool = False) -> Column:
    """True for rows strictly before the boundary in lexicographic order.

    NULL where a missing column would decide, or true with ``missing_first``.
    """
    condition = F.lit(False)
    for c, value in reversed(list(zip(order, boundary))):
        limit = _literal(df, c, value)
        before = F.col(c) < limit
        condition = (F.col(c).isNull() | before if missing_first else before) | ((F.col(c) == limit) & condition)
    return condition


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """SRC5: the first n rows in a total, NULL-free order.

    A limit would collect n rows from every task into one; here the row after the last
    is located first, and the rows before it are an ordinary filter.
    """
    if df.count() <= n:
        return df
    return df.where(before_row(df, order, row_at(df, order, n)))


def small_side(values: DataFrame, distinct: int) -> DataFrame:
    """Broadcast a table of distinct values where their counted number is small."""
    return F.broadcast(values) if distinct <= BROADCAST_VALUES else values


def ordered_values(df: DataFrame, group: list[str], value: str, slices: int | None = None) -> DataFrame:
    """Distinct known values per group with their rows ``n``, the rows ``below`` and their 0-based ``position``.

    Values are counted first, so ties cost nothing. The distinct values of all groups together
    are range-partitioned into ``slices`` (by default the session's shuffle partitions), and
    settled, since sampled borders may move. Running totals inside a slice start from the
    totals of the slices before, a small table, so no group is ordered in one task.
    """
    known = df.select(*group, _known(df, value).alias("value")).where("value is not null")
    counted = known.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    parts = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(counted.repartitionByRange(parts, *group, "value").withColumn("_slice", F.spark_partition_id()))
    totals = ranged.groupBy(*group, "_slice").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_slice",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("values").over(before), F.lit(0)).alias("_values_before"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy("value")
    below = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return join_null_safe(ranged, offsets, [*group, "_slice"]).select(
        *group,
        "value",
        "n",
        (below + F.col("_rows_before")).alias("below"),
        (F.row_number().over(inside) - 1 + F.col("_values_before")).alias("position"),
    )


def value_ranks(df: DataFrame, column: str, slices: int | None = None) -> DataFrame:
    """WIN8: every distinct value with its count, average rank and dense position."""
    values = ordered_values(df, [], column, slices)
    return values.select("value", "n", (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank"), "position")
