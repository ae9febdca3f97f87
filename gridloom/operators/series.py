"""Row positions, lags and neighbours inside time series of any length.

A window partitioned by household puts a whole household into one task. That is the
best plan while every household is short, and the wrong one when a single household
holds a large part of the data. So each operator measures the longest series first:

* short series: one shuffle by household, plain windows;
* otherwise the rows are range-partitioned on (household, time, sequence) into slices
  of bounded size, whatever the skew. Per-slice counts and per-slice first/last known
  readings form a small table, whose running totals are joined back to the rows.
  Look-back operators then work on buckets of consecutive positions, each extended by
  a halo: copies of the last rows of the bucket before.

An empty list of entity columns treats the whole table as one series. A NULL entity or
order value is a value like any other on both paths: NULL households form one series,
and NULL times come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gridloom.functions.calendar import epoch_micros
from gridloom.functions.joins import join_null_safe
from gridloom.session import settle

POS = "_pos"
SLICE = "_slice"
BUCKET = "_bucket"
HALO = "_halo"

PLAIN_ROWS = 1_000_000
SLICE_ROWS = 500_000
MAX_SLICES = 20_000
FRAME_LIMIT = 128


@dataclass(frozen=True)
class SeriesKey:
    """What identifies a series and the total order of its rows."""

    entity: tuple[str, ...]
    order: tuple[str, ...]
    plain_rows: int = PLAIN_ROWS
    slice_rows: int = SLICE_ROWS
    max_slices: int = MAX_SLICES

    def by(self, *more: str | Column) -> list[Column]:
        return [F.col(c) if isinstance(c, str) else c for c in (*self.entity, *more)]

    def forward(self, *more: str | Column) -> WindowSpec:
        return _spec(self.by(*more), [F.col(c).asc() for c in self.order])

    def backward(self, *more: str | Column) -> WindowSpec:
        return _spec(self.by(*more), [F.col(c).desc() for c in self.order])


def _spec(by: list[Column], order: list[Column]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)


def _until_now(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def longest_series(df: DataFrame, entity: tuple[str, ...]) -> tuple[int, int]:
    """Total rows and rows of the longest series: one map-side combined count."""
    counts = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("n"))
    total, longest = counts.agg(F.sum("n"), F.max("n")).first()
    return total or 0, longest or 0


def rows_per_slice(df: DataFrame, key: SeriesKey, total: int) -> int:
    """``key.slice_rows``, but enough slices to occupy every core and no more than can be scheduled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(key.slice_rows, -(-total // cores)), -(-total // key.max_slices))


def slice_rows(df: DataFrame, key: SeriesKey, total: int) -> DataFrame:
    """Range-partition the rows and keep the partition number as ``_slice``.

    The result is settled because sampled range borders may move when a task is
    computed again.
    """
    ranged = df.repartitionByRange(-(-total // rows_per_slice(df, key, total)), *key.by(*key.order))
    return settle(ranged.withColumn(SLICE, F.spark_partition_id()))


def number_rows(df: DataFrame, key: SeriesKey, total: int | None = None) -> DataFrame:
    """Add ``_pos``, the 0-based position of a row in its series, without one big sort."""
    if SLICE not in df.columns:
        if total is None:
            total, _ = longest_series(df, key.entity)
        df = slice_rows(df, key, total)
    per_slice = df.groupBy(*key.by(SLICE)).agg(F.count(F.lit(1)).alias("_rows"))
    running = _before(_spec(key.by(), [F.col(SLICE)]))
    offsets = per_slice.select(
        *key.by(SLICE), F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_offset")
    )
    return (
        join_null_safe(df, offsets, [*key.entity, SLICE])
        .withColumn(POS, F.col("_offset") + F.row_number().over(key.forward(SLICE)) - 1)
        .drop("_offset")
    )


def with_positions(df: DataFrame, key: SeriesKey, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``_pos`` by the cheaper of the two ways; keeps ``_slice`` where rows were sliced."""
    total, longest = sizes or longest_series(df, key.entity)
    if longest <= key.plain_rows:
        return df.withColumn(POS, (F.row_number().over(key.forward()) - 1).cast("long"))
    return number_rows(df, key, total)


def with_look_back(
    df: DataFrame, key: SeriesKey, rows: int, sizes: tuple[int, int] | None = None
) -> DataFrame:
    """Prepare a table for windows that look back at most ``rows`` rows.

    Short series stay as they are. Long ones get ``_pos``, ``_bucket`` and ``_halo``. Use
    ``look_back_window`` for the windows and ``drop_halo`` afterwards. ``sizes`` saves
    counting the rows again.
    """
    total, longest = sizes or longest_series(df, key.entity)
    if longest <= key.plain_rows:
        return df
    size = max(4 * rows, min(key.slice_rows, rows_per_slice(df, key, total)))
    numbered = number_rows(df, key, total).drop(SLICE)
    bucket = F.floor(F.col(POS) / size)
    copies = F.when(
        F.col(POS) % size >= size - rows,
        F.array(F.struct(bucket, F.lit(False)), F.struct(bucket + 1, F.lit(True))),
    ).otherwise(F.array(F.struct(bucket, F.lit(False))))
    return (
        numbered.withColumn("_copy", F.explode(copies))
        .withColumn(BUCKET, F.col("_copy").getField("col1"))
        .withColumn(HALO, F.col("_copy").getField("col2"))
        .drop("_copy")
        .repartition(*key.by(BUCKET))
    )


def look_back_window(df: DataFrame, key: SeriesKey) -> WindowSpec:
    """One window, so one exchange and one sort, for every look-back column."""
    return _spec(key.by(BUCKET), [F.col(POS)]) if BUCKET in df.columns else key.forward()


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(POS, BUCKET, HALO) if HALO in df.columns else df.drop(POS)


def lags(df: DataFrame, key: SeriesKey, value: str, offsets: dict[str, int]) -> DataFrame:
    """Columns holding the value of earlier rows; expects ``with_look_back``."""
    return history(df, key, value, offsets, {})


def _running(value: str, spec: WindowSpec) -> Column:
    """Count, mean and squared deviation from the start of the window to the current row."""
    n = F.count(value).over(spec)
    return F.struct(
        n.alias("n"),
        F.coalesce(F.avg(value).over(spec), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(value).over(spec) * n, F.lit(0.0)).alias("dev"),
    )


def _merged(a: str, b: str) -> tuple[Column, Column]:
    """Mean and sample deviation of two disjoint sets of rows; NULL sets are empty."""

    def part(name: str, field: str, empty) -> Column:
        return F.coalesce(F.col(f"{name}.{field}"), F.lit(empty))

    n1, m1, d1 = part(a, "n", 0), part(a, "mean", 0.0), part(a, "dev", 0.0)
    n2, m2, d2 = part(b, "n", 0), part(b, "mean", 0.0), part(b, "dev", 0.0)
    n = n1 + n2
    apart = F.coalesce(F.try_divide((m1 - m2) * (m1 - m2) * n1 * n2, n), F.lit(0.0))
    return F.try_divide(n1 * m1 + n2 * m2, n), F.when(n > 1, F.sqrt((d1 + d2 + apart) / F.when(n > 1, n - 1)))


def history(
    df: DataFrame,
    key: SeriesKey,
    value: str,
    offsets: dict[str, int],
    stats: dict[int, tuple[str, str]],
    shift: int = 1,
    frame_limit: int = FRAME_LIMIT,
) -> DataFrame:
    """Lags by name, and (mean, sample deviation) of the w values that end ``shift`` rows back.

    Expects ``with_look_back``. A frame over w rows costs w steps per row, so it serves
    short windows only. For a long one the positions are cut into blocks of w rows: any w
    consecutive rows are the tail of one block plus the head of the next, and running
    totals from both block ends, merged pairwise, cost the same for every w. Merging means
    and squared deviations (not raw squares) keeps the digits. All columns that look back
    share one window.
    """
    window = look_back_window(df, key)
    group = key.by(BUCKET) if BUCKET in df.columns else key.by()
    blocks = {w: names for w, names in stats.items() if w > frame_limit}
    if blocks and POS not in df.columns:
        df = df.withColumn(POS, (F.row_number().over(key.forward()) - 1).cast("long"))
    for w in blocks:
        block = F.floor(F.col(POS) / w)
        head = _until_now(_spec([*group, block], [F.col(POS).asc()]))
        tail = _until_now(_spec([*group, block], [F.col(POS).desc()]))
        df = df.withColumn(f"_head_{w}", _running(value, head)).withColumn(f"_tail_{w}", _running(value, tail))

    columns = {name: F.lag(value, k).over(window) for name, k in offsets.items()}
    for w, (mean, std) in stats.items():
        if w in blocks:
            ends_block = (F.col(POS) - shift) % w == w - 1
            columns[f"_new_{w}"] = F.lag(f"_head_{w}", shift).over(window)
            columns[f"_old_{w}"] = F.when(~ends_block, F.lag(f"_tail_{w}", w - 1 + shift).over(window))
        else:
            frame = window.rowsBetween(-(shift + w - 1), -shift)
            columns[mean], columns[std] = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
    df = df.withColumns(columns)
    for w, (mean, std) in blocks.items():
        both = _merged(f"_old_{w}", f"_new_{w}")
        df = df.withColumns({mean: both[0], std: both[1]})
    return df.drop(*[f"_{part}_{w}" for w in blocks for part in ("head", "tail", "new", "old")])


def time_history(
    df: DataFrame,
    key: SeriesKey,
    ts_col: str,
    value: str,
    lags_s: dict[str, int],
    stats_s: dict[int, tuple[str, str]],
) -> DataFrame:
    """Lags and trailing statistics by time instead of by row: seconds back, not rows back.

    A lag is the value exactly that many seconds earlier (of several, the last in the series'
    order), NULL if there is none; statistics cover the w seconds before the row's own second.
    Rows are bucketed by time with a halo of the longest reach, so no series is one task.
    """
    reach = max([1, *lags_s.values(), *stats_s])
    size = max(4 * reach, 86_400)
    second = F.floor(epoch_micros(ts_col) / 1_000_000)
    bucket = F.floor(F.col("_second") / size)
    own = F.struct(bucket.alias("b"), F.lit(False).alias("h"))
    following = F.struct((bucket + 1).alias("b"), F.lit(True).alias("h"))
    copies = F.when(F.pmod("_second", F.lit(size)) >= size - reach, F.array(own, following)).otherwise(F.array(own))
    placed = df.withColumn("_second", second).withColumn("_copy", F.explode(copies))
    placed = placed.withColumns({BUCKET: F.col("_copy.b"), HALO: F.col("_copy.h")})
    window = Window.partitionBy(*key.by(BUCKET)).orderBy("_second")
    ranked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(key.order)], F.col(value).alias("v"))
    columns = {name: F.max(ranked).over(window.rangeBetween(-k, -k)).getField("v") for name, k in lags_s.items()}
    for w, (mean, std) in stats_s.items():
        frame = window.rangeBetween(-w, -1)
        columns |= {mean: F.avg(value).over(frame), std: F.stddev_samp(value).over(frame)}
    return placed.withColumns(columns).where(~F.col(HALO)).drop("_second", "_copy", BUCKET, HALO)


def known_neighbours(
    df: DataFrame, key: SeriesKey, axis: Column, values: list[str], sizes: tuple[int, int] | None = None
) -> DataFrame:
    """Add ``_prev_<c>`` and ``_next_<c>``: the nearest known (axis, value) on either side.

    Both directions use growing frames (ascending and descending order); a frame that
    starts at the current row and runs to the end would be quadratic. ``sizes`` saves
    counting the rows again.
    """
    total, longest = sizes or longest_series(df, key.entity)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(axis.alias("x"), F.col(c).alias("v"))) for c in values}
    if longest <= key.plain_rows:
        ahead, back = _until_now(key.forward()), _until_now(key.backward())
        return df.withColumns(
            {f"_prev_{c}": F.last(k, ignorenulls=True).over(ahead) for c, k in known.items()}
            | {f"_next_{c}": F.last(k, ignorenulls=True).over(back) for c, k in known.items()}
        )

    sliced = df if SLICE in df.columns else slice_rows(df, key, total)
    rank = F.struct(*key.order)
    edges = sliced.groupBy(*key.by(SLICE)).agg(
        *[F.max_by(k, F.when(F.col(c).isNotNull(), rank)).alias(f"_last_{c}") for c, k in known.items()],
        *[F.min_by(k, F.when(F.col(c).isNotNull(), rank)).alias(f"_first_{c}") for c, k in known.items()],
    )
    earlier = _before(_spec(key.by(), [F.col(SLICE).asc()]))
    later = _before(_spec(key.by(), [F.col(SLICE).desc()]))
    carried = edges.select(
        *key.by(SLICE),
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_from_{c}") for c in values],
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_to_{c}") for c in values],
    )
    ahead, back = _until_now(key.forward(SLICE)), _until_now(key.backward(SLICE))
    joined = join_null_safe(sliced, carried, [*key.entity, SLICE])
    return joined.withColumns(
        {
            f"_prev_{c}": F.coalesce(F.last(k, ignorenulls=True).over(ahead), F.col(f"_from_{c}"))
            for c, k in known.items()
        }
        | {
            f"_next_{c}": F.coalesce(F.last(k, ignorenulls=True).over(back), F.col(f"_to_{c}"))
            for c, k in known.items()
        }
    ).drop(SLICE, *[f"_from_{c}" for c in values], *[f"_to_{c}" for c in values])
