"""Row repair: missing readings, duplicates, outliers, gaps, and the report on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from gridloom.functions.calendar import epoch_micros
from gridloom.functions.numeric import finite, numeric_columns, percent, present
from gridloom.operators import columns as cols
from gridloom.operators.quantiles import approximate_quantiles, column_quantiles
from gridloom.operators.series import (
    POS,
    SeriesKey,
    drop_halo,
    known_neighbours,
    longest_series,
    look_back_window,
    with_look_back,
    with_positions,
)
from gridloom.schemas import PHYSICAL_LIMITS
from gridloom.session import settle

FILL_LIMIT = 60
IQR_REACH = 1.5
Z_LIMIT = 3.0
FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _between_neighbours(column: str, at: Column) -> Column:
    """Straight line through the known neighbours; the nearest one at the ends."""
    x0, v0 = F.col(f"_prev_{column}.x"), F.col(f"_prev_{column}.v")
    x1, v1 = F.col(f"_next_{column}.x"), F.col(f"_next_{column}.v")
    line = v0 + (v1 - v0) * F.coalesce(F.try_divide((at - x0).cast("double"), (x1 - x0).cast("double")), F.lit(0.0))
    return F.coalesce(F.col(column), line, v0, v1)


def _interpolate(
    df: DataFrame, key: SeriesKey, axis: Column, values: list[str], sizes: tuple[int, int] | None = None
) -> DataFrame:
    filled = known_neighbours(df, key, axis, values, sizes)
    return filled.withColumns({c: _between_neighbours(c, axis) for c in values}).drop(
        *[f"_prev_{c}" for c in values], *[f"_next_{c}" for c in values]
    )


def interpolate_by_time(
    df: DataFrame,
    key: SeriesKey,
    ts_col: str,
    values: list[str] | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """CLN1: time-weighted linear interpolation of every numeric reading."""
    values = values or numeric_columns(df, [*key.entity, *key.order])
    at = "_micros"
    return _interpolate(df.withColumn(at, epoch_micros(ts_col)), key, F.col(at), values, sizes).drop(at)


def interpolate_by_row(df: DataFrame, key: SeriesKey, values: list[str] | None = None) -> DataFrame:
    """CLN2: linear interpolation on row positions."""
    values = values or numeric_columns(df, [*key.entity, *key.order])
    sizes = longest_series(df, key.entity)
    return _interpolate(with_positions(df, key, sizes), key, F.col(POS), values, sizes).drop(POS)


def forward_fill(df: DataFrame, key: SeriesKey, values: list[str], limit: int = FILL_LIMIT) -> DataFrame:
    """CLN3: carry the last known value at most ``limit`` rows."""
    placed = with_look_back(df, key, limit)
    frame = look_back_window(placed, key).rowsBetween(-limit, 0)
    return drop_halo(placed.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in values}))


def fill_missing(
    df: DataFrame, key: SeriesKey, ts_col: str | None, values: list[str] | None = None, strategy: str = "interpolate"
) -> DataFrame:
    """CLN1-CLN4 behind one switch."""
    if strategy == "drop":
        return cols.complete_rows(df)
    if strategy == "forward_fill":
        return forward_fill(df, key, values or [c for c in df.columns if c not in (*key.entity, *key.order)])
    if strategy == "interpolate":
        return interpolate_by_time(df, key, ts_col, values) if ts_col else interpolate_by_row(df, key, values)
    raise ValueError(f"unknown strategy: {strategy}")


def keep_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """CLN5: one row per key, the first in ``order``.

    An ordinary aggregate, so any number of copies of one key shrink to one row per task
    before the shuffle. A NULL order comes first. Fixed-width columns each follow the
    smallest order number, which stays a hash aggregate; otherwise the smallest (order,
    rest) struct is kept. ``order`` should be unique within a key.
    """
    rest = [c for c in df.columns if c not in subset and c not in order]
    fixed = all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in rest)
    if len(order) == 1 and fixed and isinstance(df.schema[order[0]].dataType, T.IntegralType):
        number = F.coalesce(F.col(order[0]).cast("long"), F.lit(-(2**63)))
        firsts = df.groupBy(*subset).agg(*[F.min_by(c, number).alias(c) for c in [*order, *rest]])
        return firsts.select(*df.columns)
    firsts = df.groupBy(*subset).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return firsts.select(*[F.col(c) if c in subset else F.col("_first").getField(c).alias(c) for c in df.columns])


def iqr_fences(
    df: DataFrame, columns: list[str], reach: float = IQR_REACH, exact: bool = True
) -> dict[str, tuple[float, float] | None]:
    """Quartile fences per column; None for a column without values."""
    quantiles = column_quantiles if exact else approximate_quantiles
    fences = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
        fences[c] = None if q1 is None else (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
    return fences


def drop_iqr_outliers(
    df: DataFrame, columns: list[str], reach: float = IQR_REACH, mode: str = "sequential", exact: bool = True
) -> DataFrame:
    """CLN6: keep readings inside the quartile fences, fences included.

    ``sequential`` takes the quartiles of a column from rows that passed the columns
    before it; ``joint`` takes all quartiles from the input in one pass. The fences are
    two numbers per column and enter the plan as literals, so they reach the scan.
    ``exact=False`` takes quartiles with a small bounded rank error in one pass.
    """
    columns = present(df, columns)
    groups = [columns] if mode == "joint" else [[c] for c in columns]
    for group in groups:
        for c, fence in iqr_fences(df, group, reach, exact).items():
            df = df.where(F.col(c).between(*fence) if fence else F.lit(False))
    return df


def drop_zscore_outliers(df: DataFrame, columns: list[str], limit: float = Z_LIMIT) -> DataFrame:
    """CLN7: keep readings closer than ``limit`` population deviations to the mean.

    Mean and deviation are those of the finite readings; rows without one go.
    """
    for c in present(df, columns):
        known = F.when(finite(c), F.col(c))
        mean, std = df.agg(F.avg(known), F.stddev_pop(known)).first()
        inside = finite(c) & (F.abs(F.col(c) - F.lit(mean)) / F.lit(std) < limit) if std else F.lit(False)
        df = df.where(inside)
    return df


def missing_count(df: DataFrame, columns: list[str] | None = None) -> Column:
    """AGG9: NULL cells over the given columns."""
    total = F.lit(0).cast("long")
    for c in columns or df.columns:
        total = total + F.count_if(F.col(c).isNull())
    return total


OUTLIER_COLUMNS = list(PHYSICAL_LIMITS)


def clean_readings(
    df: DataFrame,
    key: SeriesKey,
    ts_col: str,
    values: list[str],
    limits: dict[str, tuple[float, float]] = PHYSICAL_LIMITS,
    outlier_columns: list[str] = OUTLIER_COLUMNS,
    remove_outliers: bool = True,
    grid_gaps: bool = False,
) -> DataFrame:
    """CLN8: interpolate, remove duplicates, apply limits, then quartile fences."""
    cleaned, _ = clean_with_report(df, key, ts_col, values, limits, outlier_columns, remove_outliers, grid_gaps)
    return cleaned


def clean_with_report(
    df: DataFrame,
    key: SeriesKey,
    ts_col: str,
    values: list[str],
    limits: dict[str, tuple[float, float]] = PHYSICAL_LIMITS,
    outlier_columns: list[str] = OUTLIER_COLUMNS,
    remove_outliers: bool = True,
    grid_gaps: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """CLN8 and CLN9: the cleaned rows and a (step, metric, value) report.

    The counts ride along with the jobs that do the work. The repaired rows are settled
    once, because each outlier column needs quartiles of the rows the column before left.
    """
    spark = df.sparkSession
    if grid_gaps:
        df = fill_time_grid(df, key, ts_col)
    rows = F.count(F.lit(1)).alias("rows")
    # measured below the observations, whose counts would keep every column in that scan
    sizes = longest_series(df, key.entity)
    before, filled, deduped = Observation(), Observation(), Observation()
    work = df.observe(before, rows, missing_count(df).alias("missing"))
    work = interpolate_by_time(work, key, ts_col, values, sizes)
    work = work.observe(filled, rows, missing_count(work).alias("missing"))
    work = keep_first(work, [*key.entity, ts_col], [c for c in key.order if c != ts_col])
    work = work.observe(deduped, rows)
    work = settle(cols.within_limits(work, limits))
    in_limits = work.count()
    if remove_outliers:
        work = drop_iqr_outliers(work, outlier_columns)
    final = work.count()

    n0, m0 = before.get["rows"], before.get["missing"]
    n1, m1, n2 = filled.get["rows"], filled.get["missing"], deduped.get["rows"]
    report = [
        ("missing_values", "initial", m0),
        ("missing_values", "final", m1),
        ("missing_values", "removed", m0 - m1),
        ("missing_values", "percentage_cleaned", (1 - m1 / max(m0, 1)) * 100),
        ("duplicates", "removed", n1 - n2),
        ("physical_validation", "initial", n2),
        ("physical_validation", "final", in_limits),
        ("physical_validation", "invalid_removed", n2 - in_limits),
    ]
    if remove_outliers:
        report += [
            ("outliers", "initial_rows", in_limits),
            ("outliers", "final_rows", final),
            ("outliers", "removed", in_limits - final),
            ("outliers", "percentage_removed", (in_limits - final) / max(in_limits, 1) * 100),
        ]
    report += [("total", "initial_rows", n0), ("total", "final_rows", final)]
    table = [(step, metric, float(value)) for step, metric, value in report]
    return work, spark.createDataFrame(table, "step STRING, metric STRING, value DOUBLE")


def quality_profile(df: DataFrame, ts_col: str, values: list[str]) -> DataFrame:
    """One side of the before/after summary as (metric, value), from one aggregate.

    Every column in ``values`` is described; the printed summary named five of them.
    """
    stats = {
        "rows": F.count(F.lit(1)),
        "columns": F.lit(len(df.columns)),
        "first_second": F.min(epoch_micros(ts_col)) / 1e6,
        "last_second": F.max(epoch_micros(ts_col)) / 1e6,
        "missing": missing_count(df),
    }
    for c in values:
        stats |= {
            f"{c}.mean": F.avg(c),
            f"{c}.std": F.stddev_samp(c),
            f"{c}.min": F.min(c),
            f"{c}.max": F.max(c),
            f"{c}.missing": F.count_if(F.col(c).isNull()),
        }
    pairs = [F.struct(F.lit(name).alias("metric"), agg.cast("double").alias("value")) for name, agg in stats.items()]
    return df.agg(F.array(*pairs).alias("m")).select(F.inline("m"))


def before_after_summary(before: DataFrame, after: DataFrame, ts_col: str, values: list[str]) -> DataFrame:
    """CLN10: the two profiles side by side, plus rows removed and quality gained.

    The profile rows (a few per described column) pass through the driver once.
    """
    left = quality_profile(before, ts_col, values).withColumnRenamed("value", "before")
    right = quality_profile(after, ts_col, values).withColumnRenamed("value", "after")
    repeated = duplicate_timestamps(before, [], ts_col).select(
        F.lit("duplicates").alias("metric"),
        F.col("duplicates").cast("double").alias("before"),
        F.lit(None).cast("double").alias("after"),
    )
    joined = left.join(right, "metric", "full")
    both = before.sparkSession.createDataFrame(joined.collect(), joined.schema)
    impact = both.agg(
        F.max(F.when(F.col("metric") == "rows", F.col("before"))).alias("n0"),
        F.max(F.when(F.col("metric") == "rows", F.col("after"))).alias("n1"),
        F.max(F.when(F.col("metric") == "missing", F.col("before"))).alias("m0"),
        F.max(F.when(F.col("metric") == "missing", F.col("after"))).alias("m1"),
    ).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("rows_removed_pct").alias("metric"),
                    F.lit(None).cast("double").alias("before"),
                    percent(F.col("n0") - F.col("n1"), F.col("n0")).alias("after"),
                ),
                F.struct(
                    F.lit("quality_gain_pct").alias("metric"),
                    F.lit(None).cast("double").alias("before"),
                    (F.lit(100.0) * (F.col("m0") - F.col("m1")) / F.greatest(F.col("m0"), F.lit(1.0))).alias("after"),
                ),
            )
        )
    )
    return both.unionByName(repeated).unionByName(impact)


def duplicate_timestamps(df: DataFrame, entity: list[str], ts_col: str) -> DataFrame:
    """AGG10: rows beyond the first per key; NULL keys count as equal."""
    copies = df.groupBy(*entity, ts_col).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def find_gaps(df: DataFrame, key: SeriesKey, ts_col: str, step_seconds: int = 60) -> DataFrame:
    """CLN11: rows that follow a hole, with the number of whole steps missing."""
    placed = with_look_back(df, key, 1)
    seen = placed.withColumn("prev_ts", F.lag(ts_col).over(look_back_window(placed, key)))
    seconds = F.timestamp_diff("SECOND", F.col("prev_ts"), F.col(ts_col))
    return (
        drop_halo(seen)
        .withColumn("gap_seconds", seconds)
        .where(F.col("gap_seconds") > step_seconds)
        .withColumn("missing_steps", (F.ceil(F.col("gap_seconds") / step_seconds) - 1).cast("long"))
    )


def fill_time_grid(df: DataFrame, key: SeriesKey, ts_col: str, step_seconds: int = 60) -> DataFrame:
    """CLN11: add a row of NULL readings for every missing step of the grid.

    Only holes produce rows. A long hole is cut into day-sized pieces that are spread
    over the cluster before their steps are listed.
    """
    step = F.expr(f"INTERVAL '{step_seconds}' SECOND")
    holes = find_gaps(df, key, ts_col, step_seconds).select(
        *key.entity,
        (F.col("prev_ts") + step).alias("_from"),
        (F.col(ts_col) - F.expr("INTERVAL '1' MICROSECOND")).alias("_to"),
    )
    pieces = (
        holes.withColumn("_steps", F.floor(F.timestamp_diff("SECOND", F.col("_from"), F.col("_to")) / step_seconds))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor(F.col("_steps") / 1440).cast("int"))))
        .repartition(*key.by("_from", "_chunk"))
    )
    first = F.col("_chunk") * 1440
    last = F.least(first + 1439, F.col("_steps")).cast("int")
    listed = pieces.withColumn("_n", F.explode(F.sequence(first, last)))
    added = listed.select(
        *key.entity,
        (F.col("_from") + F.make_dt_interval(secs=(F.col("_n") * step_seconds).cast("decimal(18,6)"))).alias(ts_col),
    )
    return df.unionByName(added, allowMissingColumns=True)
