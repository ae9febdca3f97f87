"""Row repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import cleaning
from workloads.base import BY_USER, ONE_SERIES, READINGS, query, readings, table


def _interpolation_sql(source: str, partition: str, axis: str, value: str = "reading") -> str:
    back = f"OVER ({partition} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER ({partition} ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""SELECT * REPLACE (coalesce({value}, v0 + (v1 - v0) * coalesce((x - x0)::DOUBLE / nullif(x1 - x0, 0), 0), v0, v1) AS {value})
FROM (SELECT *, last_value(CASE WHEN {value} IS NOT NULL THEN x END IGNORE NULLS) {back} AS x0,
  last_value({value} IGNORE NULLS) {back} AS v0,
  first_value(CASE WHEN {value} IS NOT NULL THEN x END IGNORE NULLS) {ahead} AS x1,
  first_value({value} IGNORE NULLS) {ahead} AS v1
  FROM (SELECT *, {axis} AS x FROM {source}))"""


USER = "PARTITION BY household_id"
MICROS = "epoch_us(ts)"
ROW = "row_number() OVER (PARTITION BY household_id ORDER BY ts, event_id)"
ROW_ONE = "row_number() OVER (ORDER BY ts, event_id)"


@query(
    "cln1_interpolate_by_household",
    f"SELECT event_id, reading FROM ({_interpolation_sql(READINGS, USER, MICROS)})",
    reading=6,
)
def _(spark, sf):
    return cleaning.interpolate_by_time(readings(spark, sf), BY_USER, "ts", ["reading"]).select("event_id", "reading")


@query(
    "cln1_interpolate_one_series",
    f"SELECT event_id, reading FROM ({_interpolation_sql(READINGS, '', MICROS)})",
    reading=6,
)
def _(spark, sf):
    return cleaning.interpolate_by_time(readings(spark, sf), ONE_SERIES, "ts", ["reading"]).select("event_id", "reading")


@query(
    "cln2_interpolate_by_row",
    f"SELECT event_id, reading FROM ({_interpolation_sql(READINGS, USER, ROW)})",
    reading=6,
)
def _(spark, sf):
    return cleaning.interpolate_by_row(readings(spark, sf), BY_USER, ["reading"]).select("event_id", "reading")


@query(
    "cln2_interpolate_by_row_one_series",
    f"SELECT event_id, reading FROM ({_interpolation_sql(READINGS, '', ROW_ONE)})",
    reading=6,
)
def _(spark, sf):
    return cleaning.interpolate_by_row(readings(spark, sf), ONE_SERIES, ["reading"]).select("event_id", "reading")


@query(
    "win5_known_neighbours",
    f"""SELECT event_id, last_value(reading IGNORE NULLS) OVER ({USER} ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_known,
  first_value(reading IGNORE NULLS) OVER ({USER} ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_known FROM {READINGS}""",
)
def _(spark, sf):
    from gridloom.functions.calendar import epoch_micros
    from gridloom.operators.series import known_neighbours

    out = known_neighbours(readings(spark, sf), BY_USER, epoch_micros("ts"), ["reading"])
    return out.select(
        "event_id", F.col("_prev_reading.v").alias("prev_known"), F.col("_next_reading.v").alias("next_known")
    )


def _fill_sql(partition: str, limit: int) -> str:
    return f"""SELECT event_id, last_value(reading IGNORE NULLS) OVER ({partition} ORDER BY ts, event_id
  ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW) AS reading FROM {READINGS}"""


@query("cln3_forward_fill", _fill_sql(USER, 60))
def _(spark, sf):
    return cleaning.forward_fill(readings(spark, sf), BY_USER, ["reading"]).select("event_id", "reading")


@query("win4_forward_fill_one_series", _fill_sql("", 2))
def _(spark, sf):
    return cleaning.forward_fill(readings(spark, sf), ONE_SERIES, ["reading"], 2).select("event_id", "reading")


@query("cln4_drop_missing", f"SELECT event_id, reading FROM {READINGS} WHERE reading IS NOT NULL")
def _(spark, sf):
    rows = readings(spark, sf).select("event_id", "ts", "household_id", "reading")
    return cleaning.fill_missing(rows, BY_USER, "ts", strategy="drop").select("event_id", "reading")


@query(
    "cln5_keep_first",
    f"""SELECT household_id, epoch_us(date_trunc('minute', ts)) AS minute, event_id, value FROM {READINGS}
QUALIFY row_number() OVER (PARTITION BY household_id, date_trunc('minute', ts) ORDER BY event_id) = 1""",
)
def _(spark, sf):
    minutes = readings(spark, sf).select(
        "household_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "event_id", "value"
    )
    return cleaning.keep_first(minutes, ["household_id", "minute"], ["event_id"])


def _fence(column: str, source: str) -> str:
    return f"""SELECT s.* FROM {source} s, (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3
  FROM {source}) WHERE {column} BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)"""


@query("cln6_iqr_one_column", f"SELECT event_id, value FROM ({_fence('value', 'events')})")
def _(spark, sf):
    return cleaning.drop_iqr_outliers(table(spark, sf, "events").select("event_id", "value"), ["value"])


LINES = """(SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity * l_quantity AS size2,
  l_extendedprice * l_quantity AS load FROM lineitem)"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") * F.col("l_quantity")).alias("size2"),
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("load"),
    )


@query(
    "cln6_iqr_sequential",
    f"WITH src AS {LINES}, a AS ({_fence('load', 'src')}) {_fence('size2', 'a')}",
    load=2,
)
def _(spark, sf):
    return cleaning.drop_iqr_outliers(_lines(spark, sf), ["load", "not_there", "size2"])


@query(
    "cln6_iqr_joint",
    f"""WITH src AS {LINES}, q AS (SELECT quantile_cont(load, 0.25) AS a1, quantile_cont(load, 0.75) AS a3,
  quantile_cont(size2, 0.25) AS b1, quantile_cont(size2, 0.75) AS b3 FROM src)
SELECT src.* FROM src, q WHERE load BETWEEN a1 - 1.5::DOUBLE * (a3 - a1) AND a3 + 1.5::DOUBLE * (a3 - a1)
  AND size2 BETWEEN b1 - 1.5::DOUBLE * (b3 - b1) AND b3 + 1.5::DOUBLE * (b3 - b1)""",
    load=2,
)
def _(spark, sf):
    return cleaning.drop_iqr_outliers(_lines(spark, sf), ["load", "size2"], mode="joint")


@query(
    "cln7_zscore",
    f"""SELECT event_id, reading FROM {READINGS}, (SELECT avg(reading) AS m, stddev_pop(reading) AS s FROM {READINGS})
WHERE abs(reading - m) / s < 3""",
)
def _(spark, sf):
    return cleaning.drop_zscore_outliers(readings(spark, sf).select("event_id", "reading"), ["reading"])


LIMITS = {"reading": (0.0, 400.0)}
CLEAN_SQL = f"""WITH filled AS ({_interpolation_sql(READINGS, USER, MICROS)}),
firsts AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY household_id, ts ORDER BY event_id) = 1),
valid AS (SELECT * FROM firsts WHERE reading BETWEEN 0 AND 400),
cleaned AS ({_fence('reading', 'valid')})"""


def _log(spark, sf):
    return readings(spark, sf).select("event_id", "ts", "household_id", "reading")


@query("cln8_clean_all", f"{CLEAN_SQL} SELECT event_id, household_id, reading FROM cleaned", reading=6)
def _(spark, sf):
    out = cleaning.clean_readings(_log(spark, sf), BY_USER, "ts", ["reading"], LIMITS, ["reading"])
    return out.select("event_id", "household_id", "reading")


@query(
    "cln9_cleaning_report",
    f"""{CLEAN_SQL}, n AS (SELECT (SELECT count(*) FROM filled) AS n0, (SELECT count(*) FROM firsts) AS n1,
  (SELECT count(*) FROM valid) AS n2, (SELECT count(*) FROM cleaned) AS n3,
  (SELECT count(*) - count(reading) FROM {READINGS}) AS m0, (SELECT count(*) - count(reading) FROM filled) AS m1)
SELECT step, metric, value::DOUBLE AS value FROM (
SELECT 'missing_values' AS step, 'initial' AS metric, m0::DOUBLE AS value FROM n
UNION ALL SELECT 'missing_values', 'final', m1 FROM n UNION ALL SELECT 'missing_values', 'removed', m0 - m1 FROM n
UNION ALL SELECT 'missing_values', 'percentage_cleaned', (1 - m1::DOUBLE / greatest(m0, 1)) * 100 FROM n
UNION ALL SELECT 'duplicates', 'removed', n0 - n1 FROM n
UNION ALL SELECT 'physical_validation', 'initial', n1 FROM n UNION ALL SELECT 'physical_validation', 'final', n2 FROM n
UNION ALL SELECT 'physical_validation', 'invalid_removed', n1 - n2 FROM n
UNION ALL SELECT 'outliers', 'initial_rows', n2 FROM n UNION ALL SELECT 'outliers', 'final_rows', n3 FROM n
UNION ALL SELECT 'outliers', 'removed', n2 - n3 FROM n
UNION ALL SELECT 'outliers', 'percentage_removed', 100.0::DOUBLE * (n2 - n3) / n2 FROM n
UNION ALL SELECT 'total', 'initial_rows', n0 FROM n UNION ALL SELECT 'total', 'final_rows', n3 FROM n)""",
    value=6,
)
def _(spark, sf):
    return cleaning.clean_with_report(_log(spark, sf), BY_USER, "ts", ["reading"], LIMITS, ["reading"])[1]


@query(
    "cln10_before_after",
    f"""{CLEAN_SQL}, b AS (SELECT 'before' AS side, event_id, ts, household_id, reading FROM {READINGS}
  UNION ALL SELECT 'after', event_id, ts, household_id, reading FROM cleaned),
p AS (SELECT side, count(*)::DOUBLE AS n, min(epoch_us(ts)) / 1e6 AS f, max(epoch_us(ts)) / 1e6 AS l,
  (count(*) - count(reading))::DOUBLE AS miss, avg(reading) AS mean, stddev_samp(reading) AS std,
  min(reading) AS lo, max(reading) AS hi FROM b GROUP BY 1),
x AS (SELECT * FROM p WHERE side = 'before'), y AS (SELECT * FROM p WHERE side = 'after')
SELECT 'rows' AS metric, x.n AS before, y.n AS after FROM x, y UNION ALL SELECT 'columns', 4, 4
UNION ALL SELECT 'first_second', x.f, y.f FROM x, y UNION ALL SELECT 'last_second', x.l, y.l FROM x, y
UNION ALL SELECT 'missing', x.miss, y.miss FROM x, y UNION ALL SELECT 'reading.mean', x.mean, y.mean FROM x, y
UNION ALL SELECT 'reading.std', x.std, y.std FROM x, y UNION ALL SELECT 'reading.min', x.lo, y.lo FROM x, y
UNION ALL SELECT 'reading.max', x.hi, y.hi FROM x, y UNION ALL SELECT 'reading.missing', x.miss, y.miss FROM x, y
UNION ALL SELECT 'duplicates', (SELECT count(*) - count(DISTINCT ts) FROM events), NULL
UNION ALL SELECT 'rows_removed_pct', NULL, 100 * (x.n - y.n) / x.n FROM x, y
UNION ALL SELECT 'quality_gain_pct', NULL, 100 * (x.miss - y.miss) / greatest(x.miss, 1) FROM x, y""",
    before=4, after=4,
)
def _(spark, sf):
    log = _log(spark, sf)
    cleaned = cleaning.clean_readings(log, BY_USER, "ts", ["reading"], LIMITS, ["reading"])
    return cleaning.before_after_summary(log, cleaned.select(*log.columns), "ts", ["reading"])


GAPS = f"""(SELECT household_id, ts, lag(ts) OVER (PARTITION BY household_id ORDER BY ts, event_id) AS prev_ts FROM {READINGS})"""


@query(
    "cln11_gaps",
    f"""SELECT household_id, epoch_us(ts) AS ts, (epoch_us(ts) - epoch_us(prev_ts)) // 1000000 AS gap_seconds,
  (ceil(((epoch_us(ts) - epoch_us(prev_ts)) // 1000000)::DOUBLE / 86400) - 1)::BIGINT AS missing_steps
FROM {GAPS} WHERE (epoch_us(ts) - epoch_us(prev_ts)) // 1000000 > 86400""",
)
def _(spark, sf):
    gaps = cleaning.find_gaps(readings(spark, sf), BY_USER, "ts", 86400)
    return gaps.select("household_id", "ts", "gap_seconds", "missing_steps")



@query(
    "cln11_fill_grid",
    f"""WITH h AS (SELECT DISTINCT household_id, date_trunc('hour', ts) AS ts FROM {READINGS}),
g AS (SELECT household_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1)
SELECT g.household_id, epoch_us(g.ts) AS ts, h.ts IS NOT NULL AS observed FROM g LEFT JOIN h USING (household_id, ts)""",
)
def _(spark, sf):
    from gridloom.operators.series import SeriesKey

    hours = readings(spark, sf).select("household_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    grid = cleaning.fill_time_grid(hours.withColumn("observed", F.lit(True)), SeriesKey(("household_id",), ("ts",)), "ts", 3600)
    return grid.withColumn("observed", F.coalesce("observed", F.lit(False)))
