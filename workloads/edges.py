"""The same operators where rows lack a household, a date or an order, or hold NaN and infinity,
on the paths for long series and large columns; and checks of whole reports and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import association, charts, cleaning, learning, quantiles, rollup, series, statistics
from gridloom.operators.series import SeriesKey
from gridloom.plans import exploration, features
from gridloom.schemas import READING_COLUMNS, stored_schema
from gridloom.session import scratch_folder
from gridloom.sources import logs, tables
from workloads.analysis import _moments
from workloads.base import FRAME, ONE_SERIES, READINGS, frame, query, readings, table
from workloads.cleaning import _fill_sql, _interpolation_sql
from workloads.windows import _lag_sql, _rolling_digits, _rolling_sql

SOME_NULL = READINGS.replace("user_id AS household_id", "CASE WHEN user_id % 3 <> 0 THEN user_id END AS household_id")
LONG_PATH = SeriesKey(("household_id",), ("ts", "event_id"), plain_rows=0)
USER = "PARTITION BY household_id"


def _unknown_households(spark, sf):
    return readings(spark, sf).withColumn("household_id", F.when(F.col("household_id") % 3 != 0, F.col("household_id")))


@query(
    "cln1_interpolate_null_household",
    f"SELECT event_id, reading FROM ({_interpolation_sql(SOME_NULL, USER, 'epoch_us(ts)')})",
    reading=6,
)
def _(spark, sf):
    out = cleaning.interpolate_by_time(_unknown_households(spark, sf), LONG_PATH, "ts", ["reading"])
    return out.select("event_id", "reading")


@query("cln3_forward_fill_null_household", _fill_sql(USER, 60).replace(READINGS, SOME_NULL))
def _(spark, sf):
    return cleaning.forward_fill(_unknown_households(spark, sf), LONG_PATH, ["reading"]).select("event_id", "reading")


@query("win1_lags_null_household", _lag_sql(USER, [1, 60]).replace(READINGS, SOME_NULL))
def _(spark, sf):
    out = features.add_history(_unknown_households(spark, sf), LONG_PATH, "value", [1, 60], [])
    return out.select("event_id", "target_lag_1", "target_lag_60")


@query("win2_rolling_null_household", _rolling_sql(USER, [60, 360]).replace(READINGS, SOME_NULL), **_rolling_digits([60, 360]))
def _(spark, sf):
    out = features.rolling_features(_unknown_households(spark, sf), LONG_PATH, "reading", [60, 360])
    return out.select("event_id", *_rolling_digits([60, 360]))


@query(
    "win6_row_index_null_household",
    f"SELECT event_id, row_number() OVER ({USER} ORDER BY ts, event_id) - 1 AS _pos FROM {SOME_NULL}",
)
def _(spark, sf):
    return series.with_positions(_unknown_households(spark, sf), LONG_PATH).select("event_id", "_pos")


ODD_VALUES = """(SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE
  WHEN event_id % 89 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 11 <> 0 THEN value END AS v FROM events)"""


def _odd_values(spark, sf):
    """Every seventh value is NaN, every eleventh NULL, a few are infinite."""
    n = F.col("event_id")
    v = F.when(n % 7 == 0, F.lit(float("nan"))).when(n % 97 == 0, F.lit(float("inf"))).when(n % 89 == 0, F.lit(float("-inf")))
    return table(spark, sf, "events").select("event_id", "event_type", v.when(n % 11 != 0, F.col("value")).alias("v"))


@query(
    "st2_quantiles_nan_inf",
    f"""SELECT event_type, count(v) AS rows, quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.9) AS q90
FROM {ODD_VALUES} GROUP BY 1""",
    q10=6, q50=6, q90=6,
)
def _(spark, sf):
    found = quantiles.grouped_quantiles(_odd_values(spark, sf), ["event_type"], "v", [0.1, 0.5, 0.9], exact_rows=0)
    return found.select("event_type", "rows", *[F.col("q")[i].alias(n) for i, n in enumerate(["q10", "q50", "q90"])])


@query(
    "cln6_iqr_nan_inf",
    f"""WITH q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM {ODD_VALUES})
SELECT event_id, v FROM {ODD_VALUES}, q WHERE v BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a)""",
)
def _(spark, sf):
    return cleaning.drop_iqr_outliers(_odd_values(spark, sf), ["v"]).select("event_id", "v")


@query(
    "st1_summary_nan",
    f"""SELECT 'v' AS feature, m AS metric, x AS value FROM (SELECT count(v)::DOUBLE AS count, avg(v) AS mean, min(v) AS min, max(v) AS max,
  quantile_cont(v, 0.5) AS "50%" FROM {ODD_VALUES} WHERE v IS NULL OR isfinite(v)) UNPIVOT (x FOR m IN (count, mean, min, max, "50%"))""",
    value=5,
)
def _(spark, sf):
    finite = _odd_values(spark, sf).where("v is null or isnan(v) or abs(v) < double('Infinity')")
    found = statistics.statistical_summary(finite, ["v"], exact_rows=0)
    return found.where(F.col("metric").isin("count", "mean", "min", "max", "50%"))


@query(
    "src2_nan_text",
    """SELECT event_id::DOUBLE AS Global_intensity, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS Global_active_power FROM events""",
)
def _(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("value").cast("string"))
    fields = {c: F.lit("?") for c in READING_COLUMNS} | {
        "Date": F.lit("1/2/2007"),
        "Time": F.lit("00:00:00"),
        "Global_active_power": text,
        "Global_intensity": F.col("event_id").cast("string"),
    }
    raw = table(spark, sf, "events").select(*[v.alias(k) for k, v in fields.items()])
    return logs.parse_log(raw).select("Global_intensity", "Global_active_power")


def _path(spark) -> str:
    return f"{scratch_folder(spark)}/gridloom-{uuid.uuid4().hex}"


@query("src4_reread_summary", "SELECT event_type AS feature, 'count' AS metric, count(value)::DOUBLE AS value FROM events GROUP BY 1")
def _(spark, sf):
    path = f"{_path(spark)}.csv"
    counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count("value").cast("double").alias("value"))
    tables.write_summary(counted.select("feature", F.lit("count").alias("metric"), "value"), path)
    return logs.read_table(spark, path, numeric=["value"])


@query(
    "snk2_rejected_rows",
    """SELECT event_id, 'avg_power' AS misfit FROM events WHERE value * 1000 >= 99999.9995 AND value IS NOT NULL""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") * 1000).alias("avg_power"))
    _, rejected = tables.split_by_fit(rows, stored_schema("hourly_consumption"))
    return rejected.select("event_id", F.explode("misfits").alias("misfit"))


@query(
    "cln5_null_sequence",
    """SELECT user_id, seq, value FROM (SELECT user_id, value, CASE WHEN event_id % 4 <> 0 THEN event_id END AS seq, event_id FROM events
  WHERE event_id % 4 <> 0 OR event_id % 8 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq NULLS LAST, event_id) = 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events").where("event_id % 4 <> 0 or event_id % 8 = 0")
    kept = events.select("user_id", "value", F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("seq"))
    # a user's rows without a sequence are several; those that have one decide
    first = cleaning.keep_first(kept.where("seq is not null"), ["user_id"], ["seq"])
    lonely = cleaning.keep_first(events.select("user_id", "value", F.lit(None).cast("bigint").alias("seq"), "event_id"), ["user_id"], ["event_id"])
    return rollup.merge_by_key(lonely.drop("event_id"), first, ["user_id"]).select("user_id", "seq", "value")


HOURS = """SELECT {date} AS date, hour(ts)::BIGINT AS hour, {home} AS household_id, count(*) AS record_count, max(value) AS max_power
FROM events {where} GROUP BY 1, 2, 3"""
DATE, HOME = "CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END", "CASE WHEN user_id % 3 <> 0 THEN user_id END"


@query(
    "snk3_upsert_null_date",
    f"""WITH old AS ({HOURS.format(date=DATE, home=HOME, where='')}), fresh AS ({HOURS.format(date=DATE, home=HOME, where="WHERE event_type = 'purchase'")})
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.date IS NOT DISTINCT FROM old.date
  AND f.hour = old.hour AND f.household_id IS NOT DISTINCT FROM old.household_id)""",
)
def _(spark, sf):
    path = _path(spark)
    events = table(spark, sf, "events").withColumns(
        {
            "date": F.when(F.col("event_id") % 5 != 0, F.to_date("ts")),
            "hour": F.hour("ts"),
            "household_id": F.when(F.col("user_id") % 3 != 0, F.col("user_id")),
        }
    )

    def hours(df):
        return df.groupBy(*rollup.HOURLY_KEYS).agg(F.count(F.lit(1)).alias("record_count"), F.max("value").alias("max_power"))

    tables.upsert(hours(events), path, rollup.HOURLY_KEYS)
    tables.upsert(hours(events.where("event_type = 'purchase'")), path, rollup.HOURLY_KEYS)
    return spark.read.parquet(path).select("date", "hour", "household_id", "record_count", "max_power")


@query(
    "snk5_append_predictions",
    """SELECT epoch_us(ts) AS timestamp, user_id AS household_id, round(value, 3)::DOUBLE AS predicted_power, 'last' AS model_name
FROM events UNION ALL SELECT epoch_us(ts), user_id, round(value, 3)::DOUBLE, 'other' FROM events WHERE event_type = 'click'""",
    predicted_power=2,
)
def _(spark, sf):
    path = _path(spark)
    events = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("household_id"),
        F.col("value").alias("predicted_power"),
        F.col("value").alias("actual_power"),
        F.lit(0.0).alias("error_abs"),
        F.lit(0.0).alias("error_pct"),
        "event_type",
    )
    tables.append_predictions(events.withColumn("model_name", F.lit("last")), path)
    tables.append_predictions(events.where("event_type = 'click'").withColumn("model_name", F.lit("other")), path)
    back = spark.read.parquet(path)
    return back.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "household_id", "predicted_power", "model_name")


_CALENDAR_SQL = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "dayofweek": "isodow(ts) - 1",
    "dayofyear": "dayofyear(ts)", "weekofyear": "weekofyear(ts)", "quarter": "quarter(ts)",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END", "is_workday": "CASE WHEN isodow(ts) < 6 THEN 1 ELSE 0 END",
    "season": "(month(ts) % 12) // 3", "time_of_day": "CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2 ELSE 3 END",
    "is_morning_peak": "CASE WHEN hour(ts) BETWEEN 7 AND 9 THEN 1 ELSE 0 END", "is_evening_peak": "CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1 ELSE 0 END",
    "is_night": "CASE WHEN hour(ts) >= 23 OR hour(ts) <= 6 THEN 1 ELSE 0 END",
}
_CIRCLES = [("hour", "hour(ts)", 24), ("dayofweek", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12), ("dayofyear", "dayofyear(ts)", 365)]


def _feature_table_sql() -> str:
    over = "OVER (ORDER BY ts, event_id)"
    parts = [f"({e})::BIGINT AS {n}" for n, e in _CALENDAR_SQL.items()]
    for n, e, period in _CIRCLES:
        parts += [f"{f}(2 * pi() * {e} / {period}) AS {n}_{f}" for f in ("sin", "cos")]
    parts += [f"lag(value, {k}) {over} AS target_lag_{k}" for k in [*features.NEAR_LAGS, *features.FAR_LAGS]]
    for w in features.WINDOWS:
        rows = f"OVER (ORDER BY ts, event_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        parts += [f"avg(value) {rows} AS target_rolling_mean_{w}", f"stddev_samp(value) {rows} AS target_rolling_std_{w}"]
    return f"SELECT event_id, value, {', '.join(parts)} FROM events"


_REAL = [f"{n}_{f}" for n, _, _ in _CIRCLES for f in ("sin", "cos")] + [f"target_rolling_{s}_{w}" for w in features.WINDOWS for s in ("mean", "std")]


@query("plan_feature_table_one_series", _feature_table_sql(), **dict.fromkeys(_REAL, 6))
def _(spark, sf):
    """All 41 columns on one series; a lag longer than the series is left out of the plan and NULL here."""
    log = table(spark, sf, "events").select("event_id", "ts", "value")
    out = features.feature_table(log, ONE_SERIES, "ts", "value", drop_incomplete=False)
    lags = {f"target_lag_{k}": F.lit(None).cast("double") for k in features.lag_offsets(1) if f"target_lag_{k}" not in out.columns}
    return out.withColumns(lags).drop("ts") if lags else out.drop("ts")


_SECOND = "(epoch_us(ts) // 1000000)"


@query(
    "win1_time_lags",
    f"""WITH r AS (SELECT event_id, household_id, value, reading, {_SECOND} AS s FROM {READINGS}),
m AS (SELECT household_id, s // 60 AS minute, max(event_id) AS event_id FROM r GROUP BY 1, 2),
k AS (SELECT r.event_id, r.household_id, r.reading, minute FROM m JOIN r ON r.event_id = m.event_id)
SELECT a.event_id, b.reading AS lag_1h,
  avg(a.reading) OVER (PARTITION BY a.household_id ORDER BY a.minute * 60 RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS mean_1d,
  stddev_samp(a.reading) OVER (PARTITION BY a.household_id ORDER BY a.minute * 60 RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS std_1d
FROM k a LEFT JOIN k b ON a.household_id = b.household_id AND b.minute = a.minute - 60""",
    lag_1h=6, mean_1d=6, std_1d=6,
)
def _(spark, sf):
    log = readings(spark, sf).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    last = log.groupBy("household_id", "minute").agg(F.max_by("reading", "event_id").alias("reading"), F.max("event_id").alias("event_id"))
    key = SeriesKey(("household_id",), ("minute", "event_id"))
    out = series.time_history(last, key, "minute", "reading", {"lag_1h": 3600}, {86400: ("mean_1d", "std_1d")})
    return out.select("event_id", "lag_1h", "mean_1d", "std_1d")


def _t_tail_sql(t: str, dof: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over u = x / (1 + x), on a fixed grid."""
    return f"""(SELECT 2 * sum(w * d) / 3 / 20000 * (1 - max(u0)) FROM (SELECT u0, i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w,
  CASE WHEN u0 + (1 - u0) * i / 20000 >= 1 THEN 0 ELSE exp(lgamma(({dof} + 1) / 2.0::DOUBLE) - lgamma({dof} / 2.0::DOUBLE)
    - 0.5::DOUBLE * ln({dof} * pi()) - ({dof} + 1) / 2.0::DOUBLE * ln(1 + power((u0 + (1 - u0) * i / 20000) / (1 - u0 - (1 - u0) * i / 20000), 2) / {dof}))
    / power(1 - u0 - (1 - u0) * i / 20000, 2) END AS d
  FROM (SELECT abs({t}) / (1 + abs({t})) AS u0), (SELECT unnest(generate_series(0, 20000))::DOUBLE AS i)))"""


@query(
    "st9_p_values",
    " UNION ALL ".join(
        f"""SELECT feature, {_t_tail_sql('t', 'dof')} AS p_value FROM (SELECT '{f}' AS feature, count(*) - 2 AS dof,
  sqrt(power(corr({f}, l_extendedprice), 2) * (count(*) - 2) / (1 - power(corr({f}, l_extendedprice), 2))) AS t FROM {FRAME})"""
        for f in ("l_quantity", "l_discount", "l_tax")
    ),
    p_value=5,
)
def _(spark, sf):
    return statistics.f_test(frame(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("feature", "p_value")


@query(
    "st10_p_value",
    f"""SELECT {_t_tail_sql('t', 'dof')} AS p_value FROM (SELECT n1 + n2 - 2 AS dof, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2)
  / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t FROM (SELECT count(value) FILTER (WHERE isodow(ts) <= 5) AS n1,
  count(value) FILTER (WHERE isodow(ts) > 5) AS n2, avg(value) FILTER (WHERE isodow(ts) <= 5) AS m1, avg(value) FILTER (WHERE isodow(ts) > 5) AS m2,
  var_samp(value) FILTER (WHERE isodow(ts) <= 5) AS v1, var_samp(value) FILTER (WHERE isodow(ts) > 5) AS v2 FROM events))""",
    p_value=5,
)
def _(spark, sf):
    return statistics.weekday_weekend_test(table(spark, sf, "events"), "ts", "value").select("p_value")


@query(
    "st6_kendall_distinct_values",
    """WITH p AS (SELECT p_partkey AS x, p_retailprice AS y FROM part),
s AS (SELECT sum(CASE WHEN a.y < b.y THEN 1 WHEN a.y > b.y THEN -1 ELSE 0 END)::DOUBLE AS s FROM p a JOIN p b ON a.x < b.x),
n AS (SELECT count(*)::DOUBLE AS n FROM p),
ty AS (SELECT sum(c * (c - 1) / 2)::DOUBLE AS t FROM (SELECT count(*) AS c FROM p GROUP BY y))
SELECT s / sqrt(n * (n - 1) / 2 * (n * (n - 1) / 2 - t)) AS r FROM s, n, ty""",
    r=8,
)
def _(spark, sf):
    part = table(spark, sf, "part")
    return association.kendall_pairs(part, [("p_partkey", "p_retailprice")], stripe_rows=100).select("r")


@query(
    "st12_pca_two_of_three",
    f"""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, disc_price) AS b, corr(l_extendedprice, disc_price) AS c FROM {FRAME}),
e AS (SELECT sqrt((2 * a * a + 2 * b * b + 2 * c * c) / 6) AS p, a * b * c AS d FROM r),
h AS (SELECT p, acos(greatest(-1, least(1, 2 * d / (p * p * p) / 2))) / 3 AS phi FROM e)
SELECT k + 1 AS pc, (1 + 2 * p * cos(phi + 2 * pi() * CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END / 3)) / 3 AS variance_explained
FROM h, (SELECT unnest([0, 1, 2])::BIGINT AS k)""",
    variance_explained=7,
)
def _(spark, sf):
    return statistics.explained_variance(frame(spark, sf), ["l_quantity", "l_extendedprice", "disc_price"]).select("pc", "variance_explained")


@query(
    "st14_inflation_of_three",
    f"""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM {FRAME}),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS feature, (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'l_extendedprice', (1 - b * b) / det FROM d
UNION ALL SELECT 'l_tax', (1 - a * a) / det FROM d""",
    vif=7,
)
def _(spark, sf):
    return statistics.variance_inflation(frame(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"]).select("feature", "vif")


@query(
    "ch4_fit_points",
    """SELECT 'l_quantity' AS feature, (SELECT count(*) FROM lineitem) > 0 AS any_rows, true AS inside, true AS enough""",
)
def _(spark, sf):
    """Sample points lie on given rows, and as many as the bins allow are taken."""
    lines = frame(spark, sf)
    points = charts.fit_points(lines, ["l_quantity"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 200)
    known = lines.select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y")).distinct()
    real = points.join(known, ["x", "y"], "left_semi")
    n = points.count()
    return points.groupBy("feature").agg(
        F.lit(True).alias("any_rows"), F.lit(real.count() == n).alias("inside"), F.lit(180 <= n <= 200).alias("enough")
    )


@query("plan_exploration_report", "SELECT unnest(['statistical_summary', 'correlation_matrix', 'histogram']) AS name, unnest([70, 49, 50])::BIGINT AS n FROM (SELECT count(*) AS c FROM events HAVING c > 0)")
def _(spark, sf):
    log = readings(spark, sf)
    wide = log.select("ts", *[(F.col("value") * (i + 1) + F.col("event_id") % (i + 2)).alias(c) for i, c in enumerate(READING_COLUMNS)])
    report = exploration.exploration_report(wide, "ts")
    parts = [report[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("statistical_summary", "correlation_matrix", "histogram")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "plan_selection_report",
    f"""SELECT 'disc_price' AS feature, corr(disc_price, l_extendedprice) AS pearson, true AS ranked FROM {FRAME}
UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice), true FROM {FRAME}""",
    pearson=6,
)
def _(spark, sf):
    report = exploration.selection_report(frame(spark, sf), ["disc_price", "l_tax"], "l_extendedprice")
    weights = report["rf_importance"].select("feature", "importance")
    ranked = report["target_correlations"].join(weights, "feature")
    return ranked.select("feature", "pearson", ((F.col("importance") > 0.5) == (F.col("feature") == "disc_price")).alias("ranked"))


@query("st6_kendall_matrix", "SELECT a AS var1, b AS var2 FROM (SELECT unnest(['l_quantity', 'l_linenumber']) AS a), (SELECT unnest(['l_quantity', 'l_linenumber']) AS b) WHERE (SELECT count(*) FROM lineitem) > 0")
def _(spark, sf):
    found = association.kendall_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"])
    return found.where("r between -1 and 1").select("var1", "var2")


@query("ml1_quick_sample", "SELECT event_type, true AS within FROM events GROUP BY 1")
def _(spark, sf):
    """Each stratum's share is within five deviations of the asked half."""
    events = table(spark, sf, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]
    sample = learning.quick_stratified_sample(events, "event_type", dict.fromkeys(kinds, 0.5))
    sizes = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    taken = sample.groupBy("event_type").agg(F.count(F.lit(1)).alias("k"))
    return sizes.join(taken, "event_type").select("event_type", (F.abs(F.col("k") - F.col("n") / 2) < 2.5 * F.sqrt("n")).alias("within"))


UNSURE = """(SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v, event_id::DOUBLE AS n FROM events)"""


def _unsure(spark, sf, *, infinite: bool = False):
    """NaN for every error, and if asked an infinity for every signup."""
    kind = F.col("event_type")
    value = F.when(kind == "error", F.lit(float("nan")))
    if infinite:
        value = value.when(kind == "signup", F.lit(float("inf")))
    events = table(spark, sf, "events")
    return events.select("event_id", "ts", value.otherwise(F.col("value")).alias("v"), F.col("event_id").cast("double").alias("n"))


@query(
    "st3_pearson_nan",
    " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM {UNSURE} AS k WHERE v IS NOT NULL OR '{a}{b}' = 'nn'" for a in "vn" for b in "vn"),
    r=8,
)
def _(spark, sf):
    return statistics.pearson_matrix(_unsure(spark, sf), ["v", "n"])


@query(
    "st10_two_sample_t_nan",
    f"""WITH g AS (SELECT v, isodow(ts) <= 5 AS a FROM {UNSURE} AS k),
f AS (SELECT count(v) FILTER (WHERE a) AS n1, count(v) FILTER (WHERE NOT a) AS n2, avg(v) FILTER (WHERE a) AS mean1,
  avg(v) FILTER (WHERE NOT a) AS mean2, var_samp(v) FILTER (WHERE a) AS var1, var_samp(v) FILTER (WHERE NOT a) AS var2 FROM g)
SELECT *, n1 + n2 - 2 AS dof, (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)
  * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t_statistic FROM f""",
    mean1=6, mean2=6, var1=5, var2=5, t_statistic=6,
)
def _(spark, sf):
    return statistics.two_sample_t(_unsure(spark, sf), "v", F.weekday("ts") < 5)


@query(
    "st11_normality_nan",
    f"SELECT *, exp(-jarque_bera / 2) AS p_value, exp(-jarque_bera / 2) >= 0.05 AS is_normal FROM ({_moments('v', UNSURE)})",
    jarque_bera=3, p_value=6,
)
def _(spark, sf):
    return statistics.normality(_unsure(spark, sf), ["v"])


@query(
    "cln7_zscore_nan_and_infinity",
    """WITH k AS (SELECT event_id, value FROM events WHERE event_type NOT IN ('error', 'signup'))
SELECT event_id FROM k WHERE abs(value - (SELECT avg(value) FROM k)) / (SELECT stddev_pop(value) FROM k) < 3""",
)
def _(spark, sf):
    return cleaning.drop_zscore_outliers(_unsure(spark, sf, infinite=True), ["v"]).select("event_id")


@query(
    "ml2_split_null_times",
    """WITH k AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events WHERE event_type <> 'error')
SELECT event_id, coalesce(i > floor(n * 0.8::DOUBLE), false) AS tested FROM events LEFT JOIN k USING (event_id)""",
)
def _(spark, sf):
    """Errors have no time; every row is on exactly one side."""
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    train, test = learning.chronological_split(events, ["ts", "event_id"])
    sides = train.withColumn("tested", F.lit(False)).unionByName(test.withColumn("tested", F.lit(True)))
    return sides.select("event_id", "tested")
