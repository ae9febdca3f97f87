"""Projections, filters, calendar columns, joins, rollups, profiles and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.numeric import clip_low, kw_minutes_to_kwh, numeric_columns, watt_hours_to_kwh
from gridloom.operators import cleaning, columns, profiles, reshape, rollup, selection
from workloads.base import FRAME, READINGS, frame, query, readings, table

METERS = {"click": "Sub_metering_1", "view": "Sub_metering_2", "purchase": "Sub_metering_3"}


def _hours(spark, sf):
    return rollup.hourly_rollup(readings(spark, sf), "household_id", "ts", "value")


HOURS_SQL = f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS BIGINT) AS hour, household_id,
  avg(value) AS avg_power, max(value) AS max_power, min(value) AS min_power,
  sum(value) / 60 AS total_energy, count(*) AS record_count
FROM {READINGS} GROUP BY 1, 2, 3"""

DAYS_SQL = f"""
SELECT date, household_id, sum(total_energy) AS total_energy, avg(avg_power) AS avg_power,
  max(max_power) AS max_power, min(min_power) AS min_power, max(peak) AS peak_hour
FROM (SELECT *, first_value(hour) OVER (PARTITION BY date, household_id ORDER BY avg_power DESC, hour) AS peak
      FROM ({HOURS_SQL}))
GROUP BY 1, 2"""


@query("agg1_hourly_rollup", HOURS_SQL, avg_power=4, total_energy=4)
def _(spark, sf):
    return _hours(spark, sf)


@query("agg2_daily_rollup", DAYS_SQL, avg_power=4, total_energy=4)
def _(spark, sf):
    return rollup.daily_rollup(_hours(spark, sf))


@query("prj1_drop_leaky", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_discount")
    return columns.drop_leaky(lines, ["l_tax", "l_discount", "not_there"])


@query(
    "prj2_numeric_features",
    "SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def _(spark, sf):
    return columns.numeric_features(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("prj3_storage_names", "SELECT event_id, ts_us, value AS global_active_power FROM (SELECT *, epoch_us(ts) AS ts_us FROM events)")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("ts").alias("ts_us"), "value")
    return columns.to_storage_names(events.withColumnRenamed("value", "Global_active_power"))


@query("prj4_keep_present", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    return columns.keep_present(table(spark, sf, "customer"), ["c_custkey", "c_voltage", "c_acctbal"])


@query("flt1_complete_rows", f"SELECT event_id, reading FROM {READINGS} WHERE reading IS NOT NULL")
def _(spark, sf):
    return columns.complete_rows(readings(spark, sf).select("event_id", "reading"))


@query("flt2_within_limits", f"SELECT event_id, reading FROM {READINGS} WHERE reading BETWEEN 0 AND 400")
def _(spark, sf):
    return columns.within_limits(readings(spark, sf).select("event_id", "reading"), {"reading": (0.0, 400.0)})


LIMITS = {"l_quantity": (2.0, 45.0), "l_extendedprice": (1000.0, 60000.0), "l_discount": (0.01, 0.09)}


@query(
    "flt2_limit_violations",
    """
SELECT 'l_quantity' AS rule, count(*) AS invalid FROM lineitem WHERE NOT l_quantity BETWEEN 2 AND 45
UNION ALL SELECT 'l_extendedprice', count(*) FROM lineitem
  WHERE l_quantity BETWEEN 2 AND 45 AND NOT l_extendedprice BETWEEN 1000 AND 60000
UNION ALL SELECT 'l_discount', count(*) FROM lineitem
  WHERE l_quantity BETWEEN 2 AND 45 AND l_extendedprice BETWEEN 1000 AND 60000 AND NOT l_discount BETWEEN 0.01::DOUBLE AND 0.09::DOUBLE""",
)
def _(spark, sf):
    return columns.limit_violations(table(spark, sf, "lineitem"), LIMITS)


@query("flt3_required_columns", "SELECT event_id, value FROM events")
def _(spark, sf):
    checked = columns.require_columns(table(spark, sf, "events"), ["event_id", "value"])
    return columns.keep_present(checked, ["event_id", "value", "voltage"])


@query("flt4_weekdays", "SELECT event_id FROM events WHERE isodow(ts) <= 5")
def _(spark, sf):
    return columns.weekdays(table(spark, sf, "events"), "ts").select("event_id")


@query("flt4_weekends", "SELECT event_id FROM events WHERE isodow(ts) > 5")
def _(spark, sf):
    return columns.weekends(table(spark, sf, "events"), "ts").select("event_id")


@query(
    "flt5_clip_negative",
    f"SELECT event_id, CASE WHEN reading IS NULL THEN NULL ELSE greatest(reading - 50, 0) END AS clipped FROM {READINGS}",
    clipped=4,
)
def _(spark, sf):
    return readings(spark, sf).select("event_id", clip_low(F.col("reading") - 50).alias("clipped"))


CALENDAR_SQL = """
SELECT year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute,
  isodow(ts) - 1 AS dayofweek, dayofyear(ts) AS dayofyear, weekofyear(ts) AS weekofyear, quarter(ts) AS quarter,
  CASE WHEN isodow(ts) > 5 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN isodow(ts) > 5 THEN 0 ELSE 1 END AS is_workday,
  CASE WHEN month(ts) IN (12, 1, 2) THEN 0 WHEN month(ts) <= 5 THEN 1 WHEN month(ts) <= 8 THEN 2 ELSE 3 END AS season,
  CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2 ELSE 3 END AS time_of_day,
  CASE WHEN hour(ts) IN (7, 8, 9) THEN 1 ELSE 0 END AS is_morning_peak,
  CASE WHEN hour(ts) IN (18, 19, 20, 21) THEN 1 ELSE 0 END AS is_evening_peak,
  CASE WHEN hour(ts) = 23 OR hour(ts) <= 6 THEN 1 ELSE 0 END AS is_night, * FROM source"""
PARTS = [
    "year", "month", "day", "hour", "minute", "dayofweek", "dayofyear", "weekofyear", "quarter",
    "is_weekend", "is_workday", "season", "time_of_day", "is_morning_peak", "is_evening_peak", "is_night",
]
PARTS_SQL = ", ".join(f"{p}::BIGINT AS {p}" for p in PARTS)


@query(
    "scl1_calendar_events",
    f"WITH source AS (SELECT event_id, ts FROM events) SELECT event_id, {PARTS_SQL} FROM ({CALENDAR_SQL})",
)
def _(spark, sf):
    return calendar.add_calendar(table(spark, sf, "events"), "ts").select("event_id", *PARTS)


@query(
    "scl2_calendar_shipdates",
    f"""WITH source AS (SELECT l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1)
SELECT epoch_us(ts) AS ts, n, {PARTS_SQL} FROM ({CALENDAR_SQL})""",
)
def _(spark, sf):
    days = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.add_calendar(days, "ts").select("ts", "n", *PARTS)


@query(
    "scl6_cyclic",
    """SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dayofweek_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dayofweek_cos,
  sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos,
  sin(2 * pi() * dayofyear(ts) / 365) AS dayofyear_sin, cos(2 * pi() * dayofyear(ts) / 365) AS dayofyear_cos
FROM events""",
    **{f"{p}_{f}": 9 for p in ("hour", "dayofweek", "month", "dayofyear") for f in ("sin", "cos")},
)
def _(spark, sf):
    circles = [f"{p}_{f}" for p in ("hour", "dayofweek", "month", "dayofyear") for f in ("sin", "cos")]
    return calendar.add_calendar(table(spark, sf, "events"), "ts").select("event_id", *circles)


@query(
    "scl7_date_hour",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, hour(ts)::BIGINT AS hour FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))


@query(
    "scl9_day_names",
    """SELECT event_id, ['Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche'][isodow(ts)] AS day_name
FROM events""",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", calendar.day_name(F.weekday("ts")).alias("day_name"))


@query("scl10_units", "SELECT event_id, value / 1000 AS from_wh, value / 60 AS from_kw FROM events", from_wh=6, from_kw=6)
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        watt_hours_to_kwh(F.col("value")).alias("from_wh"),
        kw_minutes_to_kwh(F.col("value")).alias("from_kw"),
    )


def _households(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("location"))
    return (
        table(spark, sf, "customer")
        .join(nations, "c_nationkey")
        .select(F.col("c_custkey").alias("household_id"), F.col("c_name").alias("name"), "location")
    )


HOUSEHOLDS = """(SELECT c_custkey AS household_id, c_name AS name, n_name AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "jn3_facts_with_household",
    f"""SELECT location, count(*) AS readings, sum(value) AS total FROM {READINGS}
JOIN {HOUSEHOLDS} USING (household_id) GROUP BY 1""",
    total=2,
)
def _(spark, sf):
    joined = rollup.with_household(readings(spark, sf).select("household_id", "value"), _households(spark, sf))
    return joined.groupBy("location").agg(F.count(F.lit(1)).alias("readings"), F.sum("value").alias("total"))


@query(
    "jn3_orphans",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)",
)
def _(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    return rollup.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), seen, "o_custkey")


@query(
    "jn2_peak_hour",
    f"""SELECT date, household_id, hour AS peak_hour FROM ({HOURS_SQL})
QUALIFY row_number() OVER (PARTITION BY date, household_id ORDER BY avg_power DESC, hour) = 1""",
)
def _(spark, sf):
    return _hours(spark, sf).groupBy("date", "household_id").agg(rollup.peak_of_day("hour", "avg_power").alias("peak_hour"))


def wide(spark, sf):
    """Sub-meter readings per household and hour, one column per meter."""
    hours = readings(spark, sf).withColumn("timestamp", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    sums = [F.sum(F.when(F.col("event_type") == kind, F.col("value"))).alias(c) for kind, c in METERS.items()]
    return hours.groupBy("household_id", "timestamp").agg(F.sum("value").alias("Global_active_power"), *sums)


WIDE = f"""(SELECT household_id, date_trunc('hour', ts) AS timestamp, sum(value) AS Global_active_power,
  sum(CASE WHEN event_type = 'click' THEN value END) AS Sub_metering_1,
  sum(CASE WHEN event_type = 'view' THEN value END) AS Sub_metering_2,
  sum(CASE WHEN event_type = 'purchase' THEN value END) AS Sub_metering_3
FROM {READINGS} GROUP BY 1, 2)"""


def measurements(spark, sf):
    firsts = readings(spark, sf).withColumn("timestamp", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return firsts.groupBy("household_id", "timestamp").agg(F.min("event_id").alias("id"))


MEASUREMENTS = f"""(SELECT household_id, date_trunc('hour', ts) AS timestamp, min(event_id) AS id
FROM {READINGS} GROUP BY 1, 2)"""


@query(
    "jn1_measurement_ids",
    f"""SELECT id AS measurement_id, household_id, Global_active_power
FROM {WIDE} JOIN {MEASUREMENTS} USING (household_id, timestamp)""",
    Global_active_power=2,
)
def _(spark, sf):
    joined = reshape.attach_measurement_ids(wide(spark, sf), measurements(spark, sf), ["household_id", "timestamp"], "id")
    return joined.select("measurement_id", "household_id", "Global_active_power")


@query(
    "rsh1_submeters_long",
    f"""WITH j AS (SELECT id AS measurement_id, Sub_metering_1 AS k, Sub_metering_2 AS l, Sub_metering_3 AS c
  FROM {WIDE} JOIN {MEASUREMENTS} USING (household_id, timestamp))
SELECT measurement_id, 'kitchen' AS meter_type, k AS energy_consumed FROM j
UNION ALL SELECT measurement_id, 'laundry', l FROM j
UNION ALL SELECT measurement_id, 'climate', c FROM j""",
    energy_consumed=2,
)
def _(spark, sf):
    return reshape.submeter_rows(wide(spark, sf), measurements(spark, sf), ["household_id", "timestamp"])


@query(
    "rsh2_matrix_long",
    """SELECT l_returnflag, metric, value FROM (
  SELECT l_returnflag, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1)
UNPIVOT (value FOR metric IN (quantity, discount))""",
    value=6,
)
def _(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount")
    )
    return reshape.matrix_long(means, "l_returnflag", ["quantity", "discount"], "metric", "value")


PROFILE_SQL = """SELECT hour(ts)::BIGINT AS hour, avg(value) AS mean, stddev_samp(value) AS std,
  min(value) AS min, max(value) AS max FROM events GROUP BY 1"""


@query("agg3_hourly_profile", PROFILE_SQL, mean=6, std=6)
def _(spark, sf):
    return profiles.hourly_profile(table(spark, sf, "events"), "ts", "value")


@query(
    "agg4_profile_band",
    f"SELECT hour, mean, std, mean - std AS band_low, mean + std AS band_high FROM ({PROFILE_SQL})",
    mean=6, std=6, band_low=6, band_high=6,
)
def _(spark, sf):
    return profiles.profile_band(profiles.hourly_profile(table(spark, sf, "events"), "ts", "value")).drop("min", "max")


@query(
    "agg4_peak_and_low_hour",
    f"""SELECT (SELECT hour FROM ({PROFILE_SQL}) ORDER BY mean DESC, hour LIMIT 1) AS peak_hour,
  (SELECT hour FROM ({PROFILE_SQL}) ORDER BY mean, hour LIMIT 1) AS low_hour,
  max(mean) AS peak_mean, min(mean) AS low_mean FROM ({PROFILE_SQL})""",
    peak_mean=6, low_mean=6,
)
def _(spark, sf):
    return profiles.peak_and_low_hour(profiles.hourly_profile(table(spark, sf, "events"), "ts", "value"))


WEEK_SQL = """SELECT (isodow(ts) - 1)::BIGINT AS day_of_week, avg(value) AS mean, stddev_samp(value) AS std,
  ['Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche'][isodow(ts)] AS day_name
FROM events GROUP BY 1, 4"""


@query("agg5_weekly_profile", WEEK_SQL, mean=6, std=6)
def _(spark, sf):
    return profiles.weekly_profile(table(spark, sf, "events"), "ts", "value")


@query(
    "agg6_weekday_vs_weekend",
    f"""SELECT avg(mean) FILTER (WHERE day_of_week < 5) AS weekday_mean,
  avg(mean) FILTER (WHERE day_of_week >= 5) AS weekend_mean FROM ({WEEK_SQL})""",
    weekday_mean=6, weekend_mean=6,
)
def _(spark, sf):
    return profiles.weekday_vs_weekend(profiles.weekly_profile(table(spark, sf, "events"), "ts", "value"))


def _shares_sql(factor: str) -> str:
    return f"""WITH s AS (SELECT coalesce(sum(Sub_metering_1), 0) / 1000 AS a, coalesce(sum(Sub_metering_2), 0) / 1000 AS b,
  coalesce(sum(Sub_metering_3), 0) / 1000 AS c,
  sum(greatest(Global_active_power * {factor} - (coalesce(Sub_metering_1, 0) + coalesce(Sub_metering_2, 0)
    + coalesce(Sub_metering_3, 0)) / 1000, 0)) AS d FROM {WIDE})
SELECT 'Cuisine (Sub 1)' AS category, a AS energy_kwh, 100 * a / (a + b + c + d) AS share_pct FROM s
UNION ALL SELECT 'Buanderie (Sub 2)', b, 100 * b / (a + b + c + d) FROM s
UNION ALL SELECT 'Chauffage/Clim (Sub 3)', c, 100 * c / (a + b + c + d) FROM s
UNION ALL SELECT 'Autres', d, 100 * d / (a + b + c + d) FROM s"""


@query("agg7_submeter_shares", _shares_sql("1"), energy_kwh=3, share_pct=6)
def _(spark, sf):
    return profiles.submeter_shares(wide(spark, sf))


@query("agg7_submeter_shares_kwh", _shares_sql("(1.0::DOUBLE / 60)"), energy_kwh=3, share_pct=6)
def _(spark, sf):
    return profiles.submeter_shares(wide(spark, sf), power_factor=1 / 60.0)


@query(
    "agg8_dataset_profile",
    f"""WITH r AS (SELECT ts, household_id, event_type, reading FROM {READINGS})
SELECT 'total_rows' AS metric, count(*) AS value FROM r
UNION ALL SELECT 'total_columns', 4
UNION ALL SELECT 'first_us', min(epoch_us(ts)) FROM r UNION ALL SELECT 'last_us', max(epoch_us(ts)) FROM r
UNION ALL SELECT 'missing.ts', count(*) - count(ts) FROM r
UNION ALL SELECT 'missing.household_id', count(*) - count(household_id) FROM r
UNION ALL SELECT 'missing.event_type', count(*) - count(event_type) FROM r
UNION ALL SELECT 'missing.reading', count(*) - count(reading) FROM r
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r))""",
)
def _(spark, sf):
    return profiles.dataset_profile(readings(spark, sf).select("ts", "household_id", "event_type", "reading"), "ts")


@query(
    "agg8_duplicate_rows",
    """SELECT 'duplicates' AS metric, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_shipdate
  FROM lineitem)) AS value FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_shipdate")
    return profiles.dataset_profile(lines, "l_shipdate").where(F.col("metric") == "duplicates")


@query(
    "agg8_column_types",
    f"""SELECT t.column_name, t.data_type, CASE t.column_name WHEN 'reading' THEN (SELECT count(*) - count(reading) FROM {READINGS})
  WHEN 'event_type' THEN (SELECT count(*) - count(event_type) FROM {READINGS}) ELSE 0 END AS missing
FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('household_id', 'bigint'), ('event_type', 'string'),
  ('value', 'double'), ('reading', 'double')) AS t(column_name, data_type)""",
)
def _(spark, sf):
    return profiles.column_types(readings(spark, sf))


@query("agg9_missing_cells", f"SELECT count(*) - count(reading) AS missing FROM {READINGS}")
def _(spark, sf):
    return readings(spark, sf).agg(cleaning.missing_count(readings(spark, sf)).alias("missing"))


@query(
    "agg10_duplicate_times",
    f"""SELECT count(*) - count(DISTINCT (household_id, date_trunc('minute', ts))) AS duplicates FROM {READINGS}""",
)
def _(spark, sf):
    minutes = readings(spark, sf).withColumn("minute", F.date_trunc("minute", "ts"))
    return cleaning.duplicate_timestamps(minutes, ["household_id"], "minute")


@query(
    "agg11_row_counts",
    """SELECT 'households' AS table_name, count(*) AS row_count FROM customer
UNION ALL SELECT 'energy_measurements', count(*) FROM events
UNION ALL SELECT 'predictions', count(*) FROM lineitem""",
)
def _(spark, sf):
    names = {"households": "customer", "energy_measurements": "events", "predictions": "lineitem"}
    return rollup.table_row_counts({k: table(spark, sf, v) for k, v in names.items()})


@query(
    "agg12_seasonal_means",
    """WITH s AS (SELECT CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 0 WHEN month(l_shipdate) <= 5 THEN 1
  WHEN month(l_shipdate) <= 8 THEN 2 ELSE 3 END::BIGINT AS season, l_quantity AS v FROM lineitem),
t AS (SELECT avg(v) AS annual_mean FROM s)
SELECT season, avg(v) AS mean, max(annual_mean) AS annual_mean,
  100 * (avg(v) - max(annual_mean)) / max(annual_mean) AS vs_annual_pct FROM s, t GROUP BY 1""",
    mean=6, annual_mean=6, vs_annual_pct=6,
)
def _(spark, sf):
    return profiles.seasonal_means(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity")


@query(
    "set1_three_way_intersection",
    """SELECT l_partkey AS feature FROM lineitem WHERE l_returnflag = 'A' INTERSECT
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "feature")
    return selection.in_all([lines.where(F.col("l_returnflag") == flag) for flag in "ANR"])


@query(
    "set2_difference",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey"))


@query(
    "srt1_chronological_rank",
    f"""SELECT household_id, event_id, row_number() OVER (PARTITION BY household_id ORDER BY ts, event_id) - 1 AS _pos
FROM {READINGS}""",
)
def _(spark, sf):
    from gridloom.operators.series import with_positions
    from workloads.base import BY_USER

    return with_positions(readings(spark, sf), BY_USER).select("household_id", "event_id", "_pos")


@query(
    "prj2_numeric_names",
    "SELECT count(*) AS n, avg(disc_price) AS mean FROM " + FRAME,
    mean=2,
)
def _(spark, sf):
    lines = frame(spark, sf)
    price = [c for c in numeric_columns(lines) if c.startswith("disc")][0]
    return lines.agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("mean"))


@query(
    "scl3_season",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  (CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 0 WHEN month(l_shipdate) <= 5 THEN 1 WHEN month(l_shipdate) <= 8 THEN 2 ELSE 3 END)::BIGINT
  AS season FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", calendar.season(F.month("l_shipdate")).alias("season"))


@query(
    "scl4_time_of_day",
    """SELECT event_id, (CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2 ELSE 3 END)::BIGINT
  AS time_of_day FROM events""",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", calendar.time_of_day(F.hour("ts")).alias("time_of_day"))


@query(
    "scl5_peak_flags",
    """SELECT (hour(ts) BETWEEN 7 AND 9)::BIGINT AS is_morning_peak, (hour(ts) BETWEEN 18 AND 21)::BIGINT AS is_evening_peak,
  (hour(ts) >= 23 OR hour(ts) <= 6)::BIGINT AS is_night, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3""",
    total=3,
)
def _(spark, sf):
    flags = ["is_morning_peak", "is_evening_peak", "is_night"]
    flagged = calendar.add_calendar(table(spark, sf, "events"), "ts")
    return flagged.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("scl8_text_to_timestamp", "SELECT event_id, epoch_us(ts) AS ts FROM events")
def _(spark, sf):
    from gridloom.sources.logs import restore_timestamp

    text = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    return restore_timestamp(text, "ts")


@query(
    "jn5_known_pairs",
    f"""SELECT count(*) AS n, corr(reading, event_id) AS r FROM {READINGS} WHERE reading IS NOT NULL AND event_id IS NOT NULL""",
    r=8,
)
def _(spark, sf):
    from gridloom.operators.statistics import pearson

    known = columns.complete_rows(readings(spark, sf), ["reading", "event_id"])
    return known.agg(F.count(F.lit(1)).alias("n"), pearson("reading", "event_id").alias("r"))


@query(
    "top4_busiest_hour",
    f"""SELECT household_id, hour AS busiest_hour FROM (
  SELECT household_id, hour(ts)::BIGINT AS hour, count(*) AS n FROM {READINGS} GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY n DESC, hour) = 1""",
)
def _(spark, sf):
    hours = readings(spark, sf).groupBy("household_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("household_id").agg(rollup.peak("hour", "n").alias("busiest_hour"))


@query(
    "set3_union_of_meters",
    f"""SELECT meter_type, count(*) AS n, count(energy_consumed) AS known, sum(energy_consumed) AS total FROM (
  SELECT 'kitchen' AS meter_type, Sub_metering_1 AS energy_consumed FROM {WIDE}
  UNION ALL SELECT 'laundry', Sub_metering_2 FROM {WIDE} UNION ALL SELECT 'climate', Sub_metering_3 FROM {WIDE}) GROUP BY 1""",
    total=2,
)
def _(spark, sf):
    tall = reshape.submeters_long(wide(spark, sf), ["household_id", "timestamp"])
    return tall.groupBy("meter_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("energy_consumed").alias("known"),
        F.sum("energy_consumed").alias("total"),
    )
