"""Logs, stored tables and streams; files go to the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import rollup
from gridloom.plans.rollups import store_and_roll_up
from gridloom.schemas import LOG_COLUMNS
from gridloom.session import scratch_folder
from gridloom.sources import logs, tables
from gridloom.streaming import rollup as streams
from workloads.base import READINGS, query, readings, table
from workloads.basics import HOURS_SQL, MEASUREMENTS, WIDE, measurements, wide


def _folder(spark) -> str:
    return f"{scratch_folder(spark)}/gridloom-{uuid.uuid4().hex}"


def _log_rows(spark, sf):
    """Events written the way the meter log is: text fields, ``?`` and blanks for missing."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    fields = {
        "Date": F.date_format("ts", "d/M/yyyy"),
        "Time": F.date_format("ts", "HH:mm:ss"),
        "Global_active_power": F.when(kind == "error", "?").otherwise(value),
        "Global_reactive_power": F.when(kind == "signup", "").otherwise(value),
        "Voltage": F.when(kind == "view", "n/a").otherwise(value),
        "Global_intensity": F.col("event_id").cast("string"),
        "Sub_metering_1": value,
        "Sub_metering_2": F.lit("0.000"),
        "Sub_metering_3": F.lit("?"),
    }
    return table(spark, sf, "events").select(*[fields[c].alias(c) for c in LOG_COLUMNS])


LOG_SQL = """SELECT epoch_us(date_trunc('second', ts)) AS timestamp,
  CASE WHEN event_type <> 'error' THEN value END AS Global_active_power,
  CASE WHEN event_type <> 'signup' THEN value END AS Global_reactive_power,
  CASE WHEN event_type <> 'view' THEN value END AS Voltage, event_id::DOUBLE AS Global_intensity,
  value AS Sub_metering_1, 0.0::DOUBLE AS Sub_metering_2, NULL::DOUBLE AS Sub_metering_3 FROM events"""


@query("src1_read_log", LOG_SQL)
def _(spark, sf):
    path = _folder(spark)
    _log_rows(spark, sf).write.option("sep", ";").option("header", True).csv(path)
    return logs.read_log(spark, path)


@query("src2_parse_text", LOG_SQL)
def _(spark, sf):
    return logs.parse_log(_log_rows(spark, sf))


@query("src3_fallback_to_cleaned", f"SELECT epoch_us(ts) AS timestamp, event_id, reading FROM {READINGS} WHERE reading IS NOT NULL")
def _(spark, sf):
    path = _folder(spark)
    readings(spark, sf).select(F.col("ts").alias("timestamp"), "event_id", "reading").write.parquet(path)
    return logs.read_readings(spark, f"{path}-absent.txt", path)


@query("src4_reread_table", "SELECT epoch_us(ts) AS timestamp, value FROM events")
def _(spark, sf):
    path = f"{_folder(spark)}.csv"
    table(spark, sf, "events").select(F.col("ts").cast("string").alias("timestamp"), "value").write.option(
        "header", True
    ).csv(path)
    return logs.read_table(spark, path, numeric=["value"])


@query("src5_first_rows", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 700")
def _(spark, sf):
    return logs.read_first(table(spark, sf, "events"), ["ts", "event_id"], 700).select("event_id", "value")


@query("snk1_write_dated", "SELECT event_id, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events")
def _(spark, sf):
    path = _folder(spark)
    tables.write_dated(table(spark, sf, "events").select("event_id", "ts", "value"), path, "ts")
    return spark.read.parquet(path).select("event_id", "value", "date")


@query(
    "snk2_append_measurements",
    """SELECT user_id AS household_id, epoch_us(ts) AS timestamp, value AS global_active_power,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events""",
    global_active_power=3,
)
def _(spark, sf):
    path = _folder(spark)
    stored = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("household_id"),
        F.col("value").alias("Global_active_power"),
        F.lit(0.0).alias("Global_reactive_power"),
        F.lit(240.0).alias("Voltage"),
        F.lit(1.0).alias("Global_intensity"),
    )
    tables.append_measurements(stored, path)
    return spark.read.parquet(path).select(
        "household_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "global_active_power", "date"
    )


@query(
    "snk2_measurement_ids",
    """WITH parts AS (SELECT user_id AS household_id, epoch_us(ts) AS timestamp, event_type = 'purchase' AS later FROM events)
SELECT household_id, timestamp, row_number() OVER (ORDER BY later, household_id, timestamp) AS id FROM parts""",
)
def _(spark, sf):
    """Two appends: the second is numbered after the first, which keeps its ids."""
    path = _folder(spark)
    kind = F.col("event_type")
    for part in (kind != "purchase", kind == "purchase"):
        log = table(spark, sf, "events").where(part).select(
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("user_id").alias("household_id"),
            F.col("value").alias("Global_active_power"),
            F.lit(0.0).alias("Global_reactive_power"),
            F.lit(240.0).alias("Voltage"),
            F.lit(1.0).alias("Global_intensity"),
        )
        tables.append_measurements(log, path)
    return spark.read.parquet(path).select("household_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "id")


@query(
    "snk4_household_ids",
    """WITH h AS (SELECT DISTINCT c_name AS name, n_name AS location FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT name, location, row_number() OVER (ORDER BY location >= 'J', name, location) AS id FROM h""",
)
def _(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("location"))
    customers = table(spark, sf, "customer").join(nations, "c_nationkey").select(F.col("c_name").alias("name"), "location")
    some = tables.add_households(customers.where(F.col("location") < "J"), None)
    return tables.add_households(customers, some).select("name", "location", "id")


@query(
    "snk2_append_submeters",
    f"""WITH j AS (SELECT id AS measurement_id, Sub_metering_1 AS k, Sub_metering_2 AS l, Sub_metering_3 AS c
  FROM {WIDE} JOIN {MEASUREMENTS} USING (household_id, timestamp))
SELECT measurement_id, 'kitchen' AS meter_type, k AS energy_consumed FROM j
UNION ALL SELECT measurement_id, 'laundry', l FROM j
UNION ALL SELECT measurement_id, 'climate', c FROM j""",
    energy_consumed=2,
)
def _(spark, sf):
    path = _folder(spark)
    tables.append_submeters(wide(spark, sf), measurements(spark, sf), path)
    return spark.read.parquet(path).select("measurement_id", "meter_type", "energy_consumed")


FRESH_SQL = HOURS_SQL.replace("GROUP BY 1, 2, 3", "WHERE event_type = 'purchase' GROUP BY 1, 2, 3")


def _hours(log):
    return rollup.hourly_rollup(log, "household_id", "ts", "value")


@query(
    "jn6_merge_by_key",
    f"""WITH old AS ({HOURS_SQL}), fresh AS ({FRESH_SQL})
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.date = old.date AND f.hour = old.hour AND f.household_id = old.household_id)""",
    avg_power=4, total_energy=4,
)
def _(spark, sf):
    log = readings(spark, sf)
    return rollup.merge_by_key(_hours(log), _hours(log.where(F.col("event_type") == "purchase")), rollup.HOURLY_KEYS)


@query(
    "snk3_upsert_rollup",
    f"""WITH old AS ({HOURS_SQL}), fresh AS ({FRESH_SQL})
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.date = old.date AND f.hour = old.hour AND f.household_id = old.household_id)""",
    avg_power=4, total_energy=4,
)
def _(spark, sf):
    path = _folder(spark)
    log = readings(spark, sf)
    tables.upsert(_hours(log), path, rollup.HOURLY_KEYS)
    tables.upsert(_hours(log.where(F.col("event_type") == "purchase")), path, rollup.HOURLY_KEYS)
    return spark.read.parquet(path).select(
        "date", "hour", "household_id", "avg_power", "max_power", "min_power", "total_energy", "record_count"
    )


@query(
    "snk4_add_households",
    "SELECT c_name AS name, n_name AS location FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def _(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("location"))
    customers = table(spark, sf, "customer").join(nations, "c_nationkey").select(F.col("c_name").alias("name"), "location")
    some = tables.add_households(customers.where(F.col("location") < "J"), None)
    return tables.add_households(customers, some).select("name", "location")


@query("plan_store_and_roll_up", """SELECT 'energy_measurements' AS table_name, count(*) AS row_count FROM events
UNION ALL SELECT 'hourly_consumption', count(*) FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) FROM events)
UNION ALL SELECT 'daily_consumption', count(*) FROM (SELECT DISTINCT user_id, date_trunc('day', ts) FROM events)""")
def _(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("household_id"),
        F.col("value").alias("Global_active_power"),
        F.lit(0.0).alias("Global_reactive_power"),
        F.lit(240.0).alias("Voltage"),
        F.lit(1.0).alias("Global_intensity"),
    )
    return store_and_roll_up(spark, log, _folder(spark))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("str1_streaming_rollup", HOURS_SQL, avg_power=4, total_energy=4)
def _(spark, sf):
    folder = _folder(spark)
    hours = streams.hourly_stream(_event_stream(spark, sf), "user_id", "ts", "value")
    streams.keep_hourly_table(hours, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select(
        "date", "hour", "household_id", "avg_power", "max_power", "min_power", "total_energy", "record_count"
    )


@query("str2_streaming_checks", "SELECT event_id, value FROM events WHERE value BETWEEN 0 AND 400")
def _(spark, sf):
    folder = _folder(spark)
    checked = streams.checked_stream(_event_stream(spark, sf), ["user_id"], "ts", {"value": (0.0, 400.0)})
    (
        checked.select("event_id", "value")
        .writeStream.format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("event_id BIGINT, value DOUBLE").parquet(f"{folder}/table")


@query(
    "str2_first_of_stream",
    """WITH e AS (SELECT event_id, user_id, value, date_trunc('hour', ts) AS slot FROM events)
SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM e
WHERE slot <= (SELECT max(slot) FROM e) - INTERVAL 2 HOUR GROUP BY user_id, slot""",
)
def _(spark, sf):
    folder = _folder(spark)
    slots = _event_stream(spark, sf).select("user_id", F.date_trunc("hour", "ts").alias("slot"), "event_id", "value")
    (
        streams.first_of_stream(slots, ["user_id"], "slot", ["event_id"])
        .select("user_id", "event_id", "value")
        .writeStream.format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("user_id BIGINT, event_id BIGINT, value DOUBLE").parquet(f"{folder}/table")
