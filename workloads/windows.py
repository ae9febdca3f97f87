"""Positions, lags, trailing statistics and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import quantiles, series, statistics
from gridloom.plans import features
from workloads.base import BY_USER, ONE_SERIES, READINGS, query, readings, table


def _lag_sql(partition: str, offsets: list[int]) -> str:
    over = f"OVER ({partition} ORDER BY ts, event_id)"
    lags = ", ".join(f"lag(value, {k}) {over} AS target_lag_{k}" for k in offsets)
    return f"SELECT event_id, {lags} FROM {READINGS}"


def _rolling_sql(partition: str, windows: list[int], shift: int = 1) -> str:
    parts = []
    for w in windows:
        over = f"OVER ({partition} ORDER BY ts, event_id ROWS BETWEEN {shift + w - 1} PRECEDING AND {shift} PRECEDING)"
        parts.append(f"avg(reading) {over} AS target_rolling_mean_{w}, stddev_samp(reading) {over} AS target_rolling_std_{w}")
    return f"SELECT event_id, {', '.join(parts)} FROM {READINGS}"


def _rolling_digits(windows: list[int]) -> dict[str, int]:
    return {f"target_rolling_{s}_{w}": 6 for w in windows for s in ("mean", "std")}


USER = "PARTITION BY household_id"
SHORT = [1, 2, 3, 5, 10, 60]


@query("win1_lags_by_household", _lag_sql(USER, SHORT))
def _(spark, sf):
    out = features.lag_features(readings(spark, sf), BY_USER, "value")
    return out.select("event_id", *[f"target_lag_{k}" for k in SHORT])


@query("win1_lags_one_series", _lag_sql("", [*features.NEAR_LAGS, *features.FAR_LAGS]))
def _(spark, sf):
    """A lag longer than the series is left out of the plan; as a column it would be NULL."""
    out = features.lag_features(readings(spark, sf), ONE_SERIES, "value")
    names = [f"target_lag_{k}" for k in features.lag_offsets(1)]
    return out.select("event_id", *[F.col(n) if n in out.columns else F.lit(None).cast("double").alias(n) for n in names])


@query("win1_lags_horizon_60", _lag_sql(USER, [60]))
def _(spark, sf):
    out = features.lag_features(readings(spark, sf), BY_USER, "value", horizon=60)
    return out.select("event_id", "target_lag_60")


@query("win2_rolling_by_household", _rolling_sql(USER, [60, 360, 1440]), **_rolling_digits([60, 360, 1440]))
def _(spark, sf):
    out = features.rolling_features(readings(spark, sf), BY_USER, "reading")
    return out.select("event_id", *_rolling_digits([60, 360, 1440]))


@query("win3_rolling_one_series", _rolling_sql("", [60, 360, 1440]), **_rolling_digits([60, 360, 1440]))
def _(spark, sf):
    out = features.rolling_features(readings(spark, sf), ONE_SERIES, "reading")
    return out.select("event_id", *_rolling_digits([60, 360, 1440]))


@query("win3_rolling_horizon_30", _rolling_sql("", [60, 360, 1440], 30), **_rolling_digits([60, 360, 1440]))
def _(spark, sf):
    out = features.rolling_features(readings(spark, sf), ONE_SERIES, "reading", horizon=30)
    return out.select("event_id", *_rolling_digits([60, 360, 1440]))


@query("win2_rolling_row_frame", _rolling_sql(USER, [10]), **_rolling_digits([10]))
def _(spark, sf):
    out = features.rolling_features(readings(spark, sf), BY_USER, "reading", [10])
    return out.select("event_id", *_rolling_digits([10]))


@query(
    "win6_row_index_one_series",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS _pos FROM events",
)
def _(spark, sf):
    return series.with_positions(readings(spark, sf), ONE_SERIES).select("event_id", "_pos")


@query(
    "win7_running_share",
    """SELECT user_id, ts_day, n, sum(n) OVER (PARTITION BY user_id ORDER BY ts_day)::BIGINT AS running
FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ts_day, count(*) AS n FROM events GROUP BY 1, 2)""",
)
def _(spark, sf):
    from pyspark.sql import Window

    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("ts_day")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("user_id").orderBy("ts_day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("running", F.sum("n").over(running))


@query(
    "win8_average_ranks",
    """SELECT value, count(*) AS n, min(r) + (count(*) - 1) / 2.0::DOUBLE AS rank
FROM (SELECT value, rank() OVER (ORDER BY value) AS r FROM events) GROUP BY 1""",
    rank=1,
)
def _(spark, sf):
    return quantiles.value_ranks(table(spark, sf, "events"), "value", slices=8).select("value", "n", "rank")


@query(
    "plan_feature_table",
    f"""SELECT * FROM (SELECT event_id, household_id, hour(ts)::BIGINT AS hour, (isodow(ts) - 1)::BIGINT AS dayofweek,
  lag(value, 1) OVER w AS target_lag_1, lag(value, 10) OVER w AS target_lag_10, lag(value, 60) OVER w AS target_lag_60,
  avg(value) OVER (PARTITION BY household_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS target_rolling_mean_60,
  stddev_samp(value) OVER (PARTITION BY household_id ORDER BY ts, event_id ROWS BETWEEN 1440 PRECEDING AND 1 PRECEDING)
    AS target_rolling_std_1440
  FROM {READINGS} WINDOW w AS (PARTITION BY household_id ORDER BY ts, event_id)) WHERE target_lag_60 IS NOT NULL""",
    target_rolling_mean_60=6, target_rolling_std_1440=6,
)
def _(spark, sf):
    log = readings(spark, sf).select("event_id", "ts", "household_id", "value")
    out = features.feature_table(log, BY_USER, "ts", "value")
    return out.select(
        "event_id", "household_id", "hour", "dayofweek", "target_lag_1", "target_lag_10", "target_lag_60",
        "target_rolling_mean_60", "target_rolling_std_1440",
    )


@query(
    "st13_leakage_check",
    """SELECT 'disc_price' AS feature, corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS pearson FROM lineitem""",
    pearson=6,
)
def _(spark, sf):
    from workloads.base import frame

    names = ["l_quantity", "l_discount", "l_tax", "disc_price"]
    return statistics.leaking_features(frame(spark, sf), names, "l_extendedprice")
