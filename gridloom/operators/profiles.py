"""Load profiles by hour, weekday and season, sub-meter shares, and dataset facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.calendar import day_name, epoch_micros, season
from gridloom.functions.numeric import clip_low, percent, watt_hours_to_kwh
from gridloom.operators.rollup import peak, trough
from gridloom.schemas import SUBMETER_COLUMNS, TARGET

# Consumption categories of the sub-meter report.
CATEGORIES = ["Cuisine (Sub 1)", "Buanderie (Sub 2)", "Chauffage/Clim (Sub 3)", "Autres"]


def hourly_profile(df: DataFrame, ts_col: str, value: str = TARGET) -> DataFrame:
    """AGG3"""
    return df.groupBy(F.hour(ts_col).alias("hour")).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def profile_band(profile: DataFrame) -> DataFrame:
    """AGG4: the profile with its mean +/- one deviation band."""
    return profile.withColumns({"band_low": F.col("mean") - F.col("std"), "band_high": F.col("mean") + F.col("std")})


def peak_and_low_hour(profile: DataFrame) -> DataFrame:
    """AGG4"""
    return profile.agg(
        peak("hour", "mean").alias("peak_hour"),
        trough("hour", "mean").alias("low_hour"),
        F.max("mean").alias("peak_mean"),
        F.min("mean").alias("low_mean"),
    )


def weekly_profile(df: DataFrame, ts_col: str, value: str = TARGET) -> DataFrame:
    """AGG5"""
    return (
        df.groupBy(F.weekday(ts_col).alias("day_of_week"))
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        .withColumn("day_name", day_name(F.col("day_of_week")))
    )


def weekday_vs_weekend(profile: DataFrame) -> DataFrame:
    """AGG6: means of the day means, not of the rows."""
    working = F.col("day_of_week") < 5
    return profile.agg(
        F.avg(F.when(working, F.col("mean"))).alias("weekday_mean"),
        F.avg(F.when(~working, F.col("mean"))).alias("weekend_mean"),
    )


def submeter_balance(
    df: DataFrame, power: str = TARGET, meters: list[str] = SUBMETER_COLUMNS, power_factor: float = 1.0
) -> DataFrame:
    """AGG7 per row: metered kWh and the unmetered rest.

    With the default factor the power reading enters as it is; ``1/60`` turns one-minute
    kilowatts into kilowatt hours first.
    """
    metered: Column = F.lit(0.0)
    for c in meters:
        metered = metered + F.coalesce(F.col(c), F.lit(0.0))
    rest = F.col(power) * F.lit(power_factor) - F.col("total_submeters")
    return df.withColumn("total_submeters", watt_hours_to_kwh(metered)).withColumn("other_consumption", clip_low(rest))


def submeter_shares(
    df: DataFrame, power: str = TARGET, meters: list[str] = SUBMETER_COLUMNS, power_factor: float = 1.0
) -> DataFrame:
    """AGG7: energy per category and its share of the total, in one aggregate."""
    balance = submeter_balance(df, power, meters, power_factor)
    sums = [F.coalesce(watt_hours_to_kwh(F.sum(c)), F.lit(0.0)) for c in meters]
    sums.append(F.coalesce(F.sum("other_consumption"), F.lit(0.0)))
    labels = CATEGORIES if len(meters) == len(CATEGORIES) - 1 else [*meters, CATEGORIES[-1]]
    totals = balance.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    whole: Column = F.lit(0.0)
    for i in range(len(sums)):
        whole = whole + F.col(f"s{i}")
    rows = [
        F.struct(
            F.lit(label).alias("category"),
            F.col(f"s{i}").alias("energy_kwh"),
            percent(F.col(f"s{i}"), whole).alias("share_pct"),
        )
        for i, label in enumerate(labels)
    ]
    return totals.select(F.inline(F.array(*rows)))


def dataset_profile(df: DataFrame, ts_col: str) -> DataFrame:
    """AGG8: rows, columns, period, NULLs per column and repeated rows as (metric, value)."""
    counts = {
        "total_rows": F.count(F.lit(1)),
        "total_columns": F.lit(len(df.columns)),
        "first_us": F.min(epoch_micros(ts_col)),
        "last_us": F.max(epoch_micros(ts_col)),
    }
    counts |= {f"missing.{c}": F.count_if(F.col(c).isNull()) for c in df.columns}
    pairs = [F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value")) for k, v in counts.items()]
    facts = df.agg(F.array(*pairs).alias("m")).select(F.inline("m"))
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    repeated = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("value"))
    return facts.unionByName(repeated.select(F.lit("duplicates").alias("metric"), "value"))


def column_types(df: DataFrame) -> DataFrame:
    """AGG8: type and missing values per column."""
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count_if(F.col(f.name).isNull()).alias("missing"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*rows).alias("c")).select(F.inline("c"))


def seasonal_means(df: DataFrame, ts_col: str, value: str = TARGET) -> DataFrame:
    """AGG12: season means against the mean of all rows, from one pass over the readings."""
    per_season = df.groupBy(season(F.month(ts_col)).alias("season")).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    facts = per_season.agg(
        F.collect_list(F.struct("season", "mean")).alias("s"), (F.sum("_sum") / F.sum("_n")).alias("annual_mean")
    )
    return facts.select(F.inline("s"), "annual_mean").withColumn(
        "vs_annual_pct", percent(F.col("mean") - F.col("annual_mean"), F.col("annual_mean"))
    )
