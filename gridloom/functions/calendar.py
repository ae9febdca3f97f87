"""Calendar columns derived from a timestamp; all run inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Day names, Monday first.
DAY_NAMES = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 for TIMESTAMP and TIMESTAMP_NTZ columns."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def season(month: Column) -> Column:
    """Winter 0 (Dec-Feb), spring 1, summer 2, autumn 3."""
    return F.floor((month % 12) / 3).cast("int")


def time_of_day(hour: Column) -> Column:
    """Hours 0-6, 7-12, 13-18 and 19-23 as 0 to 3."""
    return F.when(hour <= 6, 0).when(hour <= 12, 1).when(hour <= 18, 2).when(hour <= 23, 3)


def is_weekend(weekday: Column) -> Column:
    return _flag(weekday >= 5)


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in DAY_NAMES]), weekday + 1)


def on_circle(part: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * part / F.lit(period)
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """The 24 calendar features by name. Weekdays count from Monday = 0."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    hour, month = F.hour(ts), F.month(ts)
    weekday, yearday = F.weekday(ts), F.dayofyear(ts)
    columns = {
        "year": F.year(ts),
        "month": month,
        "day": F.day(ts),
        "hour": hour,
        "minute": F.minute(ts),
        "dayofweek": weekday,
        "dayofyear": yearday,
        "weekofyear": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": is_weekend(weekday),
        "is_workday": _flag(weekday < 5),
        "season": season(month),
        "time_of_day": time_of_day(hour),
        "is_morning_peak": _flag(hour.between(7, 9)),
        "is_evening_peak": _flag(hour.between(18, 21)),
        "is_night": _flag((hour >= 23) | (hour <= 6)),
    }
    for name, part, period in [
        ("hour", hour, 24),
        ("dayofweek", weekday, 7),
        ("month", month, 12),
        ("dayofyear", yearday, 365),
    ]:
        columns[f"{name}_sin"], columns[f"{name}_cos"] = on_circle(part, period)
    return columns


def add_calendar(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    return df.withColumns(calendar_columns(ts_col))
