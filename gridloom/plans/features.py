"""Leakage-safe feature table: calendar, lags and trailing statistics of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.functions.calendar import add_calendar
from gridloom.functions.numeric import numeric_columns
from gridloom.operators.columns import complete_rows, drop_leaky
from gridloom.operators.series import (
    FRAME_LIMIT,
    SeriesKey,
    drop_halo,
    history,
    longest_series,
    with_look_back,
)
from gridloom.operators.statistics import leaking_features
from gridloom.schemas import TARGET

# Row offsets at one-minute steps.
NEAR_LAGS = [1, 2, 3, 5, 10]
FAR_LAGS = [60, 120, 360, 720, 1440, 10080]
WINDOWS = [60, 360, 1440]


def lag_offsets(horizon: int, series_rows: int | None = None) -> list[int]:
    """Offsets known at forecast time, and not longer than the longest series."""
    wanted = (NEAR_LAGS if horizon == 1 else []) + FAR_LAGS
    return [k for k in wanted if k >= max(1, horizon) and (series_rows is None or k <= series_rows)]


def window_sizes(horizon: int, windows: list[int] | None = None) -> list[int]:
    return [w for w in (windows or WINDOWS) if w >= horizon]


def add_history(
    df: DataFrame,
    key: SeriesKey,
    target: str,
    offsets: list[int],
    windows: list[int],
    shift: int = 1,
    frame_limit: int = FRAME_LIMIT,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """WIN1-WIN3 over one shared layout of the rows."""
    reach = max([0, *offsets, *[w + shift for w in windows]])
    out = with_look_back(df, key, reach, sizes)
    lag_names = {f"target_lag_{k}": k for k in offsets}
    stat_names = {w: (f"target_rolling_mean_{w}", f"target_rolling_std_{w}") for w in windows}
    return drop_halo(history(out, key, target, lag_names, stat_names, shift, frame_limit))


def lag_features(df: DataFrame, key: SeriesKey, target: str = TARGET, horizon: int = 1) -> DataFrame:
    """WIN1"""
    sizes = longest_series(df, key.entity)
    return add_history(df, key, target, lag_offsets(horizon, sizes[1]), [], sizes=sizes)


def rolling_features(
    df: DataFrame,
    key: SeriesKey,
    target: str = TARGET,
    windows: list[int] | None = None,
    horizon: int = 1,
    compatible: bool = False,
    frame_limit: int = FRAME_LIMIT,
) -> DataFrame:
    """WIN2, WIN3: statistics of readings known at forecast time.

    ``compatible`` keeps the shift of one row at every horizon, as in the original job;
    both agree at horizon 1.
    """
    shift = 1 if compatible else max(1, horizon)
    return add_history(df, key, target, [], window_sizes(horizon, windows), shift, frame_limit)


def feature_table(
    df: DataFrame,
    key: SeriesKey,
    ts_col: str = "timestamp",
    target: str = TARGET,
    horizon: int = 1,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Calendar, lag and trailing columns in one plan; incomplete rows are dropped last."""
    sizes = longest_series(df, key.entity)
    offsets, windows = lag_offsets(horizon, sizes[1]), window_sizes(horizon)
    known = add_history(drop_leaky(df), key, target, offsets, windows, max(1, horizon), sizes=sizes)
    # The calendar comes last, so its columns take no part in the shuffle and the sorts.
    table = add_calendar(known, ts_col)
    return complete_rows(table) if drop_incomplete else table


def leakage_report(table: DataFrame, key: SeriesKey, target: str = TARGET) -> DataFrame:
    """ST13 over every numeric column of a feature table."""
    features = numeric_columns(table, [target, *key.entity, *key.order])
    return leaking_features(table, features, target)
