"""Small numeric expressions that stay safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns the frame really has, in the wanted order."""
    return [name for name in wanted if name in df.columns]


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spark sorts NaN above every number, so missing values must be NULL."""
    floating = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def finite(column: str) -> Column:
    """True for numbers, false for NaN and the infinities, NULL for NULL."""
    return F.abs(F.col(column).cast("double")) < F.lit(float("inf"))


def ratio(top: Column, bottom: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    return F.lit(100.0) * ratio(top, bottom)


def clip_low(value: Column, floor: float = 0.0) -> Column:
    """Negative values become the floor; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def watt_hours_to_kwh(value: Column) -> Column:
    return value / F.lit(1000.0)


def kw_minutes_to_kwh(value: Column) -> Column:
    return value / F.lit(60.0)


# Fixed values of a published rational approximation to the normal quantile, relative error below 1.2e-9.
MIDDLE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239]
MIDDLE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]
TAIL = 0.02425
# Fixed values of a published approximation to the error function, absolute error below 1.5e-7.
ERROR_SHRINK = 0.3275911
ERROR_TERMS = [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0]


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Highest power first."""
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_score(p: Column) -> Column:
    """Normal quantile of a probability between 0 and 1, as an expression."""
    q = p - 0.5
    middle = q * polynomial(MIDDLE_TOP, q * q) / polynomial(MIDDLE_BOTTOM, q * q)
    far = F.sqrt(F.lit(-2.0) * F.log(F.least(p, 1 - p)))
    tail = polynomial(TAIL_TOP, far) / polynomial(TAIL_BOTTOM, far)
    return F.when(F.abs(q) <= 0.5 - TAIL, middle).otherwise(F.when(q < 0, tail).otherwise(-tail))


def normal_share(z: Column) -> Column:
    """Share of a standard normal distribution below z, as an expression."""
    x = F.abs(z) / F.lit(2.0**0.5)
    above = polynomial(ERROR_TERMS, F.lit(1.0) / (F.lit(1.0) + F.lit(ERROR_SHRINK) * x)) * F.exp(-x * x) / 2
    return F.when(z < 0, above).otherwise(F.lit(1.0) - above)
