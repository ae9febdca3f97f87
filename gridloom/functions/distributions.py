"""Tail probabilities for the handful of test statistics a report holds.

These work on single numbers (one per feature), never on readings.
"""

from __future__ import annotations

import math
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated bottom up."""
    terms = 200 + int(4 * math.sqrt(max(a, b)))
    value = 1.0
    for m in range(terms, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + even / (1.0 + odd / value)
    first = -(a + b) * x / (a + 1)
    return 1.0 / (1.0 + first / value)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f) with d1 and d2 degrees of freedom."""
    if f <= 0.0:
        return 1.0
    if d1 == 1.0 and d2 > 1e7:
        return math.erfc(math.sqrt(f / 2.0))
    return beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return f_tail(t * t, 1.0, df)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
