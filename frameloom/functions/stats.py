"""Column functions of the score formulas."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

MAD_SCALE, EPS = 1.4826, 1e-6


def charbonnier(x: Column, tau: float) -> Column:
    return F.sqrt(x * x + F.lit(tau * tau)) - F.lit(float(tau))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def median_over(x: Column, *keys: str) -> Column:
    return F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*keys))


def tail(x: Column) -> Column:
    """0.4 P50 + 0.4 P90 + 0.2 P99, percentiles linearly interpolated; an aggregate."""
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return 0.4 * p[0] + 0.4 * p[1] + 0.2 * p[2]


def alternation(x: Column, k: Column) -> Column:
    """|sum of (-1)^k x| / (sum |x| + 1e-6); an aggregate."""
    return F.abs(F.sum(F.when(k % 2 == 0, x).otherwise(-x))) / (F.sum(F.abs(x)) + EPS)


def parity_mean_gap(x: Column, k: Column, least: int = 4) -> Column:
    """|mean of even - mean of odd| / (mean |x| + 1e-6), 0 if either side has fewer than ``least``; an aggregate."""
    even, odd = F.when(k % 2 == 0, x), F.when(k % 2 == 1, x)
    return F.when((F.count(even) < least) | (F.count(odd) < least), 0.0).otherwise(F.abs(F.avg(even) - F.avg(odd)) / (F.avg(F.abs(x)) + EPS))


def subscore(error: Column) -> Column:
    return 100.0 * F.exp(-1.8 * error)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation, null where either side doesn't vary; an aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
