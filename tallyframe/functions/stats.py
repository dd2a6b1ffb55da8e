"""Statistics finished from exact sums.

Moments are accumulated as DECIMAL / BIGINT sums, which are exact and independent
of partitioning and merge order; only the final formula runs in DOUBLE, always in
the same operation order. Results are therefore reproducible run to run and agree
bit-for-bit with any engine that evaluates the same formula.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(c: Column) -> Column:
    return c.cast("double")


def sample_std(n: Column, s1: Column, s2: Column) -> Column:
    """Sample standard deviation (ddof=1) from n, Σx, Σx²; null when n < 2."""
    nn, a, b = d(n), d(s1), d(s2)
    var = F.try_divide(b - F.try_divide(a * a, nn), nn - F.lit(1.0))
    return F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))


def ols_slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    """Least-squares slope of y on x; null when x has no spread."""
    nn, a, b, c, e = d(n), d(sx), d(sy), d(sxx), d(sxy)
    den = nn * c - a * a
    return F.when(den != 0, F.try_divide(nn * e - a * b, den))


def ols_intercept(n: Column, sx: Column, sy: Column, slope: Column) -> Column:
    return F.try_divide(d(sy) - slope * d(sx), d(n))


def index_sums(n: Column) -> tuple[Column, Column]:
    """Σx and Σx² for x = 0..n-1, in closed form (no spine needed)."""
    nl = n.cast("bigint")
    sx = nl * (nl - 1) / 2
    sxx = (nl - 1) * nl * (nl * 2 - 1) / 6
    return sx.cast("bigint"), sxx.cast("bigint")


def pct_change(cur: Column, prev: Column) -> Column:
    """(cur / prev - 1) * 100 in DOUBLE; null where prev is 0 (pandas gives ±inf/NaN)."""
    return F.when(prev != 0, (F.try_divide(d(cur), d(prev)) - F.lit(1.0)) * F.lit(100.0))
