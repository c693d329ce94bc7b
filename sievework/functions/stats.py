"""Small statistical formulas as column expressions or on fitted scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wald_low(p: Column, n: Column) -> Column:
    half = Z95 * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))
    return F.when(half.isNotNull(), F.greatest(F.lit(0.0), p - half))


def wald_high(p: Column, n: Column) -> Column:
    half = Z95 * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))
    return F.when(half.isNotNull(), F.least(F.lit(1.0), p + half))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(x).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, scale * ((n + 1) * F.kurtosis(x) + 6))


def deviation(x: Column, sample: bool = False) -> Column:
    """Standard deviation that is exactly zero for a constant column.

    Merging partial sums of equal values may leave a rounding error, so
    constancy is read off the smallest and largest value.
    """
    std = F.stddev_samp(x) if sample else F.stddev_pop(x)
    return F.when(F.min(x) < F.max(x), std).when(F.count(x) > 0, F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over the complete pairs; NULL when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(deviation(a) * deviation(b), F.lit(0.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p_value(r: float | None, n: int) -> float | None:
    """Two-sided t test of r = 0 with n - 2 degrees of freedom."""
    if r is None or n <= 2:
        return None
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - r * r))
