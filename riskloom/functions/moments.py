"""Aggregate expressions for sample moments (pandas conventions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_sample(col) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``Series.skew``).

    Spark's ``skewness`` is the population g1; G1 = g1·sqrt(n(n-1))/(n-2).
    """
    c = F.col(col) if isinstance(col, str) else col
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_sample(col) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``Series.kurtosis``)."""
    c = F.col(col) if isinstance(col, str) else col
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pct(num, den, digits: int | None = None) -> Column:
    """``100·num/den`` (null-safe, 0 on empty), optionally rounded."""
    v = F.coalesce(F.try_divide(num * F.lit(100.0), den), F.lit(0.0))
    return F.round(v, digits) if digits is not None else v
