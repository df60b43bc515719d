"""Guarded arithmetic. ANSI mode stays on: whatever could divide by zero goes through these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ANNUAL = 252**0.5


def safe_div(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den; ``default`` where den is null or 0. A null num gives null, default or not."""
    if default is None:
        return F.try_divide(num, den)
    return F.when(den.isNull() | (den == 0), F.lit(default)).otherwise(F.try_divide(num, den))


def log_ratio(a: Column, b: Column) -> Column:
    return F.log(F.try_divide(a, b))


def corr_over(x: Column, y: Column, w: WindowSpec, least: int) -> Column:
    """Pearson correlation over a frame; null under ``least`` rows or without spread."""
    r = F.try_divide(F.covar_samp(x, y).over(w), F.stddev(x).over(w) * F.stddev(y).over(w))
    return F.when(F.count(F.lit(1)).over(w) >= least, r)


def skew_over(x: Column, w: WindowSpec, least: int) -> Column:
    """Bias-corrected skewness; 0 without spread, null under ``least`` values."""
    n = F.count(x).over(w)
    g = F.skewness(x).over(w) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= least, F.when(F.stddev(x).over(w) == 0, F.lit(0.0)).otherwise(g))


def kurt_over(x: Column, w: WindowSpec, least: int) -> Column:
    """Bias-corrected excess kurtosis; -3 without spread, null under ``least`` values."""
    n = F.count(x).over(w)
    g = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6)
    return F.when(n >= least, F.when(F.stddev(x).over(w) == 0, F.lit(-3.0)).otherwise(g))
