"""Recursive exponential means (ema_t = a * x_t + (1 - a) * ema_t-1, seeded with the first value).

Spark has the weighted mean over all rows so far as a window aggregate, which the pandas API uses; it is
reached through an internal module, and only here. With b = 1 - a and t values so far, the recursive
mean is (1 - b^t) * weighted mean + b^t * first value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction
from pyspark.sql.window import Window, WindowSpec


def ema(x: Column, alpha: float, w: WindowSpec) -> Column:
    """Over the ordered window ``w`` without a frame. Leading nulls are skipped: the mean is seeded with the first value."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    t = F.count(x).over(so_far)
    left = F.pow(F.lit(1 - alpha), t)
    return F.when(t > 0, (1 - left) * InternalFunction.ewm(x, alpha, False).over(so_far) + left * F.first(x, ignorenulls=True).over(so_far))


def span(n: int) -> float:
    return 2 / (n + 1)
