"""Timing of the cross-sectional workload (volatility ratio, percent ranks by date, scaled return): by number of partitions,
and against pandas on the same rows. Results go to the noop sink, so that no window is pruned away as unused."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cross_section as xs
from ..operators import features as ft


def workload(bars: DataFrame) -> DataFrame:
    return xs.scaled_return(xs.ranks(ft.volatility(ft.returns(bars)))).select("ticker", "date", "vol_ratio", "xs_ret_rank", "xs_vol_rank", "ret_z_60")


def timed(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def partition_sweep(bars: DataFrame, counts: tuple[int, ...]) -> list[dict]:
    """A row for each number of partitions by entity: elapsed seconds of the cached panel's workload, rows a second, and the
    speedup over the slowest."""
    rows = []
    for n in dict.fromkeys(counts):
        dealt = bars.repartition(n, "ticker").persist()
        n_rows = dealt.count()
        timed(workload(dealt))  # to warm up
        elapsed = timed(workload(dealt))
        dealt.unpersist()
        rows.append({"n_partitions": n, "simulated_workers": max(1, n // 2), "rows_processed": n_rows, "elapsed_seconds": round(elapsed, 3), "rows_per_second": round(n_rows / elapsed)})
    slowest = max((r["elapsed_seconds"] for r in rows), default=0.0)
    return [r | {"speedup": round(slowest / r["elapsed_seconds"], 2)} for r in rows]


def against_pandas(bars: DataFrame, partitions: int = 4) -> dict:
    """The volatility ratio and its average-tie percent rank by date, in pandas (one process, the whole panel of the bench's
    data folder) and here, with one definition of the rank; seconds, rows a second and their ratio."""
    w = Window.partitionBy("ticker").orderBy("date")
    returns = F.log(F.col("adj_close") / F.lag("adj_close").over(w))
    dealt = bars.select("ticker", "date", "adj_close").repartition(partitions, "ticker").persist()
    n_rows = dealt.count()
    vol = lambda n: F.stddev("r").over(w.rowsBetween(1 - n, 0))
    ratio = dealt.withColumn("r", returns).withColumn("vol_ratio", F.try_divide(vol(20), vol(60)))
    ours = xs.average_rank(ratio, "vol_ratio", "rank")
    timed(ours)
    spark_seconds = timed(ours)
    frame = dealt.toPandas()
    dealt.unpersist()
    began = time.time()
    import numpy as np

    frame = frame.sort_values(["ticker", "date"])
    frame["r"] = np.log(frame["adj_close"]).groupby(frame["ticker"]).diff()
    each = frame.groupby("ticker")["r"]
    spread = {n: each.rolling(n, min_periods=2).std().reset_index(level=0, drop=True) for n in (20, 60)}
    frame["vol_ratio"] = spread[20] / spread[60]
    frame["rank"] = frame.groupby("date")["vol_ratio"].rank(pct=True)
    pandas_seconds = time.time() - began
    return {"rows": n_rows, "pandas_seconds": round(pandas_seconds, 3), "pandas_rows_per_second": round(n_rows / pandas_seconds), "spark_seconds": round(spark_seconds, 3), "spark_rows_per_second": round(n_rows / spark_seconds), "pandas_over_spark": round(pandas_seconds / spark_seconds, 3)}
