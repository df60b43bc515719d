"""Features across entities: against the benchmark, ranks by date, forward targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import ANNUAL, corr_over, log_ratio, safe_div
from ..plans.spec import PANEL, PARAMS, PanelSpec, Params
from .features import last_rows, own


def benchmark_rows(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows of the benchmark entity."""
    if spec.benchmark is not None:
        return df.filter(F.col(spec.entity) == spec.benchmark)
    name = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), spec.entity).limit(1).select(spec.entity)
    return df.join(F.broadcast(name), spec.entity, "left_semi")  # one row


def against_benchmark(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """corr_spy_60, beta_60 and idio_vol_60. Needs ret_1d and vol_20. Days without the benchmark count as returns of 0;
    the benchmark's series has one row for a date, and the engine broadcasts it where its size allows."""
    series = benchmark_rows(df.select(spec.entity, spec.time, "ret_1d", "vol_20"), spec).select(spec.time, F.col("ret_1d").alias("_bench_ret"), F.col("vol_20").alias("_bench_vol"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = df.join(series, spec.time, "left").withColumns({"_r": zero("ret_1d"), "_b": zero("_bench_ret"), "_v": zero("vol_20"), "_bv": zero("_bench_vol")})
    out = out.withColumn("corr_spy_60", corr_over(F.col("_r"), F.col("_b"), last_rows(own(spec), 60), 20))
    out = out.withColumn("beta_60", safe_div(F.col("corr_spy_60") * F.col("_v"), F.col("_bv")))
    left = F.pow("_v", F.lit(2)) - F.pow(F.coalesce("beta_60", F.lit(0.0)), F.lit(2)) * F.pow("_bv", F.lit(2))
    return out.withColumn("idio_vol_60", F.sqrt(F.greatest(left, F.lit(0.0)))).drop("_bench_ret", "_bench_vol", "_r", "_b", "_v", "_bv")


def ranks(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Percent ranks by date: nulls come first, ties share the least rank. One exchange serves all three."""
    by = lambda c: F.percent_rank().over(Window.partitionBy(spec.time).orderBy(F.asc_nulls_first(c)))
    return df.withColumns({"xs_ret_rank": by("ret_1d"), "xs_vol_rank": by("vol_20"), "xs_mom_rank": by("mom_12_1")})


def average_rank(df: DataFrame, column: str, name: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Rank by date over the number of values, ties sharing their mean rank; null for null."""
    w = Window.partitionBy(spec.time)
    ordered = w.orderBy(F.asc_nulls_last(column))
    ties = F.count(F.lit(1)).over(Window.partitionBy(spec.time, column))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.try_divide(F.rank().over(ordered) + (ties - 1) / 2, F.count(column).over(w))))


def scaled_return(df: DataFrame) -> DataFrame:
    return df.withColumn("ret_z_60", safe_div(F.col("ret_1d"), F.col("vol_20") / ANNUAL))


def forward_targets(df: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """Log return of the next hold_days rows and its sign. Rows without one go, after the lead is taken."""
    p = F.col(spec.price)
    out = df.withColumn("target_ret_5d", log_ratio(F.lead(p, params.hold_days).over(own(spec)), F.when(p > 0, p))).filter(F.col("target_ret_5d").isNotNull())
    return out.withColumns({"target_5d": F.when(F.col("target_ret_5d") > 0, 1).otherwise(0), "ret_5d_fwd": F.col("target_ret_5d")})


def gold(features: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """All of this module. Work by entity comes before and after the one exchange by date."""
    out = forward_targets(scaled_return(ranks(against_benchmark(features, spec), spec)), spec, params)
    return out
