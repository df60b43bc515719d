"""Metrics of predictions (ticker, date, asset_class, signal, p_hold, ret_5d_fwd, model): grouped aggregation by model.

Rows are pooled over entities. Where the order matters (drawdown, lagged covariance) it is date, then ticker, or
ticker, then date, as stated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialise import cut
from ..plans.spec import PARAMS, Params


def strategy_returns(pred: DataFrame) -> DataFrame:
    """signal_ret, and turnover: whether the signal differs from the ticker's previous one, null on its first row."""
    w = Window.partitionBy("model", "ticker").orderBy("date")
    return pred.withColumns({"signal_ret": F.col("ret_5d_fwd") * F.coalesce("signal", F.lit(0)), "turnover": (F.col("signal") != F.lag("signal").over(w)).cast("double")})


def after_costs(bps: int | Column) -> Column:
    return F.col("signal_ret") - F.col("turnover") * (bps if isinstance(bps, Column) else F.lit(bps)) / 10000.0


def sharpe(r: Column, params: Params = PARAMS) -> Column:
    """Annualised; null under 10 returns or without spread."""
    return F.when((F.count(r) >= 10) & (F.stddev(r) >= 1e-12), F.try_divide(F.avg(r), F.stddev(r)) * math.sqrt(params.periods))


def sortino(r: Column, params: Params = PARAMS) -> Column:
    down = F.when(r < 0, r)
    return F.when((F.count(down) >= 2) & (F.stddev(down) >= 1e-12), F.try_divide(F.avg(r), F.stddev(down)) * math.sqrt(params.periods))


def win_rate(r: Column) -> Column:
    return F.avg(F.when((F.col("signal") == 1) & r.isNotNull(), (r > 0).cast("double")))


def profit_factor(r: Column) -> Column:
    active = F.col("signal") == 1
    losses = F.abs(F.coalesce(F.sum(F.when(active & (r < 0), r)), F.lit(0.0)))
    return F.when(losses > 1e-8, F.try_divide(F.coalesce(F.sum(F.when(active & (r > 0), r)), F.lit(0.0)), losses))


def equity(df: DataFrame, r: str, keys: tuple[str, ...] = ("model",), time: str = "date", entity: str = "ticker") -> DataFrame:
    """Running product of 1 + r (null r: 1) by time, then entity, with its peak and drawdown. It is done in two steps,
    within each date and over dates, so that no task holds a whole model's rows; a return under -1 turns the
    product negative, so that a date's lowest value may become its peak."""
    day = [*keys, time]
    inside = Window.partitionBy(*day).orderBy(entity).rowsBetween(Window.unboundedPreceding, 0)
    step = df.withColumn("_in", F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(inside)).withColumns({"_peak_in": F.max("_in").over(inside), "_low_in": F.min("_in").over(inside)})
    days = df.groupBy(*day).agg(F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).alias("_all"))
    tops = step.groupBy(*day).agg(F.max("_peak_in").alias("_top"), F.min("_low_in").alias("_bottom"))
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    state = days.join(tops, day).withColumn("_base", F.coalesce(F.product("_all").over(before), F.lit(1.0)))
    state = state.withColumn("_peak", F.max(F.greatest(F.col("_base") * F.col("_top"), F.col("_base") * F.col("_bottom"))).over(before)).select(*day, "_base", "_peak")
    out = step.join(state, day).withColumn("equity", F.col("_base") * F.col("_in"))
    out = out.withColumn("peak", F.greatest("_peak", F.col("_base") * F.col("_peak_in"), F.col("_base") * F.col("_low_in")))
    return out.withColumn("drawdown", F.try_divide("equity", "peak") - 1).drop("_in", "_peak_in", "_low_in", "_base", "_peak")


def max_drawdown(df: DataFrame, r: str = "signal_ret") -> DataFrame:
    return equity(df, r).groupBy("model").agg(F.min("drawdown").alias("max_drawdown"))


def stop_loss(pred: DataFrame, daily: DataFrame, params: Params = PARAMS) -> DataFrame:
    """sl_ret: what signal 1 realises over the next hold_days prediction dates of the ticker, cut at the stop. Fewer
    following rows without a stop, and null daily returns, give 0; a date without a daily row counts as 0."""
    day = daily.select("ticker", "date", F.col("ret_1d").alias("_day"), F.lit(True).alias("_known"))
    w = Window.partitionBy("model", "ticker").orderBy("date")
    out = pred.join(day, ["ticker", "date"], "left").withColumn("_day", F.when(F.col("_known"), F.col("_day")).otherwise(0.0))
    cum, branch = None, None
    for j in range(1, params.hold_days + 1):
        step = F.lead("_day", j).over(w)
        cum = step if cum is None else cum + step
        out = out.withColumn(f"_c{j}", cum)
        hit = F.col(f"_c{j}") < params.stop_loss
        branch = F.when(hit, params.stop_loss) if branch is None else branch.when(hit, params.stop_loss)
    value = branch.otherwise(F.coalesce(f"_c{params.hold_days}", F.lit(0.0)))
    out = out.withColumn("sl_ret", F.when(F.col("signal") == 1, value).otherwise(0.0))
    return out.drop("_day", "_known", *(f"_c{j}" for j in range(1, params.hold_days + 1)))


def summary(pred: DataFrame, daily: DataFrame, params: Params = PARAMS, costs_bps: int = 10, models: tuple[str, ...] = (), interval: bool = True) -> DataFrame:
    """One row of metrics for each model; those of ``models`` without a prediction have n_predictions 0 and nulls. Without
    ``interval`` the bootstrap is left out."""
    r, year = F.col("signal_ret"), params.periods
    full = stop_loss(strategy_returns(pred), daily, params).withColumn("ret_tc", after_costs(costs_bps))
    active = F.col("signal") == 1
    table = full.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.countDistinct("ticker").alias("n_tickers"),
        (F.avg(r) * year * 100).alias("ann_return_pct"),
        sharpe(r, params).alias("sharpe"),
        sortino(r, params).alias("sortino"),
        (F.stddev(r) * math.sqrt(year) * 100).alias("vol_ann_pct"),
        (win_rate(r) * 100).alias("win_rate_pct"),
        profit_factor(r).alias("profit_factor"),
        (F.avg(F.when(active & (r > 0), r)) * 100).alias("avg_win_pct"),
        (F.avg(F.when(active & (r < 0), r)) * 100).alias("avg_loss_pct"),
        sharpe(F.col("ret_tc"), params).alias("sharpe_10bps"),
        (F.avg("ret_tc") * year * 100).alias("ann_return_10bps"),
        sharpe(F.col("sl_ret"), params).alias("sharpe_stoploss"),
        (F.avg("sl_ret") * year * 100).alias("ann_return_sl_pct"),
        (F.avg("turnover") * year).alias("turnover_per_yr"),
        (F.avg("signal") * 100).alias("hold_rate_pct"),
    )
    depth = max_drawdown(full)
    out = table.join(depth, "model")
    calmar = F.when(F.abs("max_drawdown") > 1e-6, F.col("ann_return_pct") / 100 / F.abs("max_drawdown"))
    out = out.withColumns({"calmar": calmar, "max_drawdown_pct": F.col("max_drawdown") * 100}).drop("max_drawdown")
    out = out.join(group_sharpe(full, params), "model", "left")
    if interval:
        out = out.join(bootstrap_sharpe(full, params), "model", "left")
    if models:
        named = pred.sparkSession.createDataFrame([(m,) for m in models], "model string")
        out = named.unionByName(out.select("model")).distinct().join(out, "model", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_predictions", "n_tickers")})
    return out


def group_sharpe(full: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Sharpe by asset class, one column each. Spark needs the classes, a constant of the panel."""
    r = F.col("signal_ret")
    cells = [sharpe(F.when(F.col("asset_class") == g, r), params).alias("sharpe_" + g.replace(" ", "_")) for g in params.groups]
    return full.groupBy("model").agg(*cells)


def bootstrap_sharpe(full: DataFrame, params: Params = PARAMS, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the Sharpe ratio over ``bootstrap`` resamples; null under 20 returns. Every row draws its
    number of copies in each resample from a Poisson distribution (in place of resamples of exactly n rows), so that a batch
    adds its part to all resamples at once, as a product of two matrices, and nothing is collected. The draws are hashes of
    the row's key and the resample. Returns are taken from their model's mean, so that the spread loses no digits."""
    copies = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            resample = (np.arange(params.bootstrap, dtype=np.uint64) + np.uint64(1 + seed * params.bootstrap)) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for (model, centre), rows in pdf.groupby(["model", "centre"]):
                parts = np.zeros((params.bootstrap, 3))
                for begin in range(0, len(rows), 512):
                    some = rows.iloc[begin : begin + 512]
                    h = some["key"].to_numpy().astype(np.uint64)[:, None] ^ resample[None, :]
                    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
                        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
                    w = np.searchsorted(copies, (h >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
                    x = some["r"].to_numpy() - centre
                    parts += w.T.astype(np.float64) @ np.column_stack([np.ones(len(x)), x, x * x])
                yield pd.DataFrame({"model": model, "centre": centre, "b": range(params.bootstrap), "n": parts[:, 0], "s": parts[:, 1], "q": parts[:, 2]})

    rows = full.filter(F.col("signal_ret").isNotNull()).select("model", F.xxhash64("ticker", "date").alias("key"), F.col("signal_ret").alias("r"))
    centred = rows.join(F.broadcast(rows.groupBy("model").agg(F.avg("r").alias("centre"))), "model")  # one row a model
    sums = centred.mapInPandas(run, "model string, centre double, b int, n double, s double, q double").groupBy("model", "centre", "b").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    shift = F.try_divide("s", "n")
    mean = F.col("centre") + shift
    spread = F.sqrt(F.greatest(F.try_divide("q", "n") - shift * shift, F.lit(0.0)))
    each = sums.withColumn("v", F.when(spread > 1e-12, F.try_divide(mean, spread) * math.sqrt(params.periods)).otherwise(0.0))
    edge = (1 - level) / 2
    out = each.groupBy("model").agg(F.percentile("v", edge).alias("sharpe_ci_lo"), F.percentile("v", 1 - edge).alias("sharpe_ci_hi"))
    enough = rows.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 20")
    return out.join(enough.select("model"), "model", "left_semi")


def cost_sensitivity(pred: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Sharpe by model at each cost level: bps, model, sharpe."""
    full = strategy_returns(pred)
    wide = full.groupBy("model").agg(*(sharpe(after_costs(b), params).alias(f"_{b}") for b in params.costs_bps))
    pairs = F.array(*(F.struct(F.lit(b).alias("bps"), F.col(f"_{b}").alias("sharpe")) for b in params.costs_bps))
    return wide.select("model", F.explode(pairs).alias("_p")).select("_p.bps", "model", "_p.sharpe")


def lagged_pairs(df: DataFrame, most: int) -> DataFrame:
    """model, lag, d and l: every value of ``df`` (model, ticker, date, d) with those up to ``most`` rows before it in the order
    ticker, date. Pairs within a ticker come from a window over it; the first rows of a ticker meet the last rows of the
    tickers before it by their place in the model, which needs the tickers' counts only."""
    w = Window.partitionBy("model", "ticker")
    lagged = [F.lag("d", k).over(w.orderBy("date")) for k in range(1, most + 1)]
    rows = df.withColumns({"_at": F.row_number().over(w.orderBy("date")), "_n": F.count(F.lit(1)).over(w), "_lags": F.array(*lagged)})
    counts = df.groupBy("model", "ticker").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("model").orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("model", "ticker", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_begin"))
    inside = rows.select("model", "d", F.posexplode("_lags").alias("lag", "l")).select("model", (F.col("lag") + 1).alias("lag"), "d", "l").filter(F.col("l").isNotNull())
    edge = rows.filter((F.col("_at") <= most) | (F.col("_at") > F.col("_n") - most)).join(begins, ["model", "ticker"]).withColumn("_place", F.col("_begin") + F.col("_at"))
    heads = edge.filter(F.col("_at") <= most).select("model", "d", "_at", "_place", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")).filter(F.col("lag") >= F.col("_at"))
    tails = edge.filter(F.col("_at") > F.col("_n") - most).select("model", F.col("_place").alias("_before"), F.col("d").alias("l"))
    across = heads.withColumn("_before", F.col("_place") - F.col("lag")).join(tails, ["model", "_before"]).select("model", "lag", "d", "l")
    return inside.unionByName(across)


def dm_statistic(pred: DataFrame, baseline: str = "always_hold", params: Params = PARAMS) -> DataFrame:
    """Diebold-Mariano statistic of every model against the baseline on squared strategy returns, with lagged covariances
    (hold_days - 1 of them, in the order ticker, date): model, n, dm_stat (null under 20 rows)."""
    full = strategy_returns(pred).select("model", "ticker", "date", "signal_ret")
    base = full.filter(F.col("model") == baseline).select("ticker", "date", F.col("signal_ret").alias("_base"))
    both = full.filter(F.col("model") != baseline).join(base, ["ticker", "date"]).withColumn("d", F.pow("_base", F.lit(2)) - F.pow("signal_ret", F.lit(2)))
    both = cut(both.select("model", "ticker", "date", "d"))
    lags = range(1, params.hold_days)
    covariances = lagged_pairs(both, params.hold_days - 1).groupBy("model").agg(*(F.covar_samp(F.when(F.col("lag") == k, F.col("d")), F.when(F.col("lag") == k, F.col("l"))).alias(f"_g{k}") for k in lags))
    sums = both.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("_m"), F.var_samp("d").alias("_v")).join(covariances, "model", "left")
    var = F.col("_v") / F.col("n")
    for k in lags:
        var = var + 2 * (1 - k / params.hold_days) * F.coalesce(f"_g{k}", F.lit(0.0)) / F.col("n")
    return sums.select("model", "n", F.when(F.col("n") >= 20, F.col("_m") / F.sqrt(F.greatest(var, F.lit(1e-12)))).alias("dm_stat"))


def dm_tests(pred: DataFrame, baseline: str = "always_hold", params: Params = PARAMS) -> DataFrame:
    """dm_statistic with the two-sided normal p-value and its reading. The p-value is Python on a row for each model."""

    @F.pandas_udf("double")
    def p_value(stat: pd.Series) -> pd.Series:
        return stat.map(lambda s: math.erfc(abs(s) / math.sqrt(2)) if pd.notna(s) else None).astype(float)

    out = dm_statistic(pred, baseline, params).withColumn("p_value", p_value("dm_stat"))
    read = F.when(F.col("dm_stat").isNull(), "insufficient data").when((F.col("dm_stat") < 0) & (F.col("p_value") < 0.05), "model_1_better").when((F.col("dm_stat") > 0) & (F.col("p_value") < 0.05), "model_2_better")
    return out.select("model", "dm_stat", "p_value", read.otherwise("no_significant_difference").alias("result"))


def portfolio(pred: DataFrame) -> DataFrame:
    """Mean strategy return by model and date, and its equity curve and drawdown."""
    daily = strategy_returns(pred).groupBy("model", "date").agg(F.coalesce(F.avg("signal_ret"), F.lit(0.0)).alias("ret"))
    w = Window.partitionBy("model").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.product(1 + F.col("ret")).over(w))
    return out.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def win_heatmap(pred: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Share of all rows that were held and won, by model (rows) and asset class (columns)."""
    win = ((F.col("ret_5d_fwd") > 0) & (F.col("signal") == 1)).cast("double")
    return pred.groupBy("model").agg(*(F.avg(F.when(F.col("asset_class") == g, win)).alias("win_" + g.replace(" ", "_")) for g in params.groups))


def benchmark_overlay(pred: DataFrame, benchmark: DataFrame, last: int = 60) -> DataFrame:
    """The benchmark's last predictions of all models pooled (ties by model), and each model's cumulative return on them."""
    rows = strategy_returns(pred.join(benchmark, "ticker", "left_semi")).orderBy(F.desc("date"), "model").limit(last)
    w = Window.partitionBy("model").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative", F.product(1 + F.coalesce("signal_ret", F.lit(0.0))).over(w)).select("model", "ticker", "date", "signal", "ret_5d_fwd", "cumulative")
