"""Features of one entity's own series.

Windows with the same partitioning and order are stacked in layers, a layer being one projection, so that a
plan has one exchange and one sort on the entity however many features are asked for; the rest is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.ewm import ema, span
from ..functions.safe import ANNUAL, kurt_over, log_ratio, safe_div, skew_over
from ..plans.spec import PANEL, PanelSpec


def own(spec: PanelSpec = PANEL) -> WindowSpec:
    return Window.partitionBy(spec.entity).orderBy(spec.time)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def returns(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Log returns over 1, 5, 21, 63 and 252 rows, and momentum from 252 to 21 rows back."""
    p, w = F.col(spec.price), own(spec)
    out = {f"ret_{k}d": log_ratio(p, F.lag(p, k).over(w)) for k in (1, 5, 21, 63, 252)}
    return df.withColumns(out | {"mom_12_1": safe_div(F.lag(p, 21).over(w), F.lag(p, 252).over(w)) - 1})


def volatility(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """vol_20, vol_60, their ratio, the volatility of vol_20, and atr_14. Needs ret_1d."""
    w, prev = own(spec), F.lag("close", 1).over(own(spec))
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    out = df.withColumns({"vol_20": F.stddev("ret_1d").over(last_rows(w, 20)) * ANNUAL, "vol_60": F.stddev("ret_1d").over(last_rows(w, 60)) * ANNUAL, "_range": spread})
    return out.withColumns({"vol_ratio": safe_div(F.col("vol_20"), F.col("vol_60")), "vol_of_vol": F.stddev("vol_20").over(last_rows(w, 20)), "atr_14": F.avg("_range").over(last_rows(w, 14))}).drop("_range")


def trend(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Moving averages, distances to them, and Bollinger bands."""
    p, w = F.col(spec.price), own(spec)
    out = df.withColumns({f"sma_{n}": F.avg(p).over(last_rows(w, n)) for n in (20, 60, 200)} | {"_sd": F.stddev(p).over(last_rows(w, 20))})
    out = out.withColumns({f"dist_sma_{n}": safe_div(p, F.col(f"sma_{n}")) - 1 for n in (20, 60, 200)} | {"bb_mid": F.col("sma_20"), "bb_up": F.col("sma_20") + 2 * F.col("_sd"), "bb_low_band": F.col("sma_20") - 2 * F.col("_sd")})
    width = F.col("bb_up") - F.col("bb_low_band")
    return out.withColumns({"trend_strength": F.abs("dist_sma_20"), "bb_pctb": safe_div(p - F.col("bb_low_band"), width, 0.5), "bb_bandwidth": safe_div(width, F.col("bb_mid"))}).drop("_sd")


def liquidity(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Turnover, price impact, ranges and gaps. Needs ret_1d."""
    p, w = F.col(spec.price), own(spec)
    w60 = last_rows(w, 60)
    out = df.withColumns(
        {
            "dollar_volume": p * F.col("volume"),
            "hl_range": safe_div(F.col("high") - F.col("low"), p),
            "intraday_ret": safe_div(F.col("close") - F.col("open"), F.col("open")),
            "gap": safe_div(F.col("open"), F.lag(p, 1).over(w)) - 1,
        }
    )
    score: dict[str, Column] = {n: safe_div(F.col(c) - F.avg(c).over(w60), F.stddev(c).over(w60)) for n, c in (("turnover_z_60", "dollar_volume"), ("vol_z_60", "volume"))}
    return out.withColumns({"amihud": safe_div(F.abs("ret_1d"), F.col("dollar_volume"))} | score)


def drawdowns(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Index of the last 252 returns, drawdown from the 252-row peak, its depth and speed. Needs ret_1d."""
    p, w = F.col(spec.price), own(spec)
    w252 = last_rows(w, 252)
    out = df.withColumns({"cum_index": F.exp(F.sum("ret_1d").over(w252)), "drawdown": safe_div(p, F.max(p).over(w252)) - 1})
    return out.withColumns({"max_drawdown_252": F.min("drawdown").over(w252), "drawdown_speed": F.col("drawdown") - F.lag("drawdown", 5).over(w)})


def calendar(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Day of the week (Sunday 1), month, and whether the day is the calendar's last of its month or quarter."""
    d = F.col(spec.time)
    end = F.last_day(d) == d
    return df.withColumns({"dow": F.dayofweek(d), "month": F.month(d), "is_month_end": end.cast("int"), "is_quarter_end": (F.month(d).isin(3, 6, 9, 12) & end).cast("int")})


def oscillators(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Exponential means, MACD and RSI."""
    p, w = F.col(spec.price), own(spec)
    change = p - F.lag(p, 1).over(w)
    out = df.withColumns({"ema_12": ema(p, span(12), w), "ema_26": ema(p, span(26), w), "_gain": F.when(change > 0, change).when(change.isNotNull(), 0.0), "_loss": F.when(change < 0, -change).when(change.isNotNull(), 0.0)})
    out = out.withColumns({"macd": F.col("ema_12") - F.col("ema_26"), "_up": ema(F.col("_gain"), 1 / 14, w), "_down": ema(F.col("_loss"), 1 / 14, w)})
    out = out.withColumns({"macd_signal": ema(F.col("macd"), span(9), w), "rsi_14": 100 - 100 / (1 + F.try_divide("_up", "_down"))})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_gain", "_loss", "_up", "_down")


def shape(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Downside volatility, skewness and kurtosis of ret_1d."""
    w, r = own(spec), F.col("ret_1d")
    down, w20, w60 = F.when(r < 0, r), last_rows(own(spec), 20), last_rows(w, 60)
    return df.withColumns({"downside_vol_20": F.when(F.count(down).over(w20) >= 5, F.stddev(down).over(w20) * ANNUAL), "skew_60": skew_over(r, w60, 20), "kurt_60": kurt_over(r, w60, 20)})


def winsorise(df: DataFrame, column: str, q: float = 0.99, accuracy: int = 1_000_000) -> DataFrame:
    """Values above the q-th percentile (one row, hence broadcast) become it; null stays null."""
    edge = df.agg(F.percentile_approx(column, q, accuracy).alias("_edge"))
    out = df.crossJoin(F.broadcast(edge))
    return out.withColumn(column, F.when(F.col(column) > F.col("_edge"), F.col("_edge")).otherwise(F.col(column))).drop("_edge")


def entity_features(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """All features of this module but the winsorising, which needs the whole table."""
    for step in (returns, volatility, trend, liquidity, drawdowns, calendar, oscillators, shape):
        df = step(df, spec)
    return df
