"""The panel's queries: each is one operator, or a family of them, on the panel of a data folder, with its DuckDB SQL.

Statistics that are summed in another order by another engine are rounded; products of two columns are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialise import cut
from ..operators import cross_section as xs
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import graph as gr
from ..operators import walk_forward as wf
from ..sources import bars as br
from ..sources import panel as pn
from ..sources.instruments import EXCLUDED
from ..streaming.bars import event_bars
from . import sql as q
from .spec import PARAMS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = ["ticker", "date"]


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


#: Means of few prices often lie halfway between two roundings; they are moved off by this before.
OFF_TIES = {c: 1e-7 for c in ("sma_20", "sma_60", "sma_200", "bb_mid")}


def rounded(df: DataFrame, digits: dict[str, int | None], keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys, *(F.col(c) if d is None else F.round(F.col(c) + OFF_TIES.get(c, 0.0), d).alias(c) for c, d in digits.items()))


def rounded_sql(layers: tuple[str, ...], source: str, digits: dict[str, int | None], keys: list[str] = KEYS) -> str:
    cols = ", ".join([*keys, *(c if d is None else f"round({c} + {OFF_TIES.get(c, 0.0)}::DOUBLE, {d}) AS {c}" for c, d in digits.items())])
    return f"{q.with_(*layers)}SELECT {cols} FROM {source}"


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.entity_features(pn.bars(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.gold(silver(spark, sf_dir))


def winsorised_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold layer with its price impact winsorised, as the models read it."""
    return xs.gold(ft.winsorise(silver(spark, sf_dir), "amihud"))


def gold_with_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cut(winsorised_gold(spark, sf_dir))
    return gr.with_graph_score(g, gr.graph_scores(g))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cut(gold(spark, sf_dir).select("ticker", "date", "asset_class", "dist_sma_20", "target_5d", "ret_5d_fwd"))
    return wf.always_hold(g).unionByName(wf.rule_signal(g))


def feature(name: str, digits: dict[str, int | None], layers: tuple[str, ...] = q.TO_SILVER, source: str = "silver", base: Query = silver) -> None:
    add(name, lambda s, d: rounded(base(s, d), digits), rounded_sql(layers, source, digits))


# sources and hygiene
PRICES = ["open", "high", "low", "close", "adj_close", "volume"]
add("bronze_panel", lambda s, d: pn.bars(s, d), q.with_(q.PANEL) + f"SELECT ticker, asset_class, sector, date, {', '.join(PRICES)} FROM panel")


def raw(s: SparkSession, d: str) -> DataFrame:
    """The panel as text, some prices unreadable, zero or negative, as a feed might send it."""
    day = F.dayofmonth("date")
    broken = F.when(day == 1, F.lit("n/a")).when(day == 2, F.lit("-1")).when(day == 3, F.lit("0")).otherwise(F.col("close").cast("string"))
    return pn.bars(s, d).select("ticker", F.col("date").cast("string").alias("Date"), broken.alias("Close"), F.col("adj_close").cast("string").alias("Adj Close"), F.lit(0).alias("Dividends"))


add("bronze_valid_rows", lambda s, d: br.valid_bars(br.typed_bars(br.normal_names(raw(s, d)))), q.with_(q.PANEL) + "SELECT ticker, date, close, adj_close FROM panel WHERE dayofmonth(date) > 3 AND close > 0 AND adj_close > 0")
add(
    "bronze_delisting",
    lambda s, d: br.live_entities(pn.bars(s, d), F.lit("1996-06-30").cast("date"), least=400).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows")),
    q.with_(q.PANEL) + "SELECT ticker, count(*) AS n_rows FROM panel WHERE ticker IN (SELECT ticker FROM panel GROUP BY ticker HAVING count(*) FILTER (date >= DATE '1996-06-30' - 730) >= 400) GROUP BY ticker",
)


def dimension(s: SparkSession, d: str) -> DataFrame:
    return pn.table(s, d, "nation").select(F.col("n_name").alias("ticker"), F.concat(F.lit("class_"), F.col("n_regionkey").cast("string")).alias("asset_class"))


def dimension_join(s: SparkSession, d: str) -> DataFrame:
    from ..sources.instruments import with_instrument

    return with_instrument(pn.bars(s, d).select(*KEYS, "close"), dimension(s, d))


add("instrument_dim_join", dimension_join, q.with_(q.PANEL) + "SELECT ticker, date, close, coalesce('class_' || n_regionkey, 'unknown') AS asset_class FROM panel LEFT JOIN nation ON n_name = ticker")

# one entity's own features
feature("log_returns", {f"ret_{k}d": 9 for k in (1, 5, 21, 63, 252)})
feature("momentum_12_1", {"mom_12_1": 9})
feature("volatility_family", {"vol_20": 6, "vol_60": 6, "vol_ratio": 6})
feature("vol_of_vol", {"vol_of_vol": 6})
feature("atr_14", {"atr_14": 6})
feature("sma_distance", {"sma_20": 5, "sma_60": 5, "sma_200": 5, "dist_sma_20": 7, "dist_sma_60": 7, "dist_sma_200": 7, "trend_strength": 7})
feature("bollinger", {"bb_mid": 5, "bb_up": 4, "bb_low_band": 4, "bb_pctb": 6, "bb_bandwidth": 6})
feature("liquidity_amihud", {"dollar_volume": None, "amihud": 12})
feature("turnover_z", {"turnover_z_60": 6})
feature("volume_z", {"vol_z_60": 6})
feature("intraday_gap_range", {"hl_range": 9, "intraday_ret": 9, "gap": 9})
feature("drawdown_family", {"drawdown": 9, "max_drawdown_252": 9, "drawdown_speed": 9})
feature("cum_index_252", {"cum_index": 7})
feature("downside_vol_20", {"downside_vol_20": 6})
feature("skew_kurt_60", {"skew_60": 6, "kurt_60": 5})
add("calendar_flags", lambda s, d: ft.calendar(pn.bars(s, d)).select(*KEYS, "dow", "month", "is_month_end", "is_quarter_end"), q.with_(*q.TO_SILVER) + "SELECT ticker, date, CAST(dow AS INT) AS dow, CAST(month AS INT) AS month, is_month_end, is_quarter_end FROM silver")
MACD = {"ema_12": 5, "ema_26": 5, "macd": 5, "macd_signal": 5, "macd_hist": 5}
add("ema_macd", lambda s, d: rounded(silver(s, d), MACD), q.with_(q.PANEL, q.EMA) + "SELECT ticker, date, round(ema_12, 5) AS ema_12, round(ema_26, 5) AS ema_26, round(ema_12 - ema_26, 5) AS macd, round(sig, 5) AS macd_signal, round(ema_12 - ema_26 - sig, 5) AS macd_hist FROM ema")
add("rsi_14", lambda s, d: rounded(silver(s, d), {"rsi_14": 6}), q.with_(q.PANEL, q.EMA) + "SELECT ticker, date, round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS rsi_14 FROM ema")
add(
    "winsorise_p99",
    lambda s, d: rounded(ft.winsorise(ft.liquidity(ft.returns(pn.bars(s, d))), "amihud"), {"amihud": 12}),
    q.with_(*q.TO_SILVER) + "SELECT ticker, date, round(CASE WHEN amihud > e THEN e ELSE amihud END, 12) AS amihud FROM silver, (SELECT quantile_disc(amihud, 0.99) AS e FROM silver)",
)

# across entities
feature("bench_corr_beta_idio", {"corr_spy_60": 6, "beta_60": 6, "idio_vol_60": 5}, q.TO_GOLD, "g3", lambda s, d: xs.against_benchmark(silver(s, d)))
feature("xs_percent_ranks", {"xs_ret_rank": 9, "xs_vol_rank": 9, "xs_mom_rank": 9}, q.TO_GOLD, "g3", lambda s, d: xs.ranks(silver(s, d).withColumns({c: F.col(c) for c in ("ret_1d", "vol_20", "mom_12_1")})))
add(
    "pct_rank_avg_ties",
    lambda s, d: rounded(xs.average_rank(pn.bars(s, d).withColumn("volume", F.when(F.col("volume") > 30, F.col("volume"))), "volume", "volume_rank"), {"volume_rank": 9}),
    q.with_(q.PANEL) + ", v AS (SELECT ticker, date, CASE WHEN volume > 30 THEN volume END AS volume FROM panel) SELECT ticker, date, CASE WHEN volume IS NOT NULL THEN round((rank() OVER (PARTITION BY date ORDER BY volume NULLS LAST) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY date), 9) END AS volume_rank FROM v",
)
feature("ret_z", {"ret_z_60": 6}, q.TO_GOLD, "g3", lambda s, d: xs.scaled_return(silver(s, d)))
add("forward_targets", lambda s, d: rounded(xs.forward_targets(pn.bars(s, d)), {"target_ret_5d": 9, "target_5d": None, "ret_5d_fwd": 9}), rounded_sql(q.TO_GOLD, "gold", {"target_ret_5d": 9, "target_5d": None, "ret_5d_fwd": 9}))
add(
    "hold_rate_stats",
    lambda s, d: xs.forward_targets(pn.bars(s, d)).agg(F.round(F.avg("target_5d"), 9).alias("hold_rate"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date")),
    q.with_(*q.TO_GOLD) + "SELECT round(avg(target_5d), 9) AS hold_rate, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date FROM gold",
)
add(
    "gold_winsorised",
    lambda s, d: rounded(winsorised_gold(s, d), {"amihud": 12, "ret_5d_fwd": 9}),
    q.with_(*q.TO_GOLD) + "SELECT ticker, date, round(CASE WHEN amihud > e THEN e ELSE amihud END, 12) AS amihud, round(ret_5d_fwd, 9) AS ret_5d_fwd FROM gold, (SELECT quantile_disc(amihud, 0.99) AS e FROM silver)",
)
add("gold_features", lambda s, d: rounded(gold(s, d), {"target_5d": None, "corr_spy_60": 6, "xs_mom_rank": 9, "skew_60": 6, "ret_z_60": 6, "drawdown": 9}), rounded_sql(q.TO_GOLD, "gold", {"target_5d": None, "corr_spy_60": 6, "xs_mom_rank": 9, "skew_60": 6, "ret_z_60": 6, "drawdown": 9}))

# the graph
add("refit_dates", lambda s, d: gr.refit_dates(xs.forward_targets(pn.bars(s, d))), q.with_(*q.TO_GOLD, q.REFITS) + "SELECT refit_date FROM refits")


def node_query(s: SparkSession, d: str) -> DataFrame:
    g = cut(gold(s, d))
    return rounded(gr.nodes(g, gr.refit_dates(g)), {"score": 6}, ["refit_date", "id"])


def edge_query(s: SparkSession, d: str) -> DataFrame:
    g = cut(gold(s, d).select("ticker", "date", "ret_1d"))
    return rounded(gr.edges(g, gr.refit_dates(g)), {"weight": 7}, ["refit_date", "src", "dst"])


add("node_scores", node_query, q.with_(*q.TO_GRAPH) + "SELECT refit_date, id, round(score, 6) AS score FROM nodes")
add("corr_edges", edge_query, q.with_(*q.TO_GRAPH) + "SELECT refit_date, src, dst, round(weight, 7) AS weight FROM edges")
add("message_passing", lambda s, d: rounded(gr.graph_scores(gold(s, d)), {"score": 6}, ["refit_date", "id"]), q.with_(*q.TO_GRAPH) + "SELECT refit_date, id, round(score, 6) AS score FROM h3")
add("gold_with_graph_score", lambda s, d: rounded(gold_with_score(s, d), {"pregel_score": 6}), q.with_(*q.TO_GRAPH) + "SELECT ticker, date, round(coalesce(score, 0.5), 6) AS pregel_score FROM gold LEFT JOIN h3 ON id = ticker AND refit_date = date")

_PLACES = ["date", "src", "dst"]
add("daily_graph", lambda s, d: rounded(gr.daily_graph(cut(gold(s, d).select("ticker", "date", "corr_spy_60", *gr.NODE_FEATURES))), {"weight": 7}, _PLACES), q.with_(*q.TO_GOLD, q.DAILY) + "SELECT date, src, dst, round(weight, 7) AS weight FROM daily")


def neighbour_query(s: SparkSession, d: str) -> DataFrame:
    g = cut(gold(s, d).select("ticker", "date", "corr_spy_60", *gr.NODE_FEATURES))
    return rounded(gr.neighbour_means(g, cut(gr.daily_graph(g))), {f"nb_{c}": 6 for c in gr.NODE_FEATURES})


add("neighbour_means", neighbour_query, q.with_(*q.TO_GOLD, q.DAILY) + "SELECT date, dst AS ticker, " + ", ".join(f"round(avg({c}), 6) AS nb_{c}" for c in gr.NODE_FEATURES) + " FROM daily JOIN (SELECT ticker AS src, date, " + ", ".join(gr.NODE_FEATURES) + " FROM gold) USING (date, src) GROUP BY date, dst")
add("trailing_dates", lambda s, d: wf.trailing_dates(xs.forward_targets(pn.bars(s, d))).select(*KEYS), q.with_(*q.TO_GOLD) + "SELECT ticker, date FROM gold WHERE date IN (SELECT DISTINCT date FROM gold ORDER BY date DESC LIMIT 252)")

# walk-forward
add("walk_forward_points", lambda s, d: wf.points(xs.forward_targets(pn.bars(s, d))).select(*KEYS, "t", "n_train"), q.with_(*q.TO_GOLD, q.POINTS) + "SELECT ticker, date, CAST(t AS INT) AS t, CAST(t - 5 AS INT) AS n_train FROM points")
PRED = ["ticker", "date", "asset_class", "signal", "model"]
add("always_hold_predictions", lambda s, d: rounded(wf.always_hold(xs.forward_targets(pn.bars(s, d))), {"p_hold": 9, "ret_5d_fwd": 9}, PRED), q.with_(*q.TO_PREDICTIONS) + "SELECT ticker, date, asset_class, signal, model, round(p_hold, 9) AS p_hold, round(ret_5d_fwd, 9) AS ret_5d_fwd FROM preds WHERE model = 'always_hold'")
BAYES = wf.BAYES_FEATURES
add(
    "prior_calibration",
    lambda s, d: wf.calibration(gold_with_score(s, d), BAYES).select(F.round("sigma_sq", 9).alias("sigma_sq"), F.round("delta", 7).alias("delta")),
    q.with_(*q.TO_GRAPH, q.SCORED, q.PRIOR) + "SELECT round(sigma_sq, 9) AS sigma_sq, round(delta, 7) AS delta FROM prior",
)


def gram_query(s: SparkSession, d: str) -> DataFrame:
    g = wf.gram_states(cut(gold_with_score(s, d).select("ticker", "date", "asset_class", "target_ret_5d", "ret_5d_fwd", *BAYES)), features=BAYES)
    return g.select(*KEYS, F.col("n_seen").cast("long").alias("n_seen"), *(F.round(F.col("gram")[i], 6).alias(f"g{n}") for n, i in _CELLS.items()), *(F.round(F.col("moment")[i], 6).alias(f"m{i}") for i in range(len(BAYES))))


#: Cells of the upper triangle by name, row by row.
_CELLS = {f"{i}_{j}": n for n, (i, j) in enumerate((i, j) for i in range(len(BAYES)) for j in range(i, len(BAYES)))}


_X = [f"coalesce({c}, 0)" for c in BAYES]
add(
    "bayes_gram",
    gram_query,
    q.with_(*q.TO_GRAPH, q.SCORED, q.SCORED_POINTS)
    + "SELECT p.ticker, p.date, count(*) AS n_seen, "
    + ", ".join([*(f"round(sum(x{i} * x{j}), 6) AS g{i}_{j}" for i in range(len(BAYES)) for j in range(i, len(BAYES))), *(f"round(sum(x{i} * y), 6) AS m{i}" for i in range(len(BAYES)))])
    + f" FROM points p JOIN (SELECT ticker, t, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X))}, target_ret_5d AS y FROM indexed WHERE t % 63 = 0) r ON r.ticker = p.ticker AND r.t < p.t - 5 GROUP BY ALL",
)
add(
    "bayes_predictions",
    lambda s, d: rounded(wf.bayes(gold_with_score(s, d)), {"p_hold": 6, "ret_5d_fwd": 9}, ["ticker", "date", "asset_class", "signal", "model"]),
    q.with_(*q.TO_GRAPH, q.SCORED, q.SCORED_POINTS, q.PRIOR, q.POSTERIOR) + "SELECT ticker, date, asset_class, CAST(p >= 0.5 AS INT) AS signal, 'bayesian_peft' AS model, round(p, 6) AS p_hold, round(ret_5d_fwd, 9) AS ret_5d_fwd FROM posterior",
)
add("logit_predictions", lambda s, d: wf.logit(gold_with_score(s, d)))
add("gbt_predictions", lambda s, d: wf.boosted(gold_with_score(s, d), trees=100))

# evaluation
R = "signal_ret"


def in_logs(df: DataFrame, keys: list[str], digits: dict[str, int | None]) -> DataFrame:
    """An equity curve as the sign and logarithm of its value, and the logarithm of one minus the drawdown: the panel's
    prices jump so far that products of returns have no common scale to round them on."""
    shown = df.withColumns({"equity_sign": F.signum("equity").cast("int"), "equity_log": F.when(F.col("equity") != 0, F.log(F.abs("equity"))), "depth_log": F.when(F.col("drawdown") < 1, F.log(1 - F.col("drawdown")))})
    return rounded(shown, digits | {"equity_sign": None, "equity_log": 6, "depth_log": 6}, keys)


LOGS_SQL = "CAST(sign(e) AS INT) AS equity_sign, CASE WHEN e <> 0 THEN round(ln(abs(e)), 6) END AS equity_log, CASE WHEN e / nullif(top, 0) < 2 THEN round(ln(2 - e / nullif(top, 0)), 6) END AS depth_log"


add(
    "sharpe_sortino_calmar",
    lambda s, d: ratio_query(s, d),
    q.with_(*q.TO_PREDICTIONS)
    + ", eq AS (SELECT model, date, ticker, product(1 + coalesce(signal_ret, 0)) OVER (PARTITION BY model ORDER BY date, ticker ROWS UNBOUNDED PRECEDING) AS e FROM rets), dd AS (SELECT model, e / max(e) OVER (PARTITION BY model ORDER BY date, ticker ROWS UNBOUNDED PRECEDING) - 1 AS d FROM eq), m AS (SELECT model, min(d) AS mdd FROM dd GROUP BY model)"
    + f" SELECT model, round({q.sharpe(R)}, 7) AS sharpe, round(CASE WHEN count(CASE WHEN signal_ret < 0 THEN 1 END) >= 2 THEN avg(signal_ret) / stddev_samp(CASE WHEN signal_ret < 0 THEN signal_ret END) * 2 END, 7) AS sortino, round(CASE WHEN abs(any_value(mdd)) > 1e-6 THEN avg(signal_ret) * 4 / abs(any_value(mdd)) END, 7) AS calmar FROM rets JOIN m USING (model) GROUP BY model",
)


def ratio_query(s: SparkSession, d: str) -> DataFrame:
    full = ev.strategy_returns(predictions(s, d))
    r = F.col(R)
    table = full.groupBy("model").agg(ev.sharpe(r).alias("sharpe"), ev.sortino(r).alias("sortino"), F.avg(r).alias("_mean")).join(ev.max_drawdown(full), "model")
    calmar = F.when(F.abs("max_drawdown") > 1e-6, F.col("_mean") * PARAMS.periods / F.abs("max_drawdown"))
    return table.withColumn("calmar", calmar).select("model", *(F.round(c, 7).alias(c) for c in ("sharpe", "sortino", "calmar")))


add(
    "max_drawdown_equity",
    lambda s, d: in_logs(ev.equity(ev.strategy_returns(predictions(s, d)), R), ["model", "date", "ticker"], {}),
    q.with_(*q.TO_PREDICTIONS)
    + ", eq AS (SELECT model, date, ticker, product(1 + coalesce(signal_ret, 0)) OVER (PARTITION BY model ORDER BY date, ticker ROWS UNBOUNDED PRECEDING) AS e FROM rets), dd AS (SELECT *, max(e) OVER (PARTITION BY model ORDER BY date, ticker ROWS UNBOUNDED PRECEDING) AS top FROM eq) SELECT model, date, ticker, " + LOGS_SQL + " FROM dd",
)
add(
    "win_profit_factor",
    lambda s, d: (
        ev.strategy_returns(predictions(s, d))
        .groupBy("model")
        .agg(F.round(ev.win_rate(F.col(R)), 9).alias("win_rate"), F.round(ev.profit_factor(F.col(R)), 7).alias("profit_factor"), F.round(F.avg(F.when((F.col("signal") == 1) & (F.col(R) > 0), F.col(R))) * 100, 7).alias("avg_win_pct"), F.round(F.avg(F.when((F.col("signal") == 1) & (F.col(R) < 0), F.col(R))) * 100, 7).alias("avg_loss_pct"))
    ),
    q.with_(*q.TO_PREDICTIONS)
    + "SELECT model, round(avg(CASE WHEN signal = 1 THEN CAST(signal_ret > 0 AS INT) END), 9) AS win_rate, round(sum(CASE WHEN signal = 1 AND signal_ret > 0 THEN signal_ret END) / abs(sum(CASE WHEN signal = 1 AND signal_ret < 0 THEN signal_ret END)), 7) AS profit_factor, round(avg(CASE WHEN signal = 1 AND signal_ret > 0 THEN signal_ret END) * 100, 7) AS avg_win_pct, round(avg(CASE WHEN signal = 1 AND signal_ret < 0 THEN signal_ret END) * 100, 7) AS avg_loss_pct FROM rets GROUP BY model",
)
add("tc_sensitivity", lambda s, d: rounded(ev.cost_sensitivity(predictions(s, d)), {"sharpe": 7}, ["bps", "model"]), q.with_(*q.TO_PREDICTIONS) + f"SELECT bps, model, round({q.sharpe('(signal_ret - turnover * bps / 10000.0)')}, 7) AS sharpe FROM rets, (VALUES (0), (5), (10), (20)) b(bps) GROUP BY bps, model")
_LEADS = ", ".join(f"lead(d, {j}) OVER w AS d{j}" for j in range(1, 6))
_CASE = " ".join(f"WHEN {' + '.join(f'd{i}' for i in range(1, j + 1))} < -0.02 THEN -0.02" for j in range(1, 6))
add(
    "stop_loss_exit",
    lambda s, d: rounded(stop_query(s, d), {"sl_ret": 9}, ["model", "ticker", "date"]),
    q.with_(*q.TO_PREDICTIONS) + f", r AS (SELECT p.*, CASE WHEN g.ticker IS NULL THEN 0.0 ELSE g.ret_1d END AS d FROM preds p LEFT JOIN gold g USING (ticker, date)), l AS (SELECT *, {_LEADS} FROM r WINDOW w AS (PARTITION BY model, ticker ORDER BY date)) SELECT model, ticker, date, round(CASE WHEN signal = 1 THEN CASE {_CASE} ELSE coalesce(d1 + d2 + d3 + d4 + d5, 0.0) END ELSE 0.0 END, 9) AS sl_ret FROM l",
)


def stop_query(s: SparkSession, d: str) -> DataFrame:
    g = cut(gold(s, d).select("ticker", "date", "asset_class", "ret_1d", "dist_sma_20", "target_5d", "ret_5d_fwd"))
    return ev.stop_loss(wf.always_hold(g).unionByName(wf.rule_signal(g)), g.select("ticker", "date", "ret_1d"))


_G = [(g, "sharpe_" + g.replace(" ", "_")) for g in PARAMS.groups]
add(
    "sharpe_by_group_pivot",
    lambda s, d: rounded(ev.group_sharpe(ev.strategy_returns(predictions(s, d))), {c: 7 for _, c in _G}, ["model"]),
    q.with_(*q.TO_PREDICTIONS) + "SELECT model, " + ", ".join(f"round({q.sharpe(f'''(CASE WHEN asset_class = '{g}' THEN signal_ret END)''')}, 7) AS {c}" for g, c in _G) + " FROM rets GROUP BY model",
)
_LAGS = ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in range(1, 5))
_VAR = " + ".join(["var_samp(d) / count(*)", *(f"2 * (1 - {k} / 5.0) * coalesce(covar_samp(d, l{k}), 0) / count(*)" for k in range(1, 5))])
add(
    "dm_statistic",
    lambda s, d: rounded(ev.dm_statistic(predictions(s, d)), {"n": None, "dm_stat": 6}, ["model"]),
    q.with_(*q.TO_PREDICTIONS) + f", b AS (SELECT m.model, m.ticker, m.date, a.signal_ret * a.signal_ret - m.signal_ret * m.signal_ret AS d FROM rets m JOIN rets a ON a.model = 'always_hold' AND a.ticker = m.ticker AND a.date = m.date WHERE m.model <> 'always_hold'), l AS (SELECT *, {_LAGS} FROM b WINDOW w AS (PARTITION BY model ORDER BY ticker, date)) SELECT model, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(d) / sqrt(greatest({_VAR}, 1e-12)), 6) END AS dm_stat FROM l GROUP BY model",
)
# the two-sided p-value is one minus the normal density's integral over the statistic's range, by Simpson's rule
add(
    "dm_tests",
    lambda s, d: rounded(ev.dm_tests(predictions(s, d)), {"dm_stat": 6, "p_value": 5, "result": None}, ["model"]),
    "WITH st AS (" + SQL["dm_statistic"] + ")"
    + ", pv AS (SELECT st.*, (SELECT greatest(0, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(st.dm_stat * i / 4000.0) * (st.dm_stat * i / 4000.0) / 2)) * abs(st.dm_stat) / 4000 / 3 / sqrt(2 * pi())) FROM range(4001) r(i)) AS p FROM st)"
    + " SELECT model, dm_stat, CASE WHEN dm_stat IS NOT NULL THEN round(p, 5) END AS p_value, CASE WHEN dm_stat IS NULL THEN 'insufficient data' WHEN dm_stat < 0 AND p < 0.05 THEN 'model_1_better' WHEN dm_stat > 0 AND p < 0.05 THEN 'model_2_better' ELSE 'no_significant_difference' END AS result FROM pv",
)
add("bootstrap_sharpe_ci", lambda s, d: ev.bootstrap_sharpe(ev.strategy_returns(predictions(s, d))))
_METRICS = {
    "ann_return_pct": "avg(signal_ret) * 400",
    "sharpe": q.sharpe(R),
    "sortino": "CASE WHEN count(CASE WHEN signal_ret < 0 THEN 1 END) >= 2 THEN avg(signal_ret) / stddev_samp(CASE WHEN signal_ret < 0 THEN signal_ret END) * 2 END",
    "vol_ann_pct": "stddev_samp(signal_ret) * 200",
    "win_rate_pct": "avg(CASE WHEN signal = 1 THEN CAST(signal_ret > 0 AS INT) END) * 100",
    "profit_factor": "sum(CASE WHEN signal = 1 AND signal_ret > 0 THEN signal_ret END) / abs(sum(CASE WHEN signal = 1 AND signal_ret < 0 THEN signal_ret END))",
    "avg_win_pct": "avg(CASE WHEN signal = 1 AND signal_ret > 0 THEN signal_ret END) * 100",
    "avg_loss_pct": "avg(CASE WHEN signal = 1 AND signal_ret < 0 THEN signal_ret END) * 100",
    "sharpe_10bps": q.sharpe("(signal_ret - turnover * 10 / 10000.0)"),
    "ann_return_10bps": "avg(signal_ret - turnover * 10 / 10000.0) * 400",
    "sharpe_stoploss": q.sharpe("sl_ret"),
    "ann_return_sl_pct": "avg(sl_ret) * 400",
    "turnover_per_yr": "avg(turnover) * 4",
    "hold_rate_pct": "avg(signal) * 100",
} | {c: q.sharpe(f"(CASE WHEN asset_class = '{g}' THEN signal_ret END)") for g, c in _G}
SUMMARY = [*_METRICS, "calmar", "max_drawdown_pct"]
#: Drawdowns of products of such returns have many digits before the point.
SUMMARY_DIGITS = {c: 6 for c in SUMMARY} | {"max_drawdown_pct": 3}
MODELS = ("always_hold", "sma_rule", "a_model_without_rows")
STOPPED_SQL = f", r AS (SELECT p.*, CASE WHEN g.ticker IS NULL THEN 0.0 ELSE g.ret_1d END AS d FROM rets p LEFT JOIN (SELECT ticker, date, ret_1d FROM gold) g USING (ticker, date)), l AS (SELECT *, {_LEADS} FROM r WINDOW w AS (PARTITION BY model, ticker ORDER BY date)), sl AS (SELECT *, CASE WHEN signal = 1 THEN CASE {_CASE} ELSE coalesce(d1 + d2 + d3 + d4 + d5, 0.0) END ELSE 0.0 END AS sl_ret FROM l)"
add(
    "evaluation_summary",
    lambda s, d: rounded(summary_query(s, d), {"n_predictions": None, "n_tickers": None} | SUMMARY_DIGITS, ["model"]),
    q.with_(*q.TO_PREDICTIONS)
    + STOPPED_SQL
    + ", eq AS (SELECT model, date, ticker, product(1 + coalesce(signal_ret, 0)) OVER (PARTITION BY model ORDER BY date, ticker ROWS UNBOUNDED PRECEDING) AS e FROM rets), dd AS (SELECT model, e / max(e) OVER (PARTITION BY model ORDER BY date, ticker ROWS UNBOUNDED PRECEDING) - 1 AS d FROM eq), m AS (SELECT model, min(d) AS mdd FROM dd GROUP BY model)"
    + ", t AS (SELECT model, count(*) AS n_predictions, count(DISTINCT ticker) AS n_tickers, "
    + ", ".join(f"{sql} AS {c}" for c, sql in _METRICS.items())
    + ", CASE WHEN abs(any_value(mdd)) > 1e-6 THEN avg(signal_ret) * 4 / abs(any_value(mdd)) END AS calmar, any_value(mdd) * 100 AS max_drawdown_pct FROM sl JOIN m USING (model) GROUP BY model)"
    + " SELECT model, coalesce(n_predictions, 0) AS n_predictions, coalesce(n_tickers, 0) AS n_tickers, "
    + ", ".join(f"round({c}, {n}) AS {c}" for c, n in SUMMARY_DIGITS.items())
    + f" FROM (SELECT unnest({list(MODELS)}) AS model) LEFT JOIN t USING (model)",
)


def summary_query(s: SparkSession, d: str) -> DataFrame:
    g = cut(gold(s, d).select("ticker", "date", "asset_class", "ret_1d", "dist_sma_20", "target_5d", "ret_5d_fwd"))
    return ev.summary(cut(wf.always_hold(g).unionByName(wf.rule_signal(g))), g.select("ticker", "date", "ret_1d"), models=MODELS, interval=False)


def fitted_models(s: SparkSession, d: str) -> DataFrame:
    """Predictions of the Bayesian and the logistic model beside the baseline, without the excluded tickers."""
    g = cut(gold_with_score(s, d)).filter(~F.col("ticker").isin(*EXCLUDED))
    return cut(wf.always_hold(g).unionByName(wf.bayes(g)).unionByName(wf.logit(g)))


add("model_evaluation", lambda s, d: ev.summary(fitted_models(s, d), xs.forward_targets(ft.returns(pn.bars(s, d))).select("ticker", "date", "ret_1d")))
add("model_dm_tests", lambda s, d: ev.dm_tests(fitted_models(s, d)))
add(
    "stop_loss_comparison",
    lambda s, d: rounded(ev.strategy_returns(stop_query(s, d)).groupBy("model").agg(ev.sharpe(F.col(R)).alias("sharpe"), ev.sharpe(F.col("sl_ret")).alias("sharpe_stoploss")), {"sharpe": 7, "sharpe_stoploss": 7}, ["model"]),
    q.with_(*q.TO_PREDICTIONS) + STOPPED_SQL + f" SELECT model, round({q.sharpe(R)}, 7) AS sharpe, round({q.sharpe('sl_ret')}, 7) AS sharpe_stoploss FROM sl GROUP BY model",
)


add(
    "portfolio_equity",
    lambda s, d: in_logs(ev.portfolio(predictions(s, d)), ["model", "date"], {"ret": 9}),
    q.with_(*q.TO_PREDICTIONS) + ", p AS (SELECT model, date, coalesce(avg(signal_ret), 0) AS ret FROM rets GROUP BY ALL), q AS (SELECT *, product(1 + ret) OVER w AS e FROM p WINDOW w AS (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING)), z AS (SELECT *, max(e) OVER (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM q) SELECT model, date, round(ret, 9) AS ret, " + LOGS_SQL + " FROM z",
)
_W = [(g, "win_" + g.replace(" ", "_")) for g in PARAMS.groups]
add("win_rate_heatmap", lambda s, d: rounded(ev.win_heatmap(predictions(s, d)), {c: 9 for _, c in _W}, ["model"]), q.with_(*q.TO_PREDICTIONS) + "SELECT model, " + ", ".join(f"round(avg(CASE WHEN asset_class = '{g}' THEN CAST(ret_5d_fwd > 0 AND signal = 1 AS INT) END), 9) AS {c}" for g, c in _W) + " FROM preds GROUP BY model")
add(
    "benchmark_overlay",
    lambda s, d: overlay_query(s, d),
    q.with_(*q.TO_GOLD, q.REFITS, q.POINTS, q.PREDICTIONS) + ", o AS (SELECT * FROM rets WHERE ticker IN (FROM gbench) ORDER BY date DESC, model LIMIT 60) SELECT model, ticker, date, signal, round(ret_5d_fwd, 9) AS ret_5d_fwd, round(product(1 + coalesce(signal_ret, 0)) OVER (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING), 9) AS cumulative FROM o",
)


def overlay_query(s: SparkSession, d: str) -> DataFrame:
    g = cut(gold(s, d).select("ticker", "date", "asset_class", "dist_sma_20", "target_5d", "ret_5d_fwd"))
    pred = wf.always_hold(g).unionByName(wf.rule_signal(g))
    return rounded(ev.benchmark_overlay(pred, xs.benchmark_rows(g.select("ticker", "date")).select("ticker").distinct()), {"ret_5d_fwd": 9, "cumulative": 9}, ["model", "ticker", "date", "signal"])


# events
add(
    "event_bars",
    lambda s, d: event_bars(pn.table(s, d, "events"), "1 day").withColumn("volume", F.round("volume", 4)),
    "SELECT event_type, date_trunc('day', ts) AS bar_start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, round(sum(value), 4) AS volume, count(*) AS n FROM events GROUP BY ALL",
)
