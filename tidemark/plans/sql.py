"""DuckDB SQL of the panel's layers, as common table expressions that the queries' SQL is put together from."""

from __future__ import annotations

from .spec import BAYES_FEATURES

PANEL = """
panel AS (
  SELECT n_name AS ticker, r_name AS asset_class, 'sector_' || r_name AS sector, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS close,
    last((l_extendedprice / l_quantity) * (1 - l_discount) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS adj_close,
    sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
)"""

SILVER = """
s1 AS (
  SELECT *, {rets},
    lag(adj_close, 21) OVER w / nullif(lag(adj_close, 252) OVER w, 0) - 1 AS mom_12_1,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    avg(adj_close) OVER w20 AS sma_20, avg(adj_close) OVER w60 AS sma_60, avg(adj_close) OVER w200 AS sma_200,
    stddev_samp(adj_close) OVER w20 AS bsd,
    adj_close * volume AS dollar_volume, (high - low) / nullif(adj_close, 0) AS hl_range, (close - open) / nullif(open, 0) AS intraday_ret,
    open / nullif(lag(adj_close) OVER w, 0) - 1 AS gap,
    adj_close / nullif(max(adj_close) OVER w252, 0) - 1 AS drawdown,
    dayofweek(date) + 1 AS dow, month(date) AS month,
    CAST(last_day(date) = date AS INT) AS is_month_end, CAST(last_day(date) = date AND month(date) IN (3, 6, 9, 12) AS INT) AS is_quarter_end
  FROM panel
  WINDOW w AS (PARTITION BY ticker ORDER BY date), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING),
    w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING), w200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING),
    w252 AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)
),
s2 AS (
  SELECT *, stddev_samp(ret_1d) OVER w20 * sqrt(252) AS vol_20, stddev_samp(ret_1d) OVER w60 * sqrt(252) AS vol_60, avg(tr) OVER w14 AS atr_14,
    adj_close / nullif(sma_20, 0) - 1 AS dist_sma_20, adj_close / nullif(sma_60, 0) - 1 AS dist_sma_60, adj_close / nullif(sma_200, 0) - 1 AS dist_sma_200,
    sma_20 AS bb_mid, sma_20 + 2 * bsd AS bb_up, sma_20 - 2 * bsd AS bb_low_band,
    abs(ret_1d) / nullif(dollar_volume, 0) AS amihud,
    (dollar_volume - avg(dollar_volume) OVER w60) / nullif(stddev_samp(dollar_volume) OVER w60, 0) AS turnover_z_60,
    (volume - avg(volume) OVER w60) / nullif(stddev_samp(volume) OVER w60, 0) AS vol_z_60,
    exp(sum(ret_1d) OVER w252) AS cum_index, min(drawdown) OVER w252 AS max_drawdown_252, drawdown - lag(drawdown, 5) OVER w AS drawdown_speed,
    CASE WHEN count(CASE WHEN ret_1d < 0 THEN ret_1d END) OVER w20 >= 5 THEN stddev_samp(CASE WHEN ret_1d < 0 THEN ret_1d END) OVER w20 * sqrt(252) END AS downside_vol_20,
    CASE WHEN count(ret_1d) OVER w60 >= 20 THEN CASE WHEN stddev_samp(ret_1d) OVER w60 = 0 THEN 0.0 ELSE skewness(ret_1d) OVER w60 END END AS skew_60,
    CASE WHEN count(ret_1d) OVER w60 >= 20 THEN CASE WHEN stddev_samp(ret_1d) OVER w60 = 0 THEN -3.0 ELSE kurtosis(ret_1d) OVER w60 END END AS kurt_60
  FROM s1
  WINDOW w AS (PARTITION BY ticker ORDER BY date), w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING),
    w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING), w252 AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)
),
silver AS (
  SELECT *, vol_20 / nullif(vol_60, 0) AS vol_ratio, stddev_samp(vol_20) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS vol_of_vol,
    abs(dist_sma_20) AS trend_strength,
    CASE WHEN bb_up - bb_low_band IS NULL OR bb_up - bb_low_band = 0 THEN 0.5 ELSE (adj_close - bb_low_band) / (bb_up - bb_low_band) END AS bb_pctb,
    (bb_up - bb_low_band) / nullif(bb_mid, 0) AS bb_bandwidth
  FROM s2
)""".format(rets=", ".join(f"CASE WHEN adj_close / nullif(lag(adj_close, {k}) OVER w, 0) > 0 THEN ln(adj_close / nullif(lag(adj_close, {k}) OVER w, 0)) END AS ret_{k}d" for k in (1, 5, 21, 63, 252)))  # fmt: skip

EMA = """
numbered AS (
  SELECT ticker, date, adj_close AS p, adj_close - lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS chg,
    row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn
  FROM panel
),
ema AS (
  SELECT ticker, rn, date, p AS ema_12, p AS ema_26, 0.0::DOUBLE AS sig, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.rn, n.date, e.ema_12 + (n.p - e.ema_12) * 2 / 13, e.ema_26 + (n.p - e.ema_26) * 2 / 27,
    e.sig + ((e.ema_12 + (n.p - e.ema_12) * 2 / 13) - (e.ema_26 + (n.p - e.ema_26) * 2 / 27) - e.sig) * 0.2,
    CASE WHEN e.g IS NULL THEN greatest(n.chg, 0) ELSE e.g + (greatest(n.chg, 0) - e.g) / 14 END,
    CASE WHEN e.l IS NULL THEN greatest(-n.chg, 0) ELSE e.l + (greatest(-n.chg, 0) - e.l) / 14 END
  FROM ema e JOIN numbered n ON n.ticker = e.ticker AND n.rn = e.rn + 1
)"""

BENCH = """
bench AS (SELECT ticker FROM panel GROUP BY ticker ORDER BY count(*) DESC, ticker LIMIT 1)"""

GOLD = """
g0 AS (SELECT s.*, b.ret_1d AS br, b.vol_20 AS bv FROM silver s LEFT JOIN (SELECT date, ret_1d, vol_20 FROM silver WHERE ticker IN (FROM bench)) b USING (date)),
g1 AS (
  SELECT *, CASE WHEN count(*) OVER w >= 20 THEN covar_samp(coalesce(ret_1d, 0), coalesce(br, 0)) OVER w / nullif(stddev_samp(coalesce(ret_1d, 0)) OVER w * stddev_samp(coalesce(br, 0)) OVER w, 0) END AS corr_spy_60
  FROM g0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)
),
g2 AS (SELECT *, corr_spy_60 * coalesce(vol_20, 0) / nullif(coalesce(bv, 0), 0) AS beta_60 FROM g1),
g3 AS (
  SELECT *, sqrt(greatest(coalesce(vol_20, 0) * coalesce(vol_20, 0) - coalesce(beta_60, 0) * coalesce(beta_60, 0) * coalesce(bv, 0) * coalesce(bv, 0), 0)) AS idio_vol_60,
    percent_rank() OVER (PARTITION BY date ORDER BY ret_1d NULLS FIRST) AS xs_ret_rank, percent_rank() OVER (PARTITION BY date ORDER BY vol_20 NULLS FIRST) AS xs_vol_rank,
    percent_rank() OVER (PARTITION BY date ORDER BY mom_12_1 NULLS FIRST) AS xs_mom_rank, ret_1d / nullif(vol_20 / sqrt(252), 0) AS ret_z_60,
    lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY date) AS fwd
  FROM g2
),
gold AS (
  SELECT *, ln(fwd / adj_close) AS target_ret_5d, ln(fwd / adj_close) AS ret_5d_fwd, CASE WHEN ln(fwd / adj_close) > 0 THEN 1 ELSE 0 END AS target_5d
  FROM g3 WHERE fwd > 0 AND adj_close > 0
)"""

#: The benchmark of the gold layer, whose last rows are gone.
REFITS = """
gbench AS (SELECT ticker FROM gold GROUP BY ticker ORDER BY count(*) DESC, ticker LIMIT 1),
refits AS (SELECT date AS refit_date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM gold WHERE ticker IN (FROM gbench)) WHERE t >= 504 AND (t - 504) % 63 = 0)"""

_F = ("xs_ret_rank", "xs_vol_rank", "xs_mom_rank", "dist_sma_20", "dist_sma_60", "bb_pctb", "ret_z_60", "vol_ratio", "drawdown", "trend_strength")

GRAPH = f"""
snap AS (SELECT refit_date, ticker AS id, {', '.join(_F)} FROM gold JOIN refits ON date = refit_date WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _F)}),
nodes AS (
  SELECT refit_date, id, ({' + '.join(f'({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-9)' for c in _F)}) / {len(_F)} AS score
  FROM snap WINDOW w AS (PARTITION BY refit_date) QUALIFY count(*) OVER w >= 5
),
near AS (SELECT refit_date, ticker AS id, date, ret_1d FROM gold JOIN refits ON date BETWEEN refit_date - 90 AND refit_date WHERE ret_1d IS NOT NULL),
pairs AS (
  SELECT a.refit_date, a.id AS src, b.id AS dst, abs(covar_samp(a.ret_1d, b.ret_1d) / nullif(stddev_samp(a.ret_1d) * stddev_samp(b.ret_1d), 0)) AS weight
  FROM near a JOIN near b ON a.refit_date = b.refit_date AND a.date = b.date AND a.id < b.id GROUP BY ALL
),
edges AS (SELECT refit_date, src, dst, weight FROM pairs WHERE weight > 0.3 UNION ALL SELECT refit_date, dst, src, weight FROM pairs WHERE weight > 0.3),
h0 AS (SELECT * FROM nodes WHERE refit_date IN (SELECT refit_date FROM edges)),
""" + ",\n".join(f"h{k} AS (SELECT h.refit_date, h.id, coalesce(m.v, h.score) AS score FROM h{k - 1} h LEFT JOIN (SELECT e.refit_date, e.dst, tanh(sum(s.score * e.weight) / nullif(sum(e.weight), 0)) AS v FROM edges e JOIN h{k - 1} s ON s.refit_date = e.refit_date AND s.id = e.src GROUP BY ALL) m ON m.refit_date = h.refit_date AND m.dst = h.id)" for k in (1, 2, 3))  # fmt: skip

POINTS = """
indexed AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY ticker) AS n FROM gold),
points AS (SELECT * FROM indexed WHERE n >= 510 AND t >= 504 AND t < n - 5 AND (t - 504) % 63 = 0)"""

#: The gold layer with the graph's score, and the points on it.
SCORED = """
scored AS (SELECT gold.*, coalesce(score, 0.5) AS pregel_score FROM gold LEFT JOIN h3 ON id = ticker AND refit_date = date)"""
SCORED_POINTS = POINTS.replace("FROM gold)", "FROM scored)")

_D = len(BAYES_FEATURES)
PRIOR = f"""
spreads AS (SELECT least(greatest(var_pop(target_ret_5d), 1e-6), 1.0) AS s, ({' + '.join(f'var_samp({c})' for c in BAYES_FEATURES)}) / {_D} AS v FROM scored),
prior AS (SELECT s AS sigma_sq, least(greatest(s / (v + 1e-8), 0.01), 10.0) AS delta FROM spreads)"""

#: The Bayesian model as it is defined: one observation after another changes weights and covariance.
POSTERIOR = f"""
vectors AS (SELECT ticker, t, [{', '.join(f'coalesce({c}, 0)::DOUBLE' for c in BAYES_FEATURES)}] AS x, target_ret_5d AS y FROM indexed),
seen AS (SELECT ticker, t // 63 + 1 AS step, x, y FROM vectors WHERE t % 63 = 0),
learned AS (
  SELECT ticker, 0::BIGINT AS step, list_transform(range({_D}), lambda i: 0.0::DOUBLE) AS w,
    list_transform(range({_D}), lambda i: list_transform(range({_D}), lambda j: CASE WHEN i = j THEN delta ELSE 0.0::DOUBLE END)) AS p, sigma_sq
  FROM (SELECT DISTINCT ticker FROM seen), prior
  UNION ALL
  SELECT ticker, step, list_transform(range(1, {_D + 1}), lambda i: w[i] + px[i] / d * (y - list_dot_product(x, w))) AS w,
    list_transform(range(1, {_D + 1}), lambda i: list_transform(range(1, {_D + 1}), lambda j: p[i][j] - px[i] * px[j] / d)) AS p, sigma_sq
  FROM (SELECT *, sigma_sq + list_dot_product(x, px) AS d
        FROM (SELECT l.ticker, s.step, l.w, l.p, l.sigma_sq, s.x, s.y, list_transform(l.p, lambda r: list_dot_product(r, s.x)) AS px FROM learned l JOIN seen s ON s.ticker = l.ticker AND s.step = l.step + 1))
),
posterior AS (
  SELECT o.ticker, o.date, o.asset_class, o.ret_5d_fwd,
    1 / (1 + exp(-list_dot_product(v.x, l.w) / sqrt(1 + pi() / 8 * (list_dot_product(v.x, list_transform(l.p, lambda r: list_dot_product(r, v.x))) + l.sigma_sq)))) AS p
  FROM points o JOIN vectors v ON v.ticker = o.ticker AND v.t = o.t JOIN learned l ON l.ticker = o.ticker AND l.step = (o.t - 6) // 63 + 1
)"""

DAILY = f"""
ready AS (SELECT date, ticker AS id, abs(coalesce(corr_spy_60, 0)) AS c FROM gold WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _F)} QUALIFY count(*) OVER (PARTITION BY date) >= 3),
near_pairs AS (SELECT a.date, a.id AS src, b.id AS dst, sqrt(a.c * b.c) AS weight FROM ready a JOIN ready b ON a.date = b.date AND a.id < b.id WHERE sqrt(a.c * b.c) > 0.3),
stars AS (SELECT date, m AS src, id AS dst, 0.1::DOUBLE AS weight FROM (SELECT *, min(id) OVER (PARTITION BY date) AS m FROM ready) WHERE id <> m AND date NOT IN (SELECT date FROM near_pairs)),
one_way AS (SELECT * FROM near_pairs UNION ALL SELECT * FROM stars),
daily AS (SELECT * FROM one_way UNION ALL SELECT date, dst, src, weight FROM one_way)"""

PREDICTIONS = """
preds AS (
  SELECT ticker, date, asset_class, 1 AS signal, (SELECT avg(target_5d) FROM gold) AS p_hold, ret_5d_fwd, 'always_hold' AS model FROM points
  UNION ALL
  SELECT ticker, date, asset_class, CASE WHEN dist_sma_20 > 0 THEN 1 ELSE 0 END, CASE WHEN dist_sma_20 > 0 THEN 0.75 ELSE 0.25 END, ret_5d_fwd, 'sma_rule' FROM points
),
rets AS (SELECT *, ret_5d_fwd * coalesce(signal, 0) AS signal_ret, CAST(signal <> lag(signal) OVER (PARTITION BY model, ticker ORDER BY date) AS INT)::DOUBLE AS turnover FROM preds)"""


def sharpe(r: str) -> str:
    return f"CASE WHEN count({r}) >= 10 AND stddev_samp({r}) >= 1e-12 THEN avg({r}) / stddev_samp({r}) * 2 END"


def with_(*layers: str) -> str:
    return "WITH RECURSIVE" + ",".join(layers) + "\n"


TO_SILVER = (PANEL, SILVER)
TO_GOLD = (PANEL, SILVER, BENCH, GOLD)
TO_GRAPH = (*TO_GOLD, REFITS, GRAPH)
TO_PREDICTIONS = (*TO_GOLD, POINTS, PREDICTIONS)
