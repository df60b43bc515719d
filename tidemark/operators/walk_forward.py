"""Walk-forward predictions without look-ahead.

A point is a row of an entity at index initial_train, + refit_every, ...; a model for it may see the rows before
index t - hold_days, whose labels are closed. Models that are sums over training rows (always-hold, the Bayesian
linear model) are native plans; fitted ones get an entity's history in one grouped map, which is one entity's
daily rows and never a whole cross-section.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import BAYES_FEATURES, FEATURES, NODE_FEATURES, PANEL, PARAMS, PanelSpec, Params

#: model_fn(train_X, train_y, feat_X) -> (signal, p_hold)
ModelFn = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[int, float]]

RESULT = "ticker string, date date, asset_class string, signal int, p_hold double, ret_5d_fwd double, model string"


def trailing_dates(gold: DataFrame, last: int = 252, spec: PanelSpec = PANEL) -> DataFrame:
    """The rows of the panel's last dates."""
    dates = gold.select(spec.time).distinct().orderBy(F.desc(spec.time)).limit(last)
    return gold.join(F.broadcast(dates), spec.time, "left_semi")  # ``last`` rows


def indexed(gold: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    w = Window.partitionBy(spec.entity)
    return gold.withColumns({"t": F.row_number().over(w.orderBy(spec.time)) - 1, "n": F.count(F.lit(1)).over(w)})


def is_point(params: Params = PARAMS) -> F.Column:
    t, n, p = F.col("t"), F.col("n"), params
    return (n >= p.initial_train + p.hold_days + 1) & (t >= p.initial_train) & (t < n - p.hold_days) & ((t - p.initial_train) % p.refit_every == 0) & (t - p.hold_days >= p.min_obs)


def points(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The rows to predict, with their index t and n_train."""
    rows = gold.filter(~F.col(spec.entity).isin(*excluded)) if excluded else gold
    return indexed(rows, spec).filter(is_point(params)).withColumn("n_train", F.col("t") - params.hold_days).drop("n")


def result(df: DataFrame, p_hold: F.Column, model: str, spec: PanelSpec = PANEL, signal: F.Column | None = None) -> DataFrame:
    chosen = signal if signal is not None else (F.col("p_hold") >= PARAMS.threshold).cast("int")
    return df.withColumn("p_hold", p_hold).select(F.col(spec.entity).alias("ticker"), F.col(spec.time).alias("date"), F.col(spec.group).alias("asset_class"), chosen.alias("signal"), "p_hold", "ret_5d_fwd", F.lit(model).alias("model"))


def always_hold(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """Signal 1 with the share of positive targets of the whole panel as probability."""
    rate = gold.agg(F.avg("target_5d").alias("_rate"))
    return result(points(gold, spec, params).crossJoin(F.broadcast(rate)), F.col("_rate"), "always_hold", spec, F.lit(1))  # one row


def rule_signal(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """Hold above the 20-row mean: a fixed rule to evaluate without fitting."""
    up = F.col("dist_sma_20") > 0
    return result(points(gold, spec, params), F.when(up, 0.75).otherwise(0.25), "sma_rule", spec)


def calibration(gold: DataFrame, features: tuple[str, ...] = BAYES_FEATURES) -> DataFrame:
    """One row: sigma_sq (variance of the target, kept in [1e-6, 1]) and delta (over the mean feature variance, in [0.01, 10])."""
    cols = [c for c in features if c in gold.columns]
    row = gold.agg(F.var_pop("target_ret_5d").alias("_v"), F.count("target_ret_5d").alias("_n"), *(F.var_samp(c).alias(c) for c in cols))
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    out = row.withColumn("sigma_sq", clip(F.when(F.col("_n") > 10, F.col("_v")).otherwise(1e-3), 1e-6, 1.0))
    return out.select("sigma_sq", clip(F.col("sigma_sq") / (mean + 1e-8), 0.01, 10.0).alias("delta"))


def gram_states(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS, features: tuple[str, ...] = BAYES_FEATURES) -> DataFrame:
    """Points with the running sums of x x' (upper triangle, ``gram``) and x y (``moment``) over every refit_every-th
    training row. The sums are one pass over those rows; a point picks the state of the last row it may see."""
    cols = [c for c in features if c in gold.columns]
    rows = indexed(gold, spec).withColumns({f"_x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(cols)})
    seen = rows.filter(F.col("t") % params.refit_every == 0)
    w = Window.partitionBy(spec.entity).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    y = F.coalesce("target_ret_5d", F.lit(0.0))
    d = range(len(cols))
    state = seen.select(F.col(spec.entity).alias("_e"), F.col("t").alias("_t"), F.array(*(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).over(w) for i in d for j in d if i <= j)).alias("gram"), F.array(*(F.sum(F.col(f"_x{i}") * y).over(w) for i in d)).alias("moment"), F.count(F.lit(1)).over(w).alias("n_seen"))
    last = F.floor((F.col("t") - params.hold_days - 1) / params.refit_every) * params.refit_every
    at = rows.filter(is_point(params)).withColumn("x", F.array(*(f"_x{i}" for i in d)))
    out = at.join(state, (F.col(spec.entity) == F.col("_e")) & (last == F.col("_t")))
    return out.select(spec.entity, spec.time, spec.group, "ret_5d_fwd", "t", "n_seen", "x", "gram", "moment")


def bayes(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS, features: tuple[str, ...] = BAYES_FEATURES) -> DataFrame:
    """The Bayesian linear model in closed form: P = (I / delta + X'X / sigma_sq)^-1, w = P X'y / sigma_sq, and the
    probability from the posterior predictive. Only the d by d solves run in Python, a batch at a time."""
    states = gram_states(gold, spec, params, features).crossJoin(F.broadcast(calibration(gold, features)))  # one row

    @F.pandas_udf("double")
    def probability(x: pd.Series, gram: pd.Series, moment: pd.Series, sigma_sq: pd.Series, delta: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        xs, ms, s, dl = np.stack(x), np.stack(moment), sigma_sq.to_numpy(), delta.to_numpy()
        d = xs.shape[1]
        g = np.zeros((len(xs), d, d))
        g[(slice(None), *np.triu_indices(d))] = np.stack(gram)
        g = g + np.triu(g, 1).transpose(0, 2, 1) if d > 1 else g
        inner = np.eye(d) / dl[:, None, None] + g / s[:, None, None]
        w = np.linalg.solve(inner, (ms / s[:, None])[..., None])[..., 0]
        spread = (xs * np.linalg.solve(inner, xs[..., None])[..., 0]).sum(axis=1) + s
        z = (xs * w).sum(axis=1) / np.sqrt(1 + np.pi / 8 * spread)
        return pd.Series(1 / (1 + np.exp(-z)))

    return result(states, probability("x", "gram", "moment", "sigma_sq", "delta"), "bayesian_peft", spec)


def fitted(gold: DataFrame, model_fn: ModelFn, name: str, features: tuple[str, ...], spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """Predictions of a pluggable model. Entities too short for a point are dropped before the shuffle to Python, and
    only the needed columns travel."""
    cols = [c for c in features if c in gold.columns]
    rows = indexed(gold, spec).filter(F.col("n") >= params.initial_train + params.hold_days + 1)
    rows = rows.select(F.col(spec.entity).alias("ticker"), F.col(spec.time).alias("date"), F.col(spec.group).alias("asset_class"), "t", "target_5d", "ret_5d_fwd", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols)).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y, out = np.stack(pdf["x"]), pdf["target_5d"].to_numpy(), []
        for t in range(params.initial_train, len(pdf) - params.hold_days, params.refit_every):
            if t - params.hold_days < params.min_obs:
                continue
            signal, p = model_fn(x[: t - params.hold_days], y[: t - params.hold_days], x[t : t + 1])
            row = pdf.iloc[t]
            out.append((row["ticker"], row["date"], row["asset_class"], int(signal), float(p), float(row["ret_5d_fwd"]), name))
        return pd.DataFrame(out, columns=["ticker", "date", "asset_class", "signal", "p_hold", "ret_5d_fwd", "model"])

    return rows.groupBy("ticker").applyInPandas(run, RESULT)


def logistic_fn(c: float = 1.0, steps: int = 50) -> ModelFn:
    """L2 logistic regression by Newton's steps; the intercept is free. One class only: its label."""

    def fit(train_x: np.ndarray, train_y: np.ndarray, feat_x: np.ndarray) -> tuple[int, float]:
        if len(np.unique(train_y)) < 2:
            return int(train_y[-1]), float(train_y[-1])
        a = np.column_stack([train_x, np.ones(len(train_x))])
        penalty = np.append(np.ones(train_x.shape[1]), 0.0) / c
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
            step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(penalty + 1e-12), a.T @ (train_y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        p = float(1 / (1 + np.exp(-np.clip(np.append(feat_x[0], 1.0) @ w, -35, 35))))
        return int(p >= PARAMS.threshold), p

    return fit


def boosted_fn(trees: int = 100, depth: int = 4, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, bins: int = 32, seed: int = 42) -> ModelFn:
    """Gradient-boosted trees on logistic loss with binned features and second-order leaf weights. Columns with more than 10
    values count, zeros among them; without any the answer is (0, 0.5)."""

    def fit(train_x: np.ndarray, train_y: np.ndarray, feat_x: np.ndarray) -> tuple[int, float]:
        if len(np.unique(train_y)) < 2:
            return int(train_y[-1]), float(train_y[-1])
        use = [j for j in range(train_x.shape[1]) if np.count_nonzero(~np.isnan(train_x[:, j])) > 10]
        if not use:
            return 0, 0.5
        x, f = train_x[:, use], feat_x[:, use]
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(q, x[:, j]) for j, q in enumerate(cuts)])
        at = np.array([np.searchsorted(q, f[0, j]) for j, q in enumerate(cuts)])
        rng = np.random.default_rng(seed)
        n, d = code.shape
        margin, own = np.zeros(n), 0.0
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            take = rng.random(n) < rows
            some = np.sort(rng.choice(d, max(1, int(d * columns)), replace=False))
            g, h = (p - train_y) * take, p * (1 - p) * take
            node, here = np.zeros(n, np.int64), 0
            for _ in range(depth):
                size = 2 ** (_ + 0)
                key = (node[:, None] * len(some) + np.arange(len(some))) * bins + code[:, some]
                shape = (size, len(some), bins)
                gs, hs = (np.bincount(key.ravel(), np.repeat(v, len(some)), size * len(some) * bins).reshape(shape).cumsum(axis=2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                best = gain.reshape(size, -1).argmax(axis=1)
                feature, cut = some[best // bins], best % bins
                flat = gain.reshape(size, -1)[np.arange(size), best] <= 0
                cut = np.where(flat, bins, cut)
                here = 2 * here + int(at[feature[here]] > cut[here])
                node = 2 * node + (code[np.arange(n), feature[node]] > cut[node])
            leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + 1)
            margin, own = margin + leaf[node], own + leaf[here]
        p = float(1 / (1 + np.exp(-own)))
        return int(p >= PARAMS.threshold), p

    return fit


def logit(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """The logistic model on node features and the graph score."""
    return fitted(gold, logistic_fn(), "pregel_gnn", (*NODE_FEATURES, "pregel_score"), spec, params)


def boosted(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS, trees: int = 100) -> DataFrame:
    return fitted(gold, boosted_fn(trees), "xgboost", FEATURES, spec, params)
