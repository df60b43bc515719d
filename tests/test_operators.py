import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cross_section as xs
from tidemark.operators import evaluation as ev
from tidemark.operators import features as ft
from tidemark.operators import graph as gr
from tidemark.operators import walk_forward as wf
from tidemark.plans.spec import PanelSpec, Params
from tidemark.sources import bars as br
from tidemark.sources.instruments import UNIVERSE, instruments, with_instrument

DAY0 = dt.date(2020, 1, 1)
BARS = "ticker string, date date, asset_class string, open double, high double, low double, close double, adj_close double, volume double"


def panel(spark, series, group="ETF"):
    rows = [(t, DAY0 + dt.timedelta(i), group, p, p * 1.01, p * 0.99, p, p, 100.0 + i % 7) for t, prices in series.items() for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=1):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))).tolist()


def collected(df, *cols):
    return df.orderBy("ticker", "date").select(*cols).toPandas()


def test_recursive_features_match_pandas(spark):
    p = walk(300)
    got = collected(ft.entity_features(panel(spark, {"A": p})), "ema_12", "ema_26", "macd_signal", "rsi_14", "downside_vol_20", "skew_60", "kurt_60")
    s = pd.Series(p)
    r = np.log(s / s.shift())
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    d = s.diff()
    rs = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() / (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean().replace(0, np.nan)
    expected = {
        "ema_12": s.ewm(span=12, adjust=False).mean(),
        "macd_signal": macd.ewm(span=9, adjust=False).mean(),
        "rsi_14": 100 - 100 / (1 + rs),
        "downside_vol_20": r.where(r < 0).rolling(20, min_periods=5).std() * np.sqrt(252),
        "skew_60": r.rolling(60, min_periods=20).skew(),
        "kurt_60": r.rolling(60, min_periods=20).kurt(),
    }
    for name, want in expected.items():
        assert (got[name].isna() == want.isna()).all(), name
        np.testing.assert_allclose(got[name].dropna(), want.dropna(), rtol=1e-7, atol=1e-9)


def test_constant_prices_have_defined_features(spark):
    got = collected(xs.against_benchmark(ft.entity_features(panel(spark, {"A": [5.0] * 80, "B": walk(80)})), PanelSpec(benchmark="B")).filter("ticker = 'A'"), "bb_pctb", "rsi_14", "vol_ratio", "skew_60", "kurt_60", "corr_spy_60", "idio_vol_60")
    last = got.iloc[-1]
    assert last["bb_pctb"] == 0.5 and pd.isna(last["rsi_14"]) and pd.isna(last["vol_ratio"]) and last["skew_60"] == 0 and last["kurt_60"] == -3
    assert pd.isna(last["corr_spy_60"]) and last["idio_vol_60"] == 0


def test_first_row(spark):
    row = collected(ft.entity_features(panel(spark, {"A": [10.0, 11.0, 12.0]})), "ret_1d", "sma_20", "atr_14", "bb_pctb", "vol_20").iloc[0]
    assert pd.isna(row["ret_1d"]) and row["sma_20"] == 10 and math.isclose(row["atr_14"], 0.2) and row["bb_pctb"] == 0.5 and pd.isna(row["vol_20"])


def test_percent_rank_of_nulls_and_ties(spark):
    rows = [(t, DAY0, v, v, v) for t, v in (("a", None), ("b", 1.0), ("c", 1.0), ("d", 3.0))]
    got = xs.ranks(spark.createDataFrame(rows, "ticker string, date date, ret_1d double, vol_20 double, mom_12_1 double")).orderBy("ticker").toPandas()
    assert got["xs_ret_rank"].round(6).tolist() == [0.0, 0.333333, 0.333333, 1.0]


def test_targets_look_forward_only_and_features_backward_only(spark):
    p = walk(120)
    full, cut = (ft.entity_features(panel(spark, {"A": q})) for q in (p, p[:90]))
    cols = ["ret_21d", "vol_60", "bb_pctb", "macd_hist", "rsi_14", "drawdown"]
    pd.testing.assert_frame_equal(collected(full, *cols).iloc[:90], collected(cut, *cols))
    t = collected(xs.forward_targets(panel(spark, {"A": p})), "target_ret_5d", "target_5d")
    assert len(t) == 115 and math.isclose(t["target_ret_5d"][0], math.log(p[5] / p[0])) and t["target_5d"][0] == int(p[5] > p[0])


def test_calendar_flags(spark):
    days = [(d,) for d in (dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 3, 29), dt.date(2023, 12, 31))]
    got = ft.calendar(spark.createDataFrame(days, "date date")).toPandas()
    assert got["is_month_end"].tolist() == [1, 1, 0, 1] and got["is_quarter_end"].tolist() == [0, 1, 0, 1] and got["dow"].tolist() == [5, 1, 6, 1]


def test_winsorise_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 1001)] + [(None,)], "amihud double")
    got = ft.winsorise(df, "amihud").agg(F.max("amihud"), F.count("amihud"), F.count(F.lit(1))).first()
    assert tuple(got) == (990.0, 1000, 1001)


def test_message_passing_on_a_triangle(spark):
    d = DAY0
    nodes = spark.createDataFrame([(d, n, s) for n, s in (("a", 1.0), ("b", 0.5), ("c", -1.0), ("z", 0.3))], "refit_date date, id string, score double")
    one = [("a", "b", 0.5), ("b", "c", 1.0), ("a", "c", 0.4)]
    edges = spark.createDataFrame([(d, x, y, w) for a, b, w in one for x, y in ((a, b), (b, a))], "refit_date date, src string, dst string, weight double")
    got = {r["id"]: r["score"] for r in gr.pass_messages(nodes, edges, 1).collect()}
    assert math.isclose(got["a"], math.tanh((0.5 * 0.5 - 0.4) / 0.9)) and math.isclose(got["b"], math.tanh((0.5 - 1.0) / 1.5)) and got["z"] == 0.3


def test_walk_forward_needs_enough_rows_and_sees_no_future(spark):
    p = Params(initial_train=60, refit_every=10, min_obs=20)
    rng = np.random.default_rng(3)

    def gold(n, late=0.0):
        rows = [("A", DAY0 + dt.timedelta(i), "ETF", float(x), float(y + (late if i >= 80 else 0)), int(y > 0), float(y)) for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
        return spark.createDataFrame(rows, "ticker string, date date, asset_class string, f double, target_ret_5d double, target_5d int, ret_5d_fwd double")

    assert wf.points(gold(65), params=p).count() == 0 and wf.points(gold(66), params=p).count() == 1
    rng = np.random.default_rng(4)
    a = wf.gram_states(gold(120), params=p, features=("f",)).orderBy("date").toPandas()
    rng = np.random.default_rng(4)
    b = wf.gram_states(gold(120, late=5.0), params=p, features=("f",)).orderBy("date").toPandas()
    t = [(d - DAY0).days for d in a["date"]]
    same = [x == y for x, y in zip(a["moment"], b["moment"], strict=True)]
    assert t == [60, 70, 80, 90, 100, 110] and same == [True, True, True, False, False, False]


def test_bayes_closed_form_equals_sequential_updates(spark):
    p = Params(initial_train=60, refit_every=5, min_obs=20)
    x = np.random.default_rng(5).normal(size=(100, 3))
    rows = [("A", DAY0 + dt.timedelta(i), "ETF", float(a), float(b), 1, float(y), float(y)) for i, (a, b, y) in enumerate(x)]
    gold = spark.createDataFrame(rows, "ticker string, date date, asset_class string, f double, g double, target_5d int, target_ret_5d double, ret_5d_fwd double")
    got = wf.bayes(gold, params=p, features=("f", "g")).orderBy("date").toPandas()
    c = wf.calibration(gold, ("f", "g")).first()
    t = 60
    w, m = np.zeros(2), np.eye(2) * c["delta"]
    for i in range(0, t - 5, 5):
        k = m @ x[i, :2] / (c["sigma_sq"] + x[i, :2] @ m @ x[i, :2])
        w, m = w + k * (x[i, 2] - x[i, :2] @ w), m - np.outer(k, m @ x[i, :2])
    z = x[t, :2] @ w / math.sqrt(1 + math.pi / 8 * (x[t, :2] @ m @ x[t, :2] + c["sigma_sq"]))
    assert math.isclose(got["p_hold"][0], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_pluggable_models(spark):
    x = np.random.default_rng(6).normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    for fn in (wf.logistic_fn(), wf.boosted_fn(trees=30)):
        good = [fn(x[:150], y[:150], x[i : i + 1])[0] == y[i] for i in range(150, 200, 5)]
        assert sum(good) >= 8
    assert wf.logistic_fn()(x, np.ones(200, int), x[:1]) == (1, 1.0)


PRED = "ticker string, date date, asset_class string, signal int, p_hold double, ret_5d_fwd double, model string"


def test_turnover_stop_loss_and_drawdown(spark):
    sig, ret = [1, 1, 0, 1, 1, 1, 1, 1], [0.1, -0.2, 0.3, 0.1, -0.1, 0.05, 0.2, -0.3]
    pred = spark.createDataFrame([("A", DAY0 + dt.timedelta(i), "ETF", s, 0.5, r, "m") for i, (s, r) in enumerate(zip(sig, ret, strict=True))], PRED)
    full = ev.strategy_returns(pred).orderBy("date").toPandas()
    assert pd.isna(full["turnover"][0]) and full["turnover"][1:].tolist() == [0, 1, 1, 0, 0, 0, 0]
    daily = spark.createDataFrame([("A", DAY0 + dt.timedelta(i), v) for i, v in enumerate([0.0, 0.01, -0.05, 0.01, 0.01, 0.01, None, 0.01])], "ticker string, date date, ret_1d double")
    got = ev.stop_loss(pred, daily).orderBy("date").toPandas()["sl_ret"].tolist()
    assert got == [-0.02, -0.02, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    down = ev.max_drawdown(ev.strategy_returns(pred)).first()["max_drawdown"]
    curve = pd.Series([s * r for s, r in zip(sig, ret, strict=True)]).add(1).cumprod()
    assert math.isclose(down, (curve / curve.cummax() - 1).min())


def test_drawdown_in_two_steps_equals_one(spark):
    rng = np.random.default_rng(8)
    rows = [(f"T{j}", DAY0 + dt.timedelta(i), "ETF", 1, 0.5, float(rng.normal(0, 0.8)), "m") for i in range(12) for j in range(5)]
    got = ev.equity(ev.strategy_returns(spark.createDataFrame(rows, PRED)), "signal_ret").orderBy("date", "ticker").toPandas()
    curve = (1 + got["signal_ret"]).cumprod()
    np.testing.assert_allclose(got["equity"], curve)
    np.testing.assert_allclose(got["drawdown"], curve / curve.cummax() - 1, atol=1e-12)


def test_bootstrap_interval_holds_the_ratio_and_reruns_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(f"T{i}", DAY0, "ETF", 1, 0.5, float(x), "m") for i, x in enumerate(rng.normal(0.01, 0.05, 200))]
    full = ev.strategy_returns(spark.createDataFrame(rows, PRED))
    a, b = (ev.bootstrap_sharpe(full).first() for _ in range(2))
    sharpe = full.agg(ev.sharpe(F.col("signal_ret"))).first()[0]
    assert a == b and a["sharpe_ci_lo"] < sharpe < a["sharpe_ci_hi"]


def test_bars_are_cleaned(spark):
    raw = spark.createDataFrame([("SPY", "2020-01-02", "1.5", "2"), ("SPY", "2020-01-03", "x", "2"), ("QQQ", "2020-01-02", "-1", "2"), ("??", "2020-01-02", "3", None)], ["ticker", "Date", "Close", "Volume"])
    got = {r["ticker"]: r for r in br.clean_bars(raw).collect()}
    assert set(got) == {"SPY", "??"} and got["SPY"]["adj_close"] == 1.5 and got["SPY"]["asset_class"] == "ETF" and got["??"]["sector"] == "unknown"
    assert sum(len(v.split()) for v in UNIVERSE.values()) == 121 == instruments(spark).count()


def test_liveness_threshold(spark):
    rows = [("live", DAY0 + dt.timedelta(i)) for i in range(252)] + [("stale", DAY0 + dt.timedelta(i)) for i in range(251)]
    got = br.live_entities(spark.createDataFrame(rows, "ticker string, date date"), F.lit("2020-12-31").cast("date")).select("ticker").distinct().collect()
    assert [r[0] for r in got] == ["live"]


def test_layers_and_csv_source_round_trip(spark, tmp_path):
    df = panel(spark, {"A": walk(10), "B": walk(12, 2)})
    br.write_layer(df, str(tmp_path / "layer"))
    assert br.read_layer(spark, str(tmp_path / "layer")).select(*df.columns).exceptAll(df).count() == 0
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "SPY.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,1,2,0.5,,10\n")
    (tmp_path / "csv" / "BAD.csv").write_text("")
    spark.dataSource.register(br.BarsDataSource)
    got = spark.read.format("daily_bars").option("wait", "0").load(str(tmp_path / "csv"))
    assert [r["ticker"] for r in br.valid_bars(br.typed_bars(got)).collect()] == ["SPY"]


def test_dimension_join_keeps_unknown(spark):
    df = spark.createDataFrame([("SPY",), ("nope",)], "ticker string")
    assert {r["ticker"]: r["asset_class"] for r in with_instrument(df, instruments(spark)).collect()} == {"SPY": "ETF", "nope": "unknown"}


def test_stream_of_bars_equals_batch(spark, tmp_path):
    from tidemark.streaming.bars import event_bars, read_events, stream_to_table

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    batch = event_bars(events, "1 day")
    spark.sql("DROP TABLE IF EXISTS streamed_bars")
    stream_to_table(event_bars(read_events(spark, str(tmp_path / "events")), "1 day"), "streamed_bars", str(tmp_path / "cp")).awaitTermination()
    done = spark.table("streamed_bars")
    assert done.count() > 0 and done.exceptAll(batch).count() == 0
    spark.sql("DROP TABLE streamed_bars")


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_panels_give_empty_results(spark, rows):
    df = panel(spark, {"A": walk(rows)}) if rows else spark.createDataFrame([], BARS)
    assert xs.gold(ft.entity_features(df)).count() == 0
