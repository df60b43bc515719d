import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import graph as gr
from tidemark.operators import walk_forward as wf
from tidemark.plans import harness
from tidemark.sources import bars as br

from .test_operators import DAY0, PRED, panel, walk


def test_lagged_pairs_equal_one_window(spark):
    rng = np.random.default_rng(3)
    rows = [("m", f"T{j}", DAY0 + dt.timedelta(i), float(rng.normal())) for j, n in enumerate((1, 7, 2, 1, 1, 9, 3)) for i in range(n)]
    got = ev.lagged_pairs(spark.createDataFrame(rows, "model string, ticker string, date date, d double"), 4).toPandas()
    d = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    want = sorted((k, d[i], d[i - k]) for k in range(1, 5) for i in range(k, len(d)))
    assert sorted(zip(got["lag"], got["d"], got["l"], strict=True)) == want


def test_a_model_without_rows_is_in_the_summary(spark):
    rows = [(f"T{i % 3}", DAY0 + dt.timedelta(i), "ETF", 1, 0.5, math.sin(i) / 10, "m") for i in range(40)]
    daily = spark.createDataFrame([(t, d, r / 5) for t, d, _, _, _, r, _ in rows], "ticker string, date date, ret_1d double")
    got = {r["model"]: r for r in ev.summary(spark.createDataFrame(rows, PRED), daily, models=("none",)).collect()}
    assert got["none"]["n_predictions"] == 0 and got["none"]["sharpe"] is None
    assert got["m"]["n_predictions"] == 40 and got["m"]["sharpe_ci_lo"] < got["m"]["sharpe"] < got["m"]["sharpe_ci_hi"]


def test_bootstrap_is_near_resampling(spark):
    x = np.random.default_rng(5).normal(0.02, 0.06, 400)
    rows = [(f"T{i}", DAY0, "ETF", 1, 0.5, float(v), "m") for i, v in enumerate(x)]
    got = ev.bootstrap_sharpe(ev.strategy_returns(spark.createDataFrame(rows, PRED))).first()
    draws = np.random.default_rng(6).choice(x, (1000, 400))
    want = np.percentile(draws.mean(axis=1) / draws.std(axis=1) * 2, [2.5, 97.5])
    assert abs(got["sharpe_ci_lo"] - want[0]) < 0.05 and abs(got["sharpe_ci_hi"] - want[1]) < 0.05


def test_daily_graph_and_its_star(spark):
    rows = [(t, DAY0, c, 1.0) for t, c in (("a", 0.9), ("b", -0.4), ("c", 0.05), ("d", None))] + [(t, DAY0 + dt.timedelta(1), 0.1, 2.0) for t in "bca"] + [(t, DAY0 + dt.timedelta(2), 0.9, 3.0) for t in "ab"]
    g = spark.createDataFrame(rows, "ticker string, date date, corr_spy_60 double, vol_ratio double")
    edge = gr.daily_graph(g)
    got = {(r["date"].day, r["src"], r["dst"]): round(r["weight"], 9) for r in edge.collect()}
    assert got == {(1, "a", "b"): 0.6, (1, "b", "a"): 0.6, (2, "a", "b"): 0.1, (2, "b", "a"): 0.1, (2, "a", "c"): 0.1, (2, "c", "a"): 0.1}
    means = gr.neighbour_means(g, edge).filter(F.dayofmonth("date") == 2).collect()
    assert {(r["ticker"], r["nb_vol_ratio"]) for r in means} == {("a", 2.0), ("b", 2.0), ("c", 2.0)}


def test_trailing_dates_and_subset(spark):
    df = panel(spark, {"A": walk(30), "B": walk(20, 2)})
    assert wf.trailing_dates(df, 15).groupBy("ticker").count().orderBy("ticker").collect() == [("A", 15), ("B", 5)]
    assert br.only(df, ("B",)).count() == 20 and br.only(df, ()).count() == 50


def test_results_and_failed_files(spark, tmp_path):
    rows = [("A", DAY0, "ETF", 1, 0.5, 0.1, m) for m in ("x", "y")]
    br.write_results(spark.createDataFrame(rows, PRED), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "OK.csv").write_text("Date,Close\n2020-01-02,1.5\n")
    (tmp_path / "csv" / "BAD.csv").write_text("")
    spark.dataSource.register(br.BarsDataSource)
    raw = spark.read.format("daily_bars").option("wait", "0").load(str(tmp_path / "csv"))
    assert [r[0] for r in br.failed_tickers(raw).collect()] == ["BAD"]


def test_columns_of_zeros_count_for_the_trees():
    rng = np.random.default_rng(1)
    x = np.zeros((60, 2))
    x[::10, 0] = 1
    y = x[:, 0].astype(int)
    fit = wf.boosted_fn(trees=60)
    assert fit(x, y, np.array([[1.0, 0.0]]))[1] > fit(x, y, np.array([[0.0, 0.0]]))[1]
    assert fit(rng.normal(size=(8, 2)), np.array([0, 1] * 4), np.zeros((1, 2))) == (0, 0.5)


def test_harness(spark):
    df = panel(spark, {t: walk(80, i) for i, t in enumerate("ABC")})
    sweep = harness.partition_sweep(df, (1, 2))
    assert [r["n_partitions"] for r in sweep] == [1, 2] and all(r["rows_processed"] == 240 for r in sweep) and max(r["speedup"] for r in sweep) >= 1
    assert harness.against_pandas(df)["rows"] == 240
    assert pd.DataFrame(sweep)["rows_per_second"].gt(0).all()
