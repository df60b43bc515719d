"""The correlation graph at refit dates, and message passing on it: all dates in one plan, keyed by refit_date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialise import cut
from ..plans.spec import NODE_FEATURES, PANEL, PARAMS, PanelSpec, Params
from .cross_section import benchmark_rows


def refit_dates(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """Every refit_every-th date of the benchmark from row initial_train on."""
    at = F.row_number().over(Window.partitionBy(spec.entity).orderBy(spec.time)) - 1
    dates = benchmark_rows(gold.select(spec.entity, spec.time), spec).withColumn("_at", at)
    return dates.filter((F.col("_at") >= params.initial_train) & ((F.col("_at") - params.initial_train) % params.refit_every == 0)).select(F.col(spec.time).alias("refit_date"))


def nodes(gold: DataFrame, dates: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS, features: tuple[str, ...] = NODE_FEATURES) -> DataFrame:
    """refit_date, id and score: the mean of the features' z-scores among the date's entities without a null feature.
    Dates with fewer than least_nodes of them have no nodes."""
    cols = [c for c in features if c in gold.columns]
    snap = gold.join(dates, gold[spec.time] == dates["refit_date"]).select("refit_date", F.col(spec.entity).alias("id"), *cols).dropna(subset=cols)
    w = Window.partitionBy("refit_date")
    z = [(F.col(c) - F.avg(c).over(w)) / (F.stddev(c).over(w) + 1e-9) for c in cols]
    total = z[0]
    for x in z[1:]:
        total = total + x
    return snap.withColumns({"score": total / len(z), "_n": F.count(F.lit(1)).over(w)}).filter(F.col("_n") >= params.least_nodes).select("refit_date", "id", "score")


def trailing(gold: DataFrame, dates: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """A range join as an equi join: refit_date, id, date and ret_1d of the graph_days before each refit date. Days
    are cut into buckets as long as the range, and a row meets the dates of its own and the next bucket."""
    size = params.graph_days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / size)
    rows = gold.select(F.col(spec.entity).alias("id"), F.col(spec.time).alias("date"), "ret_1d").withColumn("_b", F.explode(F.array(bucket(F.col("date")), bucket(F.col("date")) + 1)))
    wanted = dates.withColumn("_b", bucket(F.col("refit_date")))
    return rows.join(wanted, "_b").filter((F.col("date") <= F.col("refit_date")) & (F.col("date") >= F.date_sub("refit_date", params.graph_days))).drop("_b")


def edges(gold: DataFrame, dates: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """refit_date, src, dst and weight: pairs whose returns correlate by more than the threshold, in both directions."""
    rows = trailing(gold, dates, spec, params).filter(F.col("ret_1d").isNotNull())
    a, b = rows.select("refit_date", "date", F.col("id").alias("src"), F.col("ret_1d").alias("_x")), rows.select("refit_date", "date", F.col("id").alias("dst"), F.col("ret_1d").alias("_y"))
    pairs = a.join(b, ["refit_date", "date"]).filter(F.col("src") < F.col("dst"))
    rho = F.try_divide(F.covar_samp("_x", "_y"), F.stddev("_x") * F.stddev("_y"))
    one = pairs.groupBy("refit_date", "src", "dst").agg(F.abs(rho).alias("weight")).filter(F.col("weight") > params.edge_threshold)
    return one.select("refit_date", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("_e"), "weight").select("refit_date", "_e.src", "_e.dst", "weight")


def pass_messages(node: DataFrame, edge: DataFrame, layers: int = PARAMS.layers) -> DataFrame:
    """``layers`` supersteps of score = tanh(weighted mean of the neighbours' scores); nodes without neighbours keep
    theirs. Dates without any edge are left out."""
    state = node.join(edge.select("refit_date").distinct(), "refit_date", "left_semi")
    for _ in range(layers):
        sent = edge.join(state.select("refit_date", F.col("id").alias("src"), F.col("score").alias("_s")), ["refit_date", "src"])
        got = sent.groupBy("refit_date", F.col("dst").alias("id")).agg(F.tanh(F.try_divide(F.sum(F.col("_s") * F.col("weight")), F.sum("weight"))).alias("_new"))
        state = state.join(got, ["refit_date", "id"], "left").select("refit_date", "id", F.coalesce("_new", "score").alias("score"))
    return state


def graph_scores(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS) -> DataFrame:
    """refit_date, id and score after message passing. ``gold`` feeds dates, nodes and edges, and each superstep reads the
    edges: the needed columns of the one and the others as a whole are materialised once."""
    cols = dict.fromkeys([spec.entity, spec.time, "ret_1d", *(c for c in NODE_FEATURES if c in gold.columns)])
    base = cut(gold.select(*cols))
    dates = refit_dates(base, spec, params)
    return pass_messages(cut(nodes(base, dates, spec, params)), cut(edges(base, dates, spec, params)), params.layers)


def daily_graph(gold: DataFrame, spec: PanelSpec = PANEL, params: Params = PARAMS, features: tuple[str, ...] = NODE_FEATURES) -> DataFrame:
    """date, src, dst and weight for every date with three entities or more that have all features: the root of the product of
    both correlations with the benchmark, where it exceeds the threshold, in both directions. A date without such a pair
    has a star of weight 0.1 around its first entity. A correlation is 1 at most, so that only entities above the square of
    the threshold can have an edge and meet."""
    cols = [c for c in features if c in gold.columns]
    day = Window.partitionBy(spec.time)
    rows = gold.dropna(subset=cols).select(F.col(spec.time).alias("date"), F.col(spec.entity).alias("id"), F.abs(F.coalesce("corr_spy_60", F.lit(0.0))).alias("_c"), F.count(F.lit(1)).over(day).alias("_n"), F.min(spec.entity).over(day).alias("_first")).filter("_n >= 3")
    able = rows.filter(F.col("_c") > params.edge_threshold**2 * (1 - 1e-9))
    a, b = able.select("date", F.col("id").alias("src"), F.col("_c").alias("_x")), able.select("date", F.col("id").alias("dst"), F.col("_c").alias("_y"))
    pairs = a.join(b, "date").filter(F.col("src") < F.col("dst")).withColumn("weight", F.sqrt(F.col("_x") * F.col("_y"))).filter(F.col("weight") > params.edge_threshold).select("date", "src", "dst", "weight")
    star = rows.filter(F.col("id") != F.col("_first")).join(pairs.select("date").distinct(), "date", "left_anti").select("date", F.col("_first").alias("src"), F.col("id").alias("dst"), F.lit(0.1).alias("weight"))
    one = pairs.unionByName(star)
    return one.unionByName(one.select("date", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def neighbour_means(gold: DataFrame, edge: DataFrame, spec: PanelSpec = PANEL, features: tuple[str, ...] = NODE_FEATURES) -> DataFrame:
    """Every entity of a date with the mean of its neighbours' features (``nb_`` before their names): one layer of
    neighbourhood aggregation, weights unused."""
    cols = [c for c in features if c in gold.columns]
    sent = gold.select(F.col(spec.time).alias("date"), F.col(spec.entity).alias("src"), *cols)
    got = edge.join(sent, ["date", "src"]).groupBy("date", "dst").agg(*(F.avg(c).alias(f"nb_{c}") for c in cols))
    return got.withColumnRenamed("date", spec.time).withColumnRenamed("dst", spec.entity)


def with_graph_score(gold: DataFrame, scores: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """``gold`` with pregel_score, 0.5 where there is none."""
    named = scores.select(F.col("id").alias(spec.entity), F.col("refit_date").alias(spec.time), F.col("score").alias("_score"))
    return gold.join(named, [spec.entity, spec.time], "left").withColumn("pregel_score", F.coalesce("_score", F.lit(0.5))).drop("_score")
