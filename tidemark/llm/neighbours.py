"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a cell is a pair of centroids, and every vector is
an entry of one cell. A query ranks the centroids of each half, walks the pairs in the order of their
summed nearness with a heap until the cells visited hold ``candidates`` entries, and all entries of these
cells are reranked on the original vectors in double precision.

Equal vectors count as one entry that carries its ``top + 1`` smallest ids, which is all that any query
can return of them. Cells are dealt in order into groups of some ``GROUP`` entries (a cell with more is cut
by hash), queries into parts of ``QUERY_PART``; one task joins a group with a part of the queries that
visit it. Codebooks are fitted on ``SAMPLE`` distinct vectors, those with the least hash; every vector is
indexed. The share of entries that a query gathers is calibrated on that sample, so that data without
clusters is searched widely and clustered data is not.

Nearness is the inner product; summed nearness of centroid pairs is the sum of both halves' products.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part; ids that are null take no part; with fewer candidates than ``top`` all of them
are returned; ties go to the smaller id; repeated ids with equal vectors count once. Of an id with several vectors each
is a candidate, and each a query of its own with ranks of its own, never with its own id as a candidate. An empty table
gives no rows; columns besides the key and the vector are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, read, written

TOP, QUERY_STEP = 20, 20
#: Vectors that the codebooks are fitted on, and centroids for each half (fewer for few vectors).
SAMPLE, CENTROIDS, ROUNDS = 16384, 512, 12
#: Entries of a cell on average, which the number of centroids follows.
CELL_ENTRIES = 64
#: A query gathers the least of SHARES of all distinct vectors (top + 1 at least) that gives the recall RECALL
#: to CALIBRATE queries on the sample, where the truth is computed by brute force.
RECALL, CALIBRATE = 0.97, 100
#: Components from here on count as non-finite, as their products would not be finite.
MOST = 1e150
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Entries of a group of cells, and queries of a part: what one task holds at a time.
GROUP, QUERY_PART = 4096, 8192


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded distinct rows."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = assign(x, c)
        for j in range(k):
            own = x[near == j]
            c[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)


#: The shares of entries that searches of this session were calibrated to.
_SHARES: list[float] = []


def last_share() -> float:
    return _SHARES[-1]


class MultiIndex:
    """Codebooks of both halves, and the number of entries in each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        self.half = first.shape[1]
        self.counts = np.zeros((len(first), len(second)), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return assign(x[:, : self.half], self.first) * len(self.second) + assign(x[:, self.half :], self.second)

    def visit(self, q: np.ndarray, enough: int) -> list[int]:
        """Cells that hold entries, by falling summed nearness, until they hold ``enough``."""
        a, b = self.first @ q[: self.half], self.second @ q[self.half :]
        i_order, j_order = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap = [(-(a[i_order[0]] + b[j_order[0]]), 0, 0)]
        seen = {(0, 0)}
        found, held = [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            n = int(self.counts[i_order[i], j_order[j]])
            if n:
                found.append(int(i_order[i]) * len(self.second) + int(j_order[j]))
                held += n
            for step in ((i + 1, j), (i, j + 1)):
                if step not in seen and step[0] < len(i_order) and step[1] < len(j_order):
                    seen.add(step)
                    heapq.heappush(heap, (-(a[i_order[step[0]]] + b[j_order[step[1]]]), *step))
        return found

    def recall(self, x: np.ndarray, queries: np.ndarray, top: int) -> list[tuple[float, float]]:
        """(share of entries visited, share of true neighbours among them) over ``x`` as entries."""
        own = MultiIndex(self.first, self.second)
        cells = own.cells(x)
        np.add.at(own.counts.reshape(-1), cells, 1)
        scores = queries @ x.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, : top + 1]
        where = [{c: n for n, c in enumerate(own.visit(q, len(x)))} for q in queries]
        order = np.array([[w[c] for c in cells] for w in where])
        out = []
        for share in SHARES:
            found = []
            for o, b in zip(order, best, strict=True):
                held = np.cumsum(np.bincount(o))
                last = int(np.searchsorted(held, share * len(x)))
                found.append((o[b] <= last).mean())
            out.append((share, float(np.mean(found))))
        return out


def usable(key: str, vector: str) -> F.Column:
    v = F.col(vector)
    return F.col(key).isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST)) & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """One row for each distinct vector: its hash and its ``top + 1`` smallest ids. Salted ids are cut to so
    many before they are shuffled, and the salts' survivors again."""
    salted = rows.withColumn("h", F.xxhash64("vector")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("h", "vector", "salt").orderBy("vec_id"))).filter(F.col("n") <= top + 1)
    return first.groupBy("h", "vector").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, top + 1).alias("ids"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def unpack(column: pd.Series, form: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), form).reshape(-1, width).astype(np.float64)


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, step: int = QUERY_STEP, target: float = RECALL) -> DataFrame:
    """The ``top`` nearest found of every row whose id is divisible by ``step``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    form = "<f4" if df.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    v = F.col(vector).cast("array<double>")
    rows = df.filter(usable(key, vector)).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("vector"))
    entries = written(distinct_vectors(rows, top), "vectors")
    widths = entries.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = widths[0]["width"], widths[0]["n"]
    entries = entries.filter(F.size("vector") == width)
    sample = np.array([r[0] for r in entries.orderBy("h").limit(SAMPLE).select("vector").collect()], np.float64)
    k = min(CENTROIDS, max(1, math.isqrt(total // CELL_ENTRIES)), len(sample))
    half = width // 2
    index = MultiIndex(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k))
    n_second = len(index.second)
    share = next((s for s, r in index.recall(sample, sample[:CALIBRATE], top) if r >= target), 1.0)
    _SHARES.append(share)
    enough = max(top + 1, math.ceil(share * total))

    cell_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("vec", T.BinaryType()), entries.schema["ids"]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), width)
                yield batch(cell_schema, [pa.array(index.cells(x).astype(np.int32)), b.column(2), [r.tobytes() for r in x.astype(form)], b.column(1)])

    placed = written(entries.select("vector", "ids", "h").mapInArrow(place, cell_schema), "cells")
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most CENTROIDS ** 2 rows
        index.counts[divmod(r["cell"], n_second)] = r["n"]
    # cells in order fill groups of GROUP entries; a cell with more entries is cut by hash into several
    begins = np.concatenate([[0], np.cumsum(index.counts.reshape(-1))])
    spans = [(c, int(begins[c]) // GROUP, max(0, int(begins[c + 1]) - 1) // GROUP) for c in range(len(begins) - 1) if begins[c + 1] > begins[c]]
    group_of = spark.createDataFrame(spans, "cell int, first_group long, last_group long")
    n_queries = rows.filter((F.pmod("vec_id", F.lit(step)) == 0) & (F.size("vector") == width)).count()
    parts = max(1, -(-n_queries // QUERY_PART))
    grouped = placed.join(F.broadcast(group_of), "cell").select("cell", "vec", "ids", (F.col("first_group") + F.pmod("h", F.col("last_group") - F.col("first_group") + 1)).alias("grp"))

    ask_schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("part", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("query_hash", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("cells", T.BinaryType())])
    sent = spark.sparkContext.broadcast((index, {c: (a, b) for c, a, b in spans}))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, groups = sent.value
        for b in batches:
            out = []
            if b.num_rows:
                for q, q_hash, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), matrix(b.column(1), width), strict=True):
                    by: dict[int, list[int]] = {}
                    for c in own.visit(x, enough):
                        for g in range(groups[c][0], groups[c][1] + 1):
                            by.setdefault(g, []).append(c)
                    raw = x.astype(form).tobytes()
                    out += [(g, (q // step) % parts, q, q_hash, raw, np.array(cells, "<i4").tobytes()) for g, cells in by.items()]
            if out:
                yield batch(ask_schema, [[r[i] for r in out] for i in range(6)])

    asked = rows.filter((F.pmod("vec_id", F.lit(step)) == 0) & (F.size("vector") == width)).select(F.col("vec_id").alias("query_id"), "vector", F.xxhash64("vector").alias("query_hash")).distinct()
    asks = written(asked.mapInArrow(visit, ask_schema), "asks")
    wanted = asks.select(F.col("grp").alias("to_grp"), F.col("part").alias("to_part")).distinct()

    def rerank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(asking) and len(held):
            x, cell, ids = unpack(held["vec"], form, width), held["cell"].to_numpy(), held["ids"].tolist()
            names, at = np.unique(cell, return_inverse=True)
            longest = float(np.sqrt((x * x).sum(axis=1).max()))
            for begin in range(0, len(asking), 256):
                some = asking.iloc[begin : begin + 256]
                y = unpack(some["vec"], form, width)
                scores = y @ x.T
                seen = np.zeros((len(some), len(names)), bool)
                for i, raw in enumerate(some["cells"]):
                    seen[i] = np.isin(names, np.frombuffer(raw, "<i4"))
                scores[~seen[:, at]] = -np.inf
                # top + 1 entries hold the top ids besides the query's own; equal scores at the edge stay
                edge = max(0, scores.shape[1] - top - 1)
                least = np.partition(scores, edge, axis=1)[:, edge]
                # more than what the order of summation can change
                slack = 1e-12 * longest * np.sqrt((y * y).sum(axis=1))
                for i, (n, h) in enumerate(zip(some["query_id"].tolist(), some["query_hash"].tolist(), strict=True)):
                    near = np.flatnonzero((scores[i] >= least[i] - slack[i]) & (scores[i] > -np.inf))
                    exact = (x[near] * y[i]).sum(axis=1)
                    best = [(-s, v) for e, s in zip(near.tolist(), exact.tolist(), strict=True) for v in ids[e] if v != n]
                    out += [(n, h, v, -s) for s, v in heapq.nsmallest(top, best)]
        return pd.DataFrame(out, columns=["query_id", "query_hash", "vec_id", "score"])

    offered = grouped.join(wanted, F.col("grp") == F.col("to_grp")).select("to_grp", "to_part", "cell", "vec", "ids")
    found = asks.groupBy("grp", "part").cogroup(offered.groupBy("to_grp", "to_part")).applyInPandas(rerank, "query_id long, query_hash long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
