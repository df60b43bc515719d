"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target of words; its rate (target over size, at most 2) is a whole number of copies
of every document and a fraction. The fraction is the inclusion probability with which a document gets
one copy more. The cube method moves these probabilities along the null space of the constraints (total
of documents, total of words) until they are 0 or 1, so that each source keeps both totals. A document
source is cut into blocks of some ``BLOCK`` documents by hash; each block's flight leaves two documents
undecided at most, which meet those of other blocks in the next level, until one block for each source
remains; its last one or two documents are the landing problem, solved for the least change of words
and mended by exchanging a few pairs. A hot source only has more blocks.

Sources are numbered and get their targets in DataFrame steps, however many they are; the driver sees a few sums, and
one count for each partition of the sorted sources.

Defined cases: null text is empty and has size 0; documents of size 0 take no words; a null source is a
source of its own, the last; no documents give no rows; equal rows are separate documents, also of one id (repeated or
null ids are dealt to blocks by their text and row number too); all random choices are seeded by source, level
and block, so that reruns over the same files agree. Columns besides key, text and source are not looked at.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, fresh, read, utf8, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 1024
#: A probability this near to 0 or 1 is decided.
EPS = 1e-9

UNITS = "id {id}, text_hash long, salt long, size long, source_no long, probability double"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: ``share`` of all sizes by weight, no source above ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total = share * sum(sizes)
    got = [0.0] * len(sizes)
    active = set(range(len(sizes)))
    left = total
    while active:
        whole = sum(weight[i] for i in active)
        over = [i for i in sorted(active) if left * weight[i] / whole > most * sizes[i]]
        if not over:
            for i in active:
                got[i] = left * weight[i] / whole
            break
        for i in over:
            got[i] = most * sizes[i]
            active.discard(i)
        left = total - sum(got[i] for i in range(len(sizes)) if i not in active)
    return got


def flight(sizes: list[int], probabilities: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight, all but two of them 0 or 1. Three documents are in the air at a
    time: their null vector under both constraints is the cross product of the constraint rows."""
    p = list(probabilities)
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    air: list[int] = []
    while True:
        while len(air) < 3 and (i := next(waiting, None)) is not None:
            air.append(i)
        if len(air) == 3:
            a, b, c = (sizes[i] for i in air)
            move = (float(c - b), float(a - c), float(b - a))
            if not any(move):
                move = (1.0, -1.0, 0.0)
        elif len(air) == 2 and sizes[air[0]] == sizes[air[1]]:
            move = (1.0, -1.0)
        else:
            return [0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p]
        up = min((1 - p[i]) / m if m > 0 else p[i] / -m for i, m in zip(air, move, strict=True) if m)
        down = min(p[i] / m if m > 0 else (1 - p[i]) / -m for i, m in zip(air, move, strict=True) if m)
        step = up if rng.random() * (up + down) < down else -down
        for i, m in zip(air, move, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * m))
        air = [i for i in air if EPS < p[i] < 1 - EPS]


def landing(sizes: list[int], probabilities: list[float]) -> list[float]:
    """The few probabilities that are left become 0 or 1 so that the words change least, then the documents."""
    open_ones = [i for i, x in enumerate(probabilities) if 0 < x < 1]
    out = list(probabilities)

    def change(choice: tuple[int, ...]) -> tuple[float, float]:
        moves = [x - probabilities[i] for i, x in zip(open_ones, choice, strict=True)]
        return abs(sum(m * sizes[i] for i, m in zip(open_ones, moves, strict=True))), abs(sum(moves))

    for i, x in zip(open_ones, min(itertools.product((0, 1), repeat=len(open_ones)), key=change), strict=True):
        out[i] = float(x)
    return out


def swapped(sizes: list[int], before: list[float], after: list[float], times: int = 3) -> list[float]:
    """``after`` with a few pairs of a taken and an untaken document exchanged, each the pair that brings
    the words nearest to what ``before`` promises. The number of documents stays."""
    out = list(after)
    for _ in range(times):
        excess = sum(s * (x - p) for s, x, p in zip(sizes, out, before, strict=True))
        zeros = sorted((sizes[i], i) for i, x in enumerate(out) if x == 0 < before[i])
        best = (abs(excess), -1, -1)
        for i in (i for i, x in enumerate(out) if x == 1 > before[i]):
            at = bisect.bisect_left(zeros, (sizes[i] - excess, -1))
            for size, j in zeros[max(0, at - 1) : at + 1]:
                best = min(best, (abs(excess - sizes[i] + size), i, j))
        if best[1] < 0:
            break
        out[best[1]], out[best[2]] = 0.0, 1.0
    return out


def word_counts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """id, source, text_hash and size (runs of other than ASCII white space) of every row."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("source", T.StringType()), T.StructField("text_hash", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(schema, [rows.column(0), rows.column(1), rows.column(2), [len(t.split()) for t in utf8(rows.column(3))]])

    return df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).mapInArrow(run, schema)


def salted(counted: DataFrame) -> DataFrame:
    """``counted`` (a written table) with a salt: the row's number where several rows have its id and text, else 0."""
    many = counted.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = counted.withColumn("_row", F.monotonically_increasing_id())
    met = rows.join(many, rows["id"].eqNullSafe(many["_id"]) & (rows["text_hash"] == many["_hash"]), "left")
    return met.select(*counted.columns, F.when(F.col("_hash").isNotNull(), F.col("_row")).otherwise(F.lit(0).cast("long")).alias("salt"))


def numbered_sources(counted: DataFrame) -> DataFrame:
    """source, source_no (by code point, null last), source_size and n (rows) of every source."""
    spark = counted.sparkSession
    totals = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumn("none", F.col("source").isNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = totals.repartitionByRange(parts, "none", "source").sortWithinPartitions("none", "source")
    low = (1 << 33) - 1
    table = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(low)), "sources")
    counts = sorted((r["part"], r["count"]) for r in table.groupBy("part").count().collect())  # one row a partition
    begins = [(p, begin) for (p, _), begin in zip(counts, itertools.accumulate([0, *(c for _, c in counts)]), strict=False)]
    offsets = spark.createDataFrame(begins, "part int, begin long")
    return table.join(F.broadcast(offsets), "part").select("source", (F.col("at") + F.col("begin")).alias("source_no"), "source_size", "n")


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources`` with their targets: ``targets`` in DataFrame steps. A source is above its bound if its size is small
    for its weight, so that one rate (words for each unit of weight) tells the capped ones; the driver sees only sums."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighted = sources.withColumn("weight", weight)
    total = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    rate, n_capped = 0.0, -1
    while True:
        capped = F.lit(rate) * F.col("weight") > most * F.col("source_size")
        free, held, n = weighted.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, F.col("source_size"))), F.count(F.when(capped, 1))).first()
        if n == n_capped or not free:
            break
        rate, n_capped = (total - most * (held or 0)) / free, n
    goal = F.when(capped, most * F.col("source_size")).otherwise(F.lit(rate) * F.col("weight"))
    return weighted.withColumn("target", goal.cast("double")).drop("weight")


def fly(units: DataFrame, level: int, land: bool) -> DataFrame:
    """One level: the units' probabilities after the flight of their source's blocks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "id", "size"], kind="stable")
        sizes, before = rows["size"].tolist(), rows["probability"].tolist()
        flown = flight(sizes, before, random.Random(f"{key[0]}/{level}/{key[1]}"))
        rows["probability"] = swapped(sizes, before, landing(sizes, flown)) if land else flown
        return rows[["id", "text_hash", "salt", "size", "source_no", "probability"]]

    row = ("id", "text_hash", "salt", "size")
    dealt = units.withColumn("mix", F.xxhash64(F.lit(level), *row)).withColumn("block", F.pmod(F.xxhash64(F.lit(-1 - level), *row), F.col("n_blocks")))
    return dealt.drop("n_blocks").groupBy("source_no", "block").applyInPandas(run, UNITS.format(id=units.schema["id"].dataType.simpleString()))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """id, text_hash, size, source_size, target, copies and taken of every row of ``df``."""
    counted = written(word_counts(df, key, text, source), "mix-sizes")
    goals = with_targets(numbered_sources(counted), weights, share, most)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.least(F.floor(rate + EPS), F.lit(int(most))).cast("int")
    goals = goals.withColumn("whole", whole).withColumn("part", F.when(rate - whole > EPS, rate - whole).otherwise(0.0))
    sources = written(goals.withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("long")).drop("n"), "mix-sources")
    # both sides are written tables, so that the engine knows their sizes: it sends small ones, and splits a hot source
    named = written(salted(counted).join(sources.select(F.col("source").alias("_source"), "source_no", "part"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source"), "mix-units")
    units = named.select("id", "text_hash", "salt", "size", "source_no", F.when(F.col("size") > 0, F.col("part")).otherwise(0.0).alias("probability"))
    open_units, decided = units.filter("probability > 0"), [units.filter("probability = 0")]
    blocks = sources.filter("part > 0").select("source_no", "n_blocks")
    level = 0
    most_blocks = blocks.agg(F.max("n_blocks")).first()[0]
    while most_blocks:
        last = most_blocks == 1
        flown = written(fly(open_units.join(blocks, "source_no"), level, last), f"mix-level{level}")
        settled = F.col("probability").isin(0.0, 1.0)
        decided.append(flown.filter(settled))
        if last:
            break
        open_units = flown.filter(~settled)
        # no block leaves more than two documents
        blocks = blocks.withColumn("n_blocks", F.ceil(2 * F.col("n_blocks") / BLOCK).cast("long"))
        most_blocks = -(-2 * most_blocks // BLOCK)
        level += 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.join(sources.drop("source", "part", "n_blocks"), "source_no")
    copies = (F.col("whole") + F.col("probability").cast("int")).cast("int")
    return out.select("id", "text_hash", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``df`` as the mix takes it: every row as often as it has copies. A row is known by its id and text;
    rows equal in both get the least of their copies."""
    hash_name, id_name, other, copies_name, copy_name = fresh(df, "_mix_hash", "_mix_id", "_mix_other", "_mix_copies", "_mix_copy")
    keyed = df.withColumn(hash_name, F.xxhash64(text))
    copies = mix(df, key, text, source).groupBy(F.col("id").alias(id_name), F.col("text_hash").alias(other)).agg(F.min("copies").alias(copies_name))
    taken = keyed.join(copies.filter(F.col(copies_name) > 0), F.col(key).eqNullSafe(F.col(id_name)) & (F.col(hash_name) == F.col(other)))
    return taken.withColumn(copy_name, F.explode(F.sequence(F.lit(1), F.col(copies_name)))).select(*df.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
