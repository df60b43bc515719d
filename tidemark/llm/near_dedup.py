"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds the hashes of its distinct word shingles; documents with equal sets form a class
that its smallest id stands for, or a number of its own. A signature is a one-permutation MinHash of ``BINS`` bins; ``BANDS``
bands of ``ROWS`` bins make buckets, for which empty bins copy a bin chosen by a fixed random sequence.

Candidates of a bucket are verified in three stages, so that no bucket, however large, gives all its pairs:

1. every member with the bucket's least class;
2. where a bucket still holds two components, every member of another one with the bucket's greatest class;
3. where it still does, members of different components meet in blocks of ``BLOCK``: a task compares the
   signatures of two blocks as arrays, verifies what the bounds cannot refuse, and lets out links only.

Pairs within one component need no verification, as they cannot change it. A candidate's signatures are
compared in batches; after each the posterior of its similarity is known (a Beta distribution over the bins that are
not empty in both), and a pair whose chance to reach the threshold is under ``MISS`` is dropped. Survivors are verified
exactly on their full sets.

Components come from alternating large-star and small-star steps on the written edges; nothing of it is
collected on the driver.

Defined cases: a document without words, or null, has an empty set and is linked with nothing; fewer words
than a shingle make one shingle of all of them. Rows are told apart by id and text (its 64-bit hash), so that several
texts under one id, or under none, are documents of their own, each with its own links; equal rows share their
result. A component's id is the smallest id of its rows; where it has none, it is null, and of such rows those with
the least text hash are kept. An empty table gives no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, discard, prepare, read, release, utf8, written

BINS, BANDS, ROWS = 128, 25, 5
#: Chance, at each batch, that a pair at the threshold or above is dropped.
MISS = 1e-6
BATCH = 32
#: Members of a block, and pairs of blocks that a worker gets at a time.
BLOCK, BLOCK_ROWS = 128, 4
#: Stands for a missing id where rows are looked up by id and text hash.
NO_ID = (1 << 63) - 1
#: Ids from here on can stand for a class; the numbers of other classes lie below.
LOWEST = -(1 << 62)

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = []
#: A random 64-bit value for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 2 * n)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    n = max(1, len(words) - size + 1)
    s, e = starts[:n], ends[len(words) - n :]
    hashes = (sums[e] - sums[s]) * down[s]
    return np.unique(mixed(hashes ^ ((e - s).astype(np.uint64) << np.uint64(40))))


#: For empty bins, the bins to look at in turn.
LOOK = np.random.default_rng(11).integers(0, BINS, (BINS, 512))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BINS values of 16 bits: of each bin (by the top bits) the least hash's middle bits, 0 for an empty bin; and
    the same with empty bins filled."""
    edges = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    full = np.append(edges[1:], len(hashes)) > edges
    own = ((mixed(hashes[np.minimum(edges, len(hashes) - 1)]) >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)
    own = np.where(full, np.maximum(own, 1), 0).astype(np.uint16)
    filled = own.copy()
    if not full.all():
        empty = np.flatnonzero(~full)
        first = full[LOOK[empty]].argmax(axis=1)
        source = LOOK[empty, first]
        lost = ~full[source]
        source[lost] = np.flatnonzero(full)[0]
        filled[empty] = own[source]
    return own, filled


def band_keys(sig: np.ndarray) -> list[int]:
    parts = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(p.tobytes(), seed=i) - (1 << 63) for i, p in enumerate(parts)]


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """Of n compared bins (0 to BINS) the matches below which a pair is dropped: the posterior Beta(1 + m, 1 + n - m)
    then leaves less than ``miss`` at the threshold or above."""
    out = np.zeros(BINS + 1, np.int64)
    for n in range(BINS + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


SETS_SCHEMA = (T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())))


def signatures(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, text_hash, n_shingles, set_key (128-bit hash of the set; null if empty), sig and bands of every row."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("text_hash", T.LongType()), *SETS_SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for t in utf8(rows.column(2)):
                s = shingle_set(t, size)
                if len(s):
                    sig, filled = signature(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.tobytes(), band_keys(filled)))
                else:
                    out.append((0, None, None, None))
            yield batch(schema, [rows.column(0), rows.column(1), *([r[i] for r in out] for i in range(4))])

    return df.select(key, F.xxhash64(text).alias("_text_hash"), text).mapInArrow(run, schema)


def full_sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """rep and its set, from rows of rep and text."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(schema, [rows.column(0), [shingle_set(t, size).tobytes() for t in utf8(rows.column(1))]])

    return df.select("rep", text).mapInArrow(run, schema)


class Threshold:
    """The similarity percent / 100, and what follows from it."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.least = least_matches(percent / 100)

    def sizes_fit(self, a, b):
        """The smaller set can hold enough of the larger one."""
        return (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) if isinstance(a, np.ndarray) else (100 * min(a, b) >= self.percent * max(a, b))

    def passes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of signatures (rows of x and y) no batch refuses. Bins that are empty in both tell nothing."""
        alive = np.ones(len(x), bool)
        matches, compared = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for n in range(0, BINS, BATCH):
            at = np.flatnonzero(alive)
            if not len(at):
                break
            p, q = x[at, n : n + BATCH], y[at, n : n + BATCH]
            known = (p | q) != 0
            compared[at] += known.sum(axis=1)
            matches[at] += ((p == q) & known).sum(axis=1)
            alive[at] = matches[at] >= self.least[compared[at]]
        return alive


def surviving(pairs: DataFrame, reps: DataFrame, threshold: Threshold) -> DataFrame:
    """The (a, b) pairs that the sequential test keeps."""
    known = reps.select("rep", "n_shingles", "sig")
    wide = pairs.join(known.toDF("a", "n_a", "sig_a"), "a").join(known.toDF("b", "n_b", "sig_b"), "b")
    wide = wide.filter(100 * F.least("n_a", "n_b") >= threshold.percent * F.greatest("n_a", "n_b"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                x, y = (np.frombuffer(b"".join(rows.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (2, 3))
                keep = pa.array(threshold.passes(x, y))
                yield batch(schema, [rows.column(i).filter(keep) for i in (0, 1)])

    return wide.select("a", "b", "sig_a", "sig_b").mapInArrow(run, schema)


def linked(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The (a, b) pairs whose full sets reach the threshold."""
    wide = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for p, q in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * common >= threshold.percent * (len(x) + len(y) - common))
            yield batch(schema, [rows.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)])

    return wide.select("a", "b", "set_a", "set_b").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(rep, component) for every vertex of the edges (a, b): the smallest vertex that it reaches. Each round is
    a large-star and a small-star step on written edges, until a round changes nothing; the edges that a round replaced
    are removed."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        u = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # written, so that the join deals both sides out anew and can split a hot centre
        least = kept(u.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        joined = u.join(least, u["u"] == least["w"])
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    tables: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()
    state = None
    while True:
        e = kept(star(star(e, True), False), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in tables[:-1]:
            discard(old)
        del tables[:-1]
        if now == state:
            out = written(e.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("component")), "components")
            discard(e)
            return out
        state = now


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``xs`` with every set of ``ys``."""
    shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), np.float32)
    sides = []
    for sets in (xs, ys):
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, hashes)
        known = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == hashes) if len(shared) else np.zeros(len(hashes), bool)
        order = np.argsort(at[known], kind="stable")
        sides.append((owner[known][order], at[known][order]))
    for begin in range(0, len(shared), 4096):
        marks = []
        for sets, (owner, at) in zip((xs, ys), sides, strict=True):
            a, b = np.searchsorted(at, (begin, begin + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[a:b], at[a:b] - begin] = 1
            marks.append(m)
        out += marks[0] @ marks[1].T
    return out


def block_links(members: DataFrame, threshold: Threshold) -> DataFrame:
    """Links between members (bucket, rep, n_shingles, sig, component, n_members, shingles) of a bucket and of different
    components: (a, b), one for each member and other component of two blocks. The sequential test runs on the
    signatures of two blocks, and what it keeps is verified on their full sets there, so that no row is made for a
    pair that is not linked."""
    n_blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks).cast("int"))
    packed = dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct("rep", "n_shingles", "component", "sig", "shingles")).alias("rows"))
    left, right = packed.toDF("bucket", "block", "rows"), packed.toDF("bucket_2", "block_2", "rows_2")
    met = left.join(right, (F.col("bucket") == F.col("bucket_2")) & (F.col("block") <= F.col("block_2")))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def arrays(rows: pa.StructScalar) -> tuple:
        v = rows.values
        sets = [np.frombuffer(x, np.uint64) for x in v.field("shingles").to_pylist()]
        return v.field("rep").to_pylist(), v.field("n_shingles").to_numpy(), v.field("component").to_pylist(), np.frombuffer(b"".join(v.field("sig").to_pylist()), np.uint16).reshape(-1, BINS), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for p, q in zip(rows.column(0), rows.column(1), strict=True):
                (ra, na, ca, xa, sa), (rb, nb, cb, xb, sb) = arrays(p), arrays(q)
                number: dict[int, int] = {}
                za, zb = (np.array([number.setdefault(c, len(number)) for c in side]) for side in (ca, cb))
                i, j = np.nonzero((za[:, None] != zb[None, :]) & threshold.sizes_fit(na[:, None], nb[None, :]))
                keep = threshold.passes(xa[i], xb[j])
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                c = common_counts(sa, sb)[i, j].astype(np.int64)
                true = 100 * c >= threshold.percent * (na[i] + nb[j] - c)
                i, j = i[true], j[true]
                found = {(ra[m], cb[n]): rb[n] for m, n in zip(i.tolist(), j.tolist(), strict=True)}
                if found:
                    yield batch(schema, [[a for a, _ in found], list(found.values())])

    return met.select("rows", "rows_2").mapInArrow(run, schema)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, text_hash, n_shingles, component_id, kept and leads of every row of ``df``. ``size``: words of a shingle; documents
    are linked if 100 * common >= percent * union. ``leads`` is true for the one (id, text) of each component that stands for it."""
    spark = df.sparkSession
    threshold = Threshold(percent)
    docs = written(signatures(df, key, text, size), "signatures")
    # of a class, the row with the smallest id (none is the greatest), then the least text hash
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").cast("long").alias("id"), "text_hash"))
    classes = docs.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(lead.alias("lead"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")))
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    # the smallest id stands for a class, so that a bucket's hub is its earliest document, of which the others mostly are copies;
    # classes without an id, or with one that leads several of them, have a number below all such ids
    several = written(classes.groupBy(F.col("lead.id").alias("shared")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND shared IS NOT NULL").select("shared"), "shared-leads")
    own_id = F.col("shared").isNull() & (F.col("lead.id") >= LOWEST)
    reps = classes.join(several, F.col("lead.id") == F.col("shared"), "left").withColumn("rep", F.when(own_id, F.col("lead.id")).otherwise(F.col("number") + F.lit(-(1 << 63)))).drop("shared", "number")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = written(members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n_members")).filter("n_members > 1"), "buckets")
    members = written(members.join(buckets, "bucket").select("bucket", "rep", "hub", "n_members"), "members")
    discard(buckets)
    release(spark)  # of classes and buckets

    pairs = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    survivors = written(surviving(pairs, reps, threshold), "survivors")
    # whoever may be verified at any stage stands in a bucket with others: their sets are made once, from the leading row's text
    wanted = reps.join(members.select("rep").distinct(), "rep").select("rep", F.coalesce("lead.id", F.lit(NO_ID)).alias("row_id"), F.col("lead.text_hash").alias("row_hash"))
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("row_id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))
    texts = rows.join(wanted, ["row_id", "row_hash"]).dropDuplicates(["row_id", "row_hash", "rep"])
    sets = written(full_sets(texts, "text", size), "sets")
    edges = written(linked(survivors, sets, threshold), "edges")
    discard(survivors)
    release(spark)
    found = components(edges)

    for stage in (2, 3):
        named = members.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed_buckets = written(named.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max(F.struct("rep", "component")).alias("last")).filter("c1 <> c2"), f"mixed{stage}")
        still = written(named.filter("n_members > 2").join(mixed_buckets, "bucket").select("bucket", "rep", "component", "n_members", F.col("last.rep").alias("last"), F.col("last.component").alias("last_component")), f"open{stage}")
        if stage == 2:
            pairs = still.filter("component <> last_component").select(F.least("rep", "last").alias("a"), F.greatest("rep", "last").alias("b")).distinct()
            tried = written(surviving(pairs, reps, threshold), "survivors")
            more = linked(tried, sets, threshold)
        else:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
            tried = more = written(block_links(still.join(reps.select("rep", "n_shingles", "sig"), "rep").join(sets, "rep"), threshold).distinct(), "block-links")
            prepare(spark)
        known = written(edges.unionByName(more), "edges")
        for table in (edges, tried, mixed_buckets, still, found):
            discard(table)
        release(spark)
        edges = known
        found = components(edges)

    component = reps.select("rep", "set_key", "lead").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    leads = component.groupBy("component").agg(F.min("lead").alias("first"))
    named = written(component.join(leads, "component").select("set_key", "first"), "named")
    for table in (members, sets, edges, found, classes, several):
        discard(table)
    release(spark)
    out = docs.select("id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    alone, own = F.col("set_key").isNull(), F.col("id").cast("long")
    same_text = F.col("text_hash") == F.col("first.text_hash")
    component_id = F.when(alone, own).otherwise(F.col("first.id"))
    without_id = F.col("id").isNull() & (alone | (F.col("first.none") & same_text))
    leading = alone | (own.eqNullSafe(F.col("first.id")) & same_text)
    return out.select("id", "text_hash", "n_shingles", component_id.alias("component_id"), F.coalesce(own == component_id, without_id).alias("kept"), leading.alias("leads"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM toks
),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
common AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
),
edges AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT rep AS a, rep AS b FROM classes
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
),
comp AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(p.component, d.doc_id) AS component_id, coalesce(p.component, d.doc_id) = d.doc_id AS kept
FROM (SELECT doc_id, s FROM sets) d
LEFT JOIN classes c ON list_sort(d.s) = c.s
LEFT JOIN comp p ON p.rep = c.rep
"""
