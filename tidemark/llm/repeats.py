"""Suffix-array dedup: the suffixes of the corpus are refined to depth ``LENGTH`` in buckets.

As in bucket-pointer refinement, suffixes first fall into buckets by a q-gram, a bucket of one needs no
more work, and every other bucket is refined by the bucket identifiers of its suffixes at later offsets,
identifiers made once being used again for longer strings. What differs is forced by the corpus not
fitting into one memory: a bucket's identifier is a hash of its string instead of a rank, so that tasks
agree on it without a global sort, and the first buckets hold only suffixes that must meet.

* Identifiers of 1, 2, 4, 8 and 16 bytes are built from those of half the length at later offsets; that of
  ``LENGTH`` bytes from seven of 16 bytes.
* Of the 16-byte identifiers within a LENGTH-byte string the least is its bucket. Equal strings have equal
  buckets, and neighbouring starts mostly share theirs: such a run of starts is one entry, some 2 for each
  86 bytes of text, with an identifier of the whole context that the run covers.
* First refinement: in a bucket whose entries have one context, all but the first entry repeat it. A bucket
  with several contexts (or a context that repeats within itself) stays open.
* Second refinement: the starts of open entries are cut, by their distance to the bucket's place, into steps of
  ``STEP`` starts. The bytes that all strings of a step share are its bucket, the bytes that it covers its context.
* Third refinement: the starts of steps that are still open are sorted by their own LENGTH-byte identifiers; all
  but the first of each repeat it.

A task settles what it can by itself before anything is shuffled, and sends at most one entry for each bucket
(or identifier): however often a passage or a copy occurs, a bucket gets no more entries than there are
tasks' chunks of ``CHUNK`` bytes. Entries travel packed, by ranges of identifiers.

Identifiers of strings have 128 bits (contexts: 64 bits beside the bucket's 64), so that equality of
identifiers stands for equality of strings.

Defined cases: null text is empty; texts under LENGTH bytes keep all; a null id counts as the largest. Rows are told
apart by id and, where an id is null or repeated, by the 64-bit hash of the text too (the lesser one stands earlier), so
that several texts under one id are several documents; equal rows are one document and get the same result. An empty
table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, discard, fresh, read, release, utf8, written

LENGTH, GRAM = 100, 16
#: Identifiers within a string, and the offsets of those that make up its own.
SPAN = LENGTH - GRAM + 1
OFFSETS = (0, 16, 32, 48, 64, 80, 84)
#: Starts of a step, and offsets of the identifiers of the bytes that its strings share.
STEP = 16
SHARED = (0, 16, 32, 48, 64, LENGTH - STEP + 1 - GRAM)
#: Bytes that arrays are made for at once; bytes of texts that a task settles at once.
PIECE, CHUNK = 1 << 18, 4 << 20
LAST_ID = (1 << 63) - 1
#: Entries are sent in 2 ** PART_BITS ranges of identifiers, and in more from so many ranges times PART_BYTES of text on.
PART_BITS, PART_BYTES = 10, 256 << 20

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U32 = np.uint64(32)

#: An entry: its bucket, context, document (id, and text hash where the id does not tell), first start, and starts beyond the first
#: (OPEN: only says that the bucket is open).
ENTRY = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("at", "<i4"), ("extra", "<i4")])
OPEN = -1
#: A range of starts of a document: DUP repeats what stands earlier, UNSURE is to be refined.
MARK = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("first", "<i4"), ("last", "<i4"), ("kind", "<i4")])
#: What is kept of a mark beside its document.
KEPT = np.dtype([("first", "<i4"), ("last", "<i4"), ("kind", "<i4")])
DUP, UNSURE = 0, 1

SENT, MARKED, TEXT = 0, 1, 2
ROWS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("data", T.BinaryType())])
Row = tuple[int, int, int, bytes]


def grams(data: np.ndarray) -> np.ndarray:
    """The identifier of the GRAM bytes from each position on."""
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << U32
    eight *= C1
    eight ^= eight >> U32
    out = eight[:-8] * C2
    out += eight[8:]
    out ^= out >> np.uint64(29)
    out *= C3
    out ^= out >> U32
    return out


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours, by doubling."""
    f, n = (np.minimum if least else np.maximum), 1
    while 2 * n <= width:
        x = f(x[: len(x) - n], x[n:])
        n *= 2
    rest = width - n
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def identifiers(g: np.ndarray, at: np.ndarray, offsets: tuple[int, ...] = OFFSETS) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identifiers of the LENGTH bytes from each position of ``at`` on."""
    a = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    b = np.full(len(at), 0x13198A2E03707344, np.uint64)
    for o in offsets:
        x = g[at + o]
        a = (a ^ x) * C2
        a ^= a >> np.uint64(31)
        b = (b + x) * C3
        b ^= b >> np.uint64(33)
    return a, b


def pieces(docs: Iterator[Row]) -> Iterator[tuple[np.ndarray, list[tuple[int, ...]]]]:
    """Texts (id, hash, offset, bytes) joined to some PIECE bytes: the joined bytes, and of each text its id, its
    offset, its begin and its last start in the joined bytes, and its hash. Longer texts come in overlapping parts."""
    held: list[bytes] = []
    where: list[tuple[int, ...]] = []
    size = 0
    for doc, sub, offset, text in docs:
        for begin in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[begin : begin + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            held.append(part)
            where.append((doc, offset + begin, size, size + len(part) - LENGTH, sub))
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), where
                held, where, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), where


def starts_of(n: int, where: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Which of n positions of joined texts start a string within one text; the texts as an array."""
    valid = np.zeros(n + 1, np.int8)
    w = np.array(where, np.int64)
    np.add.at(valid, w[:, 2], 1)
    np.add.at(valid, w[:, 3] + 1, -1)
    return np.cumsum(valid[:-1], dtype=np.int8) > 0, w


def places(g: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Positions that hold the least identifier of some string."""
    edge = np.full(SPAN - 1, 0, np.uint64)
    return np.flatnonzero(g == sliding(np.concatenate([edge, least, edge]), SPAN, False))


def packed(w: np.ndarray, owner: np.ndarray, key: np.ndarray, context: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), ENTRY)
    out["key"], out["more"] = key, context ^ context >> U32
    out["doc"], out["sub"], out["at"], out["extra"] = w[owner, 0], w[owner, 4], w[owner, 1] + first - w[owner, 2], last - first
    return out


def entries_of(data: np.ndarray, where: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of joined texts, and which of them may repeat themselves."""
    g = grams(data)
    least = sliding(g, SPAN, True)
    valid, w = starts_of(len(least), where)
    breaks = heads(least)
    breaks[w[:, 2]] = True
    first = np.flatnonzero(breaks & valid)
    owner = np.searchsorted(w[:, 2], first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, w[owner, 3])
    v, extra = least[first], last - first
    context = identifiers(g, first)[0] * C1 + identifiers(g, last)[0] + extra.astype(np.uint64) * C3
    # two places with the bucket's identifier make a run suspect
    picked = places(g, least)
    low, high = np.searchsorted(picked, first), np.searchsorted(picked, last + SPAN)
    n_equal = np.zeros(len(first), np.int64)
    active = np.flatnonzero(high > low)
    step = 0
    while len(active):
        n_equal[active] += g[picked[low[active] + step]] == v[active]
        step += 1
        active = active[(low[active] + step < high[active]) & (n_equal[active] < 2)]
    return packed(w, owner, v, context, first, last), (n_equal > 1) | (extra >= SPAN)


def steps_of(data: np.ndarray, where: list[tuple[int, ...]]) -> np.ndarray:
    """Entries of the steps of joined texts. A string's place is the leftmost that holds its least identifier."""
    g = grams(data)
    least = sliding(g, SPAN, True)
    valid, w = starts_of(len(least), where)
    s = np.flatnonzero(valid)
    picked = places(g, least)
    at = np.searchsorted(picked, s)
    wrong = np.flatnonzero(g[picked[at]] != least[s])
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[g[picked[at[wrong]]] != least[s[wrong]]]
    place = picked[at]
    number = (place - s) // STEP
    owner = np.searchsorted(w[:, 2], s, side="right") - 1
    head = np.flatnonzero(heads(owner, place, number))
    first, last = s[head], s[np.append(head[1:], len(s)) - 1]
    place, number, owner = place[head], number[head], owner[head]
    shared = identifiers(g, place - number * STEP, SHARED)[0]
    key = shared ^ (number.astype(np.uint64) + np.uint64(1)) * C2
    context = identifiers(g, first)[0] * C1 + identifiers(g, last)[0] + (last - first).astype(np.uint64) * C3 + (place - first).astype(np.uint64) * C2
    return packed(w, owner, key, context, first, last)


def marks(e: np.ndarray, kind: int) -> np.ndarray:
    """Marks on the starts of entries."""
    out = np.empty(len(e), MARK)
    out["doc"], out["sub"], out["first"], out["last"], out["kind"] = e["doc"], e["sub"], e["at"], e["at"] + e["extra"], kind
    return out


def openings(e: np.ndarray) -> np.ndarray:
    """Entries that only say that the buckets of ``e`` are open."""
    out = np.zeros(len(e), ENTRY)
    out["key"], out["extra"] = e["key"], OPEN
    return out


def ordered(e: np.ndarray) -> np.ndarray:
    """By bucket, context, document and start, equal ones once."""
    e = e[np.lexsort((e["at"], e["sub"], e["doc"], e["more"], e["key"]))]
    return e[np.append(True, e[1:] != e[:-1])] if len(e) else e


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where the value of sorted columns changes."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def refine(e: np.ndarray, suspect: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entries that remain (one for each bucket with a single context, OPEN ones for the rest), and marks."""
    if suspect is not None and suspect.any():
        unsure = [marks(e[suspect], UNSURE)]
        e = np.concatenate([e[~suspect], openings(e[suspect])])
    else:
        unsure = []
    e = ordered(e)
    if not len(e):
        return e, np.concatenate([np.empty(0, MARK), *unsure])
    bucket = heads(e["key"])
    number = np.cumsum(bucket) - 1
    context = heads(e["key"], e["more"]) | (e["extra"] == OPEN)
    n_contexts = np.bincount(number, weights=context)
    is_open = np.bincount(number, weights=e["extra"] == OPEN) > 0
    several = (is_open | (n_contexts > 1))[number]
    real = e["extra"] != OPEN
    lead = context & real
    repeated = e[real & ~context]
    open_leads = e[lead & several]
    kept = e[lead & ~several]
    return np.concatenate([kept, openings(e[bucket & several])]), np.concatenate([*unsure, marks(repeated, DUP), marks(open_leads, UNSURE)])


def firsts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts by their own identifiers: the first of each, and marks on the others."""
    e = ordered(e)
    lead = heads(e["key"], e["more"])
    return e[lead], marks(e[~lead], DUP)


def joined_marks(m: np.ndarray) -> np.ndarray:
    """Marks of one kind that touch or overlap become one; sorted by document."""
    if not len(m):
        return m
    m = m[np.lexsort((m["first"], m["sub"], m["doc"], m["kind"]))]
    new = heads(m["kind"], m["doc"], m["sub"])
    # ends grow within a document; a mark begins anew where it leaves a gap behind all before it
    number = np.cumsum(new) - 1
    shift = number.astype(np.int64) * (1 << 40)
    reach = np.maximum.accumulate(m["last"] + shift)
    new[1:] |= m["first"][1:] + shift[1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    out = m[at].copy()
    out["last"] = np.maximum.reduceat(m["last"], at)
    return out


def between(cut: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The ranges that begin at ``cut`` and end where the next one begins, or at n."""
    return list(itertools.pairwise([*cut.tolist(), n]))


def mark_rows(m: np.ndarray) -> list[Row]:
    m = joined_marks(m)
    m = m[np.lexsort((m["sub"], m["doc"]))]  # stable: of a document by kind
    cut = np.flatnonzero(heads(m["doc"], m["sub"]))
    kept = np.empty(len(m), KEPT)
    for name in KEPT.names:
        kept[name] = m[name]
    return [(MARKED, int(m["doc"][a]), int(m["sub"][a]), kept[a:b].tobytes()) for a, b in between(cut, len(m))]


def marks_of(found: list[bytes]) -> np.ndarray:
    """Marks of one document, from their packed form."""
    kept = np.frombuffer(b"".join(found), KEPT)
    out = np.zeros(len(kept), MARK)
    for name in KEPT.names:
        out[name] = kept[name]
    return out


def sent_rows(e: np.ndarray, bits: int) -> list[Row]:
    """Entries packed by ranges of their mixed buckets (least identifiers crowd at the low end), field after field."""
    mixed = (e["key"] ^ e["key"] >> U32) * C2
    part = (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(e), np.int64)
    order = np.argsort(part, kind="stable")
    e, part = e[order], part[order]
    cut = np.flatnonzero(heads(part))
    return [(SENT, int(part[a]), 0, b"".join([e[name][a:b].tobytes() for name in ENTRY.names])) for a, b in between(cut, len(e))]


def entries_from(packed_ones: list[bytes]) -> np.ndarray:
    out = np.empty(sum(map(len, packed_ones)) // ENTRY.itemsize, ENTRY)
    begin = 0
    for data in packed_ones:
        n, at = len(data) // ENTRY.itemsize, 0
        for name in ENTRY.names:
            form = ENTRY[name]
            out[name][begin : begin + n] = np.frombuffer(data, form, n, at)
            at += n * form.itemsize
        begin += n
    return out


def out_batches(rows: list[Row]) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(rows), 4096):
        some = rows[begin : begin + 4096]
        yield batch(ROWS, [[r[i] for r in some] for i in range(4)])


def settle(docs: DataFrame, bits: int) -> DataFrame:
    """First refinement within tasks: rows of id, sub and text become sent entries and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                e, m = refine(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield from out_batches(sent_rows(e, bits) + mark_rows(m))

        texts = ((doc, sub, 0, text) for rows in batches for doc, sub, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), utf8(rows.column(2)), strict=True))
        for data, where in pieces(texts):
            held.append(entries_of(data, where))
            size += len(data)
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return docs.select("id", "sub", "text").mapInArrow(run, ROWS)


def unsure_ranges(found: list[bytes]) -> np.ndarray:
    m = marks_of(found)
    return joined_marks(m[m["kind"] == UNSURE])


RANGE = np.dtype([("first", "<i4"), ("size", "<i4")])


def settle_steps(docs: DataFrame, bits: int) -> DataFrame:
    """Second refinement within tasks: rows of id, text and marks; the steps of UNSURE marks are sent, and
    the texts of these marks are kept for the third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts: list[Row] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                e, m = refine(np.concatenate(held))
                yield from out_batches(sent_rows(e, bits) + mark_rows(m) + texts)

        def ranges() -> Iterator[Row]:
            for rows in batches:
                for doc, sub, text, found in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), utf8(rows.column(2)), rows.column(3).to_pylist(), strict=True):
                    m = unsure_ranges(found)
                    parts = [(a, text[a : b + LENGTH]) for a, b in zip(m["first"].tolist(), m["last"].tolist(), strict=True)]
                    if parts:
                        head = np.array([(a, len(t)) for a, t in parts], RANGE)
                        texts.append((TEXT, doc, sub, len(parts).to_bytes(4, "little") + head.tobytes() + b"".join([t for _, t in parts])))
                    yield from ((doc, sub, a, t) for a, t in parts)

        for data, where in pieces(ranges()):
            held.append(steps_of(data, where))
            size += len(data)
            if size >= CHUNK:
                yield from flush()
                held, texts[:], size = [], [], 0
        yield from flush()

    return docs.select("id", "sub", "text", "marks").mapInArrow(run, ROWS)


def settle_starts(docs: DataFrame, bits: int) -> DataFrame:
    """Third refinement within tasks: rows of id, texts (of its former UNSURE marks) and marks; the starts of
    UNSURE marks are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                e, m = firsts(np.concatenate(held))
                yield from out_batches(sent_rows(e, bits) + mark_rows(m))

        def ranges() -> Iterator[Row]:
            for rows in batches:
                for doc, sub, kept, found in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                    known: list[tuple[int, bytes]] = []
                    for data in kept:
                        n = int.from_bytes(data[:4], "little")
                        head, at = np.frombuffer(data, RANGE, n, 4), 4 + n * RANGE.itemsize
                        for first, length in head.tolist():
                            known.append((first, data[at : at + length]))
                            at += length
                    known.sort()
                    begins = [a for a, _ in known]
                    for a, b in unsure_ranges(found)[["first", "last"]].tolist():
                        while a <= b:  # a range may go on from one text to the next
                            first, text = known[bisect.bisect_right(begins, a) - 1]
                            end = min(b, first + len(text) - LENGTH)
                            if end < a:
                                break
                            yield doc, sub, a, text[a - first : end - first + LENGTH]
                            a = end + 1

        for data, where in pieces(ranges()):
            g = grams(data)
            valid, w = starts_of(len(g) - SPAN + 1, where)
            s = np.flatnonzero(valid)
            owner = np.searchsorted(w[:, 2], s, side="right") - 1
            e = np.empty(len(s), ENTRY)
            e["key"], e["more"] = identifiers(g, s)
            e["doc"], e["sub"], e["at"], e["extra"] = w[owner, 0], w[owner, 4], w[owner, 1] + s - w[owner, 2], 0
            held.append(e)
            size += len(data)
            if size >= CHUNK // 2:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return docs.select("id", "sub", "texts", "marks").mapInArrow(run, ROWS)


def resolve(table: DataFrame, starts: bool, partitions: int) -> DataFrame:
    """Marks from sent entries, which meet by ranges of identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for rows in batches:
            for part, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                parts.setdefault(part, []).append(data)
        while parts:  # marks are packed within a part, so that their rows are as many however the parts are dealt out
            e = entries_from(parts.popitem()[1])
            yield from out_batches(mark_rows((firsts(e) if starts else refine(e))[1]))

    return table.filter(F.col("kind") == SENT).select("key", "data").repartition(partitions, "key").mapInArrow(run, ROWS)


def by_document(*tables: DataFrame) -> DataFrame:
    """id, sub and the list of the document's packed marks."""
    union = None
    for t in tables:
        t = t.filter(F.col("kind") == MARKED).select(F.col("key").alias("id"), "sub", "data")
        union = t if union is None else union.unionByName(t)
    return union.groupBy("id", "sub").agg(F.collect_list("data").alias("marks"))


def removed(found: list[bytes], n: int) -> list[tuple[int, int]]:
    """Removed byte ranges [begin, end) of a text of n bytes, from its marks."""
    m = marks_of(found)
    m = m[(m["kind"] == DUP) & (m["first"] <= n - LENGTH)].copy()
    m["last"] = np.minimum(m["last"], n - LENGTH) + LENGTH - 1
    m = joined_marks(m)
    return list(zip(m["first"].tolist(), (m["last"] + 1).tolist(), strict=True))


def unsure(column: str) -> F.Column:
    """Whether some packed marks hold an UNSURE one: marks of a document are sorted by kind, UNSURE is the last."""
    return F.exists(column, lambda m: m.substr(F.octet_length(m) - 3, F.lit(1)) == F.lit(bytes([UNSURE])))


def identified(df: DataFrame, key: str, text: str, id_name: str, sub_name: str) -> DataFrame:
    """``df`` with the two columns that tell its rows apart: the id (NO_ID for none), and the text's hash where several rows
    have the id. The table of such ids is small as a rule; where it is not, or one id is hot, the join is dealt out and
    split by the engine."""
    spark = df.sparkSession
    keyed = df.withColumn(id_name, F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)))
    many = written(keyed.groupBy(F.col(id_name).alias("_many")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_many"), "repeated-ids")
    ambiguous = F.col("_many").isNotNull()
    return keyed.join(many, F.col(id_name) == F.col("_many"), "left").withColumn(sub_name, F.when(ambiguous, F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("_many")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", marks_name: str = "_marks") -> DataFrame:
    """The rows of ``df`` with a column of their marks (a list of packed marks, null for none)."""
    spark = df.sparkSession
    id_name, sub_name = fresh(df, "_repeat_id", "_repeat_sub")
    keyed = identified(df, key, text, id_name, sub_name)
    docs = keyed.select(F.col(id_name).alias("id"), F.col(sub_name).alias("sub"), F.col(text).alias("text"))
    document = ["id", "sub"]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (256 << 20)))
    bits = max(PART_BITS, (total // PART_BYTES).bit_length())
    table = written(settle(docs, bits), "repeats")
    first = written(by_document(table, resolve(table, False, partitions)), "repeat-marks")
    discard(table)
    release(spark)
    steps = written(settle_steps(docs.join(first.filter(unsure("marks")), document), bits), "repeat-steps")
    second = written(by_document(steps, resolve(steps, False, partitions)), "repeat-marks")
    release(spark)
    texts = steps.filter(F.col("kind") == TEXT).groupBy(F.col("key").alias("id"), "sub").agg(F.collect_list("data").alias("texts"))
    table = written(settle_starts(texts.join(second.filter(unsure("marks")), document), bits), "repeat-starts")
    third = written(by_document(table, resolve(table, True, partitions)), "repeat-marks")
    discard(table)
    discard(steps)
    release(spark)
    found = first.unionByName(second).unionByName(third).groupBy(document).agg(F.flatten(F.collect_list("marks")).alias("marks"))
    found = written(found, "repeat-marks")
    for old in (first, second, third):
        discard(old)
    named = found.select(F.col("id").alias(id_name), F.col("sub").alias(sub_name), F.col("marks").alias(marks_name))
    return keyed.join(named, [id_name, sub_name], "left").select(*df.columns, marks_name)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with the repeated bytes of its texts removed, and its count of characters renewed. Bytes of a
    character that was cut go with it; null texts stay as they are."""
    at, counted = df.columns.index(text), df.columns.index(n_chars) if n_chars in df.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = []
            for t, known, found in zip(utf8(rows.column(at)), rows.column(at).is_valid().to_pylist(), rows.column(len(df_columns)).to_pylist(), strict=True):
                texts.append(cut_out(t, removed(found, len(t)) if found else []).decode("utf-8", "ignore") if known else None)
            columns = [rows.column(i) for i in range(len(df_columns))]
            columns[at] = texts
            if counted >= 0:
                columns[counted] = [n if t is None else len(t) for t, n in zip(texts, rows.column(counted).to_pylist(), strict=True)]
            yield batch(schema, columns)

    df_columns, schema = df.columns, df.schema
    (marks_name,) = fresh(df, "_marks")
    return repeats(df, key, text, marks_name).mapInArrow(run, schema)


def cut_out(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def apply_marks(marked: DataFrame, key: str, text: str, schema: T.StructType, last) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for t, found in zip(utf8(rows.column(1)), rows.column(2).to_pylist(), strict=True):
                ranges = removed(found, len(t)) if found else []
                out.append((len(t), sum(b - a for a, b in ranges), len(ranges), last(cut_out(t, ranges))))
            yield batch(schema, [rows.column(0), *([r[i] for r in out] for i in range(4))])

    return marked.select(key, text, "_marks").mapInArrow(run, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return apply_marks(repeats(docs), "doc_id", "text", schema, lambda kept: hashlib.sha256(kept).hexdigest())
