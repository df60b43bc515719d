"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text. A
window is whole words of some ``WINDOW`` bytes; its gap is the number of bytes by which the toxic dictionary
compresses it further than the ordinary one. A document's windows with a gap of the calibrated threshold or more,
their share and its largest gap give the score through a logistic curve fitted on labelled rows that the
dictionaries have not seen.

As toxic text is ordinary text for the most part, a toxic dictionary that is simply trained on it mostly holds what
the other one holds too, in other pieces, and gaps are noise. So

* both compressors begin with the ordinary dictionary, the toxic dictionary comes behind it;
* the toxic dictionary is trained in rounds: the toxic rows are dealt into halves, the dictionary of one half
  measures the windows of the other, and the next round trains on the parts of windows (the word whose removal
  costs most of the gap, and its neighbours) whose gap ordinary windows rarely reach;
* then its words are blanked one after another: those stay without which the gaps of more toxic rows than
  ordinary ones sink below what counts, by Fisher's exact test at ``LEVEL``. Where no word passes, all stay;
* all this is done ``PASSES`` times, each time on windows whose gap does not count yet; what stays is added.

Sampled rows of a class count for all its labelled rows, so that the sample's size moves no score;
a toxic one weighs ``COST`` times as much.
Windows that mostly repeat an earlier row of their class are left out of the fit, so that copies count once.

Only ``SAMPLE`` labelled rows of each class, those with the least hash, and of at most ``SAMPLE_BYTES`` bytes,
are fetched for fitting, one text for each id; at most ``TRAIN_ROWS`` of a class train the dictionaries; ordinary windows that only set levels come from the
first ``LEVEL_ROWS`` rows, and the blanking looks at ``PRUNE_ROWS`` rows of each class. Every row is scored over its whole text.

Defined cases: null and empty texts have no windows and the score of a document without toxic windows;
with no labelled rows of one class every score is the share of toxic rows (0 if there are none), kept off 0.5;
with so few of one class that none would be set aside, all rows train and calibrate; a label row that is null or
has no document is left out; repeated label rows with two verdicts count as toxic; of several texts under one id
the least is fitted; a null id is not held out and never fitted; an empty table gives no rows; equal texts have
equal scores; a word longer than a window is cut.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, read

#: Labelled rows of each class, and bytes of a row, that the fit may use.
SAMPLE, SAMPLE_BYTES = 2000, 65536
FOLDS = 5

#: Bytes of a window.
WINDOW = 64
#: A shorter window comes behind so many bytes that both dictionaries hold, as tiny inputs would be stored uncompressed.
LEAD = 48
LEAST_MATCH = 4
#: A byte that no window holds.
FILL = b"\n"
CUT = re.compile(rb"[^ ](?:.{0,%d}[^ ])?(?![^ ])|[^ ]{%d}" % (WINDOW - 2, WINDOW), re.DOTALL)
#: Bytes of the ordinary dictionary, and of the toxic one in each round.
ORDINARY_BYTES, TOXIC_BYTES = 16384, (4096, 2048)
#: Times that the toxic dictionary grows by what it does not yet tell apart.
PASSES = 3
#: Lengths of what the dictionary trainer counts, and of the segments it picks.
DMER, SEGMENT, ORDINARY_SEGMENT = 6, 24, 48
#: A toxic window is told apart if this share of ordinary windows has a smaller gap.
RARE = 0.95
#: Rows of each class that the dictionaries are trained on; the others calibrate.
TRAIN_ROWS = 1000
#: Rows that the fit takes levels from, rows of each class for the blanking, and its level.
LEVEL_ROWS, PRUNE_ROWS, LEVEL = 400, {1: 250, 0: 700}, 1e-3
#: A missed toxic row weighs as much as so many clean ones that are called toxic.
COST = 3.0
#: Neighbours on either side that a telling word is trained with.
AROUND = 2
#: Candidate thresholds of the gap.
GAPS = (3, 4, 5, 6)
MOST_GAP = 12.0


def windows(text: str) -> list[bytes]:
    """Whole lower-cased words, as many as ``WINDOW`` bytes hold, between two spaces; longer words are cut."""
    return [b" %b " % w for w in CUT.findall(b" ".join(text.lower().encode("utf-8", "replace").split()))]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=LEAST_MATCH, target_length=32)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of ``size`` bytes; where the samples are too few to train one, they are it."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Gaps:
    """Bytes that the toxic dictionary saves on windows."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.parts = (ordinary, toxic)
        # of one length, so that offsets cost the same and both parse alike where the toxic part has no match
        self.ordinary, self.toxic = compressor(ordinary + FILL * len(toxic)), compressor(ordinary + toxic)
        self.lead = ordinary[-LEAD:]

    def __reduce__(self):
        return Gaps, self.parts

    def of(self, some: list[bytes]) -> np.ndarray:
        plain, toxic = self.ordinary.compress, self.toxic.compress
        some = [w if len(w) >= LEAD else self.lead + w for w in some]
        return np.array([len(plain(w)) - len(toxic(w)) for w in some], np.int64)


def features(gaps: np.ndarray, threshold: int) -> tuple[float, ...]:
    n, wide = int((gaps >= threshold).sum()), int((gaps >= threshold + 2).sum())
    size = max(1, len(gaps))
    return (math.log1p(n), math.log1p(100 * n / size), math.log1p(wide), math.log1p(100 * wide / size), min(MOST_GAP, float(gaps.max(initial=0))))


class Model:
    def __init__(self, gaps: Gaps | None, threshold: int, weights: list[float], prior: float) -> None:
        self.gaps, self.threshold, self.weights, self.prior = gaps, threshold, weights, prior

    def score(self, text: str) -> float:
        if self.gaps is None:
            return self.prior
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(self.gaps.of(windows(text)), self.threshold), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (bias first) by Newton's steps, and the mean loss. ``mass``: how much each row counts."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (mass * p * (1 - p))) @ a + np.diag(penalty), a.T @ (mass * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=mass))


def chance(a: int, b: int, toxic: int, ordinary: int) -> float:
    """Fisher's exact test: the chance that of a + b rows a or more are toxic."""

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    total = ways(toxic + ordinary, a + b)
    return min(1.0, sum(math.exp(ways(toxic, k) + ways(ordinary, a + b - k) - total) for k in range(max(a, a + b - ordinary), min(toxic, a + b) + 1)))


def own_windows(texts: list[str]) -> list[list[bytes]]:
    """The windows of each text of which no more than half the word triples stand in an earlier text."""
    seen: set[int] = set()
    out = []
    for text in texts:
        kept, mine = [], set()
        for w in windows(text):
            words = w.split()
            triples = {hash(t) for t in zip(words, words[1:], words[2:], strict=False)} or {hash(w)}
            if 2 * len(triples & seen) <= len(triples):
                kept.append(w)
            mine |= triples
        seen |= mine
        out.append(kept)
    return out


def telling_parts(gaps: Gaps, some: list[bytes], least: float) -> list[bytes]:
    """Of windows with a gap of ``least`` or more, the word whose removal costs most of it, with its neighbours."""
    out = []
    for w, gap in zip(some, gaps.of(some).tolist(), strict=True):
        if gap < least:
            continue
        words = w.split()
        lost = gap - gaps.of([b" %b " % b" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))])
        at = int(lost.argmax())
        if lost[at] > 0:
            out.append(b" %b " % b" ".join(words[max(0, at - AROUND) : at + AROUND + 1]))
    return out


def blanked(ordinary: bytes, toxic: bytes, rows: dict[int, list[list[bytes]]]) -> bytes:
    """The toxic dictionary without the words that save no more in toxic rows than in ordinary ones."""
    gaps = Gaps(ordinary, toxic)
    some, row, label = [], [], []
    for verdict, found in rows.items():
        for i, own in enumerate(found[: PRUNE_ROWS[verdict]]):
            near = [w for w, gap in zip(own, gaps.of(own).tolist(), strict=True) if gap >= GAPS[0]]
            some += near
            row += [i] * len(near)
            label += [verdict] * len(near)
    where, is_toxic = np.array(row), np.array(label) == 1
    n_toxic, n_ordinary = (min(PRUNE_ROWS[v], len(rows[v])) for v in (1, 0))

    def sizes(dictionary: bytes, at: list[int]) -> np.ndarray:
        compress = compressor(ordinary + dictionary).compress
        return np.array([len(compress(some[i])) for i in at], np.int64)

    holds: dict[bytes, list[int]] = {}
    for i, w in enumerate(some):
        for gram in {w[j : j + LEAST_MATCH] for j in range(len(w) - LEAST_MATCH + 1)}:
            holds.setdefault(gram, []).append(i)
    left = bytearray(toxic)
    everywhere = list(range(len(some)))
    now = sizes(toxic, everywhere)
    bound = sizes(FILL * len(toxic), everywhere) - GAPS[0]  # a window of this size or less has a gap that counts
    n_kept = 0
    for m in re.finditer(rb"[^ ]+", toxic):
        # only windows that share a match's least length with the word can change
        around = bytes(left[max(0, m.start() - LEAST_MATCH + 1) : m.end() + LEAST_MATCH - 1])
        touched = sorted({i for j in range(len(around) - LEAST_MATCH + 1) for i in holds.get(around[j : j + LEAST_MATCH], ())})
        left[m.start() : m.end()] = FILL * len(m[0])
        then = now.copy()
        then[touched] = sizes(bytes(left), touched)
        lost = (now <= bound) & (then > bound)
        a, b = len(set(where[lost & is_toxic].tolist())), len(set(where[lost & ~is_toxic].tolist()))
        if a and chance(a, b, n_toxic, n_ordinary) < LEVEL:
            left[m.start() : m.end()] = m[0]
            n_kept += 1
        else:
            now = then
    return re.sub(rb"[ \n]+", b" ", bytes(left)) if n_kept else b""


def train(toxic_texts: list[str], ordinary_texts: list[str]) -> Gaps:
    """Both dictionaries, from texts of either class."""
    rows = {1: own_windows(toxic_texts), 0: own_windows(ordinary_texts)}
    ordinary = trained([w for own in rows[0] for w in own], ORDINARY_BYTES, ORDINARY_SEGMENT)
    usual = [w for own in rows[0][-LEVEL_ROWS:] for w in own]
    toxic = b""
    for _ in range(PASSES):
        known = Gaps(ordinary, toxic)
        open_rows = [[w for w, gap in zip(own, known.of(own).tolist(), strict=True) if gap < GAPS[0]] for own in rows[1]] if toxic else rows[1]
        halves = [[w for own in open_rows[i::2] for w in own] for i in (0, 1)]
        if not all(halves):  # one toxic row, or copies of it
            halves = [[w for own in open_rows for w in own]] * 2
        if not halves[0]:
            break
        samples = halves
        for size in TOXIC_BYTES:
            made = [trained(s, size, SEGMENT) for s in samples]
            found = []
            for half, other in zip(halves, reversed(made), strict=True):
                gaps = Gaps(ordinary + toxic, other)
                least = max(2.0, float(np.quantile(gaps.of(usual), RARE)) + 1) if usual else 2.0
                found.append(telling_parts(gaps, half, least))
            samples = [f or s for f, s in zip(found, samples, strict=True)]
        new = trained([s for part in samples for s in part], TOXIC_BYTES[-1], SEGMENT)
        kept = blanked(ordinary + toxic, new, rows)
        if not kept:
            toxic = toxic or new
            break
        toxic += kept
    return Gaps(ordinary, toxic)


def fit(rows: list[tuple[int, str, int]], totals: dict[int, int] | None = None) -> Model:
    """A model from (doc_id, text, label) rows; ``totals``: rows of each label that they were sampled from."""
    rows = sorted(rows)
    labels = [r[2] for r in rows]
    own = {v: labels.count(v) for v in (0, 1)}
    stands_for = {v: max(1.0, (totals or own).get(v, 0) / max(1, own[v])) for v in (0, 1)}
    whole = sum(own[v] * stands_for[v] for v in (0, 1))
    prior = own[1] * stands_for[1] / whole if whole else 0.0
    constant = Model(None, 0, [], min(prior, 0.49) if prior < 0.5 else max(prior, 0.51))
    if len(set(labels)) < 2:
        return constant
    order = sorted(rows, key=lambda r: zlib.crc32(b"order%d" % r[0]))
    fitting: list[tuple[int, str, int]] = []
    held: list[tuple[int, str, int]] = []
    trains = {0: 0, 1: 0}
    for r in order:
        if zlib.crc32(b"calibrate%d" % r[0]) % 3 == 0 or trains[r[2]] >= TRAIN_ROWS:
            held.append(r)
        else:
            fitting.append(r)
            trains[r[2]] += 1
    if any(len({r[2] for r in part}) < 2 for part in (held, fitting)):
        held = fitting = order  # too few rows of a class to set some aside
    toxic, ordinary = ([r[1] for r in fitting if r[2] == v] for v in (1, 0))
    if not any(t.split() for t in toxic):  # toxic rows without a word
        return constant
    gaps = train(toxic, ordinary)
    y = np.array([r[2] for r in held], float)
    mass = np.array([stands_for[r[2]] * (COST if r[2] else 1.0) for r in held])
    measured = [gaps.of(windows(r[1])) for r in held]
    best: tuple[float, Model] | None = None
    for threshold in GAPS:
        w, loss = logistic(np.array([features(g, threshold) for g in measured]), y, mass)
        if best is None or loss < best[0] - 1e-4:
            best = loss, Model(gaps, threshold, w.tolist(), prior)
    return best[1]  # type: ignore[index]


def crc_remainder(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the sample of labelled rows whose remainder is not 0."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_remainder(key) != 0))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}  # two rows
    order = F.xxhash64("_id")
    least = [known.filter(F.col("_label") == v).orderBy(order, "_id").limit(SAMPLE) for v in (0, 1)]
    picked = least[0].unionByName(least[1])
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")
    rows = rows.filter(F.col("_text").isNotNull() & (F.octet_length("_text") <= SAMPLE_BYTES))
    found = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()  # at most 2 * SAMPLE rows of SAMPLE_BYTES
    return fit([(int(r["_id"]), r["_text"], int(r["_label"])) for r in found], totals)


def toxicity_scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every row of ``docs``."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = sent.value.score
        for rows in batches:
            s = [score_of(x.as_py() or "") for x in rows.column(at)]
            yield batch(schema, [*(rows.column(i) for i in range(len(keep))), s, [int(x >= 0.5) for x in s]])

    at = keep.index(text) if text in keep else len(keep)
    return docs.select(*keep, *([] if text in keep else [F.col(text).alias("_scored")])).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity_scores(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")
