"""BPE encoding and decoding with a word-end vocabulary file of the tokenizers library.

A text is normalised (NFC, white space to one space, lower case), cut into words, and each word goes
through the merges: its symbols form a doubly linked list, the adjacent pairs wait in a
priority queue of merge ranks, and entries whose symbols have changed meanwhile are skipped as stale.
A worker keeps the runs it has seen in a table of bounded size. Decoding concatenates vocabulary
strings; this file names no decoder, so the library joins them by single spaces, and so do we.

Defined cases: a null or empty text has no tokens and decodes to the empty string; the strings of
special tokens within a text become their ids, as in the library; a symbol that the vocabulary lacks
is dropped (no unknown token is set).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import batch, read

#: Runs without white space that a worker remembers, twice (the table that is full becomes the older one), and words; longer
#: ones than so many characters are merged anew each time, so that the tables are bounded in bytes too.
CACHE_CHUNKS, CACHED_CHARS = 200_000, 64

#: Bits of a symbol's id within a pair, and of a symbol's place within a queue entry.
SHIFT, PLACES = 20, 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1,
    else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordBPE:
    """The model in a tokenizer file: vocabulary, merge ranks, word pattern and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (*self.vocab.items(), *self.special.items())}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << SHIFT | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.recent: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> list[int]:
        """The ids of one word. A queue entry is a rank and the place of the pair's left symbol in one
        number; it is stale if the pair now at that place has another rank."""
        symbols = self.symbols
        text = [symbols[b] for b in word.encode("utf-8")]
        if text:
            text[-1] += self.end
        vocab = self.vocab
        ids = [vocab[s] for s in text if s in vocab]
        n = len(ids)
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, made = self.ranks, self.made
        queue = []
        for i in range(n - 1):
            rank = ranks.get(ids[i] << SHIFT | ids[i + 1])
            if rank is not None:
                queue.append(rank << PLACES | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & (1 << PLACES) - 1, entry >> PLACES
            j = right[i]
            if j < 0 or ids[i] < 0 or ranks.get(ids[i] << SHIFT | ids[j]) != rank:
                continue
            ids[i], ids[j] = new, _ = made[rank], -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                rank = ranks.get(new << SHIFT | ids[k])
                if rank is not None:
                    heapq.heappush(queue, rank << PLACES | i)
            if (h := left[i]) >= 0:
                rank = ranks.get(ids[h] << SHIFT | new)
                if rank is not None:
                    heapq.heappush(queue, rank << PLACES | h)
        return [x for x in ids if x >= 0]

    def chunk(self, chunk: str) -> tuple[str, str]:
        """The ids of a run without white space, as decimals, and its decoded form."""
        ids: list[int] = []
        for part in self.marks.split(chunk) if self.marks and "<|" in chunk else (chunk,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self.words.findall(lower(part if part.isascii() else unicodedata.normalize("NFC", part))):
                found = self.known.get(word)
                if found is None:
                    if len(self.known) >= CACHE_CHUNKS:
                        self.known.clear()
                    found = tuple(self.merge(word))
                    if len(word) <= CACHED_CHARS:
                        self.known[word] = found
                ids += found
        return " ".join(map(str, ids)), self.decode(ids)

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """chunk() of each run without white space, in order; no merge and no normal form crosses white space."""
        # str.split() also cuts at these four control characters, which are no white space here
        chunks = SPACES.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        recent, older = self.recent, self.older
        out = []
        for c in chunks:
            found = recent.get(c)
            if found is None:
                found = older.get(c)
                if found is None:
                    found = self.chunk(c)
                if len(c) <= CACHED_CHARS:
                    recent[c] = found
                if len(recent) >= CACHE_CHUNKS:
                    older = self.older = recent
                    recent = self.recent = {}
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) if ids for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


SPACES = regex.compile(r"\s+")


def lower(text: str) -> str:
    """Lower case character by character, without rules that look at neighbours (final sigma)."""
    return text.lower() if "Σ" not in text else "Σ".lower().join(p.lower() for p in text.split("Σ"))


_MODELS: dict[str, WordBPE] = {}


def model(path: str) -> WordBPE:
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256 of every row; with ``ids``, also the ids themselves
    and the decoded text. ``path``: the tokenizer file, which every executor has at the same place."""
    path = path or default_path()
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if ids else []
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        sha = hashlib.sha256
        for rows in batches:
            n, a, b, c, d = [], [], [], [], []
            for value in rows.column(1):
                found = bpe.pieces(value.as_py() or "")
                said = " ".join([x[0] for x in found if x[0]])
                decoded = " ".join([x[1] for x in found if x[0]])
                n.append(said.count(" ") + 1 if said else 0)
                a.append(sha(said.encode()).hexdigest())
                b.append(sha(decoded.encode()).hexdigest())
                if ids:
                    c.append([int(x) for x in said.split(" ")] if said else [])
                    d.append(decoded)
            yield batch(schema, [rows.column(0), n, a, b, *([c, d] if ids else [])])

    return df.select(key, text).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"))
