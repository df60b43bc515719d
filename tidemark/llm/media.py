"""Media columns: interleaved document sequences.

``parse_sequences`` turns HTML into the ordered items of a document: text structs and media-reference
structs (digest, caption), each with its position. ``resolve_media`` joins the references with a store
of payloads by digest; every item keeps its position and caption, and references that the store lacks
keep a null payload. A store holds a payload once for each digest, so that copies cost nothing; the
references of a hot digest are spread by the engine's skew join, as both sides are written tables.

``png_encode`` stores bytes losslessly as 8-bit grey samples, 192 to a line, in a PNG whose text chunk
holds the unpadded length; ``png_decode`` reads them back and checks every chunk.

Defined cases: null text or html is empty; an empty payload is one line of spaces; a figure without a
caption has a null caption; an image whose source is no digest stays a media item with a null digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, read, utf8, written

#: Samples of a line.
LINE = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PREFIX = "sha256:"

ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])
FEATURES = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of LINE."""
    return data + b" " * (-len(data) % LINE if data else LINE)


def png_encode(data: bytes) -> bytes:
    payload = pad(data)
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def png_decode(media: bytes) -> tuple[np.ndarray, int]:
    """The lines of samples, and the unpadded length."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, body, n, shape = 8, [], 0, (0, 0)
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey PNG without interlace")
            shape = (height, width)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n = int(data[8:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter that the encoder never uses")
    return lines[:, 1:], n


def describe(lines: np.ndarray) -> str:
    """Mean and entropy of the samples, and an average hash over a grid of 8 by 8 cells."""
    counts = np.bincount(lines.reshape(-1), minlength=256)
    share = counts[counts > 0] / lines.size
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    edges = np.linspace(0, len(lines), 9).astype(int)
    columns = lines.reshape(len(lines), 8, -1).sum(axis=2, dtype=np.int64)
    total = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    heights = np.maximum(1, np.diff(edges))[:, None]
    cells = (total[edges[1:]] - total[edges[:-1]]) / (heights * (LINE // 8))
    mean = float(lines.mean())
    bits = "".join("1" if x else "0" for x in (cells > mean).reshape(-1))
    return f"mean={mean:.4f};entropy={entropy:.4f};hash={int(bits, 2):016x}"


class Items(HTMLParser):
    """The ordered items of a page; a figure's caption belongs to its image."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.unseen = 0
        self.figure: int | None = None  # the first of its items
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, **more: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "digest": None, "caption": None} | more)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.unseen += 1
        elif tag in ("img", "audio", "video"):
            self.flush()
            named = dict(attrs)
            src = named.get("src") or ""
            self.add(tag if tag != "img" else "image", digest=src.removeprefix(PREFIX) if src.startswith(PREFIX) else None, caption=named.get("alt"))
        elif tag == "figure":
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "article", "section", "br"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.unseen = max(0, self.unseen - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :] if self.figure is not None else ():
                if item["kind"] != "text":
                    item["caption"] = said
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "article", "section"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        (self.text if self.caption is None else self.caption).append(data)

    def close(self) -> None:
        super().close()
        if self.caption:
            self.handle_endtag("figcaption")
        self.flush()


def items_of(html: str) -> list[dict]:
    parser = Items()
    parser.feed(html)
    parser.close()
    return parser.items


def parse_sequences(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key`` and ``items``, the ordered array of text and media structs."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("items", T.ArrayType(ITEM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(schema, [rows.column(0), [items_of(x.as_py() or "") for x in rows.column(1)]])

    return df.select(key, html).mapInArrow(run, schema)


def resolve_media(sequences: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """One row for each media item: ``key``, position, kind, caption, digest and the store's columns.
    ``store`` has one row for each digest."""
    items = sequences.select(key, F.explode("items").alias("_item")).filter("_item.kind <> 'text'")
    refs = items.select(key, *(F.col(f"_item.{c}").alias(c) for c in ("position", "kind", "caption", "digest")))
    return refs.join(store, "digest", "left")


def store_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the html of a document that shows its text as an image, and the image with its digest."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            media = [png_encode(t) for t in utf8(rows.column(1))]
            digests = [hashlib.sha256(m).hexdigest() for m in media]
            html = [f'<article><p>Document {k}</p><figure><img src="{PREFIX}{d}"><figcaption>Text of document {k}</figcaption></figure></article>' for k, d in zip(rows.column(0).to_pylist(), digests, strict=True)]
            yield batch(schema, [rows.column(0), html, digests, media])

    return df.select(key, text).mapInArrow(run, schema)


def media_features(stored: DataFrame) -> DataFrame:
    """The stored bytes read back: one row of features for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for digest, media in zip(rows.column(0).to_pylist(), utf8(rows.column(1)), strict=True):
                if (found := hashlib.sha256(media).hexdigest()) != digest:
                    raise ValueError(f"media {digest} is damaged")
                lines, n = png_decode(media)
                payload = lines.tobytes()
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), found, describe(lines)))
            yield batch(FEATURES, [[r[i] for r in out] for i in range(len(FEATURES))])

    each = stored.select("digest", "media").mapInArrow(run, FEATURES)
    return each.groupBy("digest").agg(*(F.first(c).alias(c) for c in FEATURES.names[1:]))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store_texts(read(spark, sf_dir, "documents"), "doc_id", "text"), "media")
    store = written(media_features(stored), "media-features")
    found = resolve_media(parse_sequences(stored, "doc_id"), store, "doc_id")
    return found.select("doc_id", *FEATURES.names[1:], "position", "kind", "caption")
