"""URL filters: a trie over reversed host labels and then path segments, sent to every executor with
the task (its size is that of the rule list, which ``MAX_RULES`` bounds). The longest rule that fits wins.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host fits no
rule; of equal rules with two verdicts, block wins; two rules of equal length cannot both fit one url
unless they are equal. Only the url column and the caller's key are read, so that extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import batch, read, utf8

#: More rules than this are refused: the trie is sent to every task.
MAX_RULES = 1_000_000

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT_VERDICT = "allow"

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    end = min((i for i in (rest.find(b"/"), rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(b"?"), path.find(b"#")) if i >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


class Node:
    __slots__ = ("next", "path", "rule", "verdict", "tails")

    def __init__(self) -> None:
        self.next: dict[bytes, Node] = {}
        self.path: Node | None = None  # of a host node: the root of its paths
        self.rule: str | None = None
        self.verdict: str | None = None
        self.tails: list[tuple[bytes, Node]] = []  # rules that end within a segment


class Trie:
    """Host labels from the right, then path segments. A rule's last segment may be a part of the
    url's segment only, as a path rule is a plain prefix; such tails hang on the segment's parent."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root = Node()
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"over {MAX_RULES} url rules")
            node = self.root
            for label in reversed(host.encode().translate(LOWER).split(b".")):
                node = node.next.setdefault(label, Node())
            node.path = node.path or Node()
            node = node.path
            *segments, tail = path.encode().split(b"/")
            for segment in segments:
                node = node.next.setdefault(segment, Node())
            if tail:
                end = next((x for t, x in node.tails if t == tail), None)
                if end is None:
                    end = Node()
                    node.tails.append((tail, end))
                    node.tails.sort(key=lambda x: -len(x[0]))
                node = end
            if node.verdict != "block":
                node.rule, node.verdict = host + path, verdict

    def match(self, host: bytes, path: bytes) -> tuple[str, str] | None:
        """The longest rule (host and path together, in bytes) that fits, with its verdict."""
        best: Node | None = None
        longest = -1
        node = self.root
        segments = path.split(b"/")
        size = -1
        for label in reversed(host.split(b".")) if host else ():
            node = node.next.get(label)  # type: ignore[assignment]
            if node is None:
                break
            size += len(label) + 1
            if node.path is None:
                continue
            at, length = node.path, size
            for i, segment in enumerate(segments):
                if at.rule is not None and length > longest:
                    best, longest = at, length
                for tail, end in at.tails:
                    if segment.startswith(tail):
                        if length + len(tail) > longest:
                            best, longest = end, length + len(tail)
                        break
                if i == len(segments) - 1 or segment not in at.next:
                    break
                at = at.next[segment]
                length += len(segment) + 1
            else:
                continue
        return None if best is None else (best.rule, best.verdict)  # type: ignore[return-value]


def url_verdicts(df: DataFrame, key: str, url: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``key``, host, path, rule and verdict of every row of ``df``; see the module for its cases."""
    spark = df.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for rows in batches:
            split = [split_url(u) for u in utf8(rows.column(1))]
            found = [match(h, p) for h, p in split]
            yield batch(schema, [rows.column(0), [h.decode() for h, _ in split], [p.decode() for _, p in split], [f and f[0] for f in found], [f[1] if f else default for f in found]])

    return df.select(key, url).mapInArrow(judge, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), "page_id")


_HOST = r"coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '')"

OP6_SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN {_HOST} ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN {_PATH} ELSE '' END AS path
  FROM pages
),
best AS (
  SELECT row_no, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY row_no
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict
FROM parts LEFT JOIN best USING (row_no)
"""
