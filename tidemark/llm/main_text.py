"""HTML extraction by two passes of block rules.

Pass one looks at a block alone: its link density, its length and the density of stop words make it
good or bad, or leave it undecided ("short" or "near"). Pass two gives an undecided block the label of
its nearest decided neighbours; if the two sides differ, the nearer one decides, and at equal distance
a "near" block is good and a "short" one bad. The container is context only:

* what stands in a menu, page header, footer, sidebar, advert, control or comment list is bad from the start and is
  nobody's neighbour. An element is one by its tag, or by a class, id or role that says nothing else ("comment-list",
  "ad-slot-3", not "social-history");
* a form, or an element one of whose names only mentions such a thing, is one unless pass one calls the greater part of
  its text good and that is ``PROSE`` characters or more: forms around a whole page, articles about adverts;
* an article or main element is a prior: it makes pass one milder by a class within it, its edges count as good neighbours
  within and as bad ones outside, and it moves the balance between two different neighbours by one block. What pass one
  calls good stays good outside too, and an article with less text than that is no prior.

Defined cases: null or empty html gives the empty text; unclosed tags end with their container, an unclosed head with
the first element or text of the body; a page without any container is judged by the block rules alone; a page whose
blocks all stay undecided keeps them. Rows are judged one by one, so that repeated ones, ties and an empty table need no
rule; only the html column and the caller's keys are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import batch, read

#: Thresholds of the block rules: characters, and shares of words or characters.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINK_HIGH = 0.33
#: Characters of good text that make a form or a named element content.
PROSE = 400

#: Frequent function words.
STOP_WORDS = {
    "en": "the of and a in to is it that for was on are with as be by at this have from or an not they his her you he she we but which has had its were been their will would there what all can if more when who so no out up into than them then some could these two may other do any my now such like our over me even most",
    "de": "der die das und in zu den mit von ist des für auf im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich",
    "fr": "le la les de des du et en un une est que qui dans pour pas par sur au aux avec ce ces il elle ils elles on ne se sa son ses plus ou mais nous vous leur leurs être été sont était cette comme tout fait deux même aussi bien sans",
    "es": "de la el que en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros es son era fue ser",
}
ALL_STOP_WORDS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never shown as text.
UNSEEN = frozenset("script style noscript template title svg math iframe object canvas audio video".split())
#: Elements that hold controls, menus and what surrounds an article.
AROUND = frozenset("nav footer aside menu dialog button select textarea label fieldset header".split())
#: Elements that do not end an open head.
HEADS = frozenset("head title base link meta script style noscript template".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A block element that closes an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "head", "title"}

#: Words in a class, id or role that mark what surrounds an article, and words that say nothing beside them.
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promotions banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav footer masthead header topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommend recommended recommendation recommendations widget comment comments commentlist respond replies disqus pagination pager toolbar complementary contentinfo search searchbox skip copyright legal disclaimer".split()
)
PLAIN_NAMES = frozenset("site page top bottom left right main global primary secondary post posts article articles story stories entry item items list box block slot unit area section content contents wrap wrapper container inner outer row col column bar panel link links icon icons button buttons btn text title heading form side body group policy message msg us up in to the and by of more js bg mobile desktop fixed sticky hidden small large wide full".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Of these an article element itself can be one, as comments and teasers often are.
AROUND_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser widget".split())
#: A name that begins so tells what an element has or lacks, not what it is.
ABOUT = frozenset("has with without no is not".split())
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("parts", "linked", "heading", "article", "around", "suspects", "label")

    def __init__(self, heading: bool, article: bool, around: bool, suspects: tuple[int, ...]) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.heading, self.article, self.around, self.suspects = heading, article, around, suspects
        self.label = ""

    @property
    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


class Blocks(HTMLParser):
    """Cuts a page into blocks, each with its link characters and its context."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Block] = []
        self.open: list[tuple[str, str]] = []  # element, and what it opens: unseen, around, suspect, article or nothing
        self.depth = {"unseen": 0, "around": 0, "suspect": 0, "article": 0, "a": 0, "heading": 0}
        self.suspects: list[int] = []
        self.n_suspects = 0
        self.in_head = False
        self.block: Block | None = None

    def named(self, name: str) -> str:
        """What a class, id or role makes of its element."""
        parts = [x.lower() for x in NAME_PART.findall(name)]
        if not parts or parts[0] in ABOUT or not AROUND_NAMES.intersection(parts):
            return ""
        if self.depth["article"] and parts[-1] == "header":
            return ""
        return "around" if all(x in AROUND_NAMES or x in PLAIN_NAMES or x.isdigit() for x in parts) else "suspect"

    def enter(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in UNSEEN:
            return "unseen"
        named = {k: v or "" for k, v in attrs}
        if "hidden" in named or HIDDEN_STYLE.search(named.get("style", "")) or named.get("aria-hidden") == "true":
            return "unseen"
        if tag == "header" and self.depth["article"]:
            return ""
        if tag in AROUND:
            return "around"
        names = [n for k in ("class", "id", "role") for n in named.get(k, "").split()]
        if tag in ARTICLE:
            told = [{x.lower() for x in NAME_PART.findall(n)} for n in names if n.lower().split("-")[0].split("_")[0] not in ABOUT]
            return "around" if any(AROUND_ARTICLES & parts for parts in told) else "article"
        if tag not in ("body", "html"):
            kinds = {self.named(n) for n in names} | ({"suspect"} if tag == "form" else set())
            for kind in ("around", "suspect"):
                if kind in kinds:
                    return kind
        return "heading" if tag in HEADINGS else "a" if tag == "a" else ""

    def opened(self, kind: str) -> None:
        self.depth[kind] += 1
        if kind == "suspect":
            self.suspects.append(self.n_suspects)
            self.n_suspects += 1

    def closed(self, kind: str) -> None:
        self.depth[kind] -= 1
        if kind == "suspect":
            self.suspects.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.in_head and tag not in HEADS:
            self.end("title", frozenset())  # also one that was never closed
            self.end("head", frozenset())
            self.in_head = False
        if tag == "head":
            self.in_head = True
        if tag == "br":
            self.handle_data("\n")
            return
        if tag in ENDS_P:
            self.end("p", BLOCKS - {"p"})
        if tag in BLOCKS:
            self.block = None
        if tag in VOID:
            return
        if tag == "li":
            self.end("li", frozenset(("ul", "ol", "menu")))
        kind = self.enter(tag, attrs)
        self.open.append((tag, kind))
        if kind:
            self.opened(kind)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style"):
            self.handle_endtag(tag)

    def end(self, tag: str, until: frozenset[str]) -> None:
        """End the innermost open ``tag`` and all within it, unless one of ``until`` is opened within."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                for _, kind in reversed(self.open[i:]):
                    if kind:
                        self.closed(kind)
                del self.open[i:]
                return
            if name in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block = None
        if tag == "head":
            self.in_head = False
        # an inline end tag does not reach out of its block
        self.end(tag, frozenset() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data: str) -> None:
        depth = self.depth
        if depth["unseen"]:
            return
        if self.block is None:
            if not data.strip():
                return
            self.block = Block(depth["heading"] > 0, depth["article"] > 0, depth["around"] > 0, tuple(self.suspects))
            self.found.append(self.block)
        self.block.parts.append(data)
        if depth["a"]:
            self.block.linked += len(data.strip())


def first_pass(block: Block, text: str) -> str:
    """good, bad, near or short."""
    if block.around:
        return "bad"
    links = block.linked / max(1, len(text))
    if links > LINK_HIGH and not (block.article and block.heading):
        return "bad"
    if len(text) < LENGTH_LOW:
        return "short"
    words = TOKEN.findall(text.lower())
    stop = sum(w in ALL_STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH:
        return "good" if len(text) > LENGTH_HIGH or block.article else "near"
    if stop >= STOP_LOW:
        return "near"
    return "near" if block.article else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours in the same kind of container. On a
    page with an article the container's edge is a neighbour too, good for an article's blocks and bad for others."""
    n = len(blocks)
    named = any(b.article for b in blocks)
    some_good = any(b.label == "good" for b in blocks)

    def nearest(order: range) -> list[tuple[int, str]]:
        """Of each block the distance and label of the last decided one in this order."""
        out: list[tuple[int, str]] = [(0, "")] * n
        last, previous = (0, ""), None
        for i in order:
            b = blocks[i]
            if previous is None or b.article != previous.article:
                last = (0, ("good" if b.article else "bad") if named else "")
            last = (last[0] + 1, last[1])
            out[i] = last
            if b.label in ("good", "bad"):
                last = (0, b.label)
            previous = b
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    labels = []
    for b, (d0, left), (d1, right) in zip(blocks, before, after, strict=True):
        if b.label in ("good", "bad"):
            labels.append(b.label)
        elif not left and not right:
            labels.append("bad" if some_good else "good")
        elif left == right or not left or not right:
            labels.append(left or right)
        else:
            # the container moves the balance by one block
            balance = (d1 - d0 if left == "good" else d0 - d1) + ((1 if b.article else -1) if named else 0)
            fine = balance > 0 or (balance == 0 and b.label == "near") or (b.heading and (b.article or not named))
            labels.append("good" if fine else "bad")
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def settle_suspects(texts: list[tuple[Block, str]]) -> None:
    """Forms and elements that a name makes suspect surround the content unless most of their text is good."""
    size: dict[int, int] = {}
    good: dict[int, int] = {}
    for b, t in texts:
        if b.suspects and not b.around:
            # a name does not tell: the block must stand by its own text
            fine = Block(b.heading, False, False, ())
            fine.linked = b.linked
            for k in b.suspects:
                size[k] = size.get(k, 0) + len(t)
                good[k] = good.get(k, 0) + (len(t) if first_pass(fine, t) == "good" else 0)
    for b, _ in texts:
        b.around = b.around or any(good[k] < PROSE or 2 * good[k] <= size[k] for k in b.suspects)


def main_blocks(html: str) -> list[str]:
    """The texts of a page's good blocks, in page order."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    texts = [(b, t) for b in parser.found if (t := b.text)]
    settle_suspects(texts)
    blocks = [b for b, _ in texts]
    for b, t in texts:
        b.label = first_pass(b, t)
    inside = sum(len(t) for b, t in texts if b.article and b.label != "bad")
    if inside < sum(len(t) for b, t in texts if not b.article and b.label == "good"):
        for b, t in texts:  # more prose stands outside: the article is a card or a teaser, and tells nothing
            b.article = False
            b.label = first_pass(b, t)
    second_pass([b for b in blocks if not b.around])  # what stands around the content is nobody's neighbour
    return [t for b, t in texts if b.label == "good"]


def extract_main_text(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``keys``, text and n_chars of every row of ``df``."""
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = ["\n".join(main_blocks(x.as_py() or "")) for x in rows.column(len(keys))]
            yield batch(schema, [*(rows.column(i) for i in range(len(keys))), texts, [len(t) for t in texts]])

    return df.select(*keys, html).mapInArrow(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"), ["page_id", "url"])
