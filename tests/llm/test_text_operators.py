import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, license_scan, main_text, media, url_filter
from tidemark.llm.queries import ORACLES, QUERIES

from ..oracle import compare

SF = "/root/testdata/sf0.001"
ODD = ["", "   ", None, "Hello  WORLD's 123 été <|endoftext|> x\n\ny %%% a!!b 你好 İ don't\x00\x1f\x85z ﬁ é", "ΑΣ ΣΑΣ <|x <|startoftext|><|endoftext|>a", "a" * 5000, " x y​z\x1c\x1d q"]


def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, media string, n_chars long")  # extra columns with clashing names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA \n'sétT漢Σςİ<|endoftext>1½²́\x1c\x00ﬃ", max_size=60))
def test_bpe_equals_the_library(text):
    library = Tokenizer.from_file(bpe.default_path())
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.model(bpe.default_path())
    assert own.encode(text) == ids and " ".join(d for i, d in own.pieces(text) if i) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    library = Tokenizer.from_file(bpe.default_path())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = bpe.encode_decode(docs(spark, texts), ids=True).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids"] == ids and r["decoded"] == decoded
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, ["x"]).limit(0)).count() == 0


def test_media_round_trip(spark, tmp_path):
    texts = [*ODD, "x" * 192, "x" * 193, "same", "same", "same "]
    folder = tmp_path / "sf"
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in media.op1_media_columns(spark, str(folder)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["media_bytes"] == len(media.png_encode(data)) and r["caption"] == f"Text of document {i}"
    same = [tuple(got[i])[1:9] for i in range(len(texts)) if texts[i] == "same"]
    assert same[0] == same[1]


def test_items_stay_aligned(spark):
    html = '<p>one &amp; two<figure><img src="sha256:aa"><figcaption>cap  A</figcaption></figure>tail<img src="x.png" alt="alt"><script>no</script>'
    items = media.items_of(html)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "one & two", None, None), (1, "image", None, "aa", "cap A"), (2, "text", "tail", None, None), (3, "image", None, None, "alt")]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = media.resolve_media(media.parse_sequences(pages, "page_id"), store, "page_id").orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["caption"], r["size"]) for r in got] == [(1, 1, "cap A", 7), (1, 3, "alt", None)]


def test_damaged_media_is_refused():
    m = bytearray(media.png_encode(b"text"))
    m[-20] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(m))


ARTICLE = "The cat sat on the mat and it was the best of all the days that we have had for a very long time in this town, and that is what they said to us when we came by."


def test_main_text_without_an_article_element():
    page = f'<html><body><div id="menu"><a href=x>Home</a> <a>News</a></div><div class="post"><h1>Big title</h1><p>{ARTICLE}<p>Short one.<p>{ARTICLE}</div><aside><p>{ARTICLE}</aside><form><label>Name</label></form><div class="comments"><p>{ARTICLE}</div><footer>{ARTICLE}</footer></body></html>'
    assert main_text.main_blocks(page) == ["Big title", ARTICLE, "Short one.", ARTICLE]


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><h1>A&amp;B</h1><p>x\n  y<br>z<p>&eacute;<div class='ad'>buy</div></article><nav><a>n</a></nav>"), (2, None, None), (3, "u", ""), (4, "u", "<p>just some short words")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text.extract_main_text(pages, ["page_id", "url"]).collect()}
    assert got == {1: ("A&B\nx y z\né", 11), 2: ("", 0), 3: ("", 0), 4: ("just some short words", 21)}


def test_main_text_of_the_given_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:h1|p)[^>]*>", inner)]
        assert main_text.main_blocks(r["html"]) == [b for b in blocks if b]


def judge(url, rules):
    """The rules by their definition, one after another."""
    host, path = ("", "") if url is None or "://" not in url else re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len((h + p).encode()), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="orgcmexaple.:/?#EN1fd", max_size=30).map(lambda s: "http://" + s))
def test_trie_equals_a_scan_of_the_rules(url):
    rules = [*url_filter.RULES, ("block", "com", ""), ("allow", "example.com", "/f"), ("block", "example.com", "/f/"), ("allow", "org", "/e"), ("block", "m.org", "/e/1/")]
    trie = url_filter.Trie(rules)
    host, path = url_filter.split_url(url.encode())
    found = trie.match(host, path)
    assert (host.decode(), path.decode(), *(found or (None, "allow"))) == judge(url, rules)


def test_url_rows(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?x", "https://example.org/es/", "x://b.com/de/1#f", "http://com/fr/", "http://example.org"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df, "page_id").collect()}
    assert got == {i: judge(u, url_filter.RULES) for i, u in enumerate(urls)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def test_license_rows(spark):
    rng = random.Random(2)
    vocabulary = "mit license apache general public the of é 1 x".split()
    texts = [*ODD, license_scan.TEMPLATES["apache"], "xx " + license_scan.TEMPLATES["bsd"][:300], *(rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=80)) for _ in range(60))]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, texts), spans=True).collect()}
    for i, t in enumerate(texts):
        n, found = places(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None)) and 0 <= r["score"] <= 1
    assert got[len(ODD)]["labels"] == "apache" and got[len(ODD) + 1]["labels"] == "bsd" and got[len(ODD) + 1]["spans"][0]["first"] == 1


def test_matching_statistics_by_brute_force():
    texts = [[1, 2, 3, 1, 2], [2, 3, 2, 3, 4], [1, 2]]
    sam = license_scan.Automaton(texts)
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for s in subs:
        state = 0
        for w in s:
            state = sam.next[state][w]
        ends = [(k, j - 1) for k, t in enumerate(texts) for j in range(len(s), len(t) + 1) if tuple(t[j - len(s) : j]) == s]
        assert sam.ends[state] == ends


def test_every_query_has_all_rows(spark):
    for name, table in (("op2_html_extraction", "pages"), ("op7_license_scan", "documents"), ("op3_bpe", "documents")):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert QUERIES["op7_license_scan"](spark, SF).filter(F.col("score").isNull()).count() == 0
