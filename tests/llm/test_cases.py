"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every stage and operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, license_scan, main_text, media, neighbours, toxicity, url_filter

from .test_corpus_operators import sentence

SF = "/root/testdata/sf0.001"
CLASHES = ("score", "predicted", "_SCORED", "_text_hash", "_kept_id", "_row_hash", "_marks", "_repeat_id", "_repeat_sub", "_mix_hash", "_mix_copies", "id", "text_hash", "rep")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(21)
    long = sentence(rng, 200_000)
    texts = [None, "", "one", "two words", long, long + " end", sentence(rng, 80), sentence(rng, 80), "é ß\x00 \u2028 😀" * 30]
    rows = [(i, t, "en", "s0" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[6], "en", "s1", 1), (None, texts[7], "en", "s1", 1), (None, None, None, None, None), (6, texts[7], "de", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHES))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert stage(spark, odd.limit(0), SF).count() == 0
    got = out.collect()
    if name == "bpe":
        assert len(got) == odd.count() and min(r["n_tokens"] for r in got) == 0
        return
    assert out.columns == odd.columns and all(r[c] == c for r in got for c in CLASHES)
    texts = [r["text"] for r in got]
    # the mix takes texts of size 0 as often as their source's whole rate says, which may be never
    assert name == "mixing" or (None in texts and "" in texts)
    if name == "toxicity":
        assert len(got) == odd.count()
    if name == "near_dedup":  # of the long text and its near copy one stays, and of each of the two others
        assert sum(len(t or "") > 100_000 for t in texts) == 1 and len(got) < odd.count()
    if name == "suffix_dedup":
        assert len(got) == odd.count() and sum(len(t or "") > 100_000 for t in texts) == 1
    if name == "mixing":
        assert len(got) > 0


def test_operators_on_empty_tables_and_long_texts(spark, odd):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("u://h").alias("url"), F.concat(F.lit("<p>"), F.col("text")).alias("html"), "score")
    runs = [
        lambda d, p: main_text.extract_main_text(p, ["page_id", "url"]),
        lambda d, p: url_filter.url_verdicts(p, "page_id"),
        lambda d, p: license_scan.license_scan(d),
        lambda d, p: bpe.encode_decode(d),
        lambda d, p: media.parse_sequences(p, "page_id"),
        lambda d, p: media.store_texts(d, "doc_id", "text"),
        lambda d, p: toxicity.toxicity_scores(d, toxicity.fit([]), ["doc_id"], score="s", predicted="p"),
    ]
    for run in runs:
        assert run(odd, pages).count() == odd.count()
        assert run(odd.limit(0), pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, h long, ids string")
    assert neighbours.search(vectors).count() == 0


def test_held_out_is_defined_for_missing_ids(spark):
    held = F.coalesce(toxicity.crc_remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    assert [r["held_out"] for r in spark.createDataFrame([(None,)], "doc_id long").select(held).collect()] == [False]
