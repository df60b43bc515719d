"""The corpus pipeline: documents in, token digests out.

Each stage works on all that its predecessor kept. The first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.bpe import encode_decode
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.repeats import without_repeats
from tidemark.llm.toxicity import learn, toxicity_scores

#: Fitted models, hashes of sets and suffix buckets are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts score as documents without toxic windows; null and repeated ids are scored by their own text and
    stay or go one by one; an empty table gives an empty one; columns of any name stay as they are.
    """
    labels = common.read(spark, sf_dir, "labels")
    score, predicted = common.fresh(docs, "score", "predicted")
    scored = toxicity_scores(docs, learn(docs, labels), docs.columns, score=score, predicted=predicted)
    return scored.filter(F.col(predicted) == 0).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8), and one of equal rows.

    Of a group the smallest id stays, rows without an id being the last and ties going to the least text hash. Null and
    empty texts are groups of their own; several texts under one id, or under none, are several documents; an empty table
    gives an empty one; columns of any name stay as they are.
    """
    common.prepare(spark)
    row_hash, kept_id, kept_hash, kept_none = common.fresh(docs, "_row_hash", "_kept_id", "_kept_hash", "_kept_none")
    found = near_duplicates(docs, size=5, percent=80).filter("leads")
    kept = found.select(F.col("id").alias(kept_id), F.col("text_hash").alias(kept_hash), F.col("id").isNull().alias(kept_none)).distinct()
    keyed = docs.withColumn(row_hash, F.xxhash64("text"))
    # a missing id is looked up by the text alone
    met = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.coalesce(F.col(kept_id), F.lit(0))) & (F.col("doc_id").isNull() == F.col(kept_none)) & (F.col(row_hash) == F.col(kept_hash))
    return keyed.join(kept, met, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier are cut from the texts.

    Null and short texts stay as they are; earlier are smaller ids, missing ones last, then lesser text hashes; several texts
    under one id are several documents and equal rows are one; an empty table gives an empty one; columns of any name stay.
    """
    common.prepare(spark)
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document comes as often as the mix takes it.

    Null and empty texts have size 0: they take no words, and come as often as their source's whole rate says. A null source is
    one of its own; several texts under one id are several documents, rows equal in both get one number of copies; an
    empty table gives an empty one; columns of any name stay as they are.
    """
    common.prepare(spark)
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row for each row: null and empty texts have no tokens, repeated rows
    repeat their result, an empty table gives none, and columns besides doc_id and text are dropped."""
    common.prepare(spark)
    return encode_decode(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
