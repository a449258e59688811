"""A corpus pipeline of five stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm import jaccard, linedup, packing, secrets, toxicity
from tidegrid.llm.common import stash, text_of
from tidegrid.llm.queries import held_out, table, vocabulary

#: Texts that score this or more go; the rows with the labels of the held-out quarter are never learned from.
TOXIC = 0.3


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents again, n_chars of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")))
    return docs.select(like.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.reject(docs, model, TOXIC)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from every text."""
    return _columns(linedup.dedup_lines(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return jaccard.keep_one(docs).select(docs.columns)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return _columns(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are packed into sequences, mixed by source; a row per piece."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), digests=True)


STAGES = [("toxicity", toxic), ("lines", lines), ("near", near), ("secrets", secret), ("packing", pack)]

#: SQL cannot express the toxicity, near-duplicate and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
