"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all that the one before it kept, whatever its size.
Stages that drop rows number them first, so repeated and null ids are rows
like others; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm import jaccard, mixing, radix_dedup, sentencepiece_codec, toxicity
from passagekit.llm.common import cut, documents, read, release, scratch


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learnt from ``labels``, does not reject."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document, that with the largest id."""
    return radix_dedup.dedup(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) one document, that with the smallest id."""
    return jaccard.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, the last one cut where the budget ends."""
    return mixing.mixed(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to, as digests."""
    found = sentencepiece_codec.encode(docs, sentencepiece_codec.default_model())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near dedup", apart), ("mixing", mixed), ("sentencepiece", coded)]

#: SQL cannot express the classifier or the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes for itself, and the table before it, are deleted once its own table is written."""
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch():
            found = stage(spark, before, sf_dir)
            docs = cut(found, f"stage-{name.replace(' ', '-')}", keep=True)
        if n:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
