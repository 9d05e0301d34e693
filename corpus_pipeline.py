"""A corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wikispark.llm import bpe, langid, mixing, neardup, quality, simhash
from wikispark.llm.common import materialise, row_bucket, table
from wikispark.llm.queries import vocabulary


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without an identifiable language go."""
    model = langid.train(docs.where(row_bucket("doc_id", 5) != 0), vocabulary("piece_bpe_32k.model"))
    return langid.keep_identified(docs, model)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents below the threshold go. It learns from labelled documents of this stage's input."""
    labels = table(spark, sf_dir, "labels")
    seen = row_bucket("doc_id", 4) != 2
    return quality.keep_good(docs, quality.train(docs.where(seen), labels.where(seen)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup by SimHash: one document stays of each group linked by fingerprints within two bits (op5's ball hashing) or, since
    near copies reach more bits than a ball can have, by five-word shingles of Jaccard similarity 0.8 or more."""
    return simhash.keep_least(docs, neardup.joined(simhash.groups(docs), neardup.groups(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the tokenised corpus, ids of every document's text as 32-bit integers, with digests of them and of what they decode to."""
    return bpe.digest(bpe.encode(docs, vocabulary()), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("quality", filter_quality),
    ("near_dedup", deduplicate),
    ("mix", mix),
    ("bpe", encode),
]
ORACLE_SQL = None  # the first two stages are learned models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
