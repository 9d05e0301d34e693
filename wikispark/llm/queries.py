"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wikispark.llm import bpe, extract, langid, lm, merkle, mixing, nearest, phrases, quality, simhash, spelling, topk, warc
from wikispark.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.groups(table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_predict(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.cut(table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_main_text": op2_main_text,
        "op3_topk": op3_topk,
        "op4_mix_sources": op4_mix_sources,
        "op5_simhash_groups": op5_simhash_groups,
        "op6_language": op6_language,
        "op7_bpe": op7_bpe,
        "op8_quality": op8_quality,
        "op9_kneser_ney": op9_kneser_ney,
        "op10_nearest": op10_nearest,
        "op11_phrases": op11_phrases,
        "op12_merkle": op12_merkle,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.WARC_SQL,
        "op3_topk": topk.TOPK_SQL,
        "op10_nearest": nearest.NEAREST_SQL,
        "op11_phrases": phrases.PHRASES_SQL,
        "op13_spelling": spelling.VARIANTS_SQL,
        "op12_merkle": merkle.MERKLE_SQL,
        "op4_mix_sources": mixing.MIX_SQL.format(documents="documents"),
    }
