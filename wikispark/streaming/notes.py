"""The row-level operators take streams as they take tables: notes as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikispark.operators.atoms import extract_atoms
from wikispark.operators.notes import chunk, detect_formulas
from wikispark.sources.readers import source_name


def stream_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, content) of note files as they arrive."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{md,txt}").load(folder)
    return rows.select(source_name(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("source_id"), F.col("value").alias("content"))


def stream_atoms(sources: DataFrame) -> DataFrame:
    return extract_atoms(chunk(sources))


def stream_formulas(sources: DataFrame) -> DataFrame:
    return detect_formulas(sources)
