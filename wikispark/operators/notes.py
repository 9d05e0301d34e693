"""Notes as lines and chunks: formula detection, correction batches, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import text as X


def lines(sources: DataFrame) -> DataFrame:
    """(source_id, line_no from 1, text)."""
    return sources.select("source_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select("source_id", (F.col("pos") + 1).alias("line_no"), "text")


def detect_formulas(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, text, reason, matches): lines with a formula outside mark-up, by the first reason that holds."""
    found = lines(sources).withColumn("reason", X.formula_reason(F.col("text"))).where(F.col("reason").isNotNull())
    return found.withColumn("matches", F.when(F.col("reason") == "chemical_formula", X.chem_matches(F.col("text"))))


def assign_batches(df: DataFrame, size: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """+ batch_no, batch_pos: runs of `size` rows in order, within each value of `by`."""
    n = F.row_number().over(W.partitionBy(*(by or [])).orderBy(*order)) - 1
    return df.withColumn("batch_no", F.floor(n / size).cast("int")).withColumn("batch_pos", (n % size).cast("int"))


def clean_fix(c: Column) -> Column:
    """A returned line without its number; null if nothing is left."""
    return X.non_empty(F.trim(F.regexp_replace(c, r"^[0-9]+\.\s*", "")))


def apply_line_fixes(sources: DataFrame, candidates: DataFrame, fixes: DataFrame) -> DataFrame:
    """(source_id, content, fixed): candidates(source_id, line_no, batch_no, batch_pos) and fixes(source_id, batch_no, returned array).

    A batch counts only if it returned as many lines as were sent; a line changes only if its fix is new and not empty.
    """
    cleaned = fixes.select("source_id", "batch_no", F.array_compact(F.transform("returned", clean_fix)).alias("returned"))
    sent = candidates.groupBy("source_id", "batch_no").agg(F.count("*").alias("sent"))
    good = cleaned.join(sent, ["source_id", "batch_no"]).where(F.size("returned") == F.col("sent"))
    fixed = candidates.join(good, ["source_id", "batch_no"]).select("source_id", "line_no", F.col("returned")[F.col("batch_pos")].alias("fix"))
    own = lines(sources).join(fixed, ["source_id", "line_no"], "left")
    changed = F.col("fix").isNotNull() & (F.col("fix") != F.col("text"))
    whole = F.sort_array(F.collect_list(F.struct("line_no", F.when(changed, F.col("fix")).otherwise(F.col("text")).alias("t"))))
    return own.groupBy("source_id").agg(F.array_join(F.transform(whole, lambda x: x["t"]), "\n").alias("content"), F.sum(changed.cast("long")).alias("fixed"))


def formula_totals(candidates: DataFrame, fixed: DataFrame) -> DataFrame:
    """(source_id, candidates, fixed, changed) and the grand total under a null source_id."""
    per = candidates.groupBy("source_id").agg(F.count("*").alias("n")).join(fixed.select("source_id", "fixed"), "source_id", "left")
    out = per.rollup("source_id").agg(F.sum("n").alias("candidates"), F.coalesce(F.sum("fixed"), F.lit(0)).alias("fixed"), F.sum((F.col("fixed") > 0).cast("long")).alias("changed"))
    return out.withColumn("changed", F.coalesce("changed", F.lit(0)))


def chunk(sources: DataFrame, size: int = 8000, overlap: int = 200) -> DataFrame:
    """(source_id, chunk_no, start, text): overlapping pieces; those of white space only are dropped."""
    step = max(size - overlap, 1)
    starts = F.when(F.length("content") > 0, F.sequence(F.lit(0), F.length("content") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = sources.select("source_id", "content", F.posexplode(starts).alias("chunk_no", "start"))
    rows = rows.select("source_id", "chunk_no", "start", F.substring("content", F.col("start") + 1, F.lit(size)).alias("text"))
    return rows.where(F.col("text").rlike(r"[^\s ﻿  -     　]"))
