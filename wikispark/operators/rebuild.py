"""Rebuilding only what changed: sources, their atoms, their pages and the counts of topics, kept as tables by part.

A part is a bucket of source ids. A rebuild compares content hashes with those stored, works out the atoms and pages of
sources that are new or changed, takes over those of unchanged sources in the same parts from the stored tables, writes
both beside the tables and moves these parts into place; other parts are neither read nor written beyond ids and hashes. Atoms follow from their source alone
and a page from its atoms, so the sources that changed are the whole closure up to pages; a topic's counts follow from all of its pages
and are worked out again for each topic that a changed source has or had.

Atoms are dealt by part once and numbered, compared and written as they lie; so are pages. Each write frees its shuffles, and no table is
held in another copy than the stored one and the one that takes its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikispark.operators import atoms as A
from wikispark.operators.graphs import settle
from wikispark.operators.notes import chunk
from wikispark.operators.pages import bullet_list
from wikispark.sources.writers import freed

PARTS = 64
COPIED = 16  # parts whose unchanged rows are picked at a time; others are not read then


def part_of(source_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(parts)).cast("int")


def compiled_atoms(sources: DataFrame, fn: Callable | None = None, parts: int = PARTS) -> DataFrame:
    """sources(source_id, content) → their deduplicated atoms + part, dealt by part."""
    raw = A.extract_atoms(chunk(sources.select("source_id", "content")), fn)  # fn: a model as in `extract_atoms`
    dealt = raw.withColumn("part", part_of(F.col("source_id"), parts)).repartition("part")
    return A.dedup_atoms(A.sequence_atoms(dealt, ("part",)), within=("part",))


def compiled_pages(sources: DataFrame, atoms: DataFrame, parts: int = PARTS) -> DataFrame:
    """(source_id, topic, n, body, part): a page for each source, with its atoms in order; without atoms, an empty body. Dealt by part.

    A source and its atoms are rows of one group, so that no join has to deal them again.
    """
    each = atoms.select("part", "source_id", "seq", "kind", "claim", "quote")
    own = sources.select(part_of(F.col("source_id"), parts).alias("part"), "source_id", "topic")
    rows = own.unionByName(each, allowMissingColumns=True).repartition("part").groupBy("part", "source_id")
    return rows.agg(F.max("topic").alias("topic"), F.count("seq").alias("n"), bullet_list("seq").alias("body")).select("source_id", "topic", "n", "body", "part")


def topic_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("topic").agg(F.count("*").alias("pages"), F.sum("n").alias("atoms"))


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def _write(rows: DataFrame, root: str, name: str, by: str = "part", dealt: bool = False, mode: str = "overwrite") -> None:
    """dealt: the rows lie by part already, or are few."""
    with freed(rows.sparkSession):
        out = (rows if dealt else rows.repartition(by)).write.mode(mode).option("compression", "zstd")
        (out if mode == "append" else out.option("partitionOverwriteMode", "dynamic")).partitionBy(by).parquet(f"{root}/{name}")


def _replace(spark: SparkSession, root: str, staged: str, name: str, by: str, values: list) -> None:
    """Moves the staged partitions of these values into place; those that have no rows any more go."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in values:
        new, old = path(f"{staged}/{name}/{by}={value}"), path(f"{root}/{name}/{by}={value}")
        fs.delete(old, True)
        if fs.exists(new) and not fs.rename(new, old):
            raise OSError(f"{new} could not be moved to {old}")


def _cleared(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def build(sources: DataFrame, root: str, parts: int = PARTS, fn: Callable | None = None) -> None:
    """Compiles all of sources(source_id, topic, content) into the tables under root. Each source_id has one row."""
    rows = sources.select("source_id", "topic", F.sha2("content", 256).alias("sha"), part_of(F.col("source_id"), parts).alias("part"))
    _write(rows, root, "sources")
    _write(compiled_atoms(sources, fn, parts), root, "atoms", dealt=True)
    stored = _read(sources.sparkSession, root, "atoms")
    _write(compiled_pages(sources, stored, parts), root, "pages", dealt=True)
    topic_counts(_read(sources.sparkSession, root, "pages")).write.mode("overwrite").parquet(f"{root}/topics")


def rebuild(sources: DataFrame, root: str, parts: int = PARTS, fn: Callable | None = None) -> DataFrame:
    """Brings the tables under root up to sources and tells (action, sources, atoms): new, changed and deleted sources with the
    atoms made or dropped, those copied within touched parts, and those left alone. parts: as in `build`."""
    spark = sources.sparkSession
    old, old_pages = _read(spark, root, "sources"), _read(spark, root, "pages")
    now = sources.select("source_id", F.col("topic").alias("new_topic"), F.sha2("content", 256).alias("new_sha"))
    both = old.join(now.withColumnRenamed("source_id", "new_id"), F.col("source_id") == F.col("new_id"), "full_outer")
    same = F.col("sha").eqNullSafe(F.col("new_sha")) & F.col("topic").eqNullSafe(F.col("new_topic"))
    action = F.when(F.col("source_id").isNull(), "new").when(F.col("new_id").isNull(), "deleted").when(same, "same").otherwise("changed")
    own = F.coalesce("source_id", "new_id")
    status = settle(both.select(own.alias("source_id"), "topic", "new_topic", "new_sha", action.alias("action"), part_of(own, parts).alias("part")))
    moved = status.where("action <> 'same'")
    touched = sorted(r.part for r in moved.select("part").distinct().collect())  # at most `parts` numbers
    topics = settle(moved.select(F.explode(F.array("topic", "new_topic")).alias("moved_topic")).distinct())
    renewed = moved.where("action <> 'deleted'")
    inside, staged = F.col("part").isin(touched), f"{root}/_rebuild"
    _cleared(spark, staged)  # of a rebuild that was cut off
    if touched:
        _write(compiled_atoms(sources.join(renewed.select("source_id"), "source_id", "left_semi"), fn, parts), staged, "atoms", dealt=True)
        atoms = spark.read.schema(_read(spark, root, "atoms").schema).parquet(f"{staged}/atoms")
        _write(compiled_pages(renewed.select("source_id", F.col("new_topic").alias("topic")), atoms, parts), staged, "pages", dealt=True)
        made = spark.read.schema(old_pages.schema).parquet(f"{staged}/pages").select("source_id", "n")
    else:
        made = old_pages.where("false").select("source_id", "n")
    dropped = old_pages.where(inside).join(moved.where("action = 'deleted'").select("source_id"), "source_id", "left_semi").select("source_id", "n")
    kept = old_pages.select("source_id", "n", "part").join(moved.select("source_id"), "source_id", "left_anti")
    sizes = moved.join(made.unionByName(dropped), "source_id", "left").groupBy("action").agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("atoms"))
    still = kept.groupBy(F.when(inside, "copied").otherwise("left alone").alias("action")).agg(F.count("*").alias("sources"), F.sum("n").alias("atoms"))
    report = settle(sizes.unionByName(still))
    if not touched:
        return report
    for name in ("atoms", "pages"):
        for at in range(0, len(touched), COPIED):
            some = F.col("part").isin(touched[at : at + COPIED])
            copied = _read(spark, root, name).where(some).join(moved.where(some).select("source_id"), "source_id", "left_anti")
            _write(copied.select(*_read(spark, root, name).columns), staged, name, mode="append")
    _write(status.where(inside & (F.col("action") != "deleted")).select("source_id", F.col("new_topic").alias("topic"), F.col("new_sha").alias("sha"), "part"), staged, "sources")
    fresh = spark.read.schema(old_pages.schema).parquet(f"{staged}/pages")  # all is worked out before anything is replaced
    again = F.col("topic").eqNullSafe(F.col("moved_topic"))
    counts = topic_counts(fresh.unionByName(old_pages.where(~inside)).join(topics, again, "left_semi"))
    counts = settle(counts.unionByName(_read(spark, root, "topics").join(topics, again, "left_anti")))
    for name in ("atoms", "pages", "topics", "sources"):  # hashes last: a rebuild that was cut off is done again by the next one
        if name == "topics":
            counts.write.mode("overwrite").parquet(f"{root}/topics")
            continue
        _replace(spark, root, staged, name, "part", touched)
    _cleared(spark, staged)
    return report
