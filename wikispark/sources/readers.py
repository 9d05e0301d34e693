"""Readers: notes, atom files, page heads of both dialects, compile logs and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STORED_ATOM = "id string, claim string, evidence struct<quote:string,source_id:string,char_offset:array<int>>, kind string, draft_tags array<string>, lifted_at string"


def source_name(file_name: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(file_name, r"\.[^.]+$", "")


def read_sources(spark: SparkSession, folder: str, topic: str = "") -> DataFrame:
    """(topic, source_id, content) of every .md and .txt file in a folder."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = rows.where(F.col("file").rlike(r"\.(md|txt)$"))
    return rows.select(F.lit(topic).alias("topic"), source_name(F.col("file")).alias("source_id"), F.col("value").alias("content"))


def first_non_empty(*sides: DataFrame, by: str = "topic") -> DataFrame:
    """For each topic the rows of the first side that has any."""
    rows = None
    for i, side in enumerate(sides):
        side = side.withColumn("_side", F.lit(i))
        rows = side if rows is None else rows.unionByName(side)
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_side").alias("_first"))
    return rows.join(first, (F.col(by) == F.col("_by")) & (F.col("_side") == F.col("_first"))).drop("_side", "_by", "_first")


def read_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Stored atoms of JSON files, as a list or as {atoms: [...]}, with file and pos for their order."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    kind = f"array<struct<{STORED_ATOM.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<atoms:{kind}>")["atoms"])
    return text.select("file", F.posexplode(F.coalesce(listed, F.array().cast(kind))).alias("pos", "a")).select("file", "pos", "a.*")


def parse_frontmatter(pages: DataFrame) -> DataFrame:
    """pages(page, text) → (page, fields map, body): the head between --- lines, keys up to the first colon, one outer quote
    off each end; the last of equal keys counts; without a head all is body."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n?", 1)
    has = F.col("text").rlike(r"(?s)^---\n.*?\n---")
    lines = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 0)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), "^[\"']", ""), "[\"']$", "").alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    fields = F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))
    return pages.select("page", fields.alias("fields"), F.when(has, F.regexp_replace("text", r"(?s)^---\n.*?\n---\n?", "")).otherwise(F.col("text")).alias("body"))


def parse_page_registry(pages: DataFrame) -> DataFrame:
    """pages(page, text) → (page, fields map of scalars, lists map of arrays): the dialect with block lists, whatever the indentation."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    rows = pages.select("page", F.posexplode(F.split(head, "\n")).alias("no", "line")).where(F.trim("line") != "")
    item = F.trim("line").startswith("- ")
    key = F.when(~item, F.trim(F.substring_index("line", ":", 1)))
    rows = rows.select("page", "no", item.alias("item"), F.last(key, ignorenulls=True).over(W.partitionBy("page").orderBy("no")).alias("key"), "line")
    bare = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    value = F.when(F.col("item"), bare(F.regexp_replace(F.trim("line"), "^- ", ""))).otherwise(bare(F.expr("substr(line, instr(line, ':') + 1)")))
    rows = rows.withColumn("value", value)
    by_key = rows.groupBy("page", "key").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("item"), F.struct("no", "value")))), lambda x: x["value"]).alias("items"), F.max(F.when(~F.col("item"), F.col("value"))).alias("scalar"))
    return by_key.groupBy("page").agg(
        F.map_from_entries(F.collect_list(F.when((F.size("items") == 0) & (F.col("scalar") != ""), F.struct("key", "scalar")))).alias("fields"),
        F.map_from_entries(F.collect_list(F.when(F.size("items") > 0, F.struct("key", "items")))).alias("lists"),
    )


def _under_headers(lines: DataFrame, header: Column) -> DataFrame:
    """+ head: the last header line above, by document and line number."""
    return lines.withColumn("head", F.last(F.when(header, F.col("text")), ignorenulls=True).over(W.partitionBy("doc").orderBy("line_no")))


def parse_compile_log(lines: DataFrame) -> DataFrame:
    """lines(doc, line_no, text) → (doc, line_no, ts, action, source, created): `## [ts] action | source` and the bullets below."""
    form = r"^## \[([^\]]*)\] ([^|]*) \| (.*)$"
    rows = _under_headers(lines, F.col("text").rlike(form)).where(F.col("head").isNotNull())
    started = F.sum(F.col("text").rlike(form).cast("int")).over(W.partitionBy("doc").orderBy("line_no"))
    rows = rows.withColumn("entry", started)
    bullet = F.when(F.col("text").rlike(r"^\s*- "), F.struct("line_no", F.regexp_replace("text", r"^\s*- ", "").alias("t")))
    part = lambda i: F.regexp_extract("head", form, i)
    out = rows.groupBy("doc", "entry", "head").agg(F.min("line_no").alias("line_no"), F.transform(F.sort_array(F.collect_list(bullet)), lambda x: x["t"]).alias("created"))
    return out.select("doc", "line_no", part(1).alias("ts"), part(2).alias("action"), part(3).alias("source"), "created")


def parse_journal(lines: DataFrame) -> DataFrame:
    """lines(doc, line_no, text) → (doc, line_no, ts, source, kind, done, item): `## [ts] 来自 source`, then `- [ ]` or `- ⚠️` items."""
    form = r"^## \[([^\]]*)\] 来自 (.*)$"
    rows = _under_headers(lines, F.col("text").rlike(form)).where(F.col("head").isNotNull() & F.col("text").rlike(r"^- (\[[ x]\]|⚠️) "))
    kind = F.when(F.col("text").startswith("- ["), "question").otherwise("contradiction")
    return rows.select("doc", "line_no", F.regexp_extract("head", form, 1).alias("ts"), F.regexp_extract("head", form, 2).alias("source"), kind.alias("kind"), F.col("text").startswith("- [x]").alias("done"), F.regexp_replace("text", r"^- (\[[ x]\]|⚠️) ", "").alias("item"))
