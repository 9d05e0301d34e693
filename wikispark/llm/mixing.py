"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 32-bit hash of its id. Tokens are summed by source and hash bucket (12 bits), which shows the
bucket where a source's budget ends; only that bucket is split by the next 12 bits, then by the last 8. What lies below
the threshold found is taken: a filter, without sorting documents. Budgets nest: a larger target of the same source
takes a superset, and a target above the source's size takes whole repeats first and then the threshold's share.

Definitions. size: words of the text, null or empty text 0. Sources are ranked by code point, null last (null is a
source of its own), and weigh 5, 2, 1, 5, 2, 1 ...; a document without an id is hashed by its text; rows with equal ids
are told apart by their texts and, where these are equal too, by numbers, and each has a hash of its own. An empty table gives an empty result; sources of size 0 get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SALTS = 1024  # of equal rows
LEVELS = ((20, 4096), (8, 4096), (0, 256))  # (bits to the right of this level's digit, digits)


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def first_bits(digest: Column) -> Column:
    """The first 32 bits of an MD5 digest, which SQL engines share."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hashed(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns of docs(doc_id, text) and h, a 32-bit hash of each row: of its id, or its text without one.

    Rows that share it are hashed by id, text and a number among equal ones: numbered by a salt first, then by the counts
    of the salts before, so that very many equal rows are not dealt to one task.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(*[c.alias(k) for k, c in columns.items()], digest.alias("m"))
    often = docs.groupBy(digest.alias("often")).agg(F.count("*").alias("n")).where("n > 1").select("often")
    often = materialise(often, "mix-often")
    if not often.limit(1).count():
        return rows.select(*columns, first_bits(F.col("m")).alias("h"))
    words = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(*[c.alias(k) for k, c in columns.items()], digest.alias("m"), words.alias("t"), (F.monotonically_increasing_id() % SALTS).alias("salt"))
    rows = rows.join(often, F.col("m") == F.col("often"), "left")
    several = materialise(rows.where("often IS NOT NULL"), "mix-several")
    counts = several.groupBy("m", "t", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("m", "t").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("m", "t", "salt", before.alias("before"))
    nth = F.row_number().over(W.partitionBy("m", "t", "salt").orderBy("m")) - 1
    numbered = several.withColumn("nth", nth).join(places, ["m", "t", "salt"])
    own = F.md5(F.concat_ws(":", "m", "t", (F.col("nth") + F.col("before")).cast("string")).cast("binary"))
    return rows.where("often IS NULL").select(*columns, first_bits(F.col("m")).alias("h")).unionByName(numbered.select(*columns, first_bits(own).alias("h")))


def targets(sources: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) → + weight, target double.

    The excess of capped sources is reshared by weight until none is above its cap. The fixed point of that is
    min(weight * level, cap) for one level: order the sources by cap / weight, and the level follows from running sums.
    One row per source, so the windows without a partition see no documents.
    """
    everything, ordered = W.partitionBy(), W.orderBy(F.col("ratio"), F.col("rank"))
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ratio", F.lit(float(max_repeat)) * F.col("source_size") / F.col("weight"))
    left = F.sum("source_size").over(everything) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumns({"left": left, "weight_left": weight_left})
    fits = F.col("left").cast("double") / F.col("weight_left") <= F.col("ratio")
    level = F.min(F.when(fits, F.struct("ratio", "rank", "left", "weight_left"))).over(everything)
    ranked = ranked.withColumn("level", level)
    share = F.col("weight").cast("double") * F.col("level.left") / F.col("level.weight_left")
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    return ranked.select("source", "source_size", "weight", F.when(F.col("level").isNull(), cap).otherwise(F.least(share, cap)).alias("target"))


def _boundary(hist: DataFrame) -> DataFrame:
    """(source, rest, b, s) → the bucket of each source where rest ends: (source, rest in it, b, s)."""
    cum = F.sum("s").over(W.partitionBy("source").orderBy("b"))
    hist = hist.withColumn("cum", cum).where((F.col("cum") - F.col("s") <= F.col("rest")) & (F.col("cum") > F.col("rest")))
    return hist.select("source", (F.col("rest") - (F.col("cum") - F.col("s"))).alias("rest"), "b", "s")


def thresholds(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, size, h) of every document → source, source_size, target, copies (whole repeats), below (hashes below it once more)."""
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = materialise(goals.withColumn("copies", whole), "mix-goals")
    ends = goals.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    rows = sized
    for shift, digits in LEVELS:
        digit = (F.shiftrightunsigned("h", shift) % digits).alias("b")
        e = ends.withColumnRenamed("source", "e_source")
        match = F.col("source").eqNullSafe(F.col("e_source"))
        match &= F.shiftrightunsigned("h", shift + digits.bit_length() - 1) == F.col("prefix")
        hist = rows.join(e, match).groupBy("source", "rest", "prefix", digit).agg(F.sum("size").alias("s"))
        found = _boundary(hist.drop("prefix")).join(ends.select(F.col("source").alias("e_source"), "prefix"), F.col("source").eqNullSafe(F.col("e_source")))
        ends = materialise(found.select("source", "rest", "s", (F.col("prefix") * digits + F.col("b")).alias("prefix")), "mix-ends")
    # the last bucket is one hash value: it comes in when the total is then nearer to the budget
    last = F.col("prefix") + F.when(F.col("s") - F.col("rest") < F.col("rest"), 1).otherwise(0)
    ends = ends.select(F.col("source").alias("e_source"), last.alias("below"))
    out = goals.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
    return out.select("source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; docs needs doc_id, text and source."""
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": size_of(F.col("text"))}
    sized = materialise(hashed(docs, own), "mix-sizes")
    plan = thresholds(sized, weights, max_repeat).withColumnRenamed("source", "p_source")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left")
    times = F.col("copies") + (F.col("h") < F.col("below")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = hashed(docs, {"row": row, "src": F.col("source"), "size": size_of(F.col("text"))})
    plan = thresholds(materialise(rows.select(F.col("src").alias("source"), "size", "h"), "mix-sizes"), weights, max_repeat)
    out = rows.join(plan, F.col("src").eqNullSafe(F.col("source")))
    times = (F.col("copies") + (F.col("h") < F.col("below")).cast("long")).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("again")).select("row.*")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(CASE WHEN n = 1 THEN m ELSE md5(m || ':' || t || ':' || (row_number() OVER (PARTITION BY m, t) - 1)) END, 1, 8) AS BIGINT) AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS m, md5(coalesce(text, '')) AS t FROM {documents}))),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(rk - 1) % 3 + 1] AS BIGINT) AS weight FROM sums),
ranked AS (
  SELECT *, CAST(3.0 AS DOUBLE) * source_size / weight AS ratio FROM weighed),
running AS (
  SELECT *,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weight_left
  FROM ranked),
level AS (
  SELECT rest AS l_rest, weight_left AS l_weight FROM running
  WHERE CAST(rest AS DOUBLE) / weight_left <= ratio ORDER BY ratio, rk LIMIT 1),
goals AS (
  SELECT source, source_size, least(CAST(weight AS DOUBLE) * l_rest / l_weight, CAST(3.0 AS DOUBLE) * source_size) AS target
  FROM running, level),
parts AS (
  SELECT source AS g_source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goals),
placed AS (
  SELECT s.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.g_source)
SELECT doc_id, source, size, source_size, target,
       (copies + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) * size AS taken
FROM placed
""".strip()
