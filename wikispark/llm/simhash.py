"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has bit i set if more than half of the text's shingle hashes have it. Two fingerprints within radius 2 have
a midpoint within radius 1 of both, so every distinct fingerprint emits itself and its 64 one-bit variants, one shuffle
brings equal variants together, and only fingerprints that meet are compared. At most 65 distinct fingerprints can meet
in one variant, and those are all within the radius of each other, so linking each with the smallest there keeps every
component without making all pairs. Rows with equal fingerprints are one node: thousands of copies cost one row.

Definitions. Words: runs of characters other than ASCII white space, A-Z lower-cased; shingles: `width` consecutive words
with repeats, joined by a space; fewer words: the whole sequence; none (null, empty or blank text): fingerprint zero,
which links like any other. Rows that repeat a doc_id keep their row; the component of rows that all lack an id is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import materialise, packed, parts
from wikispark.llm.graph import components

WIDTH, SEED, BITS = 3, 42, 64
PART = 1 << 15  # shingle hashes turned into bits at a time


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = sum(np.unpackbits(hashes[i : i + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, n, PART))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in parts(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t, width) for t in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def links(nodes: DataFrame) -> DataFrame:
    """Distinct fp → (a, b): links that connect all that lie within two bits of each other."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(BITS)])
    variants = nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = variants.select("fp", F.first("fp").over(W.partitionBy("variant").orderBy("fp")).alias("first"))
    near = met.where((F.col("fp") != F.col("first")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= 2))
    return near.select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()


def groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, fp, root: a fingerprint that names the component, component_id: its smallest doc_id) of every row."""
    fps = materialise(fingerprints(docs, width), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return fps.join(of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each component (doc_id, text_hash, root, component_id) one row of docs, with the smallest id and of such rows the text with the smallest hash."""
    own = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = own.groupBy("root", F.col("doc_id").alias("kept_id")).agg(F.min("text_hash").alias("kept_hash")).drop("root")
    rows = packed(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")))
    return found.dropDuplicates(["doc_id", "text_hash"]).select("row.*")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without near copies: of each component the row that `keep_least` names."""
    return keep_least(docs, groups(docs, width))
