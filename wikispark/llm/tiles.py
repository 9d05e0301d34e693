"""Pairing a query set with all rows in tiles: every tile meets one block of queries and one block of candidates.

Rows are dealt to blocks by a hash of their content, so blocks have about equal sizes whatever the data; a block travels
as one row. Blocks are bounded by the bytes of their vectors as doubles, so that few copies of each travel: a candidate
goes to as many tiles as there are blocks of queries, which grow with their bytes only. Inside a tile, TILE rows of each
side are multiplied at a time. Rows that repeat an id and a vector count once. Vectors that are null or hold null or non-finite components,
and rows without an id, take no part; only vectors of equal length meet.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from wikispark.llm.common import materialise

BLOCK_BYTES = 16_000_000  # of a block's vectors as doubles
TILE = 1024


def usable(vec: Column) -> Column:
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vectors(df: DataFrame, id_col: str, vec_col: str, keep: Column | None = None) -> DataFrame:
    """(id, vec, key): the distinct usable rows, written once; key tells rows of one id with different vectors apart."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = rows.where(keep) if keep is not None else rows
    return materialise(rows.distinct().withColumn("key", F.xxhash64("id", "vec")), "vectors")


def block_counts(queries: DataFrame, candidates: DataFrame, q_rows: int | None = None, c_rows: int | None = None) -> tuple[int, int]:
    """How many blocks of queries and of candidates: by bytes, or by rows if given; candidates make work for all cores."""
    measured = [rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first() for rows in (queries, candidates)]
    (n_q, q_size), (n_c, c_size) = measured
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    return (
        max(1, ceil(n_q / q_rows) if q_rows else ceil(8 * q_size / BLOCK_BYTES)),
        max(1, ceil(n_c / c_rows) if c_rows else max(ceil(8 * c_size / BLOCK_BYTES), min(cores, ceil(n_c / TILE)))),
    )


def tiles(queries: DataFrame, candidates: DataFrame, n_q: int, n_c: int) -> GroupedData:
    """Groups with one row `q` (a list of query structs) and one row `c` (a list of candidate structs) each."""

    def blocks(rows: DataFrame, n: int, block: str, name: str) -> DataFrame:
        rows = rows.select(F.size("vec").alias("dim"), F.pmod("key", F.lit(n)).cast("int").alias(block), F.struct("*").alias("r"))
        return rows.groupBy("dim", block).agg(F.collect_list("r").alias(name))

    q = blocks(queries, n_q, "qb", "q").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = blocks(candidates, n_c, "cb", "c").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return q.unionByName(c, allowMissingColumns=True).groupBy("dim", "qb", "cb")


def spans(n: int):
    """Slices of at most TILE of n rows."""
    return [slice(i, min(i + TILE, n)) for i in range(0, n, TILE)]


def unpack(table, name: str):
    """The list column `name` of a group as ({field: numpy array}, matrix of the vectors); None if the block is missing."""
    import pyarrow as pa

    column = table.column(name).drop_null()
    if not len(column):
        return None, None
    rows = pa.concat_arrays([c.flatten() for c in column.chunks]) if len(column.chunks) > 1 else column.chunk(0).flatten()
    vec = rows.field("vec")
    matrix = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else None
    return {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type if f.name != "vec"}, matrix
