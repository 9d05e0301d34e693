"""Exact top-k search by the three-phase uniform threshold.

A score is a sum over `slices` of the components, each slice a list of local scores. Phase 1 gathers every slice's k best
from each tile, resolves those pairs and takes the k-th best of a query's totals: a cutoff that the answer reaches for
sure. Phase 2 gives each query's cutoff to all tiles, and a slice sends the entries of at least cutoff / slices: a total
at or above the cutoff needs one such entry. Candidates go by falling length, so that queries leave a tile as soon as no
product with what is left can reach their cutoff, and a slice of which no product can reach its share is not multiplied
for its entries. Phase 3 adds up the slices of the pairs sent and keeps the totals that reach the cutoff; the k best of
them are the result, ties to the smaller id. What leaves a tile is k rows a query in each phase.

Components are floor(256 * x) (x as double, kept within 64 bits); sums are exact: in float64 while they fit 53 bits, in
Python integers beyond, kept within 64 bits at the end. See tiles.py for what takes part. A table without queries or
candidates gives no rows; fewer than k candidates give all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.llm.tiles import block_counts, spans, tiles, unpack, vectors

SLICES = 4


def slices_of(q, c, slices: int):
    """The components in slices, and the kind of number in which sums of products are exact."""
    import numpy as np

    most = [int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (q, c)]
    kind = np.float64 if most[0] * most[1] * max(1, q.shape[1]) < 1 << 53 else object
    return [p for p in np.array_split(np.arange(q.shape[1]), slices) if len(p)], kind


def best_first(i, ids, total, k: int):
    """The places of the k best of each query i, in order."""
    import numpy as np

    order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -total[x], ids[x])), np.int64) if total.dtype == object else np.lexsort((ids, -total, i))
    return order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]


def _tile(k: int, slices: int, cut: bool):
    def run(table):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "key", "vec_id", "score"]
        (q, qm), (c, cm) = unpack(table, "q"), unpack(table, "c")
        if q is None or c is None:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        own_slices, kind = slices_of(qm, cm, slices)
        norms = lambda m: [np.sqrt((m[:, p].astype(np.float64) ** 2).sum(axis=1)) for p in own_slices]
        q_norms, c_norms = norms(qm), norms(cm)
        order = np.argsort(-sum((n * n for n in c_norms), np.zeros(len(cm))), kind="stable")
        cm, c_ids, c_norms = cm[order], c["id"][order], [n[order] for n in c_norms]
        bound = np.array([-np.inf if x is None or x != x else x for x in q["cutoff"].tolist()], np.float64) if cut else np.full(len(qm), -np.inf)
        bound -= 1e-9 * np.abs(np.nan_to_num(bound, neginf=0))  # what floats may hide
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))]
        for rows in spans(len(qm)):
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))]
            for part in spans(len(cm)):
                most = [a[rows] * b[part].max() for a, b in zip(q_norms, c_norms, strict=True)]  # no product of a slice is larger
                at = np.arange(rows.start, rows.stop)
                at = at[sum(most, np.zeros(len(at))) >= bound[rows]] if cut else at
                if not len(at):
                    continue
                own = q["id"][at][:, None] == c_ids[part][None, :]
                products = [qm[at][:, p].astype(kind) @ cm[part][:, p].astype(kind).T for p in own_slices] or [np.zeros(own.shape)]
                if cut:
                    sent = np.zeros(own.shape, bool)
                    for x, m in zip(products, most or [np.full(len(at), np.inf)], strict=True):
                        if not most or (m[at - rows.start] * len(products) >= bound[at]).any():
                            sent |= x * len(products) >= bound[at][:, None]
                    i, j = np.nonzero(sent & ~own)
                else:
                    picks = set()
                    for x in products:
                        x = np.where(own, -np.inf, x).astype(np.float64)
                        best = np.argpartition(-x, min(k, x.shape[1]) - 1, axis=1)[:, :k]
                        picks.update(zip(np.repeat(np.arange(len(x)), best.shape[1]).tolist(), best.ravel().tolist(), strict=True))
                    picks = sorted(x for x in picks if not own[x])
                    i, j = np.array(picks, np.int64).reshape(-1, 2).T
                total = sum(x[i, j] for x in products)
                reach = total >= bound[at][i]
                held.append((at[i[reach]], c_ids[part][j[reach]], total[reach]))
                i, ids, total = (np.concatenate(x) for x in zip(*held, strict=True))
                kept = best_first(i, ids, total, k)
                held = [(i[kept], ids[kept], total[kept])]
            found += held
        i, ids, total = (np.concatenate(x) for x in zip(*found, strict=True))
        score = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in total.tolist()]
        return pa.table([q["id"][i], q["key"][i], ids, pa.array(score, pa.int64())], names=names)

    return run


def search(df: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", slices: int = SLICES, q_rows: int | None = None, c_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every row whose id divides by `every`."""
    rows = vectors(df, id_col, vec_col)
    rows = rows.select("id", "key", F.transform("vec", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vec"))
    queries = rows.where(F.col("id") % every == 0)
    blocks = block_counts(queries, rows, q_rows, c_rows)
    schema = "query_id long, key long, vec_id long, score long"
    best = W.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    local = tiles(queries, rows, *blocks).applyInArrow(_tile(k, slices, cut=False), schema)
    top = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoffs = top.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "key", F.col("score").alias("cutoff"))
    queries = queries.join(cutoffs, ["id", "key"], "left")
    found = tiles(queries, rows, *blocks).applyInArrow(_tile(k, slices, cut=True), schema)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""".strip()
