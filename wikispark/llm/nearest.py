"""Nearest neighbours by a block matrix join over int8 tiles.

Each vector is x = s * i + r with int8 codes i, a scale s and a residual of length e. Codes are made once, stored and sent
to the tiles as int8, with the vector beside them. One tile's product of codes gives every squared distance of the tile up
to 2 * (e_q * |c| + |s_q i_q| * e_c). Pairs whose lower bound is above the k-th smallest upper bound of their query, or
above what the query's heap already holds, cannot be among the k nearest; the others are recomputed in float64 from the
original vectors and pushed on the heap, inside the tile, so that clusters of near-equal vectors cost multiplications but
no rows. The heaps of all tiles are merged by rank. The bounds hold for every pair, so the result is exact: recall is 1.

Distances add up the squared differences in component order, in double precision; one that overflows is infinite and
takes part as such. Vectors of zeros take no part; see tiles.py for the rest. A table without queries or candidates gives
no rows; fewer than k candidates give all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import materialise
from wikispark.llm.tiles import block_counts, spans, tiles, unpack, vectors

MEASURES = ("scale", "residual", "length", "coded")


def quantise(x):
    """(int8 codes, scale, length of the residual, length, length of what the codes stand for) of each row of x."""
    import numpy as np

    with np.errstate(all="ignore"):
        scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / scale[:, None])
        norm = lambda m: np.sqrt((m * m).sum(axis=1))
        measures = scale, norm(x - codes * scale[:, None]), norm(x), norm(codes) * scale
        return np.nan_to_num(codes).astype(np.int8), *measures


def coded(rows: DataFrame) -> DataFrame:
    """rows (id, vec, key) with the codes and measures of each vector, written once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            codes: list = [None] * b.num_rows
            measures = np.zeros((b.num_rows, 4))
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, start = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                found, *values = quantise(flat[start[own][:, None] + np.arange(n)])
                measures[own] = np.stack(values, axis=1)
                for i, c in zip(own, found, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), *(pa.array(m) for m in measures.T)], names=[*b.schema.names, "codes", *MEASURES])

    added = [T.StructField("codes", T.BinaryType())] + [T.StructField(m, T.DoubleType()) for m in MEASURES]
    return materialise(rows.select("id", "vec", "key").mapInArrow(run, T.StructType([*rows.select("id", "vec", "key").schema.fields, *added])), "vectors")


def code_products(a, b):
    """Exact products of int8 codes as matrix products: float32 holds whole numbers to 2**24, which 1,024 components cannot exceed."""
    import numpy as np

    return sum((a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], 1024))


def _tile(k: int):
    def run(table):
        import heapq
        import math

        import numpy as np
        import pyarrow as pa

        names = ["query_id", "key", "vec_id", "score"]
        (q, qm), (c, cm) = unpack(table, "q"), unpack(table, "c")
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if q is None or c is None:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        qm, cm = qm.astype(np.float64), cm.astype(np.float64)
        q_codes, c_codes = (np.frombuffer(b"".join(x["codes"]), np.int8).reshape(m.shape) for x, m in ((q, qm), (c, cm)))
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(qm))]
        for rows in spans(len(qm)):
            worst = np.full(len(qm[rows]), np.inf)  # the k-th smallest squared distance found so far
            qs, qe, ql, qh = (q[m][rows][:, None] for m in MEASURES)
            for part in spans(len(cm)):
                cs, ce, cl, _ = (c[m][part][None, :] for m in MEASURES)
                ids, x, y = c["id"][part], qm[rows], cm[part]
                with np.errstate(all="ignore"):
                    far = ql * ql + cl * cl - 2 * qs * cs * code_products(q_codes[rows], c_codes[part])
                    slack = 2 * (qe * cl + qh * ce) + 1e-9 * (ql + cl) ** 2
                    own = q["id"][rows][:, None] == ids[None, :]
                    upper = np.where(own, np.inf, far + slack)
                    limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(x), np.inf)
                    i, j = np.nonzero(~(far - slack > np.minimum(limit, worst)[:, None]) & ~own)
                    exact = np.zeros(len(i))
                    for d in range(x.shape[1]):
                        step = x[i, d] - y[j, d]
                        exact += step * step
                for a, d, v in zip(i.tolist(), exact.tolist(), ids[j].tolist(), strict=True):
                    heap = heaps[rows.start + a]
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -v))
                    elif (-d, -v) > heap[0]:
                        heapq.heapreplace(heap, (-d, -v))
                    if len(heap) == k:
                        worst[a] = -heap[0][0]
        found = [(x, -v, math.sqrt(-d)) for x, heap in enumerate(heaps) for d, v in heap]
        at = [x for x, _, _ in found]
        return pa.table([pa.array(q["id"][at], kinds[0]), pa.array(q["key"][at], kinds[1]), pa.array([v for _, v, _ in found], kinds[2]), pa.array([d for _, _, d in found], kinds[3])], names=names)

    return run


def search(df: DataFrame, every: int, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", q_rows: int | None = None, c_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest of every row whose id divides by `every`."""
    rows = coded(vectors(df, id_col, vec_col, F.exists("vec", lambda x: x != 0)))
    queries = rows.where(F.col("id") % every == 0)
    found = tiles(queries, rows, *block_counts(queries, rows, q_rows, c_rows)).applyInArrow(_tile(k), "query_id long, key long, vec_id long, score double")
    best = W.partitionBy("query_id", "key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.z) + 1), lambda i: (q.z[i] - c.z[i]) * (q.z[i] - c.z[i])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.z) = len(c.z))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""".strip()
