"""Near copies by the Jaccard similarity of word shingles: MinHash proposes pairs, the shingle sets decide them.

Each text has BANDS x ROWS minima of its hashed shingles; texts that agree in all minima of a band meet in a bucket. A
pair of similarity s meets in none with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, 4e-9 at 0.85. That is all that can
be missed: of those that meet, every pair is compared exactly unless both are already in one component. First each text
is compared with one pivot a bucket, another one in each band, which joins nearly all of a large group of copies at a
comparison a text and band; then, in buckets that still hold several components, the texts outside the pivot's are
compared with all others in tiles that give links only. Equal texts are one node.

Definitions. Words as in `simhash`; the set of `width` consecutive words; fewer words: the whole sequence; none (null,
empty or blank text): the empty set, similar to itself alone. Rows that repeat a doc_id keep their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import materialise, parts
from wikispark.llm.graph import components
from wikispark.llm.simhash import keep_least

WIDTH, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
PART = 512  # shingles whose minima are taken at a time
TILE = 1 << 17  # shingles on each side of a tile


def shingles(text: str | None, width: int = WIDTH):
    """The distinct shingle hashes of a text, sorted."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, max(1, len(words) - width + 1)))


def similarity(a, b) -> float:
    """The Jaccard similarity of two sorted arrays of distinct hashes; 1 of two empty ones."""
    import numpy as np

    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _factors():
    import numpy as np

    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(found, factors) -> list[int]:
    """One signed key for each band."""
    import numpy as np
    import xxhash

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), PART):
        low = np.minimum(low, ((found[None, i : i + PART] ^ factors[1]) * factors[0]).min(axis=1))
    digests = np.array([xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64)
    return digests.view(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, n distinct shingles, keys) of every row."""

    def run(batches):
        import pyarrow as pa

        factors = _factors()
        for b in parts(batches, 2):
            sets = [shingles(t, width) for t in b.column(2).to_pylist()]
            keys = pa.array([buckets(s, factors) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), keys], names=["doc_id", "text_hash", "n", "keys"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, found: its shingle hashes as bytes) for the texts whose hash is in nodes (node, least: the smallest doc_id that has it).

    The id takes part in the join, so that of very many copies only one row is dealt by the text's hash.
    """

    def run(batches):
        import pyarrow as pa

        for b in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "found"])

    texts = docs.select(F.xxhash64("text").alias("node"), "doc_id", "text").alias("t")
    one = texts.join(nodes.alias("n"), (F.col("t.node") == F.col("n.node")) & F.col("t.doc_id").eqNullSafe(F.col("n.least")), "left_semi")
    return one.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, found binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least `least`."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in parts(batches, 3):
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            kept = b.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    of_a, of_b = sets.select(F.col("node").alias("a"), F.col("found").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("found").alias("of_b"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def tile_links(tile, least: float):
    """The links between components of one tile: of its left texts with its right ones, one for each pair it joins anew.

    All left texts are counted against a right one at once, by the places of its shingles among the sorted left ones.
    """
    import numpy as np
    import pyarrow as pa

    is_left = tile.column("left").to_numpy()
    roots, sets = tile.column("root").to_numpy(), [np.frombuffer(x, np.uint64) for x in tile.column("found").to_pylist()]
    left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    sizes = np.array([len(sets[i]) for i in left], np.int64)
    held = np.concatenate([sets[i] for i in left])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(left)), sizes)[order]
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    found = []
    for r in right:
        start, n = np.searchsorted(held, sets[r], "left"), len(sets[r])
        times = np.searchsorted(held, sets[r], "right") - start
        at = np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())
        common = np.bincount(owner[at], minlength=len(left))
        of_both = sizes + n - common
        near = (common >= least * of_both) & (common / np.maximum(of_both, 1) >= least) | (of_both == 0)
        for x in np.unique(roots[left[near]]).tolist():
            a, b = top(x), top(int(roots[r]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                found.append((x, int(roots[r])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def rest_links(met: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the components that `labels` (node, root) gives, from all pairs that met and are not in one.

    In each bucket that holds several components, the texts outside the pivot's are compared with all others, in tiles
    of about TILE shingles on each side; a tile is a group of its own and gives links, not pairs.
    """
    rooted = met.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = F.max(F.when(F.col("node") == F.col("pivot"), F.col("root")))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("r"), F.max("root").alias("s"), own.alias("main")).where("r != s")
    active = materialise(rooted.join(mixed, ["band", "key"]).select("band", "key", "node", "n", "root", "main"), "neardup-mixed")
    outside, weight = F.col("root") != F.col("main"), F.col("n") + 16
    of_bucket = active.groupBy("band", "key").agg(F.ceil(F.sum(F.when(outside, weight)) / TILE).alias("lefts"), F.ceil(F.sum(weight) / TILE).alias("rights"))
    placed = active.join(of_bucket, ["band", "key"]).withColumn("hash", F.xxhash64("node"))
    one = placed.where(outside).withColumn("l", F.expr("pmod(hash, lefts)")).withColumn("r", F.explode(F.expr("sequence(0L, rights - 1)"))).withColumn("left", F.lit(True))
    other = placed.withColumn("r", F.expr("pmod(hash, rights)")).withColumn("l", F.explode(F.expr("sequence(0L, lefts - 1)"))).withColumn("left", F.lit(False))
    rows = one.unionByName(other).select("band", "key", "l", "r", "node", "root", "left").join(sets, "node")
    return rows.groupBy("band", "key", "l", "r").applyInArrow(lambda tile: tile_links(tile, least), "a long, b long")


def groups(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, root: the text hash that names the component, component_id: its smallest doc_id) of every row."""
    rows = materialise(sketches(docs, width), "neardup")
    nodes = rows.groupBy(F.col("text_hash").alias("node")).agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = materialise(nodes, "neardup-nodes")
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    first = F.min(F.struct(F.xxhash64("band", "node").alias("at"), "node", "n"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), first.alias("first")).where("size > 1")
    met = keyed.join(shared, ["band", "key"]).select("band", "key", "node", "n", F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n"))
    met = materialise(met, "neardup-met")
    sets = materialise(shingle_sets(docs, nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "least"), width), "neardup-sets")
    close = F.least("n", "pivot_n") >= least * F.greatest("n", "pivot_n") - 1e-9
    pairs = met.where((F.col("node") != F.col("pivot")) & close).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    labels = components(similar(pairs, sets, least))
    tops = components(rest_links(met, labels, sets, least))
    of = nodes.select("node", "least").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = of.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", "least", F.coalesce("top", "root").alias("root"))
    of = materialise(of, "neardup-roots")
    of = of.select("node", "root").join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("text_hash"), "root", "component_id")
    return rows.select("doc_id", "text_hash").join(of, "text_hash").select("doc_id", "text_hash", "root", "component_id")


def joined(*grouped: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root, component_id) of every row: what is linked in any of several groupings (doc_id, text_hash, root) of the same rows."""
    rows = materialise(grouped[0].select("doc_id", "text_hash"), "neardup-rows")
    links = None
    for g in grouped:
        of = g.select("text_hash", "root").distinct()
        edges = of.join(of.groupBy("root").agg(F.min("text_hash").alias("a")), "root").select("a", F.col("text_hash").alias("b")).where("a <> b")
        links = edges if links is None else links.unionByName(edges)
    texts = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least")).join(components(links).withColumnRenamed("node", "text_hash"), "text_hash", "left")
    texts = materialise(texts.select("text_hash", "least", F.coalesce("root", "text_hash").alias("root")), "neardup-joined")
    of = texts.join(texts.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("text_hash", "root", "component_id")
    return rows.join(of, "text_hash").select("doc_id", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of docs without near copies: of each component the row that `keep_least` names."""
    return keep_least(docs, groups(docs, width, least))
