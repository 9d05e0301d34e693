"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, one root, and a witness for every row.

Leaves are appended in order to open trees of fan-out 16. A run that gets its 16th node completes: its parent is appended
one level up, and whatever lies below has its witness extended by the other nodes of the run. The leaves of a source go in
aligned blocks of 16**3, each appended by one task; a block keeps the nodes of its levels, which are the partial
witnesses of all its leaves, and its root is a further append to the next block of block roots, and so on. Witnesses then
come down once: a block's path above it is joined to it, and each leaf's own part is read from the block's levels. No task
holds more than a block, whatever the size of a source.

Definitions. H is lower-case hexadecimal sha256 of its inputs concatenated, digests as text. A leaf is H of doc_id,
source, lang, n_chars and text, each `-` if null, else its UTF-8 byte count, `:` and its value. A source's leaves ascend by
doc_id (null first, rows that repeat an id by leaf); while several nodes remain, each 16 consecutive ones (the last run:
fewer, even one) become their H; a lone leaf is the subroot itself. Subroots, ordered by source (null first, then by
UTF-8 bytes), give the root in the same way. An empty text is `0:`; rows that repeat wholly have a leaf each; an empty
table gives no row. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import materialise, row_bucket

FAN, HEIGHT, SIZE = 16, 3, 32  # a block has FAN**HEIGHT nodes
TAMPERED = 5  # rows whose crc32(doc_id) this divides are tampered with
STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
STEPS = T.ArrayType(STEP)


def parent(digests: bytes) -> bytes:
    """H of some digests, all as bytes."""
    return hashlib.sha256(bytes(digests).hex().encode()).digest()


class Open:
    """A tree under append: the nodes of each level, as bytes one after another."""

    def __init__(self) -> None:
        self.levels = [bytearray()]

    def append(self, digest: bytes, level: int = 0) -> None:
        """Adds a node; runs that are full now complete, level by level."""
        while True:
            if level == len(self.levels):
                self.levels.append(bytearray())
            run = self.levels[level]
            run += digest
            if len(run) % (FAN * SIZE):
                return
            digest, level = parent(run[-FAN * SIZE :]), level + 1

    def close(self, height: int | None = None) -> bytes:
        """The root after the last runs, full or not, are completed up to `height`, or until one node remains."""
        level = 0
        while len(self.levels[level]) > SIZE if height is None else level < height:
            rest = len(self.levels[level]) // SIZE % FAN
            if rest:
                self.append(parent(self.levels[level][-rest * SIZE :]), level + 1)
            level += 1
        return bytes(self.levels[level])


def witness(levels: list[bytes], i: int) -> Iterator[tuple[str, str]]:
    """The other nodes of leaf i's run before and after it, at each level below the top one."""
    for level in levels[:-1]:
        start = i // FAN * FAN * SIZE
        run, at = level[start : start + FAN * SIZE].hex(), 2 * (i * SIZE - start)
        yield run[:at], run[at + 2 * SIZE :]
        i //= FAN


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness give."""
    for before, after in steps:
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def leaves(docs: DataFrame) -> DataFrame:
    """(key: the source as an ordered text, doc_id, leaf and tampered as bytes; tampered is null where nothing is done)."""

    def said(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[said(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], said(text)), 256))

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    tampered = F.when((row_bucket("doc_id", TAMPERED) == 0) & F.col("text").isNotNull(), leaf(lowered))
    return docs.select(key.alias("key"), "doc_id", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with pos, their place within their key by `order` from 0 on, and `of`, the key's rows; by ranges and their sizes, not a key at a time."""
    names = rows.columns
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "merkle-order").withColumn("range", F.shiftright("at", 33))
    sizes = ranged.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_key = W.partitionBy("key")
    before = F.coalesce(F.sum("n").over(by_key.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("key", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(by_key).alias("of"))
    return ranged.join(sizes, ["key", "range"]).select(*names, (F.col("at") + F.col("shift")).alias("pos"), "of")


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(key, pos, of, digest) → (key, pos, steps: the witness of each node up to the top, top: the one node that remains)."""
    size = FAN**height

    def close(group):
        import pyarrow as pa

        group = group.sort_by("pos")
        tree, more = Open(), group.column("of")[0].as_py() > size
        for digest in group.column("digest").to_pylist():
            tree.append(digest)
        root = tree.close(height if more else None)
        steps = [[{"before": b, "after": a} for b, a in witness(tree.levels[: height + 1], i)] for i in range(group.num_rows)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        cells = [group.column("key"), group.column("pos"), group.column("of"), pa.array(steps, kind), pa.array([root] * group.num_rows, pa.binary())]
        return pa.table(cells, names=["key", "pos", "of", "steps", "root"])

    blocks = nodes.groupBy("key", F.expr(f"pos div {size}").alias("block"))
    closed = materialise(blocks.applyInArrow(close, f"key string, pos long, of long, steps {STEPS.simpleString()}, root binary"), "merkle-paths")
    closed = closed.withColumn("block", F.expr(f"pos div {size}"))
    more = closed.where(F.col("of") > size)
    if not more.limit(1).count():
        return closed.select("key", "pos", "steps", F.col("root").alias("top"))
    roots = more.where(F.col("pos") % size == 0).select("key", F.col("block").alias("pos"), F.expr(f"(of + {size - 1}) div {size}").alias("of"), F.col("root").alias("digest"))
    up = paths(roots, height).select("key", F.col("pos").alias("block"), F.col("steps").alias("further"), "top")
    joined = closed.join(up, ["key", "block"], "left")
    return joined.select("key", "pos", F.concat("steps", F.coalesce("further", F.array().cast(STEPS))).alias("steps"), F.coalesce("top", "root").alias("top"))


def blocks(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row for each block of a source's leaves: doc_ids, tampered leaves, levels (the partial witnesses) and, from the
    appends after it, steps (the witness of the block), subroot and root."""
    size = FAN**height
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("block", T.LongType()), T.StructField("of", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind))]
        + [T.StructField("tampered", T.ArrayType(T.BinaryType())), T.StructField("levels", T.ArrayType(T.BinaryType())), T.StructField("top", T.BinaryType())]
    )

    def close(group):
        import pyarrow as pa

        group = group.sort_by("pos")
        tree, of = Open(), group.column("of")[0].as_py()
        for digest in group.column("leaf").to_pylist():
            tree.append(digest)
        root = tree.close(height if of > size else None)
        ids, changed = group.column("doc_id").combine_chunks(), group.column("tampered").combine_chunks()
        whole = pa.array([0, group.num_rows], pa.int32())
        levels = pa.array([[bytes(x) for x in tree.levels[: height + 1]]], pa.list_(pa.binary()))
        cells = [pa.array([group.column("key")[0].as_py()], pa.string()), pa.array([group.column("pos")[0].as_py() // size], pa.int64()), pa.array([of], pa.int64())]
        cells += [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, changed.cast(pa.binary())), levels, pa.array([root], pa.binary())]
        return pa.table(cells, names=["key", "block", "of", "doc_ids", "tampered", "levels", "top"])

    rows = placed(materialise(leaves(docs), "merkle-leaves"), ["doc_id", "leaf"])
    closed = materialise(rows.groupBy("key", F.expr(f"pos div {size}").alias("block")).applyInArrow(close, schema), "merkle-blocks")
    more = closed.where(F.col("of") > size).select("key", F.col("block").alias("pos"), F.expr(f"(of + {size - 1}) div {size}").alias("of"), F.col("top").alias("digest"))
    up = materialise(paths(more, height), "merkle-sources").select("key", F.col("pos").alias("block"), "steps", F.col("top").alias("subroot"))
    joined = closed.join(up, ["key", "block"], "left").withColumn("subroot", F.coalesce("subroot", "top"))
    joined = joined.withColumn("steps", F.coalesce("steps", F.array().cast(STEPS))).drop("top", "of")
    small = closed.where(F.col("of") <= size).select("key", F.col("top").alias("digest"))
    subroots = small.unionByName(up.where("block = 0").select("key", F.col("subroot").alias("digest")))
    ordered = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest"), ["source_key"])
    ordered = materialise(ordered, "merkle-subroots")
    last = paths(ordered.drop("source_key"), height).select("pos", F.col("steps").alias("last"), F.col("top").alias("root"))
    ends = ordered.join(last, "pos").select(F.col("source_key").alias("key"), "last", "root")
    return joined.join(ends, "key").withColumn("steps", F.concat("steps", "last")).drop("last")


def _rows(block) -> Iterator[tuple]:
    """(doc_id, leaf, tampered leaf or leaf, witness) of each leaf of a block."""
    over = [(s["before"], s["after"]) for s in block["steps"]]
    for i, (doc_id, changed) in enumerate(zip(block["doc_ids"], block["tampered"], strict=True)):
        leaf = block["levels"][0][i * SIZE : (i + 1) * SIZE].hex()
        yield doc_id, leaf, leaf if changed is None else changed.hex(), [*witness(block["levels"], i), *over]


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, witness: the other nodes of each run on the way to the root) of every row."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "source", "leaf", "subroot", "root", "witness"]
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.StringType()) for c in names[1:5]] + [T.StructField("witness", STEPS)])

    def run(batches):
        import pyarrow as pa

        steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                rows = list(_rows(block))
                source = block["key"][1:] if block["key"] else None
                cells = [pa.array([x[0] for x in rows], batch.schema.field("doc_ids").type.value_type), pa.array([source] * len(rows), pa.string()), pa.array([x[1] for x in rows])]
                cells += [pa.array([block[c].hex()] * len(rows)) for c in ("subroot", "root")]
                cells += [pa.array([[{"before": b, "after": a} for b, a in x[3]] for x in rows], steps)]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    return blocks(docs, height).mapInArrow(run, schema)


def verify(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every row with its leaf, subroot, root and the digest of its witness, and the root that the row gives after tampering.

    Rows whose id's crc32 is divisible by 5 (a null id counts as empty text) have A-Z of their text lower-cased, the others
    stay; folded_root is recomputed from that leaf and the original witness, verified says whether it is the root.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.StringType()) for c in names[1:6]] + [T.StructField("verified", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                root, subroot = block["root"].hex(), block["subroot"].hex()
                found = []
                for doc_id, leaf, changed, steps in _rows(block):
                    proof = hashlib.sha256("".join(b + a for b, a in steps).encode()).hexdigest()
                    folded = fold(changed, steps)
                    found.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
                kinds = [batch.schema.field("doc_ids").type.value_type, *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return blocks(docs, height).mapInArrow(run, schema)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: crc32 of a text, from its bytes
CRC_SQL = """xor(list_reduce([4294967295] || list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

MERKLE_SQL = f"""WITH RECURSIVE leaf AS (SELECT *, row_number() OVER () AS rid, coalesce('s' || source, '') AS key, {_leaf_sql("text")} AS leaf,
  CASE WHEN {CRC_SQL.format(text="coalesce(CAST(doc_id AS VARCHAR), '')")} % {TAMPERED} = 0 AND text IS NOT NULL THEN {_leaf_sql(_LOWERED)} END AS tampered FROM documents),
p AS (SELECT rid, doc_id, key, leaf, coalesce(tampered, leaf) AS changed, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
up AS (SELECT 0 AS level, key, pos, leaf AS digest, count(*) OVER (PARTITION BY key) AS n FROM p
  UNION ALL SELECT level + 1, key, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY level, key, pos // 16),
sub AS (SELECT key, digest AS subroot, level AS height, row_number() OVER (ORDER BY key) - 1 AS pos FROM up WHERE n = 1),
over_ AS (SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM over_ WHERE n > 1 GROUP BY level, pos // 16),
node AS (SELECT key, level, pos, digest FROM up WHERE n > 1 UNION ALL SELECT NULL, level, pos, digest FROM over_ WHERE n > 1),
side AS (SELECT a.key, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM node a JOIN node b ON a.key IS NOT DISTINCT FROM b.key AND a.level = b.level AND a.pos // 16 = b.pos // 16 GROUP BY a.key, a.level, a.pos),
hop AS (SELECT key, level, pos, before, after, true AS hashed, key AS to_key, level + 1 AS to_level, pos // 16 AS to_pos FROM side
  UNION ALL SELECT key, height, 0, '', '', false, NULL, 0, pos FROM sub),
walk AS (SELECT rid, key AS at_key, 0 AS level, pos, changed AS digest, '' AS proof FROM p
  UNION ALL SELECT w.rid, h.to_key, h.to_level, h.to_pos, CASE WHEN h.hashed THEN sha256(h.before || w.digest || h.after) ELSE w.digest END, w.proof || h.before || h.after
  FROM walk w JOIN hop h ON h.key IS NOT DISTINCT FROM w.at_key AND h.level = w.level AND h.pos = w.pos),
ended AS (SELECT w.* FROM walk w WHERE at_key IS NULL AND level = (SELECT max(level) FROM over_))
SELECT p.doc_id, p.leaf, sub.subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM p JOIN sub ON p.key = sub.key JOIN ended e ON p.rid = e.rid CROSS JOIN (SELECT digest FROM over_ WHERE n = 1) r"""
