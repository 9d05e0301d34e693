"""Removes passages that repeat, word for word, anywhere in the corpus.

A window is `window` consecutive words of one document. Its anchor is the run of ANCHOR words in it whose hash is least,
so equal windows have equal anchors at the same place and about one run in fifteen is an anchor at all.

1. Confirm: anchors are counted; windows whose anchor occurs once cannot recur. The others meet by anchor and hash of the
   window (128 bits together), packed by anchor; those that start in two places are confirmed, for each part of the corpus
   that holds them. One of these parts names the first words of their anchors: the phrases.
2. Deal: a phrase goes to the parts that hold a confirmed window around it, and to no other.
3. Locate: all documents stream past the phrases of their part. For each chunk of text those whose anchors it has are compiled into
   Aho-Corasick automata of a bounded number of phrases; an automaton finds every occurrence of a phrase, the windows around
   it are held against the part's confirmed ones, and words of those that are there go. Stretches of a text around an
   anchor of the automaton are run through it.

Words are coded as 16 bits in an automaton, so that its nodes have at most 256 children; what such a code takes for a
phrase without being it fails at the confirmed windows. A part is rows of one file of the table that step 1 writes; its
anchors, windows and phrases come back in a folder of its own and are read with its text only, so that all work
grows with the text, however much of it repeats.

Definitions. Words are runs of characters other than ASCII white space, unchanged. A window goes if its words also start
at another place, in the same document or row or any other; rows that repeat count as places of their own, overlapping
windows too. Null, empty and blank texts and those of fewer words than a window lose nothing. Columns other than
doc_id and text take no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import file_system, freed, materialise, parts, shared_dir

WINDOW, ANCHOR = 35, 8
CODED = 5  # words at the start of an anchor that an automaton knows as the phrase
CHUNK = 1 << 21  # bytes of text held at a time
LONG = 64  # bytes of a word that are hashed along with all other words'
PART = 13  # bits of a row's number within a part
HOT, SALTS = 1000, 64  # windows of anchors met so often are dealt singly, by their own hash
SHARD = 50_000  # phrases of an automaton


def word_hashes(data: bytes):
    """(hashes, starts, ends) of the words of a text in bytes: byte by byte for all words at once, long words one by one."""
    import numpy as np
    import xxhash

    of = np.frombuffer(data, np.uint8)
    white = (of == 32) | ((of >= 9) & (of <= 13))
    edges = np.flatnonzero(np.diff(np.r_[np.True_, white, np.True_]))
    starts, ends = edges[::2].astype(np.int32), edges[1::2].astype(np.int32)
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LONG + 1).astype(np.int16), kind="stable")
    at, hashes = starts[order], sizes[order].astype(np.uint64)
    lengths = sizes[order]
    for k in range(min(int(lengths[0]) if len(lengths) else 0, LONG)):
        n = int(np.searchsorted(-lengths, -k, "left"))  # words with more than k bytes come first
        step = (hashes[:n] ^ of[at[:n] + k]) * np.uint64(0x9E3779B97F4A7C15)
        hashes[:n] = step ^ (step >> np.uint64(32))
    for i in range(int(np.searchsorted(-lengths, -LONG, "left"))):
        hashes[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + lengths[i]])
    found = np.empty_like(hashes)
    found[order] = hashes * np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29)), starts, ends


def mix(x, y):
    """One hash of two in order, elementwise."""
    import numpy as np

    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def grams(words, size: int):
    """Hashes of all runs of `size` consecutive words, from hashes of runs of powers of two."""
    n, k, at, found = max(0, len(words) - size + 1), 1, 0, None
    while n:
        if size & k:
            piece = words[at : at + n]
            found = piece if found is None else mix(found, piece)
            at += k
        if 2 * k > size:
            return found
        words, k = mix(words[:-k], words[k:]), 2 * k
    return words[:0]


def sliding(values, size: int, take):
    """take (minimum or maximum) of all runs of `size` consecutive values."""
    k = 1
    while 2 * k <= size and len(values) > k:
        values, k = take(values[:-k], values[k:]), 2 * k
    rest = size - k
    return take(values[: len(values) - rest], values[rest:]) if rest else values


class Chunk:
    """Some texts as one sequence of word hashes: its windows, their anchors and which windows lie within one text."""

    def __init__(self, texts: list, window: int) -> None:
        import numpy as np

        self.window, self.reach = window, window - ANCHOR + 1
        pieces = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(pieces)
        self.words, self.starts, self.stops = word_hashes(self.data)
        borders = np.cumsum([len(p) + 1 for p in pieces])
        self.doc = np.searchsorted(borders, self.starts, "right").astype(np.int32)
        self.sizes = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = grams(self.words, window)
        n = len(self.hashes)
        self.grams = grams(self.words, ANCHOR)
        self.anchors = sliding(self.grams, self.reach, np.minimum) if n else self.hashes
        self.valid = np.arange(n) + window <= self.ends[self.doc[:n]] if n else np.zeros(0, bool)

    def anchor_hashes(self):
        """The hash of each place that is the anchor of a window."""
        import numpy as np

        if not len(self.hashes):
            return self.hashes
        none = np.zeros(self.reach - 1, np.uint64)
        most = sliding(np.concatenate([none, np.where(self.valid, self.anchors, np.uint64(0)), none]), self.reach, np.maximum)
        return self.grams[(most == self.grams) & (most > 0)]


def runs_of_parts(batches, text: int, part: int):
    """(part, batch of rows of it) of batches, cut so that texts stay under CHUNK bytes."""
    import numpy as np

    for b in parts(batches, text, CHUNK):
        of = b.column(part).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start < end:
                yield int(of[start]), b.slice(start, end - start)


def chunks(batches, window: int):
    """(part, Chunk) of batches (text, part)."""
    for part, b in runs_of_parts(batches, 0, 1):
        yield part, Chunk(b.column(0).to_pylist(), window)


def stored(folder: str, part: int, columns: list[str]):
    """What a folder written by part holds of one, as numpy columns."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyarrow import fs as afs

    fs, path = file_system(f"{folder}/part={part}")
    files = [f.path for f in fs.get_file_info(afs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(fs.open_input_file(f), columns=columns) for f in files]
    return [np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in tables] or [np.zeros(0, np.int64)]) for c in columns]


def unstored(folder: str) -> None:
    fs, path = file_system(folder)
    fs.delete_dir(path)


def held(values, of):
    """Which values are among sorted ones."""
    import numpy as np

    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    return of[np.minimum(at, len(of) - 1)] == values


def both_held(h, m, of_h, of_m):
    """Which pairs are among pairs sorted by the first and then the second."""
    import numpy as np

    at, found = np.searchsorted(of_h, h), np.zeros(len(h), bool)
    while True:
        inside = at < len(of_h)
        near = np.minimum(at, max(len(of_h) - 1, 0))
        same = inside & (of_h[near] == h) if len(of_h) else inside
        if not same.any():
            return found
        found |= same & (of_m[near] == m) if len(of_m) else False
        at = np.where(same, at + 1, len(of_h))


def by_part(rows: DataFrame, label: str) -> str:
    """Writes rows in a folder for each part."""
    path = shared_dir(rows.sparkSession, label)
    with freed(rows.sparkSession):
        rows.repartition("part").sortWithinPartitions("part", "anchor").write.partitionBy("part").parquet(path)
    return path


def recurring_anchors(parted: DataFrame, window: int, hot: int = HOT) -> DataFrame:
    """(part, anchor, hot) of the anchors that occur in two places or more, for each part that holds them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, c in chunks(batches, window):
            anchors, n = np.unique(c.anchor_hashes(), return_counts=True)
            cells = [pa.array(anchors.view(np.int64)), pa.array(np.full(len(n), part, np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cells, names=["anchor", "part", "n"])

    rows = parted.select("text", "part").mapInArrow(run, "anchor long, part long, n int")
    rows = rows.withColumn("all", F.sum("n").over(W.partitionBy("anchor"))).where("`all` > 1")
    return rows.groupBy("part", "anchor").agg((F.max("all") >= hot).alias("hot"))


def recurring_windows(parted: DataFrame, anchors: str, window: int) -> DataFrame:
    """(part, anchor, hash, first) of each window that starts in two places or more, for each part that holds it; first is true for one of these."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, of, hot = None, None, None
        for part, c in chunks(batches, window):
            if part != at:
                of, hot = stored(anchors, part, ["anchor", "hot"])
                order = np.argsort(of.view(np.uint64))
                at, of, hot = part, of.view(np.uint64)[order], hot[order].astype(bool)
            kept = np.flatnonzero(c.valid)
            kept = kept[held(c.anchors[kept], of)]
            m, h = c.anchors[kept], c.hashes[kept]
            order = np.lexsort((h, m))
            m, h = m[order], h[order]
            new = np.r_[True, (m[1:] != m[:-1]) | (h[1:] != h[:-1])][: len(m)]
            first = np.flatnonzero(new)
            n = np.minimum(np.diff(np.r_[first, len(m)]), 2).astype(np.int8)
            m, h = m[first], h[first]
            salt = np.where(hot[np.searchsorted(of, m)], (h % np.uint64(SALTS)).astype(np.int32), -1) if len(m) else np.zeros(0, np.int32)
            order = np.lexsort((salt, m))
            m, h, n, salt = m[order], h[order], n[order], salt[order].astype(np.int32)
            starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (salt[1:] != salt[:-1])][: len(m)])
            ends = pa.array(np.r_[starts, len(m)].astype(np.int32))
            cells = [pa.array(m[starts].view(np.int64)), pa.array(salt[starts]), pa.array(np.full(len(starts), part, np.int64))]
            cells += [pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(n))]
            yield pa.RecordBatch.from_arrays(cells, names=["anchor", "salt", "part", "hashes", "ns"])

    packed = parted.select("text", "part").mapInArrow(run, "anchor long, salt int, part long, hashes array<long>, ns array<byte>")
    dealt = packed.repartition("anchor", "salt").select("anchor", "salt", "part", "ns", F.posexplode("hashes").alias("k", "hash"))
    same = W.partitionBy("anchor", "salt", "hash")
    counted = dealt.select("anchor", "salt", "part", "hash", F.sum(F.expr("ns[k]")).over(same).alias("n"), F.min("part").over(same).alias("least"))
    kept = counted.where("n > 1").groupBy("anchor", "salt", "hash", "part").agg(F.min("least").alias("least"))
    return kept.select("part", "anchor", "hash", (F.col("part") == F.col("least")).alias("first"))


def confirmed(folder: str, part: int):
    """(hashes, anchors, which are first) of a part's confirmed windows, ordered by hash and anchor."""
    import numpy as np

    m, h, first = stored(folder, part, ["anchor", "hash", "first"])
    m, h = m.view(np.uint64), h.view(np.uint64)
    order = np.lexsort((m, h))
    return h[order], m[order], first[order].astype(bool)


def phrases(parted: DataFrame, windows: str, window: int) -> DataFrame:
    """(anchor, words: the phrase as codes) of the confirmed windows, from the part that each names first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, of_h, of_m = None, None, None
        for part, c in chunks(batches, window):
            if part != at:
                of_h, of_m, first = confirmed(windows, part)
                at, of_h, of_m = part, of_h[first], of_m[first]
            kept = np.flatnonzero(c.valid)
            kept = kept[both_held(c.hashes[kept], c.anchors[kept], of_h, of_m)]
            m, once = np.unique(c.anchors[kept], return_index=True)
            kept = kept[once]
            around = kept[:, None] + np.arange(c.reach)
            place = kept + (c.grams[around] == m[:, None]).argmax(axis=1) if len(kept) else kept
            codes = c.words[place[:, None] + np.arange(CODED)].astype("<u2") if len(kept) else np.zeros((0, CODED), "<u2")
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array([x.tobytes() for x in codes], pa.binary())], names=["anchor", "words"])

    return parted.select("text", "part").mapInArrow(run, "anchor long, words binary")


def phrases_by_part(parted: DataFrame, windows: str, window: int) -> DataFrame:
    """(part, anchor, words): each phrase for the parts that hold a confirmed window around it."""
    holds = parted.sparkSession.read.schema("anchor long, hash long, first boolean, part long").parquet(windows).select("part", "anchor").distinct()
    return holds.join(phrases(parted, windows, window).distinct(), "anchor").select("part", "anchor", "words")


def spread(starts, length: int, n: int):
    """Which of n places lie in a run of `length` from one of the starts."""
    import numpy as np

    edges = np.zeros(n + length + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def locate(c: Chunk, of_h, of_m, anchors, words, shard: int):
    """Which words of a chunk lie in a confirmed window (of_h, of_m); anchors, in order, and the words of the phrases."""
    import ahocorasick
    import numpy as np

    n, gone = len(c.words), np.zeros(len(c.words), bool)
    coded = c.words.astype("<u2")
    c.words = c.grams = None  # what is needed of them is at hand
    if not len(anchors) or not c.valid.any():
        return gone
    runs = np.flatnonzero(np.r_[True, c.anchors[1:] != c.anchors[:-1]][: len(c.anchors)])  # of windows with one anchor
    own, sizes = c.anchors[runs], np.diff(np.r_[runs, len(c.anchors)])
    here = np.flatnonzero(held(anchors, np.unique(own)))
    for at in range(0, len(here), shard):
        some = here[at : at + shard]
        near = np.flatnonzero(np.repeat(held(own, anchors[some]), sizes) & c.valid)
        if not len(near):
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in some.tolist():
            automaton.add_word(words[i].decode("latin-1"), 1)
        automaton.make_automaton()
        chosen = np.flatnonzero(spread(near, c.window, n))
        codes = coded[chosen].tobytes().decode("latin-1")
        ends = np.fromiter((end for end, _ in automaton.iter(codes)), np.int64)
        del automaton, codes
        ends = ends[ends % 2 == 1] // 2  # the place of the last word, where both of its bytes ended
        starts = chosen[ends - (CODED - 1)]
        first = np.maximum(starts - c.reach + 1, 0)
        asked = np.flatnonzero(spread(first[first < len(c.valid)], c.reach, len(c.valid)) & c.valid)
        asked = asked[both_held(c.hashes[asked], c.anchors[asked], of_h, of_m)]
        gone |= spread(asked, c.window, n)
    return gone


def cut(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, spans: first and last place of each run of removed words, kept: the others joined by one space) of every row."""
    number = F.monotonically_increasing_id()
    parted = materialise(docs.select("doc_id", "text", F.shiftright(number, PART).alias("part")), "phrase-parts")
    anchors = by_part(recurring_anchors(parted, window, hot), "phrase-anchors")
    windows = by_part(recurring_windows(parted, anchors, window), "phrase-windows")
    unstored(anchors)
    dealt = by_part(phrases_by_part(parted, windows, window), "phrase-dealt")
    kind = docs.schema["doc_id"].dataType
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        at, held_there = None, ()
        for part, b in runs_of_parts(batches, 1, 2):
            if part != at:
                of_h, of_m, _ = confirmed(windows, part)
                phrase, words = stored(dealt, part, ["anchor", "words"])
                order = np.argsort(phrase.view(np.uint64))
                at, held_there = part, (of_h, of_m, phrase.view(np.uint64)[order], words[order])
            texts = b.column(1).to_pylist()
            c = Chunk(texts, window)
            gone = locate(c, *held_there, shard)
            removed, spans, kept = [], [], []
            for end, size in zip(c.ends.tolist(), c.sizes.tolist(), strict=True):
                mask = gone[end - size : end]
                turns = np.flatnonzero(np.diff(np.r_[False, mask, False])).reshape(-1, 2)
                removed.append(int(mask.sum()))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in turns])
                stays = np.flatnonzero(np.diff(np.r_[False, ~mask, False])).reshape(-1, 2) + (end - size)
                kept.append(b" ".join(w for x, y in stays for w in c.data[c.starts[x] : c.stops[y - 1]].split()).decode("utf-8", "surrogatepass"))
            cells = [b.column(0), pa.array(c.sizes), pa.array(removed, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return parted.select("doc_id", "text", "part").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


PHRASES_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT rid, unnest(range(0, len(w) - {WINDOW - 1})) AS pos, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT rid, pos, md5(array_to_string(w[pos + 1 : pos + {WINDOW}], ' ')) AS h FROM s),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT rid, list(DISTINCT i) AS gone FROM (SELECT rid, unnest(range(pos, pos + {WINDOW})) AS i FROM r) GROUP BY rid),
k AS (SELECT d.rid, doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (rid)),
p AS (SELECT k.rid, i, w[i + 1] AS word FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM k) k LEFT JOIN (SELECT rid, unnest(gone) AS i FROM g) x USING (rid, i) WHERE x.i IS NULL),
j AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM p GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN j USING (rid)"""
