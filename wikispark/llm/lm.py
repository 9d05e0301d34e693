"""Interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

Words are 56-bit hashes. Texts become events (u, v, w): a word with the two before it. An event belongs to the cell of its
middle word v, where the sums by (u, v, w), (u, v), (v, w) and v are whole; a word v so frequent that it would overfill
its cell (more than an even share of all tokens) is dealt over several cells by u, and only its (v, w) sums are added up
once more, dealt by w. Tasks combine what they have read before anything is shuffled. The cells are counted in PASSES
passes, each of which shuffles its share of the events and then frees the shuffle, so that the disk holds one share and
the model. A cell writes three sorted arrays to the shared folder, of trigrams, contexts and bigrams, and passes on sums
by word, which are added up by word and written as sorted arrays too. Scoring maps the arrays, which all workers of a
machine share, and looks up each distinct n-gram of a batch once.

    p(w | u v) = max(c(u v w) - D(c), 0) / c(u v) + (D1 N1(u v) + D2 N2(u v) + D3 N3+(u v)) / c(u v) * p(w | v)
    p(w | v)   = max(k(v w) - E(k), 0) / k(v .)   + (E1 N1(v) + E2 N2(v) + E3 N3+(v)) / k(v .) * p(w)
    p(w)       = max(k(w) - G(k), 0) / K          + (G1 M1 + G2 M2 + G3 M3+) / K * 1 / (V + 1)

c counts events, k(v w) the distinct words before v w (after a start: its count), k(v .) sums them, k(w) the distinct words
before w, K all distinct pairs; N and M say how many counts are 1, 2 and more; D, E and G are the discounts from counts
of counts. An unseen context leaves the shorter one; an unseen word has k = 0, the 1 in V + 1. The arrays keep 32 bits of
a key beside its bucket of about eight keys: an unseen n-gram is taken for a seen one with a probability of 2e-9.

Each text has two starts before and an end after it. Definitions: tokens are runs of characters other than ASCII white
space, A-Z lower-cased, then one end; null and empty texts are one end. Without training texts N and V are 0 and both
scores 0. Rows that repeat a document are counted and scored as often as they stand there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import file_system, freed, materialise, parts, remove, row_bucket, shared_dir, write_file

CELL_BYTES = 12_000_000  # of training text for each cell
PASSES = 3
TEXT_BYTES, EVENTS = 2_000_000, 250_000  # of text read, and of events counted or scored, at a time
PIECE = 1 << 18  # bytes hashed at a time
KEPT = 256_000_000  # bytes of arrays that a worker keeps where files cannot be mapped
MASK = (1 << 56) - 1
START, END = 0x5EED0000000001, 0x5EED0000000002  # hashes of no word but by chance

#: What a word has: its count, distinct words before it, and as a context the sum and the counts 1, 2 and more of its pairs.
WORD = ("c", "k", "pairs", "n1", "n2", "n3")
TOTALS = ["tokens", "vocabulary", "texts", "t1", "t2", "t3", "t4", "b1", "b2", "b3", "b4", "k1", "k2", "k3", "k4", "more", "pairs"]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals. Small: it goes to the tasks as it is."""

    folder: str
    cells: int
    parts: int  # of the word arrays
    tokens: int
    vocabulary: int
    texts: int
    pairs: int
    discounts: tuple[tuple[float, float, float], ...]  # of trigrams, bigrams and words
    left: float  # mass for the uniform distribution


# words to hashes


@lru_cache
def _tables():
    """(number of each byte, zero for white space; powers of an odd base; those of its inverse; which bytes are white space)."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    fold, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    fold[65:91] += 32
    space[[9, 10, 11, 12, 13, 32]] = True
    of_byte = (np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))[fold]
    of_byte[space] = 0
    powers, back = (np.cumprod(np.array([1] + [b] * PIECE, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
    return of_byte, powers, back, space


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def joined(a, b):
    """One hash of two."""
    import numpy as np

    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b))


def word_hashes(raw: bytes):
    """(hash, first byte) of every word of raw: the sum of a number for each byte times a power for its place, mixed."""
    import numpy as np

    of_byte, powers, back, white = _tables()
    sums, starts = [np.zeros(1, np.uint64)], [np.full(1, -1)]
    cut = None  # the power at which a word that a piece has cut goes on
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
        space = white[b]
        value = of_byte[b] * powers[: len(b)]
        first = np.flatnonzero(~space & np.concatenate([[cut is None], space[:-1]]))
        if cut is not None:
            sums[-1][-1:] += value[: first[0] if len(first) else None].sum(dtype=np.uint64) * cut
        if len(first):
            sums.append(np.add.reduceat(value, first) * back[first])
            starts.append(first + at)
        if space[-1]:
            cut = None
        elif len(first):
            cut = powers[len(b) - first[-1] :][:1]
        else:
            cut = cut * powers[len(b) :][:1]
    return mixed(np.concatenate(sums)[1:]) & np.uint64(MASK), np.concatenate(starts)[1:]


def events(texts: list[str | None]):
    """(hashes of the distinct words; u, v, w as places among them; tokens of each text): every token with the two before it."""
    import numpy as np
    import pandas as pd

    own = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    h, at = word_hashes(b"\n".join(own))
    codes, found = pd.factorize(h)
    ids = np.concatenate([found, np.array([START, END], np.uint64)])
    ends = np.cumsum([len(t) + 1 for t in own])
    counts = np.diff(np.searchsorted(at, ends), prepend=0) + 1
    last = np.cumsum(counts) - 1
    w = np.full(int(counts.sum()), len(found) + 1, np.int32)
    word = np.ones(len(w), bool)
    word[last] = False
    w[word] = codes
    v = np.roll(w, 1)
    v[last - counts + 1] = len(found)
    u = np.roll(v, 1)
    u[last - counts + 1] = len(found)
    return ids, u, v, w, counts


def distinct(keys):
    """(the distinct keys in order of appearance, the place of the first of each, which of them each key is)."""
    import numpy as np
    import pandas as pd

    back, key = pd.factorize(keys)
    first = np.zeros(len(key), np.int64)
    first[back[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return key, first, back


# sorted arrays in files


def write_table(uri: str, keys, fields, default) -> None:
    """Distinct sorted keys, in buckets by their first bits; only rows that differ from `default` keep their fields."""
    import numpy as np

    bits = max(0, int(np.ceil(np.log2(max(len(keys), 8) / 8))))
    top = keys >> np.uint64(32 - bits)
    bucket, low = top >> np.uint64(32), (top & np.uint64(0xFFFFFFFF)).astype("<u4")
    offsets = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4")
    other = np.flatnonzero(np.any([f != d for f, d in zip(fields, default, strict=True)], axis=0)).astype("<u4")
    fields = [f[other] for f in fields]
    kinds = [next(k for k in (1, 2, 4, 8) if not len(f) or int(f.max()) < 1 << 8 * k) for f in fields]
    head = np.array([len(keys), bits, len(other), *kinds], "<i8")
    write_file(uri, lambda out: [out.write(x.tobytes()) for x in (head, offsets, low, other, *(f.astype(f"<u{k}") for f, k in zip(fields, kinds, strict=True)))])


class Table:
    """A file of `write_table`, mapped where the file system allows it."""

    def __init__(self, whole, default):
        import numpy as np

        self.default, at = default, 8 * (3 + len(default))
        self.n, self.bits, others, *kinds = whole[:at].view("<i8").tolist() if len(whole) else [0, 0, 0]
        arrays = []
        for kind, n in zip(("<u4", "<u4", "<u4", *(f"<u{k}" for k in kinds)), ((1 << self.bits) + 1, self.n, others, *[others] * len(kinds)), strict=True) if len(whole) else ():
            arrays.append(whole[at : at + n * np.dtype(kind).itemsize].view(kind))
            at += n * np.dtype(kind).itemsize
        self.offsets, self.low, self.other, *self.fields = arrays or [None] * 3

    def find(self, keys):
        """The fields of each key, zeros where it is absent."""
        import numpy as np

        out = [np.zeros(len(keys), np.int64) for _ in self.default]
        if not self.n:
            return out
        top = keys >> np.uint64(32 - self.bits)
        bucket, low = (top >> np.uint64(32)).astype(np.int64), (top & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        a, b = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        end = b.copy()
        while (a < b).any():
            mid = (a + b) // 2
            less = (self.low[np.minimum(mid, self.n - 1)] < low) & (a < b)
            a, b = np.where(less, mid + 1, a), np.where(less, b, np.minimum(mid, b))
        hit = np.flatnonzero((a < end) & (self.low[np.minimum(a, self.n - 1)] == low))
        place = np.searchsorted(self.other, a[hit].astype(np.uint32))
        kept = place < len(self.other)
        kept[kept] = self.other[place[kept]] == a[hit][kept]
        for o, d, f in zip(out, self.default, self.fields, strict=True):
            o[hit] = d
            o[hit[kept]] = f[place[kept]]
        return out


_OPEN: dict[str, tuple[int, Table]] = {}


def table_of(uri: str, default) -> Table:
    import numpy as np
    from pyarrow import fs as pafs

    if uri not in _OPEN:
        fs, path = file_system(uri)
        there = fs.get_file_info(path).type == pafs.FileType.File
        held, whole = 0, np.zeros(0, np.uint8)
        if there and isinstance(fs, pafs.LocalFileSystem):
            whole = np.memmap(path, np.uint8, "r")
        elif there:  # no mapping: read, and keep a bounded number of bytes
            with fs.open_input_stream(path, compression=None) as stream:
                whole = np.frombuffer(stream.read(), np.uint8)
            held = len(whole)
        if len(_OPEN) > 8192 or sum(x for x, _ in _OPEN.values()) + held > KEPT:
            _OPEN.clear()
        _OPEN[uri] = held, Table(whole, default)
    return _OPEN[uri][1]


def find_in(uri, part, keys, default) -> list:
    """The fields of distinct keys; uri(part) is the file in which each key would be."""
    import numpy as np

    out = [np.zeros(len(keys), np.int64) for _ in default]
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)], strict=True):
        mine = order[a:b]
        for o, x in zip(out, table_of(uri(int(part[mine[0]])), default).find(keys[mine]), strict=True):
            o[mine] = x
    return out


ONE, CONTEXT, WORD_ROW = (1,), (1, 1, 0, 0), (1, 1, 1, 1, 0, 0)


def spread(folder: str, v):
    """Over how many cells the events of each middle word are dealt."""
    import numpy as np

    return np.maximum(table_of(f"{folder}/hot", ONE).find(mixed(v))[0], 1)


def cell_of(v, ways, other, cells: int):
    import numpy as np

    salt = np.where(ways > 1, (mixed(other) % ways.astype(np.uint64)), np.uint64(0)).astype(np.uint64)
    return (mixed(v + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)).astype(np.int64)


# counting


def added(key, values):
    """(place of the first of each distinct key in order of the keys, the sums of each value array)."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), np.diff(key[order]) != 0]))
    return order[at], [np.add.reduceat(x[order], at) if len(at) else x[:0] for x in values]


def counts_of_counts(c) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts; 0.5, 1 and 1.5 where the counts of counts are too few to tell."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))  # type: ignore[return-value]


def _frequent(cells: int):
    """(word, count) of the words that take more than a quarter of a cell's share of what a task has read; at most 4 * cells a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in (b for b in parts(batches, 0, TEXT_BYTES) if b.num_rows):
            ids, _, v, _, _ = events(b.column(0).to_pylist())
            n = np.bincount(v, minlength=len(ids))
            much = n >= max(2, len(v) / (4 * cells))
            yield pa.RecordBatch.from_arrays([pa.array(ids[much].view(np.int64)), pa.array(n[much]), pa.array([len(v)] + [0] * (int(much.sum()) - 1) if much.any() else [], pa.int64())], names=["word", "n", "tokens"])

    return run


def _count(folder: str, cells: int, passes: int, turn: int):
    def packed7(x):
        import numpy as np

        return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in (b for b in parts(batches, 0, TEXT_BYTES) if b.num_rows):
            ids, *whole, _ = events(b.column(0).to_pylist())
            ways = spread(folder, ids)
            for i in range(0, len(whole[0]), EVENTS):
                of_v = ways[whole[1][i : i + EVENTS]]
                u, v, w = (ids[x[i : i + EVENTS]] for x in whole)
                cell = cell_of(v, of_v, u, cells)
                mine = cell % passes == turn
                if not mine.any():
                    continue
                u, v, w, cell = u[mine], v[mine], w[mine], cell[mine]
                first, (n,) = added(joined(joined(u, v), w), (np.ones(len(u), np.int64),))
                order = np.lexsort((v[first], cell[first]))
                first, n = first[order], n[order]
                u, v, w, cell = u[first], v[first], w[first], cell[first]
                at = np.flatnonzero(np.diff(cell, prepend=-1))
                blocks = [(int(cell[a]), packed7(u[a:e]), packed7(v[a:e]), packed7(w[a:e]), n[a:e].astype("<u4").tobytes()) for a, e in zip(at, [*at[1:], len(cell)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), [pa.int32()] + [pa.binary()] * 4, strict=True)], names=["cell", "u", "v", "w", "n"])

    return run


def _bytes(column) -> bytes:
    return b"".join(x for x in column.to_pylist() if x)


def _unpacked7(column):
    import numpy as np

    raw = np.frombuffer(_bytes(column), np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view("<u8").ravel()


SUMS = "kind int, part int, h binary, " + ", ".join(f"{f} binary" for f in WORD)
HOT_PAIRS, WORDS, COUNTS = 0, 1, 2  # kinds of rows


def _rows(rows):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "part", "h", *WORD])


def _by_part(kind: int, part, arrays) -> list:
    """A row for each part, with the bytes of its own elements."""
    import numpy as np

    arrays = [*arrays, *[None] * (7 - len(arrays))]
    return [(kind, int(p), *(None if x is None else x[part == p].tobytes() for x in arrays)) for p in np.unique(part)]


def _word_sums(words: int, v, w, k, tokens=None) -> list:
    """The sums by word of distinct pairs (v, w) with their k, and of (words, counts) if given."""
    import numpy as np

    zero, one = np.zeros(len(k), np.int64), np.ones(len(k), np.int64)
    rows = [(w, zero, one, zero, zero, zero, zero), (v, zero, zero, k, (k == 1) * one, (k == 2) * one, (k > 2) * one)]
    if tokens:
        nothing = np.zeros(len(tokens[0]), np.int64)
        rows.append((tokens[0], tokens[1], *[nothing] * 5))
    h, *values = (np.concatenate(x) for x in zip(*rows, strict=True))
    first, values = added(h, values)
    return _by_part(WORDS, (mixed(h[first]) % np.uint64(words)).astype(np.int64), [h[first], values[0].astype("<u8"), values[1].astype("<u4"), values[2].astype("<u8"), *(x.astype("<u4") for x in values[3:])])


def _add_events(folder: str, cells: int, words: int):
    def run(table):
        import numpy as np

        cell = table.column("cell")[0].as_py()
        u, v, w = (_unpacked7(table.column(c)) for c in "uvw")
        n = np.frombuffer(_bytes(table.column("n")), "<u4").astype(np.int64)
        key = joined(joined(u, v), w)
        first, (n,) = added(key, (n,))
        u, v, w = u[first], v[first], w[first]
        write_table(f"{folder}/trigrams-{cell:07d}", key[first], [n], ONE)
        of = counts_of_counts(n)
        key, one = joined(u, v), np.ones(len(n), np.int64)
        first, sums = added(key, (n, (n == 1) * one, (n == 2) * one, (n > 2) * one))
        write_table(f"{folder}/contexts-{cell:07d}", key[first], sums, CONTEXT)
        key = joined(v, w)
        first, (k,) = added(key, (np.where(v == START, n, 1),))
        pv, pw, hot = v[first], w[first], spread(folder, v[first]) > 1
        write_table(f"{folder}/bigrams-{cell:07d}", key[first][~hot], [k[~hot]], ONE)
        to = cell_of(pv[hot], spread(folder, pv[hot]), pw[hot], cells)
        rows = _by_part(HOT_PAIRS, to, [pv[hot], pw[hot], k[hot]])
        first, (c,) = added(v, (n,))
        ends = int(n[w == END].sum())
        rows += _word_sums(words, pv[~hot], pw[~hot], k[~hot], (np.append(v[first], np.uint64(END)), np.append(c, ends)))
        rows.append((COUNTS, cell % words, np.array([*of, *counts_of_counts(k[~hot]), int((~hot).sum())], "<i8").tobytes(), *[None] * 6))
        return _rows(rows)

    return run


def _add_hot(folder: str, words: int):
    def run(table):
        import numpy as np

        cell = table.column("part")[0].as_py()
        v, w, k = (np.frombuffer(_bytes(table.column(c)), t) for c, t in (("h", "<u8"), ("c", "<u8"), ("k", "<i8")))
        key = joined(v, w)
        first, (k,) = added(key, (k,))
        write_table(f"{folder}/hot-bigrams-{cell:07d}", key[first], [k], ONE)
        return _rows([*_word_sums(words, v[first], w[first], k), (COUNTS, cell % words, np.array([0, 0, 0, 0, *counts_of_counts(k), len(k)], "<i8").tobytes(), *[None] * 6)])

    return run


def _add_words(folder: str):
    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part = table.column("part")[0].as_py()
        sums = table.filter(pc.equal(table.column("kind"), WORDS))
        h, c, k, pairs, *n = (np.frombuffer(_bytes(sums.column(f)), t).astype(t if f == "h" else np.int64) for f, t in zip(("h", *WORD), ("<u8", "<u8", "<u4", "<u8", "<u4", "<u4", "<u4"), strict=True))
        key = mixed(h)
        first, values = added(key, (c, k, pairs, *n))
        write_table(f"{folder}/words-{part:07d}", key[first], values, WORD_ROW)
        counted = np.frombuffer(_bytes(table.filter(pc.equal(table.column("kind"), COUNTS)).column("h")), "<i8").reshape(-1, 9).sum(axis=0).tolist()
        h, c, k = h[first], values[0], values[1]
        own = h != START
        row = [part, int(c[own].sum()), int((c[own] > 0).sum()), int(c[h == END].sum()), *counted[:8], *counts_of_counts(k), int((k > 2).sum()), counted[8]]
        return pa.table([pa.array([x], pa.int64()) for x in row], names=["part", *TOTALS])

    return run


def train(docs: DataFrame, cell_bytes: int = CELL_BYTES, passes: int = PASSES) -> Model:
    """The model of all texts in docs."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    texts = docs.select("text")
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(1, ceil(volume / cell_bytes))
    words = max(1, cells // 4)
    if cells > 1:  # a list of at most `cells` words, since each of them has at least that share of all tokens
        seen = materialise(texts.mapInArrow(_frequent(cells), "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")), "lm-frequent")
        share = max(1, (seen.agg(F.sum("tokens")).first()[0] or 0) / cells)
        hot = seen.where(F.col("n") >= share).select("word", F.ceil(2 * F.col("n") / share).alias("ways")).toPandas()
        write_hot(folder, hot["word"].to_numpy("int64"), hot["ways"].to_numpy("int64"))
    levels = []
    for turn in range(passes):
        blocks = texts.mapInArrow(_count(folder, cells, passes, turn), "cell int, u binary, v binary, w binary, n binary")
        levels.append(materialise(blocks.groupBy("cell").applyInArrow(_add_events(folder, cells, words), SUMS), "lm-sums"))
    sums = levels[0]
    for level in levels[1:]:
        sums = sums.unionByName(level)
    hot = materialise(sums.where(F.col("kind") == HOT_PAIRS).groupBy("part").applyInArrow(_add_hot(folder, words), SUMS), "lm-sums")
    totals = sums.where(F.col("kind") != HOT_PAIRS).unionByName(hot).groupBy("part").applyInArrow(_add_words(folder), ", ".join(f"{c} long" for c in ["part", *TOTALS]))
    with freed(spark):
        t = totals.agg(*[F.sum(c).alias(c) for c in TOTALS]).first().asDict()
    for done in (*levels, hot):
        remove(done)
    t = {k: v or 0 for k, v in t.items()}
    of = tuple(discounts([t[f"{x}{i}"] for i in (1, 2, 3, 4)]) for x in "tbk")
    left = sum(d * n for d, n in zip(of[2], (t["k1"], t["k2"], t["more"]), strict=True)) / t["pairs"] if t["pairs"] else 1.0
    return Model(folder, cells, words, t["tokens"], t["vocabulary"], t["texts"], t["pairs"], of, left)


def write_hot(folder: str, word, ways) -> None:
    import numpy as np

    key = mixed(word.view(np.uint64))
    order = np.argsort(key)
    write_table(f"{folder}/hot", key[order], [ways[order]], ONE)


# scoring


def _discounted(c, d):
    import numpy as np

    return np.maximum(c - np.select([c == 1, c == 2, c > 2], d, 0.0), 0)


def word_rows(model: Model, ids):
    """By word: (count, log10 of the base probability, probability by words, sum of its pairs, mass left to words, cells it is dealt over)."""
    import numpy as np

    _, of_b, of_w = model.discounts
    key = mixed(ids)
    c, k, pairs, *n = find_in(lambda p: f"{model.folder}/words-{p:07d}", (key % np.uint64(model.parts)).astype(np.int64), key, WORD_ROW)
    base = np.log10((c + 1) / (model.tokens + (model.vocabulary + 1)))
    p1 = _discounted(k, of_w) / max(model.pairs, 1) + model.left / (model.vocabulary + 1)
    left = np.where(pairs > 0, sum(d * x for d, x in zip(of_b, n, strict=True)) / np.maximum(pairs, 1), 1.0)
    return c, base, p1, np.maximum(pairs, 1), left, spread(model.folder, ids)


def token_scores(model: Model, ids, rows, u, v, w):
    """log10 of the model's probability of each token; u, v, w: places among ids, whose rows are those of `word_rows`."""
    import numpy as np

    folder, (of_t, of_b, _) = model.folder, model.discounts
    _, _, p1, pairs, left, ways = rows
    of_u, of_v, of_w, dealt = ids[u], ids[v], ids[w], ways[v]

    key, first, back = distinct(joined(of_v, of_w))
    cell, hot = cell_of(of_v[first], dealt[first], of_w[first], model.cells), dealt[first] > 1
    (kb,) = find_in(lambda p: f"{folder}/{'hot-' * (p % 2)}bigrams-{p // 2:07d}", 2 * cell + hot, key, ONE)
    p2 = _discounted(kb, of_b)[back] / pairs[v] + left[v] * p1[w]

    key, first, at_context = distinct(joined(of_u, of_v))
    of_context = cell_of(of_v[first], dealt[first], of_u[first], model.cells)
    total, *n = find_in(lambda p: f"{folder}/contexts-{p:07d}", of_context, key, CONTEXT)
    left = np.where(total > 0, sum(d * x for d, x in zip(of_t, n, strict=True)) / np.maximum(total, 1), 1.0)
    key, first, back = distinct(joined(key[at_context], of_w))
    (c3,) = find_in(lambda p: f"{folder}/trigrams-{p:07d}", of_context[at_context[first]], key, ONE)
    p3 = _discounted(c3, of_t)[back] / np.maximum(total, 1)[at_context] + left[at_context] * p2
    return np.log10(p3)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of (doc_id, text), with held_out carried along if docs has it."""
    carried = [c for c in ("doc_id", "held_out") if c in docs.columns]
    kinds = {f.name: f.dataType for f in docs.schema}
    added_columns = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(c, kinds[c]) for c in carried] + [T.StructField(*a) for a in added_columns])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in (b for b in parts(batches, len(carried), TEXT_BYTES) if b.num_rows):
            ids, *whole, counts = events(b.column(len(carried)).to_pylist())
            rows = word_rows(model, ids)
            known, base, full = rows[0][whole[2]] > 0, rows[1][whole[2]], np.zeros(len(whole[2]))
            for i in range(0, len(full), EVENTS):
                full[i : i + EVENTS] = token_scores(model, ids, rows, *(x[i : i + EVENTS] for x in whole))
            at = np.cumsum(counts) - counts
            columns = [b.column(i) for i in range(len(carried))]
            columns += [pa.array(counts, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(full, at))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(*carried, "text").mapInArrow(run, schema)


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 7 is not 2 and scores all."""
    rows = docs.select("doc_id", (row_bucket("doc_id", 7) == 2).alias("held_out"), "text")
    model = train(rows.where(~F.col("held_out")))
    return score(rows, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
