"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features and those of its neighbours give it a score, and the chain gives one for
keeping or changing the label from line to line; forward and backward sums give each line's probability of being good,
and the mean over lines weighted by their length is the document's quality. The field is fitted here on a bounded sample
of labelled documents (about `sample` documents, half of each label as far as there are, chosen by a hash of the id):
features are computed in Spark, and of each document at most SAMPLE_LINES consecutive lines come to the driver, from a
place that a hash of the text names, so that long documents teach as well and the driver holds a bounded number. A line takes its document's label, of which the share NOISE is taken as wrong, line by line: so the chain sees changes of
label, and scores stay graded where the labels could be told apart without doubt.

Scoring reads every text whole, in batches of bounded size. Texts of more than LINES lines run through the chain in blocks
of lines with carried state: forward over the blocks, then backward; what is kept of a line is two numbers and its hash.

Definitions. Lines end at LF; a null or empty text is one empty line; lines without characters weigh nothing unless all
are so. If the labelled documents are of one kind only, every score is 1 or 0 accordingly; without any, 1. Labels that
are null or of unknown documents teach nothing; of rows that repeat an id the text with the smallest hash teaches, once for
each label that the id has.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import packed, parts, row_bucket, text_runs

SAMPLE, SAMPLE_LINES = 3000, 128
STEPS, RATE, DECAY = 80, 0.2, 1e-4
THRESHOLD = 0.7
NOISE = 0.02
LINES = 1 << 14  # of a text held as features at a time
STEEP = 40.0  # a line's score is kept within these bounds
PIECE = 1 << 20  # bytes classified at a time
UPPER, LOWER, DIGIT, SPACE, SHOUT, STOP, BAR, SYMBOL, WIDE, OTHER = range(10)
OWN = 14  # features of a line by itself


def classes():
    """The class of every byte."""
    import numpy as np

    table = np.full(256, OTHER, np.uint8)
    for kind, own in ((SPACE, b" \t\r\x0b\x0c"), (SHOUT, b"!?"), (STOP, b".,;:'\"()-"), (BAR, b"|"), (SYMBOL, b"#$%&*+/<=>@[\\]^_`{}~")):
        table[list(own)] = kind
    table[ord("A") : ord("Z") + 1], table[ord("a") : ord("z") + 1], table[ord("0") : ord("9") + 1], table[128:] = UPPER, LOWER, DIGIT, WIDE
    return table


def line_features(lines: list[bytes], repeated, first, last):
    """(bytes of each line, matrix of the lines' features with their neighbours'); first and last mark the ends of texts."""
    import numpy as np

    n, table = len(lines), classes()
    size = np.fromiter(map(len, lines), np.int64, n)
    kinds = np.zeros((n, 10))
    ends = np.cumsum(size)
    raw = b"".join(lines)
    for a in range(0, len(raw), PIECE):
        part = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - a), a)
        i, j = np.searchsorted(ends, [a, a + len(part) - 1], side="right")
        line = np.repeat(np.arange(i, j + 1), np.diff(np.concatenate([[a], np.minimum(ends[i : j + 1], a + len(part))])))
        kinds[i : j + 1] += np.bincount((line - i) * 10 + table[part], minlength=(j + 1 - i) * 10).reshape(-1, 10)
    words, distinct, twice = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(size):
        w = lines[i].split()
        words[i], distinct[i], twice[i] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
    w, s, letters = np.maximum(words, 1), np.maximum(size, 1), np.maximum(kinds[:, UPPER] + kinds[:, LOWER], 1)
    x = np.stack(
        [
            np.log1p(size) / 8, np.log1p(words) / 6, kinds[:, UPPER] / letters, kinds[:, SYMBOL] / s, np.minimum(kinds[:, SHOUT] / w, 3), kinds[:, DIGIT] / s,
            np.minimum(kinds[:, STOP] / w, 3), kinds[:, WIDE] / s, np.minimum(s / w / 10, 5), distinct / w, twice / w, np.minimum(kinds[:, BAR] / w, 3), (size == 0) * 1.0, repeated,
        ], axis=1,
    )
    first, last = first[:, None], last[:, None]
    before, after = np.roll(x, 1, axis=0) * (1 - first), np.roll(x, -1, axis=0) * (1 - last)
    return size, np.concatenate([x, before, after, first, last, np.ones((n, 1))], axis=1)


def features(texts: list[bytes]):
    """(lines of each text, bytes of each line, features) of a few texts."""
    import numpy as np

    lines: list[bytes] = []
    counts, repeated = [], []
    for t in texts:
        own = t.split(b"\n")
        counts.append(len(own))
        lines += own
        seen = Counter(own)
        repeated += [float(seen[line] > 1 and len(line) > 0) for line in own]
    counts = np.array(counts)
    first, last = np.zeros(len(lines)), np.zeros(len(lines))
    first[np.cumsum(counts) - counts], last[np.cumsum(counts) - 1] = 1, 1
    return counts, *line_features(lines, np.array(repeated), first, last)


def sampled_features(text: bytes, most: int = SAMPLE_LINES):
    """The features of a text's lines, or of `most` consecutive ones from a place that its hash names."""
    import numpy as np
    import xxhash

    own = text.split(b"\n")
    seen, n = Counter(own), len(own)
    at = xxhash.xxh64_intdigest(text) % (n - most + 1) if n > most else 0
    end = min(n, at + most)
    a, b = max(0, at - 1), min(n, end + 1)  # with the neighbours
    lines = own[a:b]
    repeated = np.array([float(seen[line] > 1 and len(line) > 0) for line in lines])
    first, last = np.zeros(len(lines)), np.zeros(len(lines))
    first[0], last[-1] = a == 0, b == n
    return line_features(lines, repeated, first, last)[1][at - a : end - a]


def scan(carry, moves):
    """The states after each move (a row vector times its matrix), scaled to a sum of 1: chunks of moves side by side."""
    import numpy as np

    n = len(moves)
    width = max(1, int(np.sqrt(n)))
    chunks = -(-n // width)
    m = np.concatenate([moves, np.broadcast_to(np.eye(2), (chunks * width - n, 2, 2))]).reshape(chunks, width, 2, 2)
    product = np.empty_like(m)
    product[:, 0] = m[:, 0]
    for i in range(1, width):
        product[:, i] = product[:, i - 1] @ m[:, i]
        product[:, i] /= product[:, i].max(axis=(1, 2), keepdims=True)
    starts = np.empty((chunks, 1, 1, 2))
    for i in range(chunks):
        starts[i, 0, 0] = carry
        carry = carry @ product[i, -1]
        carry = carry / carry.sum()
    states = (starts @ product).reshape(-1, 2)[:n]
    return states / states.sum(axis=1, keepdims=True)


def blocks_of(raw: bytes, lines: int):
    """(first byte, one after the last) of each run of `lines` lines; the line end between two runs belongs to neither."""
    at = 0
    while at <= len(raw):
        end = at
        for _ in range(lines):
            end = raw.find(b"\n", end)
            if end < 0:
                break
            end += 1
        yield at, (len(raw) if end < 0 else end - 1)
        if end < 0:
            return
        at = end


@dataclass
class Crf:
    """Weights of the features for good against bad, and of the steps [from, to] (0 bad, 1 good)."""

    weights: object
    steps: object

    def marginals(self, counts, x, pairs: bool = False):
        """Each line's probability of being good (and, if wanted, the expected steps by kind)."""
        import numpy as np

        e = np.clip(x @ self.weights, -STEEP, STEEP)
        good, between = np.zeros(len(e)), np.zeros((2, 2))
        start = np.cumsum(counts) - counts
        level = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)  # texts of about equal length go together
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            length, t = counts[own], int(counts[own].max())
            at = np.minimum(start[own][:, None] + np.arange(t)[None, :], len(e) - 1)
            inside = np.arange(t)[None, :] < length[:, None]
            unary = np.zeros((len(own), t, 2))
            unary[:, :, 1] = np.where(inside, e[at], 0)
            forward, backward = np.zeros_like(unary), np.zeros_like(unary)
            forward[:, 0] = unary[:, 0]
            for i in range(1, t):
                step = np.logaddexp(forward[:, i - 1, :1] + self.steps[0], forward[:, i - 1, 1:] + self.steps[1]) + unary[:, i]
                forward[:, i] = np.where(inside[:, i, None], step, forward[:, i - 1])
            for i in range(t - 2, -1, -1):
                to = unary[:, i + 1] + backward[:, i + 1]
                step = np.logaddexp(to[:, :1] + self.steps[:, 0], to[:, 1:] + self.steps[:, 1])
                backward[:, i] = np.where(inside[:, i + 1, None], step, 0)
            whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            p = np.exp(forward + backward - whole[:, None, None])[:, :, 1]
            good[at[inside]] = np.clip(p[inside], 0, 1)
            if pairs and t > 1:
                joint = forward[:, :-1, :, None] + self.steps + (unary + backward)[:, 1:, None, :] - whole[:, None, None, None]
                between += np.exp(joint)[inside[:, 1:]].sum(axis=0)
        return (good, between) if pairs else good

    def quality(self, texts: list[str | None], lines: int = LINES):
        """The quality of each text."""
        import numpy as np

        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        long = np.array([t.count(b"\n") >= lines for t in raw], bool)
        out = np.zeros(len(raw))
        if not long.all():
            counts, size, x = features([t for t, k in zip(raw, long, strict=True) if not k])
            good, start = self.marginals(counts, x), np.cumsum(counts) - counts
            weight = np.where(np.repeat(np.add.reduceat(size, start), counts) > 0, size, 1)
            out[~long] = np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)
        for i in np.flatnonzero(long):
            out[i] = self.long_quality(raw[i], lines)
        return np.clip(out, 0, 1)

    def long_quality(self, raw: bytes, lines: int = LINES) -> float:
        """The quality of one text by blocks of lines."""
        import numpy as np
        import xxhash

        at = list(blocks_of(raw, lines))
        h = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, raw[a:b].split(b"\n")), np.uint64, raw.count(b"\n", a, b) + 1) for a, b in at])
        many = np.sort(h)
        many = np.unique(many[1:][many[1:] == many[:-1]])
        found = lambda x: many[np.minimum(np.searchsorted(many, x), len(many) - 1)] == x if len(many) else np.zeros(len(x), bool)
        empty, n, done = np.uint64(xxhash.xxh64_intdigest(b"")), len(h), 0
        e, size, forward = np.empty(n), np.empty(n, np.int64), np.empty((n, 2))
        state = np.ones(2) / 2
        for k, (a, b) in enumerate(at):
            own = raw[a:b].split(b"\n")
            before = [raw[raw.rfind(b"\n", 0, a - 1) + 1 : a - 1]] if k else []
            after = [raw[b + 1 : at[k + 1][1]].split(b"\n", 1)[0]] if k + 1 < len(at) else []
            here = slice(done - len(before), done + len(own) + len(after))
            repeated = (found(h[here]) & (h[here] != empty)) * 1.0
            first, last = np.zeros(len(repeated)), np.zeros(len(repeated))
            first[0], last[-1] = not k, k + 1 == len(at)
            s, x = line_features(before + own + after, repeated, first, last)
            inside = slice(len(before), len(before) + len(own))
            here = slice(done, done + len(own))
            size[here], e[here] = s[inside], np.clip(x[inside] @ self.weights, -STEEP, STEEP)
            moves = self.moves(e[here])
            if not k:
                moves[0] = np.diag(moves[0].diagonal() / np.exp(self.steps.diagonal()))  # no step to the first line
            forward[here] = scan(state, moves)
            state, done = forward[here][-1], done + len(own)
        weight = size if size.any() else np.ones(n)
        total, state = 0.0, np.ones(2) / 2
        for stop in range(n, 0, -lines):
            here = slice(max(0, stop - lines), stop)
            moves = self.moves(e[here.start + 1 : min(stop + 1, n)])[::-1].transpose(0, 2, 1)
            backward = scan(state, moves)[::-1] if len(moves) else np.zeros((0, 2))
            if stop == n:
                backward = np.concatenate([backward, np.ones((1, 2)) / 2])
            state = backward[0]
            p = forward[here] * backward
            total += float((p[:, 1] / p.sum(axis=1) * weight[here]).sum())
        return total / float(weight.sum())

    def moves(self, e):
        """The matrix [from, to] of each step to a line of score e."""
        import numpy as np

        to = np.stack([np.zeros_like(e), e], axis=1)
        to -= to.max(axis=1, keepdims=True)
        return np.exp(self.steps - self.steps.max())[None] * np.exp(to)[:, None, :]


def fit(counts, x, labels) -> Crf:
    """Gradient ascent (Adam) on the expected likelihood of the lines' labels; x in the features' own units."""
    import numpy as np

    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z, soft = (x - mean) / scale, np.where(labels > 0, 1 - NOISE, NOISE)
    y, q = np.repeat(soft, counts), np.stack([1 - soft, soft], axis=1)
    same = np.einsum("i,ij,ik->jk", counts - 1.0, q, q)
    crf = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (crf.weights, crf.steps)]
    for n in range(1, STEPS + 1):
        good, between = crf.marginals(counts, z, pairs=True)
        slopes = (z.T @ (y - good) / len(y) - DECAY * crf.weights, (same - between) / len(y) - 10 * DECAY * crf.steps)
        for p, g, (m, v) in zip((crf.weights, crf.steps), slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += RATE * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    weights = crf.weights / scale
    weights[-1] -= (weights * mean)[:-1].sum()
    return Crf(weights, crf.steps)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf | float:
    """The field fitted to docs(doc_id, text) and labels(doc_id, quality); or the one score of all texts."""
    import numpy as np

    labels = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = {k: x for k, x in labels.groupBy((F.col("quality") > 0).alias("good")).count().collect()}
    share = F.when(F.col("quality") > 0, F.lit(sample / 2 / max(1, n.get(True, 0)))).otherwise(F.lit(sample / 2 / max(1, n.get(False, 0))))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * (1 << 40))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id")  # about `sample` ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            each = [sampled_features(t.encode("utf-8", "surrogatepass")).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(each, pa.binary())], names=["quality", "x"])

    got = rows.select("text", "quality").mapInArrow(run, "quality int, x binary").orderBy("x", "quality").toPandas()
    if not len(got):
        return 1.0
    y = (got["quality"].to_numpy() > 0).astype(np.int64)
    if y.min() == y.max():
        return float(y[0])
    each = [np.frombuffer(b).reshape(-1, 3 * OWN + 3) for b in got["x"]]
    return fit(np.array([len(m) for m in each]), np.concatenate(each), y)


def score(docs: DataFrame, model: Crf | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    kind = docs.schema[id_col].dataType
    if isinstance(model, float):
        out = docs.select(id_col, F.lit(model).alias("score"))
    else:

        def run(batches):
            import pyarrow as pa

            for b in parts(batches, 1):
                scores = model.quality(b.column(1).to_pylist()) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

        out = docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Crf | float) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    if isinstance(model, float):
        return docs if model >= THRESHOLD else docs.limit(0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([s for run in text_runs(texts.where(texts.notna(), None).tolist()) for s in model.quality(run).tolist()], dtype=float)

    return packed(docs, text=F.col("text")).where(scored("text") >= THRESHOLD).select("row.*")


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 4 is not 2 and scores all."""
    held_out = row_bucket("doc_id", 4) == 2
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
