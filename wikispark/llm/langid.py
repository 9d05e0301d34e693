"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces of the product of their probabilities, by the forward algorithm; a text's is
the product over its words, and the prediction is the language with the highest, its score the posterior under equal
priors. The piece probabilities are trained here: word counts by language of a bounded sample of training documents
(about `sample` documents of each language, chosen by a hash of the id) are gathered in Spark, and each round of expectation-maximisation
is one job that adds up expected piece counts by forward and backward sums; only the table of pieces by language, whose
size the vocabulary bounds, comes to the driver. Prediction reads every text whole.

Sums over segmentations are kept within a double's range by a factor for each letter: no piece has a probability below
FLOOR, so they neither vanish nor overflow.

Definitions. Words start with a letter (Unicode categories L*) and go on with letters and marks (M*), lower-cased, with the
vocabulary's word mark in front; runs of more than 48 characters are taken 48 at a time; a letter outside the vocabulary is
a piece of small fixed probability. Null texts and
texts without a letter are `und` with score 0, as is everything if nothing was learned. Rows with null text or language
teach nothing. A tie goes to the smaller language code.
"""

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import materialise, packed, parts, row_bucket, text_runs

SAMPLE = 5_000  # documents of each language to learn from, about
ROUNDS = 2
LONGEST = 48  # letters of a word taken at once
UNKNOWN = 1e-7  # probability of a letter outside the vocabulary
FLOOR = 1e-9  # the smallest probability of a piece
FACTOR = 1e4  # for each letter of a piece
SMOOTH = 0.01  # added to each piece's expected count
CACHED = 350_000  # words a worker keeps
MARK = "▁"
PLAIN = re.compile(r"[^\W\d_]+")  # the same as letters(), and faster, where no character is odd


@lru_cache(maxsize=1)
def letters() -> re.Pattern:
    """A letter with the letters and marks that follow it."""
    spans: dict[str, list[list[int]]] = {"L": [], "M": []}
    for c in range(sys.maxunicode + 1):
        own = spans.get(unicodedata.category(chr(c))[0])
        if own is not None:
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    kinds = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in spans.items()}
    return re.compile(f"[{kinds['L']}][{kinds['L']}{kinds['M']}]*")


@lru_cache(maxsize=1 << 16)
def is_odd(c: str) -> bool:
    """A mark, or what PLAIN takes for a letter and is none."""
    kind = unicodedata.category(c)
    return kind[0] == "M" or kind in ("Nl", "No")


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    odd = not text.isascii() and any(map(is_odd, set(text)))
    found = (letters() if odd else PLAIN).findall(text)
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Piece → number of a sentencepiece file, without those that stand for no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))
    return {piece: i for i, piece in enumerate(found)}


def scaled(pieces: dict[str, int], table):
    """The table with a factor for each letter of a piece."""
    import numpy as np

    factors = np.full((len(table), 1), FACTOR)
    for piece, i in pieces.items():
        factors[i] = FACTOR ** len(piece)
    return table * factors


class Lattice:
    """Words of one length with the pieces that can stand at each place: ids[w, i, j] for characters i to j."""

    def __init__(self, pieces: dict[str, int], longest: int, own: list[str]):
        import numpy as np

        self.n = n = len(own[0])
        self.spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
        get, none, unknown = pieces.get, len(pieces), len(pieces) + 1
        self.ids = np.array([[get(w[i:j], unknown if j == i + 1 else none) for w in own] for i, j in self.spans], np.int32)

    def forward(self, table):
        """alpha[j, w, language]: the sum over segmentations of the first j characters."""
        import numpy as np

        alpha = np.zeros((self.n + 1, self.ids.shape[1], table.shape[1]))
        alpha[0] = 1
        for (i, j), ids in zip(self.spans, self.ids, strict=True):
            alpha[j] += alpha[i] * table[ids]
        return alpha

    def expected(self, table, weight):
        """(piece ids, expected counts) of all words; table: one language's probabilities as a column."""
        import numpy as np

        alpha, beta = self.forward(table), np.zeros((self.n + 1, self.ids.shape[1], 1))
        beta[self.n] = 1
        for (i, j), ids in zip(reversed(self.spans), self.ids[::-1], strict=True):
            beta[i] += table[ids] * beta[j]
        total = alpha[self.n]
        parts = [(alpha[i] * table[ids] * beta[j] / total)[:, 0] * weight for (i, j), ids in zip(self.spans, self.ids, strict=True)]
        return self.ids.ravel(), np.concatenate(parts) if parts else np.zeros(0)


def lattices(pieces: dict[str, int], longest: int, own: list[str], most: int = 4096):
    """(positions in own, lattice) for words of equal length, `most` at a time."""
    import numpy as np

    lengths = np.array([len(w) for w in own])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), most):
            part = at[k : k + most]
            yield part, Lattice(pieces, longest, [own[i] for i in part])


class Scorer:
    """log-probabilities of words in every language, kept for words that come again."""

    def __init__(self, path: str, table):
        self.pieces = vocabulary(path)
        self.table = scaled(self.pieces, table)
        self.longest = max(map(len, self.pieces))
        self.clear()

    def clear(self):
        import numpy as np

        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, self.table.shape[1]))

    def learn(self, new: list[str]):
        import numpy as np

        out = np.zeros((len(new), self.table.shape[1]))
        for at, lattice in lattices(self.pieces, self.longest, [MARK + w for w in new]):
            out[at] = np.log(lattice.forward(self.table)[-1]) - lattice.n * np.log(FACTOR)
        self.index.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate([self.logs, out])

    def texts(self, texts: list[str | None]):
        """log-probability of each text in each language; nan without letters."""
        import numpy as np

        if len(self.index) > CACHED:
            self.clear()
        own = [words(t) for t in texts]
        new = list({w for ws in own for w in ws} - self.index.keys())
        if new:
            self.learn(new)
        find = self.index.__getitem__
        return np.array([self.logs[np.fromiter(map(find, ws), np.int64, len(ws))].sum(axis=0) if ws else np.full(self.logs.shape[1], np.nan) for ws in own]).reshape(len(own), -1)


class Model:
    """Languages in order and the table piece x language of probabilities; small, it goes to the tasks as it is."""

    def __init__(self, path: str, languages: list[str], table):
        self.path, self.languages, self.table = path, languages, table


def train(docs: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Learns from docs(doc_id, text, lang)."""
    import numpy as np

    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = docs.groupBy("lang").count().select(F.col("lang").alias("of_lang"), F.lit(sample / F.col("count")).alias("share"))
    docs = docs.join(F.broadcast(sizes), F.col("lang") == F.col("of_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * (1 << 40))  # a row for each language

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()
        for b in parts(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Counter(words(text))
                seen.update({(lang, w): k for w, k in own.items()})
            if len(seen) > CACHED:
                yield pa.RecordBatch.from_pydict({"lang": [x for x, _ in seen], "word": [w for _, w in seen], "n": list(seen.values())})
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array((x for x, _ in seen), pa.string()), pa.array((w for _, w in seen), pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    counts = materialise(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    size = len(vocabulary(path))
    table = np.zeros((size + 2, len(languages)))
    table[:size] = 1.0 / size
    table[size + 1] = UNKNOWN
    place = {x: i for i, x in enumerate(languages)}

    for step in range(rounds + 1):

        def expect(batches, table=table, step=step):
            import pyarrow as pa

            pieces = vocabulary(path)
            longest = max(map(len, pieces))
            total = np.zeros((size + 2, len(languages)))
            weights = scaled(pieces, table)
            for b in batches:
                lang, n = np.array([place[x] for x in b.column(0).to_pylist()]), b.column(2).to_numpy()
                own = [MARK + w for w in b.column(1).to_pylist()]
                for k in np.unique(lang):
                    mine = np.flatnonzero(lang == k)
                    for at, lattice in lattices(pieces, longest, [own[i] for i in mine]):
                        weight = n[mine[at]]
                        if step:
                            ids, value = lattice.expected(weights[:, k : k + 1], weight)
                        else:  # first, every place where a piece fits counts
                            ids, value = lattice.ids.ravel(), np.tile(weight, len(lattice.spans))
                        total[:, k] += np.bincount(ids, value, size + 2)
            i, k = np.nonzero(total[:size])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(total[i, k])], names=["piece", "lang", "n"])

        got = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.full((size, len(languages)), SMOOTH)
        new[got["piece"], got["lang"]] += got["n"]
        table = table.copy()
        table[:size] = np.maximum(new / new.sum(axis=0), FLOOR)
    return Model(path, languages, table)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if model is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(model.path, model.table)
        for b in parts(batches, 1):
            logs = scorer.texts(b.column(1).to_pylist())
            best = np.nan_to_num(logs).argmax(axis=1)
            with np.errstate(invalid="ignore"):
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            labels = ["und" if x else model.languages[k] for x, k in zip(np.isnan(logs[:, 0]), best, strict=True)]
            scores = np.nan_to_num(share, nan=0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with at least that score."""
    if model is None:
        return docs.limit(0)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        scorer = Scorer(model.path, model.table)
        for texts in batches:
            out = []
            for run in text_runs(texts.where(texts.notna(), None).tolist()):
                logs = scorer.texts(run)
                with np.errstate(invalid="ignore"):
                    out += (1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1) >= least).tolist()
            yield pd.Series(out, dtype=bool)

    return packed(docs, text=F.col("text")).where(known("text")).select("row.*")


def learn_and_predict(docs: DataFrame, path: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 is not 0 and predicts all."""
    held_out = row_bucket("doc_id", 5) == 0
    model = train(docs.where(~held_out), path)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
