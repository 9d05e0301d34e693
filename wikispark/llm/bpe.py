"""BPE encoding with forced-boundary splitting, and decoding.

A pair of bytes that stands side by side in no vocabulary token can never be merged over, so text is cut there for
certain, each fragment is encoded by itself, and the ids are put together again; only the last fragment of a word
carries the end-of-word mark. Fragments and the runs between white space repeat across documents, so each task keeps
what it has encoded, within a bound. The vocabulary file is given by path and read by every worker.

What the tokenizer file says (normalise to NFC, lower-case each character, split into contractions, letter runs, single
digits and symbol runs, byte alphabet, merges with an end-of-word mark, special tokens taken as they stand, decoding by
one space between tokens) is what is done here. Null text counts as empty: no ids, empty decoded text.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import parts

CACHED = 250_000  # entries of each cache in a worker
#: What the classes of the splitting pattern are within ASCII; white space is that of the splitter's own engine.
ASCII_CLASSES = ((r"[\p{L}]", "[a-z]"), (r"[\p{N}]", "[0-9]"), (r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9"), (r"\s", r"\t-\r "))


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Memo(dict):
    """A dict that computes what it lacks; `bound` is looked after between documents."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        self[key] = value = self.compute(key)
        return value

    def trim(self):
        if len(self) > CACHED:
            self.clear()


class ForcedBoundaryBpe:
    """An encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.file = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.inner, self.ending = BPE(vocab, merges), self.file.model  # within a word, and at its end
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.letters = byte_alphabet()
        self.code = {c: b for b, c in enumerate(self.letters)}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for unicode_class, within_ascii in ASCII_CLASSES:
            pattern = pattern.replace(unicode_class, within_ascii)
        self.ascii_words = re.compile(pattern.encode())
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokens = ([self.code[c] for c in t.removesuffix(end)] for t in vocab)
        self.joined = {p for t in tokens for p in zip(t, t[1:], strict=False)}  # bytes that stand side by side in some token
        self.words, self.runs = _Memo(self._word), _Memo(self._run)

    def cut(self, word: bytes) -> list[bytes]:
        """The word in fragments between which no token can reach."""
        if self.joined.issuperset(zip(word, word[1:], strict=False)):
            return [word]
        ends = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.joined]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]

    def _word(self, word: bytes) -> bytes:
        """Ids of one word: its fragments' one after the other; only the last fragment ends the word."""
        *head, tail = ("".join(map(self.letters.__getitem__, f)) for f in self.cut(word))
        ids = array("I", [t.id for f in head for t in self.inner.tokenize(f)])
        ids.extend(t.id for t in self.ending.tokenize(tail))
        return ids.tobytes()

    def split(self, text: str) -> list[bytes]:
        """The words of text without special tokens. Beyond ASCII, the file's own normaliser and splitter decide, so that
        their Unicode version counts and not Python's."""
        if text.isascii():
            return self.ascii_words.findall(text.lower().encode())
        words = self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(text))
        return [bytes(map(self.code.__getitem__, w)) for w, _ in words]

    def _run(self, run: bytes) -> bytes:
        """Ids (32 bits each, little-endian) of a run without ASCII white space; no token reaches over such white space."""
        text = run.decode("utf-8")
        if b"<|" not in run or not self.specials:
            return b"".join(map(self.words.__getitem__, self.split(text)))
        parts = self.specials.split(text)  # every other one is a special token
        return b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else b"".join(map(self.words.__getitem__, self.split(p))) for i, p in enumerate(parts))

    def encode(self, text: str | None) -> bytes:
        for memo in (self.words, self.runs):
            memo.trim()
        raw = (text or "").encode("utf-8")
        if text and text.isascii() and b"<|" not in raw:
            raw = raw.lower()  # no special token: fewer distinct runs
        return b"".join(map(self.runs.__getitem__, raw.split()))

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: 32-bit little-endian, decoded string) of every row."""

    def run(batches):
        import pyarrow as pa

        bpe = coder(vocabulary)
        for b in parts(batches, 1):
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(encoded: DataFrame, *also: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row, and the columns named."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"), *also)
