"""Knowledge atoms: extraction, normalisation, validation, numbering, deduplication."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import text as X

ATOM_SCHEMA = "source_id string, chunk_no int, pos int, claim string, quote string, char_offset array<int>, kind string, draft_tags array<string>"
PIECE_END, WORD = re.compile(r"(?<=\. )|\n"), re.compile(r"[^ \t\n\x0b\f\r]+")


def extract_atoms(chunks: DataFrame, fn: Callable | None = None) -> DataFrame:
    """Raw atoms of chunks(source_id, chunk_no, start, text).

    fn: a function from an iterator of pandas frames to an iterator of frames of ATOM_SCHEMA (a batched model call). Without
    one, sentences are atoms: pieces after '. ' or a line end, quoted as they stand, with their span, a claim of at most
    120 characters and the first two distinct words as tags.
    """
    if fn is not None:
        return chunks.mapInPandas(fn, ATOM_SCHEMA)
    return chunks.select("source_id", "chunk_no", "start", "text").mapInArrow(_sentences, ATOM_SCHEMA)


def _sentences(batches):
    """The pieces of each chunk in one pass over its text, however many there are."""
    import pyarrow as pa

    schema = pa.schema([("source_id", pa.string()), ("chunk_no", pa.int32()), ("pos", pa.int32()), ("claim", pa.string()), ("quote", pa.string()), ("char_offset", pa.list_(pa.int32())), ("kind", pa.string()), ("draft_tags", pa.list_(pa.string()))])
    for b in batches:
        rows = []
        for source, no, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = start
            for pos, piece in enumerate(PIECE_END.split(text) if text is not None else ()):
                end = at + len(piece)
                quote = piece.strip(" ")
                if quote:
                    rows.append((source, no, pos, quote[:120], quote, [at, end], "definition", _first_words(quote)))
                at = end if piece.endswith(". ") else end + 1
            if len(rows) >= 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _first_words(quote: str) -> list[str]:
    """The first two distinct words."""
    first = None
    for m in WORD.finditer(quote):
        if first is None:
            first = m[0]
        elif m[0] != first:
            return [first, m[0]]
    return [first] if first is not None else []


def normalize_atoms(raw: DataFrame) -> DataFrame:
    """Quote, offset, kind and tags as one shape from the paths that models return them by.

    raw: source_id, start, text (the chunk) and the struct `atom` with any of evidence_quote, evidence.quote, quote,
    evidence_char_offset, evidence.char_offset, char_offset, kind, draft_tags, claim; missing fields are null.
    """
    a = F.col("atom")
    quote = F.coalesce(X.non_empty(a["evidence_quote"]), X.non_empty(a["evidence"]["quote"]), X.non_empty(a["quote"]), F.lit(""))
    span = F.array(F.col("start"), F.col("start") + F.length("text"))
    kept = [c for c in raw.columns if c not in ("atom",)]
    return raw.select(
        *kept, a["claim"].alias("claim"), quote.alias("quote"), F.coalesce(a["evidence_char_offset"], a["evidence"]["char_offset"], a["char_offset"], span).alias("char_offset"),
        F.when(a["kind"].isin(*X.ATOM_KINDS), a["kind"]).otherwise("definition").alias("kind"), a["kind"].alias("raw_kind"), F.coalesce(a["draft_tags"], F.array().cast("array<string>")).alias("draft_tags"),
    )


def atom_errors(claim: Column, quote: Column, char_offset: Column, kind: Column, max_claim: int = 120, max_quote: int = 600) -> Column:
    """What is wrong with an atom, as a list; invalid atoms are kept and told."""
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    return F.array_compact(
        F.array(
            F.when(missing(claim), "missing claim"), F.when(F.length(claim) > max_claim, "claim too long"), F.when(missing(quote), "missing quote"), F.when(F.length(quote) > max_quote, "quote too long"),
            F.when(F.coalesce(F.size(char_offset) != 2, F.lit(True)), "bad char_offset"), F.when(~F.coalesce(kind.isin(*X.ATOM_KINDS), F.lit(False)), "invalid kind"),
        )
    )


def sequence_atoms(raw: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """+ seq from 1 within the source over chunks, + atom_id. within: columns that follow from the source and that rows are dealt by."""
    seq = F.row_number().over(W.partitionBy(*within, "source_id").orderBy("chunk_no", "pos"))
    return raw.withColumn("seq", seq).withColumn("atom_id", X.atom_id(F.col("source_id"), F.col("seq")))


def dedup_atoms(atoms: DataFrame, prefix: int = 80, within: tuple[str, ...] = ()) -> DataFrame:
    """Of atoms of a source whose quotes begin with the same characters the first stays; ids keep their gaps. within: as in `sequence_atoms`."""
    same = W.partitionBy(*within, "source_id", F.substring("quote", 1, prefix)).orderBy("seq")
    return atoms.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def atom_counts(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """(source_id, raw, kept)."""
    a, b = raw.groupBy("source_id").agg(F.count("*").alias("raw")), kept.groupBy("source_id").agg(F.count("*").alias("kept"))
    return a.join(b, "source_id", "left").select("source_id", "raw", F.coalesce("kept", F.lit(0)).alias("kept"))


def attach_atoms(members: DataFrame, atoms: DataFrame) -> DataFrame:
    """members(label, pos, atom_id) with their atoms; missing ids are dropped, order is kept in pos."""
    return members.join(atoms, "atom_id")
