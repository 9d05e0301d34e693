"""Places where a model is called: a batched function with an offline default, a time limit, attempts and a failure policy."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikispark.functions import text as X
from wikispark.functions import vectors as V
from wikispark.operators.graphs import settle


def hashed_grams(text: Column, dims: int = 64, n: int = 3) -> Column:
    """Character n-grams hashed to `dims` counts, with length one: the default embedding, without Python."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    grams = F.transform(X.ngrams(t, n), lambda g: F.pmod(F.xxhash64(g), F.lit(dims)).cast("int"))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda g: g == i)).cast("double"))
    return X.let(X.let(grams, counts), V.unit)


def attempt(fn: Callable[[list], list], items: list, seconds: float, tries: int = 1) -> tuple[list | None, str | None, int]:
    """(values, error, attempts): fn's answer for a list, which must have as many values; else null and what went wrong.

    The call runs in a thread that is given up after `seconds`; errors are cut to 200 characters.
    """
    error = None
    for n in range(1, tries + 1):
        answers: queue.Queue = queue.Queue()

        def call(out: queue.Queue = answers) -> None:
            try:
                out.put((list(fn(items)), None))
            except Exception as e:
                out.put((None, f"{type(e).__name__}: {e}"[:200]))

        threading.Thread(target=call, daemon=True).start()
        try:
            values, error = answers.get(timeout=seconds)
        except queue.Empty:
            values, error = None, f"no answer within {seconds:g} s"
        if values is not None and len(values) != len(items):
            values, error = None, f"{len(values)} values for {len(items)} items"
        if values is not None:
            return values, None, n
    return None, error, tries


def outcomes(df: DataFrame, col: str, fn: Callable[[list], list], kind: str, seconds: float, batch: int = 64, tries: int = 1, on_error: str = "fallback", suffix: str = "") -> DataFrame:
    """+ value (of SQL type `kind`), error string, attempts int, each with the suffix: fn maps up to `batch` values of col, null ones
    too, to as many values; every batch has its own time limit and `tries` attempts. A batch that failed has null values and the error
    in each of its rows; with on_error `raise` it fails the job. Empty tables call nothing."""

    @F.pandas_udf(f"value {kind}, error string, attempts int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for items in batches:
            rows: list[tuple] = []
            for i in range(0, len(items), batch):
                part = items.iloc[i : i + batch].tolist()
                values, error, attempts = attempt(fn, part, seconds, tries)
                if error is not None and on_error == "raise":
                    raise RuntimeError(error)
                rows += [(v, error, attempts) for v in (values if values is not None else [None] * len(part))]
            yield pd.DataFrame({"value": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object), "attempts": [r[2] for r in rows]})

    found = df.withColumn("_outcome", run.asNondeterministic()(col))  # so that no plan calls the model twice for a row
    return found.select(*df.columns, *[F.col(f"_outcome.{c}").alias(c + suffix) for c in ("value", "error", "attempts")])


def embed(df: DataFrame, col: str, fn: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64, on_error: str = "fallback", seconds: float = 60, tries: int = 1) -> DataFrame:
    """+ embedding array<double>, embedding_error: fn turns up to `batch` texts into vectors; without one, hashed character n-grams.

    on_error: `fallback` gives null vectors and the error for a batch that failed, `raise` raises.
    """
    if fn is None:
        return df.withColumn("embedding", hashed_grams(F.col(col))).withColumn("embedding_error", F.lit(None).cast("string"))
    out = outcomes(df, col, fn, "array<double>", seconds, batch, tries, on_error, "_of_embedding")
    return out.select(*df.columns, F.col("value_of_embedding").alias("embedding"), F.col("error_of_embedding").alias("embedding_error"))


def embed_or_constant(df: DataFrame, col: str, fn: Callable[[list[str]], list[list[float]]] | None = None, **policy) -> DataFrame:
    """`embed`, but if any row has no vector, for whatever reason, all rows of the table have the same vector of one zero."""
    out = settle(embed(df, col, fn, **policy))
    if out.where("embedding IS NULL").limit(1).count():
        out = out.withColumn("embedding", F.array(F.lit(0.0)))
    return out


def compose_pages(ctx: DataFrame, fn: Callable[[list[str]], list[str]] | None = None, batch: int = 1, on_error: str = "fallback", seconds: float = 120, tries: int = 1) -> DataFrame:
    """ctx(slug, label, bullets, and with fn prompt) → (slug, body, error): fn maps prompts to bodies; where it fails or there is no
    fn, the label and the bullets."""
    plain = F.concat(F.lit("## "), F.coalesce("label", "slug"), F.lit("\n\n"), F.coalesce("bullets", F.lit("")))
    if fn is None:
        return ctx.select("slug", plain.alias("body"), F.lit(None).cast("string").alias("error"))
    out = outcomes(ctx.select("slug", "prompt", plain.alias("plain")), "prompt", fn, "string", seconds, batch, tries, on_error)
    return out.select("slug", F.coalesce("value", "plain").alias("body"), "error")


def fix_lines(candidates: DataFrame, fn: Callable[[list[str]], list[str]] | None = None, seconds: float = 120, tries: int = 1, on_error: str = "fallback") -> DataFrame:
    """candidates(source_id, batch_no, batch_pos, text, reason) → (source_id, batch_no, returned, error): the corrected lines of each batch.

    fn maps a batch's lines to lines, in order; a failure, a late answer or one of another length returns the lines as they are, with
    the error. By default each chemical formula or letter-digit run is put between dollar signs.
    """
    if fn is None:
        fixed = F.when(F.col("reason") == "chemical_formula", F.regexp_replace("text", X.CHEMICAL, r"\$$1\$")).when(F.col("reason") == "bare_superscript", F.regexp_replace("text", X.BARE_SUPERSCRIPT, r"\$$1^$2\$")).otherwise(F.col("text"))
        rows = F.sort_array(F.collect_list(F.struct("batch_pos", fixed.alias("t"))))
        return candidates.groupBy("source_id", "batch_no").agg(F.transform(rows, lambda x: x["t"]).alias("returned"), F.lit(None).cast("string").alias("error"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("batch_pos")["text"].tolist()
        returned, error, _ = attempt(fn, own, seconds, tries)
        if error is not None and on_error == "raise":
            raise RuntimeError(error)
        return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "batch_no": [pdf["batch_no"].iloc[0]], "returned": [own if returned is None else returned], "error": [error]})

    return candidates.groupBy("source_id", "batch_no").applyInPandas(run, "source_id string, batch_no int, returned array<string>, error string")
