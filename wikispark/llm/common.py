"""What the operators of this subpackage share: tables, the shared folder, files and predicates on columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that the driver and all executors see.

    Where the session names none, a local master (as in tests) gets a temporary folder; on a cluster this is an error,
    since a folder of one machine would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("wikispark.shared.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-wikispark-')}"
        spark.conf.set("wikispark.shared.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession):
    """Within it, a job's shuffle files go when the job is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, a lost executor costs nothing, and
    the shuffles behind it are freed."""
    path = shared_dir(df.sparkSession, label)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that `materialise` gave and nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, path = file_system(folder)
        fs.delete_dir(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_file(uri: str, write: Callable) -> None:
    """write(stream) fills a file that gets its name only when whole, so that repeated attempts of a task replace one another."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def row_bucket(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")) % n


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns as one struct `row`, beside computed ones: whatever the columns are called, nothing clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in extra.items()])


def text_runs(texts: list, most: int = 1 << 21):
    """Runs of texts of about `most` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def parts(batches, column: int, most: int = 1 << 21):
    """Arrow batches cut so that the texts of a column have about `most` bytes together: what a task holds stays small."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
            yield b.slice(start, end - start)
            start = end
        if not b.num_rows:
            yield b
