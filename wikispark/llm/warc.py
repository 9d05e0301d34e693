"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

`write_archives` makes one archive a partition, compressed as a single gzip stream: nothing in it can be reached but from
the start. `normalise` inflates such a stream once, in pieces, rewrites every record as a gzip member of its own and writes
a sidecar index of offsets beside the archive. `read_records` reads the sidecars and fetches each record by its offset.
All three are tasks over files in the shared folder; a file gets its name only when whole, so a repeated task replaces it.

Identical payloads: of rows whose payloads are equal and have at least `least` bytes, the one with the largest page_id is
stored, the others are revisit records that refer to it. Definitions: null html is the empty payload; a null url leaves
out the target; rows without a page_id are written, may refer to others and are never referred to; rows that repeat the
largest page_id of a payload are all stored. An empty table gives no archive and no record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikispark.llm.common import file_system, materialise, shared_dir, write_file

LEVEL = 1  # of compression
PIECE = 1 << 20  # bytes inflated at a time
WHEN = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its two closing line ends."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    named = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", WHEN), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload))]
    named += [("WARC-Record-ID", f"<urn:page:{page_id}>")] if page_id is not None else []
    named += [("WARC-Target-URI", "".join(url.splitlines()))] if url else []
    named += [("WARC-Profile", SAME), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if refers_to is not None else []
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a record, lower-case, and where its block starts."""
    end = raw.index(b"\r\n\r\n") + 4
    lines = raw[: end - 4].decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}, end


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces of at most PIECE bytes; an end within a member is an error."""
    engine, begun = zlib.decompressobj(31), False
    while raw := stream.read(PIECE):
        while raw:
            yield engine.decompress(raw, PIECE)
            raw, begun = engine.unconsumed_tail, True
            if engine.eof:
                raw, engine, begun = engine.unused_data, zlib.decompressobj(31), False
    if begun:
        yield engine.flush()
        if not engine.eof:
            raise EOFError("the archive ends within a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of pieces of an archive's content."""
    held = bytearray()
    need, at = 0, 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields, _ = headers(bytes(held[at : end + 4]))
                need = end + 4 - at + int(fields["content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
        at = 0
    if held:
        raise ValueError("an archive ends within a record")


def duplicates(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to): rows whose payload is stored under a larger page_id; only ids and digests are shuffled."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    small = pages.select("page_id", F.octet_length(body).alias("n"), F.sha1(body).alias("digest")).where(F.col("n") >= least)
    stored = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    found = small.join(stored, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return found.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(uri, records): one monolithic archive for each partition of pages."""
    folder = shared_dir(pages.sparkSession, "warc")
    seen = materialise(duplicates(pages, least), "warc-duplicates").select(F.col("page_id").alias("d_id"), F.col("digest").alias("d_digest"), "refers_to")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.join(seen, F.col("page_id").eqNullSafe(F.col("d_id")) & (F.col("digest") == F.col("d_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n, uri = 0, f"{folder}/whole/{TaskContext.get().partitionId():06d}.warc.gz"

        def write(out):
            nonlocal n
            engine = zlib.compressobj(LEVEL, wbits=31)
            for b in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out.write(engine.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)))
                    n += 1
            out.write(engine.flush())

        write_file(uri, write)
        yield pa.RecordBatch.from_pydict({"uri": [uri] * bool(n), "records": pa.array([n] * bool(n), pa.int64())})

    return materialise(rows.mapInArrow(run, "uri string, records long"), "warc-files")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(uri, records, index): every archive of the column `uri`, rewritten under folder with a member for each record."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for uri in b.column(0).to_pylist():
                target = f"{folder}/{uri.rsplit('/', 1)[1]}"
                index: list[str] = []

                def write(out, uri=uri, index=index, target=target):
                    at = 0
                    fs, path = file_system(uri)
                    with fs.open_input_stream(path, compression=None) as stream:
                        for raw in records(inflate(stream)):
                            engine = zlib.compressobj(LEVEL, wbits=31)
                            member = engine.compress(raw) + engine.flush()
                            index.append(f"{target}\t{at}\t{len(member)}\n")
                            out.write(member)
                            at += len(member)

                write_file(target, write)
                write_file(f"{target}.idx", lambda out, index=index: out.write("".join(index).encode()))
                yield pa.RecordBatch.from_pydict({"uri": [target], "records": pa.array([len(index)], pa.int64()), "index": [f"{target}.idx"]})

    files = archives.select("uri")
    n = max(1, files.count())  # a file is the least that a task can take
    return materialise(files.repartitionByRange(n, "uri").mapInArrow(run, "uri string, records long, index string"), "warc-normal")


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Every record that the sidecar indexes in folder list: page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and, if wanted, the stored payload (null for revisits). A stored payload that does not match its digest raises."""
    names = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    index = spark.read.schema("uri string, at long, length long").option("sep", "\t").option("pathGlobFilter", "*.idx").csv(folder)

    def number(urn: str | None) -> int | None:
        return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None

    def run(batches):
        import pyarrow as pa

        schema = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 + payload]
        opened, stream = None, None
        for b in batches:
            rows = []
            for uri, at, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if uri != opened:
                    if stream:
                        stream.close()
                    fs, path = file_system(uri)
                    opened, stream = uri, fs.open_input_file(path)
                stream.seek(at)
                raw = zlib.decompress(stream.read(length), 31)
                fields, start = headers(raw)
                body = None
                if fields["warc-type"] == "response":
                    body = raw[raw.index(b"\r\n\r\n", start) + 4 : -4]
                    if f"sha1:{hashlib.sha1(body).hexdigest()}" != fields["warc-payload-digest"]:
                        raise ValueError(f"{uri} at {at}: the payload does not match its digest")
                rows.append((number(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"], number(fields.get("warc-refers-to")), int(fields["warc-payload-length"]), fields["warc-payload-digest"][5:], body)[: 6 + payload])
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=[x.split()[0] for x in names.split(", ")])
        if stream:
            stream.close()

    return index.mapInArrow(run, names)


def round_trip(pages: DataFrame, least: int = 1000, payload: bool = False) -> DataFrame:
    """Writes pages as monolithic archives, normalises them and reads every record back by its offset."""
    folder = shared_dir(pages.sparkSession, "warc-members")
    wrote = normalise(write_archives(pages, least), folder)
    if not wrote.limit(1).count():
        names = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
        return pages.sparkSession.createDataFrame([], names)
    return read_records(pages.sparkSession, folder, payload)


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM p),
r AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= 1000 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
""".strip()
