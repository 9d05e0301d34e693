"""Full-text search over pages: every term of a query is part of a page's text, by an inverted index of short character runs.

The index holds, for each distinct run of one, two or three characters and each shard of pages, the list of the shard's pages that
have it. Runs of a shard are found for all of its texts at once, so a text is read once and no run of a page is a row of its own. A
term of one or two characters is such a run itself, a longer one contains runs of three, so a query's pages are among the lists of
every run of its terms. They are looked up for the rarest run, narrowed down by the next rarest shard by shard, and what is left is held
against the text; queries of at most RAREST terms that all are runs themselves need no text, since the lists are the answer. No
query meets pages that lack its rarest run, however short its terms. Queries of the same terms are looked up once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import text as X
from wikispark.operators.graphs import settle
from wikispark.sources.writers import discard, freed, stored

LONGEST = 3
BLOCK, CHARACTERS = 100_000, 1 << 22  # pages and characters of a shard, at most (one page at least)
BITS = 1 << 20  # marks of asked runs that tasks know; a run without a mark is not asked for
RAREST = 3  # runs of a query that are intersected before texts are looked at


@dataclass
class Index:
    """pages(slug, haystack), postings(gram, shard, slugs), counts(gram, n: its pages)."""

    pages: DataFrame
    postings: DataFrame
    counts: DataFrame


def haystack(index: DataFrame) -> DataFrame:
    """(slug, haystack): title, summary and keywords of each row in lower case."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("keywords", F.lit(""))))
    return index.select("slug", text.alias("haystack"))


def run_keys(codes, alphabet, size: int):
    """A number for each place of a text of characters: of the run of `size` that starts there, told apart by size, in 63 bits."""
    import numpy as np

    n, keys = max(0, len(codes) - size + 1), None
    for k in range(size):
        piece = alphabet[codes[k : k + n]].astype(np.uint64) + np.uint64(1)
        keys = piece if keys is None else keys * np.uint64(1 << 21) + piece
    return np.zeros(0, np.uint64) if keys is None else keys


def marks(keys):
    return ((keys * 0x9E3779B97F4A7C15) >> (64 - 20)).astype("int64")


def run_text(keys) -> list[str]:
    """The runs that keys stand for."""
    found = []
    for key in keys.tolist():
        run = ""
        while key:
            run, key = chr((key & 0x1FFFFF) - 1) + run, key >> 21
        found.append(run)
    return found


def shard_runs(texts: list, asked=None):
    """(run, pages: places in texts, in order) of all distinct runs of the texts, as (runs, starts of their pages, pages)."""
    import numpy as np

    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    page, ends = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths)
    used = np.zeros(0x110000, bool)
    used[points] = True
    alphabet, codes = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[points]
    runs, sizes, pages = [], [], []
    for size in range(1, LONGEST + 1):
        at = np.flatnonzero(np.arange(len(points)) + size <= ends)
        if not len(at):
            continue
        if len(alphabet) ** size <= 1 << 26:  # dense numbers: no sorting
            dense = codes[at].astype(np.int64)
            for k in range(1, size):
                dense = dense * len(alphabet) + codes[at + k]
            seen = np.zeros(len(alphabet) ** size, bool)
            seen[dense] = True
            values = np.flatnonzero(seen)
            number = np.cumsum(seen, dtype=np.int32)
            nth = number[dense].astype(np.int64) - 1
            letters = [values // len(alphabet) ** (size - 1 - k) % len(alphabet) for k in range(size)]
            keys = run_keys(np.stack(letters, axis=1).ravel(), alphabet, size)[::size]
        else:
            keys, nth = np.unique(run_keys(codes, alphabet, size)[at], return_inverse=True)
        if asked is not None:
            wanted = asked[marks(keys)]
            place = np.cumsum(wanted) - 1
            kept = wanted[nth]
            keys, nth, at = keys[wanted], place[nth[kept]], at[kept]
        pairs = nth * len(texts) + page[at]
        if len(keys) * len(texts) <= 1 << 28:
            held = np.zeros(len(keys) * len(texts), bool)
            held[pairs] = True
            pairs = np.flatnonzero(held)
        else:
            pairs = np.unique(pairs)
        runs += run_text(keys)
        sizes.append(np.bincount(pairs // len(texts), minlength=len(keys)))
        pages.append(pairs % len(texts))
    none = [np.zeros(0, np.int64)]
    return runs, np.concatenate([[0], np.cumsum(np.concatenate(sizes or none))]), np.concatenate(pages or none)


def shards(batches, block: int, characters: int):
    """Arrow batches (slug, haystack) cut so that each has at most so many pages and, if more than one, characters."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size, start = np.cumsum(pc.utf8_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < b.num_rows:
            done = size[start - 1] if start else 0
            end = min(start + block, max(start + 1, int(np.searchsorted(size, done + characters, side="right"))))
            yield b.slice(start, end - start)
            start = end


def postings_of(pages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """pages(slug, haystack) → (gram, shard, slugs), of the runs in only(gram) if given, and of those that share a mark with one."""
    kind = pages.schema["slug"].dataType.simpleString()
    block, characters = BLOCK, CHARACTERS

    def marked(batches):
        import numpy as np

        for b in batches:
            grams = [g for g in b.column(0).to_pylist() if g]
            keys = [run_keys(np.arange(len(g)), np.array([ord(x) for x in g]), len(g))[0] for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(marks(np.array(keys, np.uint64)))], names=["mark"])

    asked = None if only is None else [r.mark for r in only.mapInArrow(marked, "mark long").distinct().collect()]  # BITS at most

    def run(batches):
        import numpy as np

        known = None
        if asked is not None:
            known = np.zeros(BITS, bool)
            known[asked] = True
        shard = TaskContext.get().partitionId() << 33
        for b in shards(batches, block, characters):
            runs, starts, places = shard_runs(b.column(1).to_pylist(), known)
            shard += 1
            for first in range(0, len(runs), 1 << 13):
                last = min(first + (1 << 13), len(runs))
                offsets = pa.array((starts[first : last + 1] - starts[first]).astype(np.int32))
                slugs = pa.ListArray.from_arrays(offsets, b.column(0).take(pa.array(places[starts[first] : starts[last]])))
                yield pa.RecordBatch.from_arrays([pa.array(runs[first:last], pa.string()), pa.array(np.full(last - first, shard)), slugs], names=["gram", "shard", "slugs"])

    return pages.select("slug", "haystack").mapInArrow(run, f"gram string, shard long, slugs array<{kind}>")


def runs_of_terms(terms: Column) -> Column:
    """The runs that every text with these terms has: terms of up to LONGEST characters, and the longest runs of longer ones."""
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.when(F.length(t) <= LONGEST, F.array(t)).otherwise(X.ngrams(t, LONGEST)))))


def index_of(index: DataFrame, only: DataFrame | None = None) -> Index:
    """The index of rows(slug, title, summary, keywords), if only(gram) is given of these runs at least."""
    return _index(index, only)[0]


def _index(index: DataFrame, only: DataFrame | None = None) -> tuple[Index, str]:
    """The index, and where its postings are stored: texts are gone through once."""
    pages = haystack(index)
    postings, path = stored(postings_of(pages, only), "postings")
    counts = settle(postings.groupBy("gram").agg(F.sum(F.size("slugs").cast("long")).alias("n")))
    return Index(pages, postings, counts), path


def write_index(index: DataFrame, path: str) -> None:
    """Builds the whole index once, ordered by run, so that a lookup reads the row groups of its runs."""
    built, found = _index(index)
    with freed(index.sparkSession):
        built.pages.write.mode("overwrite").parquet(f"{path}/pages")
        for name, rows, order in (("postings", built.postings, ["gram", "shard"]), ("counts", built.counts, ["gram"])):
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
    discard(found)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("pages", "postings", "counts")])


def asked_terms(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) → (query_id, terms): distinct terms in order; queries without terms find nothing."""
    terms = F.array_sort(F.array_distinct(X.search_terms(F.col("query"))))
    return queries.select("query_id", terms.alias("terms")).where(F.size("terms") > 0)


def lookup(asked: DataFrame, index: Index) -> DataFrame:
    """asked(query_id, terms) → (query_id, slug)."""
    sets = stored(asked.select("terms").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")[0]  # with true sizes, few queries do not deal all postings
    keyed = sets.select("set", F.explode(runs_of_terms(F.col("terms"))).alias("gram")).join(index.counts, "gram", "left")
    rank = F.row_number().over(W.partitionBy("set").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    ranked = stored(keyed.withColumn("rank", rank).where(F.col("rank") <= RAREST).select("set", "gram", "rank"), "ranked")[0]
    found = index.postings.join(ranked.where("rank = 1").select("set", "gram"), "gram").select("set", "shard", "slugs")
    for n in range(2, RAREST + 1):
        also = ranked.where(F.col("rank") == n).select("set", F.col("gram").alias("g"))
        held = index.postings.join(also.select(F.col("g").alias("gram")).distinct(), "gram", "left_semi").select(F.col("gram").alias("g"), "shard", F.col("slugs").alias("others"))
        both = found.join(also, "set", "left").join(held, ["g", "shard"], "left").where("g IS NULL OR others IS NOT NULL")
        found = both.select("set", "shard", F.when(F.col("g").isNull(), F.col("slugs")).otherwise(F.array_intersect("slugs", "others")).alias("slugs")).where(F.size("slugs") > 0)
    named = found.join(sets, "set").select("set", "terms", F.explode("slugs").alias("slug"))
    sure = (F.size("terms") <= RAREST) & F.forall("terms", lambda t: F.length(t) <= LONGEST)
    asked_for = stored(named.where(~sure), "candidates")[0]  # its true size tells whether texts have to move
    held = asked_for.join(index.pages, "slug").where(X.search_match(F.col("terms"), F.col("haystack")))
    near = named.where(sure).select("set", "slug").unionByName(held.select("set", "slug"))
    return asked.join(sets, "terms").select("query_id", "set").join(near, "set").select("query_id", "slug")


def search(queries: DataFrame, index: DataFrame | Index) -> DataFrame:
    """queries(query_id, query), index(slug, title, summary, keywords) or a stored one → (query_id, slug): every term is part of the row's text."""
    asked = asked_terms(queries)
    if not isinstance(index, Index):
        asked = settle(asked)
        index = index_of(index, asked.select(F.explode(runs_of_terms(F.col("terms"))).alias("gram")).distinct())
    return lookup(asked, index)
