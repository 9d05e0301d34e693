"""Spelling variants: near words by dynamic programming over sorted lists, and the form each word follows.

Two words are near if one code point inserted, deleted or replaced makes one of the other. With m the length of the
shorter, one edit leaves its first or its last m // 2 code points where they are, so near words meet in a list of words of
m and m + 1 code points that begin alike, or, read backwards, end alike. Each list is sorted, and every word of m code
points is held against it: the rows of the edit matrix, three cells wide around the diagonal, are kept by depth; the next
word of the list starts from the row at its common prefix with the last one, and where a row exceeds one edit, all words
that share that prefix are left out by one jump. A pair is found once: in the forward list if both have it. Lists beyond
TILE words are split, as queries and as lists, so that no task holds more.

Definitions. Runs of A-Z, a-z and U+00C0 to U+00FF of whole texts (null: none), A-Z lower-cased. With h the unsigned crc32
of `<doc_id>:<run>` (a null id: empty), a run loses its code point h % length where `every` divides h. Words have at least
`shortest` code points and `least` occurrences, counted over all rows, also those that repeat. A word's form is its near
word with the most occurrences, ties to the smallest by code points, if it has at least twice the word's; a form that has
a form leads on to the root. As occurrences at least double, there are no cycles. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikispark.llm.common import materialise, parts
from wikispark.llm.merkle import CRC_SQL

LEAST, SHORTEST, EVERY = 3, 5, 97
TILE = 4096  # words of a list that one task holds
HELD = 1 << 18  # distinct words that a task counts before it hands them on
LETTERS = re.compile("[a-zÀ-ÿ]+")


def runs(text: str) -> Iterator[str] | list[str]:
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return LETTERS.findall(text) if len(text) < HELD else (m[0] for m in LETTERS.finditer(text))


def noisy(word: str, start: int, every: int) -> str:
    """The word without a code point where `every` divides its crc32; start: the crc32 of what stands before it."""
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """(word, n: its occurrences)."""

    def count(batches):
        import pyarrow as pa

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for b in parts(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs(text or "")).items():
                    held[noisy(word, start, every)] += n
                if len(held) >= HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return counted.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scan(words: list[str], queries: list[str], shared: int) -> Iterator[tuple[str, str]]:
    """(query, word) of those one edit apart. words: sorted; all begin with the same `shared` code points; lengths differ by one at most."""
    n = len(words)
    common = [shared] * n  # with the word before
    for i in range(1, n):
        a, b, k = words[i - 1], words[i], shared
        most = min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        common[i] = k
    less = [n] * n  # the next word that has less in common with the one before it
    open_: list[int] = []
    for i in range(n):
        while open_ and common[open_[-1]] > common[i]:
            less[open_.pop()] = i
        open_.append(i)
    for q in queries:
        size, i, padded = len(q), 0, q + "\0\0"
        rows: list[tuple[int, int, int]] = [(1, 0, 1)] * (shared + 1)  # by depth: edits to one code point less of q, as many, one more
        while i < n:
            w = words[i]
            depth = min(common[i], len(rows) - 1)
            del rows[depth + 1 :]
            low, mid, high = rows[depth]
            end, dead = len(w), False
            while depth < end:
                c = w[depth]
                if not mid:  # no edit yet: the cells beside are one edit away
                    if padded[depth] != c:
                        low, mid, high = 1, 1, 1 if padded[depth + 1] == c else 2
                else:  # one edit: a cell stays as long as its code points agree; 2 stands for more
                    low = 1 if low == 1 and padded[depth - 1] == c else 2
                    mid = 1 if mid == 1 and padded[depth] == c else 2
                    high = 1 if high == 1 and padded[depth + 1] == c else 2
                    if low + mid + high == 6:
                        depth += 1
                        dead = True
                        break
                depth += 1
                rows.append((low, mid, high))
            if not dead:
                if (low, mid, high)[size - end + 1] == 1:
                    yield q, w
                i += 1
                continue
            i += 1
            while i < n and common[i] >= depth:
                i = less[i]


def near_pairs(words: DataFrame, shortest: int = SHORTEST, tile: int = TILE) -> DataFrame:
    """(word, n, other, other_n): every two near words once, the one with fewer code points (else the smaller) first."""
    size, text = F.length("word"), F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= shortest)
    rows = rows.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("text", text).withColumn("affix", F.expr("substring(text, 1, m div 2)"))
    rows = materialise(rows.select("m", "back", "affix", "text", "n"), "spelling-lists")
    lists = rows.groupBy("m", "back", "affix").agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.expr(f"(size + {tile - 1}) div {tile}"))
    met = rows.join(lists.drop("size"), ["m", "back", "affix"]).withColumn("own", F.expr("pmod(xxhash64(text), tiles)")).withColumn("all", F.expr("sequence(0L, tiles - 1)"))
    asked = met.where(F.length("text") == F.col("m")).select("m", "back", "affix", F.col("own").alias("asking"), F.explode("all").alias("asked"), "text", "n", F.lit(True).alias("query"))
    held = met.select("m", "back", "affix", F.explode("all").alias("asking"), F.col("own").alias("asked"), "text", "n", F.lit(False).alias("query"))
    keys = ["m", "back", "affix", "asking", "asked"]

    def run(batches):
        import pyarrow as pa

        def out(group, rows):
            m, back, affix = group[:3]
            count = {t: n for t, n, _ in rows}
            found = []
            for a, b in scan([t for t, _, q in rows if not q], [t for t, _, q in rows if q], len(affix)):
                if len(b) == m and b < a:
                    continue  # found with b as the query
                w, o = (a[::-1], b[::-1]) if back else (a, b)
                if not back or w[: m // 2] != o[: m // 2]:  # else the forward list has it
                    if len(w) == len(o) and o < w:
                        w, o, a, b = o, w, b, a
                    found.append((w, count[a], o, count[b]))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["word", "n", "other", "other_n"])

        at, rows = None, []
        for b in batches:
            for *group, text, n, query in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group != at:
                    if len(rows) > 1:
                        yield out(at, rows)
                    at, rows = group, []
                rows.append((text, n, query))
        if len(rows) > 1:
            yield out(at, rows)

    dealt = asked.unionByName(held).repartition(*keys).sortWithinPartitions(*keys, "text")
    return dealt.select(*keys, "text", "n", "query").mapInArrow(run, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) → (word, root): forms followed to the last one, twice as far each round."""
    ahead = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        jump = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = materialise(ahead.join(jump, "root", "left"), "spelling-roots")
        if not joined.where("further IS NOT NULL").limit(1).count():
            return ahead
        ahead = joined.select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialise(vocabulary(docs, least, shortest, every), "spelling-words")
    pairs = materialise(near_pairs(words, shortest), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    led = F.col("form_n") >= 2 * F.col("n")
    found = found.select("word", F.when(led, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("form_n")).alias("form_n"))
    found = materialise(found, "spelling-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = f"""WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said, run, count(*) AS n FROM run GROUP BY 1, 2),
h AS (SELECT run, n, {CRC_SQL.format(text="said")} AS h FROM c),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
v AS (SELECT * FROM w WHERE n >= {LEAST} AND length(word) >= {SHORTEST}),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN d b ON a.word = b.less UNION SELECT b.word, b.n, a.word, a.n FROM v a JOIN d b ON a.word = b.less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk w ON f.word = w.word JOIN f last ON last.word = w.at AND last.form IS NULL"""
