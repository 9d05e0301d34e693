"""Main text of web pages: a host suffix array finds what pages of a host repeat, page structure ranks the rest.

A page is read as blocks in page order, each with a rank told by element, role, class and id: `text` inside an article (or,
without one, main) element; `doubtful` there, where a class or id only resembles what is no text; `open` on pages without
such an element; `aside` for menus, headers, footers, sidebars, notices, adverts, forms, comments, and all that lies
outside an article. A block starts with a mark, so a page is one stream of marks and words. The streams of all pages of a
host are concatenated and their suffixes sorted by the first `least` tokens; a run of equal prefixes from distinct pages
is a substring repeated across pages (a longer repeat is a union of such runs). Tokens covered by a repeat are boilerplate
and go, unless their rank is `text`; what no repeat covers stays if it is `doubtful` or `open`, and goes if it is `aside`.
`repeated` counts the words that go as repeats, `structural` those that structure alone tells.

In the rank `text` articles quote the same passages and come in near copies, so there a repeat must be a whole block, from
its mark to the next, on at least FEWEST kinds of pages and at least half of those of the host that have an article; shorter
suffixes that lie wholly within it decide nothing and are not sorted. Near copies of one page count as one: each page has
three minima of its hashed tokens, and a repeat counts only if its pages differ in each of them (pages of which 0.8 is
shared do so by chance once in 125 times); kinds of pages are told by the first of them. Sorting is a shuffle by host and prefix, so a host with a third of all pages is dealt out like any other, and
a prefix that many pages share is reduced to its extreme keys before it is shuffled.

Definitions. White space within a block becomes one space, blocks are joined by one space, character references are
decoded; null or empty html gives an empty text; rows that repeat a page count as one page of the host and all get their
text; a url without a host belongs to the host ''. A comment that is not closed ends at the next '>', a script or the like
that is not closed at the next block element.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikispark.llm.common import materialise, parts

LEAST = 8  # tokens of a repeat, block marks included
SALTS = 8
FEWEST = 3
MARK = ""  # starts a block; no word is empty
TEXT, DOUBTFUL, OPEN, ASIDE = range(4)

# Elements of HTML by what they mean here, and words in class or id that tell what a block is.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
UNSEEN = {"head", "noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "datalist", "dialog"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
NO_TEXT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social", "related", "recommended", "comment", "comments", "discussion", "teaser", "teasers", "notice", "notices", "announcement", "disqus", "respond", "pagination", "pager"}
BOXES = {"area", "cta", "site", "page", "banner", "bar", "block", "body", "box", "buttons", "container", "form", "icons", "inner", "item", "items", "links", "list", "posts", "section", "slot", "thread", "unit", "widget", "wrap", "wrapper"}
LIKELY = {"header", "masthead", "banner", "alert", "toolbar", "search", "login", "widget", "copyright", "disclaimer", "legal"}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
PARTS = re.compile(r"[a-z0-9]+")
BLOCK = re.compile(r"</?(?:article|body|div|footer|h[1-6]|main|nav|p|section)\b", re.I)


def told(tag: str, attributes: str, inside: bool) -> int | None:
    """ASIDE if the element, its role, class or id says that it is no text, DOUBTFUL if they resemble that, else None.

    A name says so if all its parts are words for such blocks or for boxes (comment-list, but not related-work).
    """
    if tag in CHROME and not (tag == "header" and inside):
        return ASIDE
    if not attributes or tag in ("html", "body", "main"):
        return None
    named = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "") or named.get("role") in ROLES:
        return ASIDE
    names = [set(PARTS.findall(x)) for x in (named.get("class", "") + " " + named.get("id", "")).split()]
    if any(x & NO_TEXT and x <= NO_TEXT | BOXES for x in names):
        return ASIDE
    return DOUBTFUL if any(x & (NO_TEXT | LIKELY) for x in names) and tag != "article" else None


def blocks(html: str) -> list[tuple[int, str]]:
    """(rank, text) of every block with text, in page order."""
    out: list[tuple[bool, bool, bool, bool, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # open containers: (tag, what they make of their content)
    opened: Counter = Counter()  # of them, by tag
    depth = {"unseen": 0, "aside": 0, "doubtful": 0, "article": 0, "main": 0, "": 0}

    def flush():
        if held:
            if text := " ".join(unescape("".join(held)).split()):
                out.append((depth["article"] > 0, depth["main"] > 0, depth["aside"] > 0, depth["doubtful"] > 0, text))
            held.clear()

    def leave(tag):
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                for name, kind in stack[i:]:
                    depth[kind] -= 1
                    opened[name] -= 1
                del stack[i:]
                return

    at, end, low = 0, len(html), None
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not depth["unseen"]:
            held.append(html[at:lt])
        if lt == end:
            break
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = close + 3 if close >= 0 else html.find(">", lt) + 1
            if not at:
                break
            continue
        m = TAG.match(html, lt)
        if not m:
            if html[lt + 1 : lt + 2] in ("!", "?") or html[lt + 1 : lt + 2] == "/" or html[lt + 1 : lt + 2].isalpha():
                at = html.find(">", lt) + 1  # a declaration, or a tag that is not well formed
                if not at:
                    break
            else:
                if not depth["unseen"]:
                    held.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            leave(tag)
        elif tag in RAW:
            low = html.lower() if low is None else low
            close = low.find(f"</{tag}", at)
            if close < 0:
                later = BLOCK.search(html, at)
                close = later.start() if later else end
            at = close
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
                leave(tag)
            kind = "unseen" if tag in UNSEEN else {ASIDE: "aside", DOUBTFUL: "doubtful"}.get(told(tag, m[3], depth["article"] > 0), tag if tag in ("article", "main") else "")
            if kind or tag not in INLINE and tag not in CLOSES_ITSELF:
                if tag in INLINE:
                    flush()
                stack.append((tag, kind))
                opened[tag] += 1
                depth[kind] += 1
    flush()
    inside = 0 if any(a and not x for a, _, x, _, _ in out) else 1 if any(m and not x for _, m, x, _, _ in out) else None
    found = []
    for b in out:
        aside, doubtful, text = b[2:]
        rank = ASIDE if aside or inside is not None and not b[inside] else OPEN if inside is None else DOUBTFUL if doubtful else TEXT
        found.append((rank, text))
    return found


def stream(page: list[tuple[int, str]]) -> tuple[list[str], list[int]]:
    """The tokens of a page, a mark before each block, and their ranks."""
    tokens: list[str] = []
    ranks: list[int] = []
    for rank, text in page:
        own = [MARK, *text.split(" ")]
        tokens += own
        ranks += [rank] * len(own)
    return tokens, ranks


def main_text(page: list[tuple[int, str]], starts: list[int], least: int) -> tuple[str, int, int]:
    """The text, and how many words went as repeats and by structure; a repeat covers `least` tokens from a start, or, where
    the start is negative, the block of rank text with the number -1 - start."""
    covered_blocks = {s for s in starts if s < 0}
    covered = {p for s in starts if s >= 0 for p in range(s, s + least)}
    kept, at, repeated, structural = [], 0, 0, 0
    for number, (rank, text) in enumerate(page):
        words = text.split(" ")
        left = ([] if -1 - number in covered_blocks else words) if rank == TEXT else [w for i, w in enumerate(words, at + 1) if i not in covered]
        repeated += len(words) - len(left)
        if rank == ASIDE:
            structural += len(left)
        elif left:
            kept.append(" ".join(left))
        at += len(words) + 1
    return " ".join(kept), repeated, structural


def window_hashes(tokens: list[str], least: int):
    """The hash of each run of `least` tokens."""
    import numpy as np
    import xxhash

    n = len(tokens) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))
    h = np.zeros(n, np.uint64)
    for i in range(least):
        h = (h ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def families(h, ranks: list[int], least: int) -> list[int]:
    """Three minima over the runs that are not aside (over all if none is): near copies share at least one of them."""
    import numpy as np

    own = h[(np.convolve(np.array(ranks) != ASIDE, np.ones(least, int))[least - 1 : least - 1 + len(h)] == least)] if len(h) else h
    own = own if len(own) else h
    return [int((own * np.uint64(f)).min().view(np.int64)) if len(own) else 0 for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x165667B19E3779F9)]


def suffixes(pages: DataFrame, least: int) -> DataFrame:
    """(key of host and prefix, page, start, f0, f1, f2): every suffix by its first `least` tokens, of which not all are text;
    and each block of rank text by all of its tokens, with -1 - its number as start and the host as f2."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in parts(batches, 2):
            cols: list[list] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for page, host, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page_blocks = blocks(html)
                tokens, ranks = stream(page_blocks)
                h = window_hashes(tokens, least)
                at = np.flatnonzero(np.convolve(np.array(ranks) != TEXT, np.ones(least, int))[least - 1 : least - 1 + len(h)]) if len(h) else []
                kinds = families(h, ranks, least)
                own = [(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), host & (1 << 64) - 1), -1 - i) for i, (rank, text) in enumerate(page_blocks) if rank == TEXT]
                if own:
                    for c, x in zip(cols, (np.array([k for k, _ in own], np.uint64).view(np.int64), page, [i for _, i in own], *kinds[:2], host), strict=True):
                        c.append(np.broadcast_to(np.asarray(x, np.int64), len(own)))
                if len(at):
                    key = (h[at] ^ np.uint64(host & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                    for c, x in zip(cols, (key.view(np.int64), page, at, *kinds), strict=True):
                        c.append(np.broadcast_to(np.asarray(x, np.int64), len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "page", "start", "f0", "f1", "f2"])

    return pages.select("page", "host", "html").mapInArrow(run, "key long, page long, start long, f0 long, f1 long, f2 long")


def repeats(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page, starts): where substrings repeated across distinct pages of a host start."""
    array = materialise(suffixes(pages, least), "suffixes")
    within, array = array.where("start < 0"), array.where("start >= 0")
    runs = array.groupBy("key").agg(*[g(f).alias(f"{n}{f}") for f in ("f0", "f1", "f2") for n, g in (("min_", F.min), ("max_", F.max))])
    runs = runs.where("min_f0 < max_f0 and min_f1 < max_f1 and min_f2 < max_f2").select("key")
    kinds = within.select("key", "f2", "f0").distinct().groupBy("key", "f2").agg(F.count("*").alias("n"))
    of_host = within.select("f2", "f0").distinct().groupBy("f2").agg(F.count("*").alias("all"))
    whole = kinds.where(F.col("n") >= FEWEST).join(of_host, "f2").where("2 * n >= `all`").select("key")
    found = [_met(rows, keys) for rows, keys in ((array, runs), (within, whole))]
    at = found[0].unionByName(found[1])
    return materialise(at.groupBy("page").agg(F.collect_set(F.col("start").cast("int")).alias("starts")), "repeats")


def _met(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(page, start) of the rows whose key is among the keys; a key that very many rows have is dealt out."""
    keys = keys.select(F.col("key").alias("r_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt"))
    salt = F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")
    return rows.join(keys, (F.col("key") == F.col("r_key")) & (salt == F.col("r_salt"))).select("page", "start")


def extract(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars, repeated, structural of every row."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id", "url", "html").alias("page"), F.xxhash64(host).alias("host"))
    found = repeats(rows, least).withColumnRenamed("page", "r_page")
    joined = rows.join(found, F.col("page") == F.col("r_page"), "left").select("page_id", "url", "html", "starts")

    def run(batches):
        import pyarrow as pa

        for b in parts(batches, 2):
            found = [main_text(blocks(h), s or [], least) for h, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            longs = [pa.array(x, pa.int64()) for x in ([len(t) for t, _, _ in found], [r for _, r, _ in found], [s for _, _, s in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _, _ in found], pa.string()), *longs], names=["page_id", "url", "text", "n_chars", "repeated", "structural"])

    kinds = {f.name: f.dataType for f in pages.schema}
    schema = T.StructType([T.StructField("page_id", kinds["page_id"]), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("n_chars", "repeated", "structural")])
    return joined.mapInArrow(run, schema)
