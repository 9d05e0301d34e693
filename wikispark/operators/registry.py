"""Analytics over the page registry: related pages, navigation, groupings, statistics, the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import text as X
from wikispark.operators.graphs import numbered, settle, top_ancestors

UNSORTED = "未分类"
OTHERS = "其他"


def related_pages(registry: DataFrame, limit: int = 5, most_tags: int = 8) -> DataFrame:
    """registry(slug, type, tags, pos) → (slug, related_slug, score, rank): the pages that share most tags.

    score: how many of a page's tags are among the current page's; without any, an equal type scores 0.1; ties keep registry
    order. A related page shares some set of tags with the current one; were it not among the first limit + 1 pages that
    hold this set, limit others would score as much and come first. So each set of a page's tags offers its first pages, and
    no tag, however popular, makes pairs of its pages. Pages of equal tags have the same partners but for themselves, so
    limit + 1 are found once for each distinct set of tags. Pages with more than `most_tags` tags, or with one twice, meet others
    by every tag. A page with fewer than `limit` results shares tags with fewer than that, so the first 2 * limit pages of
    its type fill them up.
    """
    own = registry.select("slug", "type", "pos", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).withColumn("set", F.array_sort(F.array_distinct("tags")))
    own = settle(own.repartition("slug"))  # a small file is one task, whatever its rows need when sorted
    plain = (F.size("tags") == F.size("set")) & (F.size("set") <= most_tags)
    bits = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("set")).cast("int") - 1)
    subsets = F.transform(bits, lambda b: F.filter("set", lambda x, i: F.pmod(F.floor(b / F.pow(F.lit(2), i)), F.lit(2)) == 1))
    even = own.where(plain & (F.size("set") > 0)).select("slug", "pos", "set")
    shown = settle(_first(even, ["set"], limit + 1))  # the first pages of each distinct set stand for all of its pages
    keyed = shown.select("slug", "pos", "set", F.explode(subsets).alias("key"))
    first = keyed.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("pos"))).where(F.col("n") <= limit + 1).select("key", F.col("slug").alias("other"), F.col("pos").alias("at"), F.col("set").alias("theirs"))
    sets = shown.select("set").distinct()
    met = sets.select("set", F.explode(subsets).alias("key")).join(first, "key").select("set", "other", "at", F.size(F.array_intersect("set", "theirs")).cast("double").alias("score")).distinct()
    order = lambda key: W.partitionBy(key).orderBy(F.col("score").desc(), "at")
    of_set = met.withColumn("rank", F.row_number().over(order("set"))).where(F.col("rank") <= limit + 1).groupBy("set").agg(F.collect_list(F.struct("other", "at", "score")).alias("best"))
    alike = even.join(of_set, "set").select("slug", F.explode("best").alias("b")).select("slug", "b.other", "b.at", "b.score").where("slug <> other")
    tag = own.select("slug", plain.alias("plain"), F.explode("set").alias("tag"))
    odd = tag.where(~F.col("plain")).select(F.col("slug").alias("x"), "tag").join(tag.select(F.col("slug").alias("y"), "tag"), "tag")
    pairs = odd.select(F.col("x").alias("slug"), F.col("y").alias("other")).unionByName(odd.select(F.col("y").alias("slug"), F.col("x").alias("other")))
    pairs = pairs.where("slug <> other").distinct()
    theirs = own.select(F.col("slug").alias("other"), F.col("tags").alias("their_tags"), F.col("pos").alias("at"))
    scored = pairs.join(own.select("slug", "set"), "slug").join(theirs, "other").select("slug", "other", "at", F.size(F.filter("their_tags", lambda t: F.array_contains("set", t))).cast("double").alias("score"))
    tagged = alike.unionByName(scored).withColumn("rank", F.row_number().over(order("slug"))).where(F.col("rank") <= limit)
    few = tagged.groupBy("slug").agg(F.count("*").alias("n"))
    few = own.join(few, "slug", "left").where(F.coalesce("n", F.lit(0)) < limit).select("slug", "type")
    kinds = _first(own.select("slug", "type", "pos"), ["type"], 2 * limit).select("type", F.col("slug").alias("other"), F.col("pos").alias("at"))
    typed = few.join(kinds, "type").where("slug <> other").join(tagged.select("slug", "other"), ["slug", "other"], "left_anti").select("slug", "other", "at", F.lit(0.1).alias("score"))
    rows = tagged.drop("rank").unionByName(typed).withColumn("rank", F.row_number().over(order("slug")))
    return rows.where(F.col("rank") <= limit).select("slug", F.col("other").alias("related_slug"), "score", "rank")


def _first(rows: DataFrame, by: list[str], n: int, shards: int = 64) -> DataFrame:
    """The first n rows by pos of each value: within shards of the rows first, so that a frequent value makes no large task."""
    within = W.partitionBy(*by, "_shard").orderBy("pos")
    kept = rows.withColumn("_shard", F.pmod(F.xxhash64("slug"), F.lit(shards))).withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= n)
    return kept.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("pos"))).where(F.col("_n") <= n).drop("_shard", "_n")


def prev_next(sequences: DataFrame) -> DataFrame:
    """sequences(seq_no, pos, path) → (path, prev, next) in the first sequence that holds the path."""
    w = W.partitionBy("seq_no").orderBy("pos")
    rows = sequences.select("seq_no", "path", F.lag("path").over(w).alias("prev"), F.lead("path").over(w).alias("next"), "pos")
    return rows.groupBy("path").agg(F.min_by(F.struct("prev", "next"), F.struct("seq_no", "pos")).alias("x")).select("path", "x.prev", "x.next")


def type_histogram(registry: DataFrame) -> DataFrame:
    """(type, cnt, percent of the largest)."""
    counts = registry.groupBy("type").agg(F.count("*").alias("cnt"))
    return counts.withColumn("percent", F.round(F.col("cnt") / F.max("cnt").over(W.partitionBy()) * 100).cast("int"))


def hero_stats(registry: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    """(knowledge_pages, cross_references, domains, all_pages): one row."""
    pages = registry.agg(F.sum((F.col("type") != "source").cast("long")).alias("knowledge_pages"), F.count("*").alias("all_pages"))
    return pages.crossJoin(links.agg(F.count("*").alias("cross_references"))).crossJoin(domains.agg(F.countDistinct("domain").alias("domains")))


def size_chart(registry: DataFrame, links: DataFrame) -> DataFrame:
    """(name, value, percent of the largest) for search entries, tags and links."""
    one = registry.agg(F.count("*").alias("a"), F.sum(F.size("tags")).cast("long").alias("b")).crossJoin(links.agg(F.count("*").alias("c")))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), F.greatest("a", "b", "c").alias("most")) for n, c in (("search entries", "a"), ("tags", "b"), ("wiki links", "c"))])).alias("x"))
    return rows.select("x.name", "x.value", F.round(F.col("x.value") / F.col("x.most") * 100).cast("int").alias("percent"))


def sitemap(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.coalesce("type", F.lit("uncategorized")).alias("type")).agg(F.count("*").alias("cnt"))


def hub_pages(registry: DataFrame, concept: bool = False, kind: str = "concept") -> DataFrame:
    """(type, cnt, total): the concept hub, or all other types."""
    own = registry.where((F.col("type") == kind) if concept else (F.col("type") != kind))
    counts = own.groupBy("type").agg(F.count("*").alias("cnt"))
    return counts.withColumn("total", F.sum("cnt").over(W.partitionBy()))


def domains(registry: DataFrame) -> DataFrame:
    """registry(slug, title, type, parent_ids) → (domain, title, cnt): pages under the top-most reachable ancestor; pages without
    a parent are their own domain only if something lies below; entities fall to the others."""
    pages = registry.where(F.col("type") != "entity")
    parents = pages.select("slug", F.try_element_at("parent_ids", F.lit(1)).alias("parent"))
    top = top_ancestors(parents)
    counts = top.groupBy(F.col("top").alias("domain")).agg(F.count("*").alias("cnt"))
    named = counts.join(registry.select(F.col("slug").alias("s"), F.col("title").alias("t")), F.col("domain") == F.col("s"), "left")
    found = named.select("domain", F.coalesce("t", X.humanise(F.regexp_replace("domain", "-", " "))).alias("title"), "cnt")
    others = registry.where(F.col("type") == "entity").agg(F.count("*").alias("cnt")).where("cnt > 0")
    return found.unionByName(others.select(F.lit(OTHERS).alias("domain"), F.lit(OTHERS).alias("title"), "cnt"))


def activity(registry: DataFrame, samples: int = 3) -> DataFrame:
    """(updated, cnt, types, titles): dated pages by day, with their types and a few titles in order."""
    dated = registry.where(F.col("updated").isNotNull())
    named = dated.where(F.col("title").isNotNull()).groupBy("updated", "title").agg(F.lit(1).alias("one"))
    named = named.withColumn("n", F.row_number().over(W.partitionBy("updated").orderBy("title"))).where(F.col("n") <= samples)
    titles = named.groupBy(F.col("updated").alias("day")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    days = dated.groupBy("updated").agg(F.count("*").alias("cnt"), F.array_sort(F.collect_set("type")).alias("types"))
    return days.join(titles, days["updated"] == titles["day"], "left").select("updated", "cnt", "types", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def link_graph(links: DataFrame, registry: DataFrame, left_out: tuple[str, ...] = ("source", "overview")) -> tuple[DataFrame, DataFrame]:
    """nodes(slug, lc, r) and edges(a, b): the undirected graph of page links, each edge once; r = 2 + lc div 3."""
    slugs = registry.where(~F.col("type").isin(*left_out)).select("slug")
    edges = links.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    edges = edges.join(slugs.select(F.col("slug").alias("a")), "a", "left_semi").join(slugs.select(F.col("slug").alias("b")), "b", "left_semi").select("a", "b")
    degree = edges.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("lc"))
    nodes = slugs.join(degree, slugs["slug"] == degree["n"], "left").select("slug", F.coalesce("lc", F.lit(0)).alias("lc"))
    return nodes.withColumn("r", (2 + F.floor(F.col("lc") / 3)).cast("int")), edges


def recent_builds(builds: DataFrame, n: int = 10) -> DataFrame:
    """The first n builds by position, the first one marked as the latest."""
    return builds.orderBy("pos").limit(n).withColumn("latest", F.col("pos") == F.min("pos").over(W.partitionBy()))


def open_items(journal: DataFrame) -> DataFrame:
    """(source, kind, cnt) of items that are not done."""
    return journal.where(~F.col("done")).groupBy("source", "kind").agg(F.count("*").alias("cnt"))


def parts_of(rows: int, df: DataFrame, each: int = 25_000) -> int:
    """How many partitions deal that many narrow rows, so that a task's share does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def next_links(pages: DataFrame) -> DataFrame:
    """pages(slug, pos) → (a, b): distinct pairs of the slugs of neighbouring places, a < b or equal.

    Rows are dealt before they are joined and before equal ones are dropped: no task holds a hash table of what one file part has.
    """
    parts = parts_of(pages.count(), pages)
    at = pages.select("slug", (F.col("pos") + 1).alias("pos")).repartition(parts, "pos")
    nxt = at.join(pages.select(F.col("slug").alias("other"), "pos").repartition(parts, "pos").hint("merge"), "pos")
    return nxt.select(F.least("slug", "other").alias("a"), F.greatest("slug", "other").alias("b")).repartition(parts, "a", "b").distinct()


def nav_neighbours(registry: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """(slug, role, pos, target): parents, all children, then up to `limit` other neighbours in the link graph by slug.

    All that is known of a slug is dealt once, by slug, into parts whose number grows with the registry, and sorted there: no
    hash tables and no broadcasts. Children count for slugs of the registry only; a parent or child is no other neighbour.
    """
    rank, none = {"self": 0, "parent": 1, "child": 2, "related": 3}, F.lit(None).cast("string")
    fact = lambda df, slug, role, pos, target: df.select(slug.alias("slug"), F.lit(role).alias("role"), F.lit(rank[role]).alias("nth"), pos.cast("int").alias("pos"), target.alias("target"))
    up, no = registry.select("slug", F.posexplode("parent_ids").alias("pos", "target")), F.lit(None)
    slug, target, a, b = (F.col(c) for c in ("slug", "target", "a", "b"))
    facts = [fact(registry, slug, "self", no, none), fact(up, slug, "parent", F.col("pos"), target), fact(up, target, "child", no, slug), fact(edges, a, "related", no, b), fact(edges, b, "related", no, a)]
    rows = facts[0]
    for f in facts[1:]:
        rows = rows.unionByName(f)
    rows = rows.repartition(parts_of(registry.count(), registry), "slug")
    known = F.max(F.col("nth") == 0).over(W.partitionBy("slug").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)) & slug.isNotNull()  # own rows come first
    rows = rows.withColumn("known", known).where("nth > 0 AND (nth <> 2 OR known)")
    kin = F.max(F.col("nth") < 3).over(W.partitionBy("slug", "target").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)) & slug.isNotNull() & target.isNotNull()
    rows = rows.withColumn("kin", kin).where("nth < 3 OR NOT kin")
    pos = F.when(F.col("nth") == 1, F.col("pos")).otherwise(F.row_number().over(W.partitionBy("slug", "nth").orderBy("target")) - 1)
    return rows.withColumn("pos", pos).where(f"nth < 3 OR pos < {int(limit)}").select("slug", "role", "pos", "target")


def tooltips(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """refs(slug) → (slug, title, label, background, colour, summary); the colours of unknown types are grey."""
    rows = refs.join(registry.select("slug", "title", "type", "summary"), "slug")
    colour = lambda i, grey: F.coalesce(X._lookup({k: v[i] for k, v in X.TYPE_COLOURS.items()}, F.col("type")), F.lit(grey))
    return rows.select("slug", "title", X.type_label(F.col("type")).alias("label"), colour(0, "#eee").alias("background"), colour(1, "#333").alias("colour"), "summary")


def domain_outline(registry: DataFrame) -> DataFrame:
    """(domain, cnt, pages): each domain with its pages in order, as one line of an outline."""
    top = top_ancestors(registry.select("slug", F.try_element_at("parent_ids", F.lit(1)).alias("parent")))
    rows = F.array_sort(F.collect_list("slug"))
    return top.groupBy(F.col("top").alias("domain")).agg(F.count("*").alias("cnt"), F.array_join(rows, ", ").alias("pages"))


def outline(registry: DataFrame) -> DataFrame:
    """registry(slug, parent_ids) → (pos from 0, level, domain, section, slug, cnt): the outline as rows in order, not as lists.

    Level 1: a domain (top-most ancestor) with its pages' number; level 2: a section (the ancestor next below the domain, or
    the page itself) with that of its pages, itself included; level 3: each further page of the section. Pages without a
    parent are in no domain. A cycle of parents has its smallest id as its domain. Rows that repeat a slug are one page.
    """
    parents = registry.select("slug", F.try_element_at("parent_ids", F.lit(1)).alias("parent")).where("parent IS NOT NULL")
    parents = parents.groupBy("slug").agg(F.min("parent").alias("parent"))
    tops = settle(top_ancestors(parents))
    below = parents.join(tops, "slug").where("parent <> top").select("slug", "parent")  # without what hangs on a domain itself
    second = top_ancestors(below).select(F.col("slug").alias("s"), F.col("top").alias("section"))
    pages = settle(tops.join(second, F.col("slug") == F.col("s"), "left").select("slug", F.col("top").alias("domain"), F.coalesce("section", "slug").alias("section")))
    none = F.lit(None).cast("string")
    heads = pages.groupBy("domain").agg(F.count("*").alias("cnt")).select(F.lit(1).alias("level"), "domain", none.alias("section"), none.alias("slug"), "cnt")
    parts = pages.groupBy("domain", "section").agg(F.count("*").alias("cnt")).select(F.lit(2).alias("level"), "domain", "section", none.alias("slug"), "cnt")
    rest = pages.where("slug <> section").select(F.lit(3).alias("level"), "domain", "section", "slug", F.lit(1).cast("long").alias("cnt"))
    return numbered(heads.unionByName(parts).unionByName(rest), ["domain", "section", "slug"], "pos")  # nulls come first


def topic_catalog(topics: DataFrame, live: DataFrame, prebuilt: DataFrame) -> DataFrame:
    """topics(topic), live/prebuilt(topic, pages) → (topic, served_from, pages): live output wins, then prebuilt, else missing."""
    rows = topics.join(live.select("topic", F.col("pages").alias("l")), "topic", "left").join(prebuilt.select("topic", F.col("pages").alias("p")), "topic", "left")
    return rows.select("topic", F.when(F.col("l").isNotNull(), "live").when(F.col("p").isNotNull(), "prebuilt").otherwise("missing").alias("served_from"), F.coalesce("l", "p", F.lit(0)).alias("pages"))
