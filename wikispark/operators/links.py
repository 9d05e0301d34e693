"""The link graph of pages and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikispark.functions import text as X
from wikispark.operators import graphs
from wikispark.operators.graphs import settle
from wikispark.operators.tree import orders


def all_links(pages: DataFrame, alias: bool = False) -> DataFrame:
    """pages(slug, body) → (source, type, target, offset): wiki links, then diagram clicks; a bag.

    alias: [[slug|label]] links to slug; otherwise the whole content is the target.
    """
    wiki = pages.select(F.col("slug").alias("source"), F.lit("wiki").alias("type"), F.explode(X.wiki_links(F.col("body"))).alias("l"))
    target = X.alias_target(F.col("l.target")) if alias else F.col("l.target")
    wiki = wiki.select("source", "type", target.alias("target"), F.col("l.offset").alias("offset"))
    clicks = pages.select(F.col("slug").alias("source"), F.lit("mermaid-click").alias("type"), F.explode(X.click_links(F.col("body"))).alias("l"))
    return wiki.unionByName(clicks.select("source", "type", F.col("l.target").alias("target"), F.col("l.offset").alias("offset")))


def classify_links(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """+ code: E4 to itself, E1 to no page, null if valid."""
    known = slugs.select(F.col("slug").alias("k")).distinct()
    rows = links.join(known, links["target"] == known["k"], "left")
    return rows.withColumn("code", F.when(F.col("source") == F.col("target"), "E4").when(F.col("k").isNull(), "E1")).drop("k")


def incoming_counts(classified: DataFrame, slugs: DataFrame) -> DataFrame:
    """(slug, cnt): valid links to each page, 0 included."""
    counts = classified.where(F.col("code").isNull()).groupBy(F.col("target").alias("t")).agg(F.count("*").alias("cnt"))
    known = slugs.select("slug").distinct()
    return known.join(counts, known["slug"] == counts["t"], "left").select("slug", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def orphans(counts: DataFrame, root: DataFrame) -> DataFrame:
    """Pages without incoming links, the root excepted."""
    return counts.where("cnt = 0").join(root.select("slug"), "slug", "left_anti").select("slug")


def hubs(counts: DataFrame, n: int = 30) -> DataFrame:
    return counts.where(F.col("cnt") > n)


def cycle_links(classified: DataFrame, tree: DataFrame) -> DataFrame:
    """(source, target, parent_child): distinct valid links within a cycle; a flag tells links between parent and child."""
    edges = classified.where(F.col("code").isNull()).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    found = graphs.cycle_edges(edges)
    kin = tree.where(F.col("parent_slug").isNotNull()).select(F.col("slug").alias("x"), F.col("parent_slug").alias("y"))
    kin = kin.unionByName(kin.select(F.col("y").alias("x"), F.col("x").alias("y"))).withColumn("kin", F.lit(True))
    rows = found.join(kin, (found["a"] == kin["x"]) & (found["b"] == kin["y"]), "left")
    return rows.select(F.col("a").alias("source"), F.col("b").alias("target"), F.coalesce("kin", F.lit(False)).alias("parent_child"))


def link_audit(pages: DataFrame, tree: DataFrame, hub: int = 30, strict: bool = False) -> dict[str, DataFrame]:
    """errors(code, source, target), warnings(code, slug, cnt), totals, audit; strict raises if there are errors."""
    slugs = tree.select("slug").distinct()
    links = graphs.settle(classify_links(all_links(pages), slugs))
    counts = incoming_counts(links, slugs)
    errors = links.where(F.col("code").isNotNull()).select("code", "source", "target")
    errors = graphs.settle(errors.unionByName(cycle_links(links, tree).select(F.lit("E2").alias("code"), "source", "target")))
    root = tree.where(F.col("parent_slug").isNull()).select("slug")
    warnings = orphans(counts, root).select(F.lit("W1").alias("code"), "slug", F.lit(0).cast("long").alias("cnt")).unionByName(hubs(counts, hub).select(F.lit("W2").alias("code"), "slug", "cnt"))
    totals = pages.agg(F.count("*").alias("total_pages")).crossJoin(links.agg(F.count("*").alias("total_links")))
    audit = errors.agg(F.count("*").alias("p0")).crossJoin(warnings.agg(F.count("*").alias("p1")))
    if strict and errors.limit(1).count():
        raise ValueError("the link audit found errors")
    return {"errors": errors, "warnings": warnings, "totals": totals, "audit": audit}


def top_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    return errors.orderBy("code", "source", "target").limit(n)


def links_outside_allowed(links: DataFrame, allowed: DataFrame) -> DataFrame:
    """(source, target): links to pages that the page's allow-list lacks."""
    own = allowed.select(F.col("slug").alias("source"), F.explode("allowed").alias("target"))
    return links.select("source", "target").join(own, ["source", "target"], "left_anti")


def links_outside(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(source, target): links to pages that are neither ancestors nor siblings nor children of the page.

    Told from places in the tree, without lists of them: an ancestor's numbers in tree order enclose the page's, a sibling
    has its parent, a child is below it. A page that is not in the tree allows nothing; one that links to itself is outside.
    """
    place = settle(orders(tree).join(tree.select("slug", "parent_slug"), "slug").select("slug", "root", "parent_slug", "pre_no", "size"))
    of, to = (place.select(*[F.col(c).alias(side + c) for c in place.columns]) for side in ("a_", "b_"))
    rows = links.select("source", "target").join(of, F.col("source") == F.col("a_slug"), "left").join(to, F.col("target") == F.col("b_slug"), "left")
    above = (F.col("a_root") == F.col("b_root")) & (F.col("b_pre_no") < F.col("a_pre_no")) & (F.col("a_pre_no") < F.col("b_pre_no") + F.col("b_size"))
    beside = (F.col("a_parent_slug") == F.col("b_parent_slug")) & (F.col("source") != F.col("target"))
    allowed = above | beside | (F.col("b_parent_slug") == F.col("source"))
    return rows.where(~F.coalesce(allowed, F.lit(False))).select("source", "target")


def root_of(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent_slug").isNull()).select("slug")


def resolve_links(pages: DataFrame, slug_map: DataFrame) -> DataFrame:
    """(slug, html): [[slug|label]] as a link to the slug's path, or a pending mark if there is none; the label defaults to the slug."""
    pieces = F.split("body", X.WIKI_LINK, -1)
    rows = pages.select("slug", F.posexplode(F.arrays_zip(pieces.alias("piece"), X.wiki_targets(F.col("body")).alias("link"))).alias("pos", "x"))
    rows = rows.select("slug", "pos", F.col("x.piece").alias("piece"), F.col("x.link").alias("link"), X.alias_target(F.col("x.link")).alias("target"))
    paths = slug_map.select(F.col("slug").alias("m"), "path")
    rows = rows.join(paths, rows["target"] == paths["m"], "left")
    label = X.alias_label(F.col("link"))
    anchor = F.when(F.col("link").isNull(), "").when(F.col("path").isNotNull(), F.concat(F.lit('<a href="'), "path", F.lit('">'), label, F.lit("</a>"))).otherwise(F.concat(F.lit('<span class="pending">'), label, F.lit("</span>")))
    part = F.concat("piece", anchor)
    return rows.groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "").alias("html"))


def unresolved_links(pages: DataFrame, slug_map: DataFrame) -> DataFrame:
    links = all_links(pages, alias=True).where("type = 'wiki'").select(F.col("source").alias("slug"), "target")
    known = slug_map.select(F.col("slug").alias("target"))
    return links.join(known, "target", "left_anti").select("slug", "target")
