"""The page tree as an adjacency table tree(topic, slug, parent_slug, kind, label, ordinal): orders, context, construction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import text as X
from wikispark.functions.models import embed_or_constant
from wikispark.operators.graphs import numbered, settle
from wikispark.operators.vectors import TRAVEL_BYTES, centroids
from wikispark.sources.writers import discard, stored

TREE = "slug string, parent_slug string, kind string, label string, ordinal int"


def _placed(tree: DataFrame, ended: DataFrame, open_: DataFrame) -> None:
    """Raises if rows have a parent that is missing (ended without a root) or lie in or below a cycle of parents (still open)."""
    gone = ended.where("root IS NULL").select("slug").distinct().limit(5).collect()
    stuck = open_.select("slug").distinct().limit(5).collect()
    said = [f"{what}: {', '.join(sorted(str(r.slug) for r in rows))}" for what, rows in (("under a missing parent", gone), ("in or below a cycle of parents", stuck)) if rows]
    if said:
        raise ValueError(f"no root reaches all nodes of the tree; {'; '.join(said)}")


def _owned(tree: DataFrame) -> tuple[DataFrame, int]:
    """The columns that orders need, and how many rows; a slug in two rows is an error."""
    own = settle(tree.select("slug", "parent_slug", "ordinal"))
    n, slugs = own.agg(F.count("*"), F.countDistinct("slug")).first()
    if n != slugs:
        raise ValueError("a slug of the tree is in several rows, or null")
    return own, n


def lineage(tree: DataFrame) -> DataFrame:
    """(slug, root, depth from 0, path: ordinals from the root, ancestors: root first) of every node.

    Each round a node puts the list of the ancestor it has come to before its own, so lists double: log2(depth) + 1 rounds.
    Rows that no root reaches are an error that names some of them.
    """
    own, n = _owned(tree)
    up = F.col("parent_slug")
    state = own.select("slug", F.when(up.isNull(), F.col("slug")).alias("root"), up.alias("next"), F.array("ordinal").alias("path"), F.when(up.isNull(), F.array().cast("array<string>")).otherwise(F.array(up)).alias("ancestors"))
    for _ in range(n.bit_length() + 1):
        ahead = state.select(F.col("slug").alias("k"), F.col("root").alias("r"), F.col("next").alias("further"), F.col("path").alias("p"), F.col("ancestors").alias("a"))
        joined = state.join(ahead, state["next"] == ahead["k"], "left")
        lists = [F.concat(F.coalesce(theirs, F.array().cast(kind)), mine).alias(mine) for mine, theirs, kind in (("path", "p", "array<int>"), ("ancestors", "a", "array<string>"))]
        state = settle(joined.select("slug", F.coalesce("root", "r").alias("root"), F.col("further").alias("next"), *lists))
        if not state.where("next IS NOT NULL").limit(1).count():
            break
    _placed(tree, state.where("next IS NULL"), state.where("next IS NOT NULL"))
    return state.select("slug", "root", F.size("ancestors").alias("depth"), "path", "ancestors")


def levels(tree: DataFrame) -> DataFrame:
    """(slug, depth, path, ancestors) by `lineage`."""
    return lineage(tree).select("slug", "depth", "path", "ancestors")


def orders(tree: DataFrame) -> DataFrame:
    """(slug, root, pre_no from 0, depth from 0, size: nodes from here down) of every node, by ranking a tour of the tree.

    The tour enters a node, its children by ordinal (ties by slug), and leaves it: two events a node, each with the next
    one. Every round an event takes over what the event that it has come to has counted up to the end, and its next, so
    log2(2 n) + 1 rounds rank all of them whatever the tree's depth. Each root has its own tour. Rows that no root reaches
    are an error that names some of them.
    """
    own, n = _owned(tree)
    family = W.partitionBy("parent_slug").orderBy("ordinal", "slug")
    first = own.where(F.col("parent_slug").isNotNull()).groupBy(F.col("parent_slug").alias("k")).agg(F.min_by("slug", F.struct("ordinal", "slug")).alias("first"))
    rows = own.withColumn("sibling", F.when(F.col("parent_slug").isNotNull(), F.lead("slug").over(family))).join(first, F.col("slug") == F.col("k"), "left")
    enter, leave = (lambda c: F.struct(F.lit(True).alias("enters"), F.col(c).alias("slug"))), (lambda c: F.struct(F.lit(False).alias("enters"), F.col(c).alias("slug")))
    none = F.lit(None).cast("struct<enters:boolean,slug:string>")
    down = rows.select(enter("slug").alias("event"), F.when(F.col("first").isNotNull(), enter("first")).otherwise(leave("slug")).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("deep"), F.lit(None).cast("string").alias("root"))
    on = F.when(F.col("sibling").isNotNull(), enter("sibling")).when(F.col("parent_slug").isNotNull(), leave("parent_slug")).otherwise(none)
    up = rows.select(leave("slug").alias("event"), on.alias("next"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("deep"), F.when(F.col("parent_slug").isNull(), F.col("slug")).alias("root"))
    state = settle(down.unionByName(up))
    for _ in range((2 * n).bit_length() + 1):
        ahead = state.select(F.col("event").alias("k"), F.col("next").alias("further"), F.col("n").alias("m"), F.col("deep").alias("d"), F.col("root").alias("r"))
        joined = state.join(ahead, state["next"] == ahead["k"], "left")
        zero = F.lit(0)
        state = settle(joined.select("event", F.col("further").alias("next"), (F.col("n") + F.coalesce("m", zero)).alias("n"), (F.col("deep") + F.coalesce("d", zero)).alias("deep"), F.coalesce("root", "r").alias("root")))
        if not state.where("next IS NOT NULL").limit(1).count():
            break
    named = state.select(F.col("event.enters").alias("enters"), F.col("event.slug").alias("slug"), "next", "n", "deep", "root")
    _placed(tree, named.where("next IS NULL"), named.where("next IS NOT NULL"))
    left = named.where("NOT enters").select("slug", F.col("n").alias("after"))
    entered = named.where("enters").select("slug", "root", "n", (-F.col("deep")).alias("depth"))
    whole = entered.where("slug = root").select("root", F.col("n").alias("all"))
    return entered.join(left, "slug").join(whole, "root").select("slug", "root", (F.col("all") - F.col("n")).alias("pre_no"), "depth", (F.col("n") - F.col("after")).alias("size"))


def preorder(tree: DataFrame) -> DataFrame:
    """(slug, path, pre_no from 0, depth, ancestors, size): parents before children, children by ordinal."""
    return orders(tree).join(lineage(tree).select("slug", "path", "ancestors"), "slug").select("slug", "path", "pre_no", "depth", "ancestors", "size")


def postorder(tree: DataFrame) -> DataFrame:
    """(slug, post_no from 0): children before parents."""
    return orders(tree).select("slug", (F.col("pre_no") + F.col("size") - 1 - F.col("depth")).alias("post_no"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """(nodes, depth), the root at depth 1."""
    return orders(tree).agg(F.count("*").alias("nodes"), (F.max("depth") + 1).alias("depth"))


def page_context(tree: DataFrame) -> DataFrame:
    """(slug, label, kind, parent, siblings, children, ancestors, post_no); siblings exclude the page, lists are in tree order.

    Every list of children is made once. Pages get their places first, while their rows are narrow, and the lists by left joins
    last: so neither a shuffle nor a broadcast ever holds the rows with their lists, which grow with the square of a family.
    """
    order = orders(tree).select("slug", "size", "pre_no", "depth").join(lineage(tree).select("slug", "ancestors"), "slug")
    placed = tree.join(order.select("slug", "ancestors", (F.col("pre_no") + F.col("size") - 1 - F.col("depth")).alias("post_no")), "slug")
    placed = settle(placed.select("slug", "label", "kind", "parent_slug", "ancestors", "post_no"))
    kids = tree.where(F.col("parent_slug").isNotNull()).groupBy("parent_slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "slug"))), lambda x: x["slug"]).alias("children"))
    kids = settle(kids.withColumnRenamed("parent_slug", "k"))
    around = kids.select(F.col("k").alias("up"), F.col("children").alias("family"))
    placed = placed.repartition(int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slug")  # lists make the work, not the few bytes of the rows
    out = placed.join(kids, placed["slug"] == kids["k"], "left").join(around, placed["parent_slug"] == around["up"], "left")
    empty = F.array().cast("array<string>")
    siblings = F.coalesce(F.array_remove("family", F.col("slug")), empty)
    return out.select("slug", "label", "kind", F.col("parent_slug").alias("parent"), siblings.alias("siblings"), F.coalesce("children", empty).alias("children"), "ancestors", "post_no")


def allowed_links(ctx: DataFrame) -> DataFrame:
    """(slug, allowed): ancestors, siblings and children, each once, in that order."""
    return ctx.select("slug", F.array_distinct(F.concat("ancestors", "siblings", "children")).alias("allowed"))


def nav_outline(tree: DataFrame) -> DataFrame:
    """(pre_no, slug, label, depth): the outline of the site, one shared table; a page marks its own row by comparison."""
    return orders(tree).join(tree.select("slug", "label"), "slug").select("pre_no", "slug", "label", "depth")


def tree_to_json(tree: DataFrame, page_atoms: DataFrame | None = None) -> DataFrame:
    """(slug, json): the nested tree of every root with the atoms of page_atoms(slug, pos, atom_id), built from the deepest level up."""
    if page_atoms is not None:
        held = page_atoms.groupBy(F.col("slug").alias("h")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "atom_id"))), lambda x: x["atom_id"]).alias("atoms"))
        tree = tree.join(held, tree["slug"] == held["h"], "left").drop("h")
    else:
        tree = tree.withColumn("atoms", F.lit(None).cast("array<string>"))
    rows = settle(orders(tree).select("slug", "depth").join(tree.select("slug", "parent_slug", "kind", "label", "ordinal", "atoms"), "slug"))
    deepest = rows.agg(F.max("depth")).first()[0]
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    below = None
    for depth in range(deepest or 0, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("inside", F.lit(""))
        else:
            inside = below.groupBy(F.col("parent_slug").alias("p")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "json"))), lambda x: x["json"]), ",").alias("inside"))
            level = level.join(inside, level["slug"] == inside["p"], "left").withColumn("inside", F.coalesce("inside", F.lit("")))
        text = F.concat(F.lit("{"), field("page_slug", F.col("slug")), F.lit(","), field("kind", F.col("kind")), F.lit(","), field("label", F.col("label")), F.lit(',"atoms":'), F.to_json(F.coalesce("atoms", F.array().cast("array<string>"))), F.lit(',"children":['), F.col("inside"), F.lit("]}"))
        below = settle(level.select("slug", "parent_slug", "ordinal", text.alias("json")))
    return below.select("slug", "json")


def unique_slugs(df: DataFrame, base: str = "base", order: str = "alloc_no", taken: DataFrame | None = None) -> DataFrame:
    """+ slug, as if rows took slugs one by one in order: their base, or else the first of base-2, base-3 … that nobody holds.

    All rows ask at once; of those that ask for one slug the first in order holds it, the others go on to their base's next
    number, until each holds its own. taken(slug) are held from the start.
    """
    own = W.partitionBy(base).orderBy(order)
    out = df.withColumn("_k", F.row_number().over(own)).withColumn("_n", F.col("_k"))  # the k-th row of a base gets the number k at least
    while True:
        out = out.withColumn("slug", F.when(F.col("_n") > 1, F.concat(base, F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(base)))
        if taken is not None:
            held = taken.select(F.col("slug").alias("_held")).distinct()
            out = out.join(held, out["slug"] == held["_held"], "left")
        lost = F.row_number().over(W.partitionBy("slug").orderBy(order)) > 1
        out = settle(out.withColumn("_lost", (lost | F.col("_held").isNotNull()) if taken is not None else lost).drop("_held"))
        if not out.where("_lost").limit(1).count():
            return out.drop("_k", "_n", "_lost")
        out = out.withColumn("_n", F.col("_n") + F.col("_lost").cast("int"))
        out = out.withColumn("_n", F.max(F.col("_n") - F.col("_k")).over(own) + F.col("_k"))  # numbers of a base keep rising


def embedded_leaves(members: DataFrame, atoms: DataFrame, fn: Callable | None = None, **policy) -> DataFrame:
    """`leaf_nodes` with embedding and embedding_error: labels by the model, or by hashed n-grams without one; if any batch failed, the
    same vector of one zero for all leaves, which then group in sequence. policy: batch, seconds, tries, on_error."""
    return embed_or_constant(leaf_nodes(members, atoms), "label", fn, **policy)


def leaf_nodes(members: DataFrame, atoms: DataFrame) -> DataFrame:
    """members(label, pos, atom_id), atoms(atom_id, claim, draft_tags) → (cluster, leaf_no, label, slug).

    Label: the first tag of the first atom that exists, else its claim's first 20 characters, else cluster-<i>.
    """
    clusters = numbered(members.select("label").distinct(), ["label"], "leaf_no")
    first = members.join(atoms, "atom_id").groupBy("label").agg(F.min_by(F.struct("claim", "draft_tags"), "pos").alias("a"))
    rows = clusters.join(first, "label", "left")
    label = F.coalesce(X.non_empty(F.try_element_at("a.draft_tags", F.lit(1))), X.non_empty(F.substring("a.claim", 1, 20)), F.concat(F.lit("cluster-"), F.col("leaf_no").cast("string")))
    rows = rows.select(F.col("label").alias("cluster"), "leaf_no", label.alias("label"))
    rows = rows.withColumn("base", X.slugify(F.lit("concept"), F.col("label"), F.col("leaf_no")))
    return unique_slugs(rows, "base", "leaf_no").drop("base")


def group_label(labels) -> object:
    """The first two labels and a mark for more."""
    return F.concat(F.array_join(F.slice(labels, 1, 2), "、"), F.when(F.size(labels) > 2, " 等").otherwise(""))


def _best(of, with_, u, size, named, low, keep: int, max_size: int):
    """(rows of `of`, rows of `with_`, s): of each the keep + 1 most similar others that fit and are not below low, ties to smaller places.

    A slab of rows is multiplied at a time. The keep + 1 largest of the maxima of short runs tell what is too small; only the
    few values that are left are rounded and ordered.
    """
    import numpy as np

    found, run = [], 32
    step = max(1, (1 << 22) // max(1, len(with_)))
    for at in range(0, len(of) if len(with_) else 0, step):
        own = of[at : at + step]
        s = u[own] @ u[with_].T
        s[(size[own][:, None] + size[with_][None, :] > max_size) | (named[own][:, None] == named[with_][None, :])] = -np.inf
        least = low[at : at + step] - 2e-12
        runs = np.maximum.reduceat(s, np.arange(0, len(with_), run), axis=1)
        if runs.shape[1] > keep:
            least = np.maximum(least, np.partition(runs, runs.shape[1] - keep - 1, axis=1)[:, runs.shape[1] - keep - 1] - 2e-12)
        i, k = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        v = np.round(s[i, k], 12)
        order = np.lexsort((k, -v, i))
        i, k, v = i[order], k[order], v[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        kept = (nth <= keep) & (v >= low[at : at + step][i])
        found.append((own[i[kept]], with_[k[kept]], v[kept]))
    return [np.concatenate([f[c] for f in found] or [np.zeros(0)]) for c in range(3)]


def _partners(groups: DataFrame, keep: int, max_size: int, block: int | None) -> DataFrame:
    """groups(g, total, size, fresh, least_s) → (x, y, s): candidates for lists of the `keep` best partners that fit.

    Each fresh group is held against all groups, in tiles: it gets its keep + 1 best of a tile, and every other group gets
    as many of the tile's fresh ones that are not below the last similarity of its own list. Similarities have 12 digits.
    Without a given block, a side of a tile has a quarter of the groups, but not under 2,048 groups and not over TRAVEL_BYTES:
    until then each vector travels to a fixed number of tiles, beyond it to one for each TRAVEL_BYTES of the others.
    """
    kind = groups.schema["g"].dataType.simpleString()
    n, fresh, width = groups.agg(F.count("*"), F.count_if("fresh"), F.max(F.size("total"))).first()
    block = block or max(2048, min(-(-n // 4), TRAVEL_BYTES // (8 * max(1, width))))
    rows, cols = max(1, -(-fresh // block)), max(1, -(-n // block))
    tile = F.pmod(F.xxhash64("g"), F.lit(1 << 30))
    own = groups.select("g", "total", "size", "fresh", F.coalesce("least_s", F.lit(-9.0)).alias("least_s"))
    left = own.where("fresh").select((tile % rows).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"), F.lit(True).alias("left"), "*")
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), (tile % cols).cast("int").alias("j"), F.lit(False).alias("left"), "*")

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("g")
        ids, size, is_left, is_fresh = (table.column(c).combine_chunks() for c in ("g", "size", "left", "fresh"))
        u = table.column("total").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        length = np.sqrt((u * u).sum(axis=1, keepdims=True))
        u = u / np.where(length == 0, 1, length)
        size, is_left, is_fresh = (c.to_numpy(zero_copy_only=False) for c in (size, is_left, is_fresh))
        least = table.column("least_s").to_numpy()
        a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        named = ids.dictionary_encode().indices.to_numpy()
        rest = b[~is_fresh[b]]  # ids are in order, so ties go to smaller ones
        sides = [_best(a, b, u, size, named, np.full(len(a), -9.0), keep, max_size), _best(rest, a, u, size, named, least[rest], keep, max_size)]
        x, y, v = (np.concatenate([side[c] for side in sides]) for c in range(3))
        return pa.table([ids.take(pa.array(x.astype(np.int64))), ids.take(pa.array(y.astype(np.int64))), pa.array(v.astype(float))], names=["x", "y", "s"])

    return left.unionByName(right).groupBy("i", "j").applyInArrow(run, f"x {kind}, y {kind}, s double")


def strongest(pairs: DataFrame, most: int, bins: int = 4096) -> DataFrame:
    """The `most` rows of pairs(x, y, s), with s within -1 and 1, that have the largest s (ties to smaller x, y).

    A histogram tells the bin in which the number is reached; only rows of that bin are ordered.
    """
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("s") + 1) / 2 * bins)).alias("bin")
    counts = {r.bin: r.n for r in pairs.groupBy(bin_).agg(F.count("*").alias("n")).collect()}
    taken = 0
    for at in sorted(counts, reverse=True):
        if taken + counts[at] > most:
            edge = pairs.where(bin_ == at).orderBy(F.col("s").desc(), "x", "y").limit(most - taken)
            return pairs.where(bin_ > at).unionByName(edge)
        taken += counts[at]
    return pairs


def sequence_runs(n: int, goal: int, max_size: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Where all similarities are equal: groups of the places 0 to n - 1 after the first two groups of a list that fit together
    are merged and put last, until goal groups are left or none fit.

    Each entry is (size, how many, ranges): that many groups of neighbours from the start of the one range on, or one group
    of several ranges (start, length). A run of equal groups is merged in one step, so there are few entries, whatever n is.
    """
    runs, left = [(1, n, [(0, n)])], n

    def without_first(run: tuple) -> list:
        size, many, ranges = run
        return [(size, many - 1, [(ranges[0][0] + size, ranges[0][1] - size)])] if many > 1 else []

    def first_of(run: tuple) -> list[tuple[int, int]]:
        return [(run[2][0][0], run[0])] if run[1] > 1 else run[2]

    while left > goal:
        at = next((i for i, r in enumerate(runs) if (r[1] > 1 and 2 * r[0] <= max_size) or any(r[0] + q[0] <= max_size for q in runs[i + 1 :])), None)
        if at is None:
            break
        size, many, ranges = runs[at]
        if many > 1 and 2 * size <= max_size:
            merges, start = min(many // 2, left - goal), ranges[0][0]
            used = 2 * size * merges
            rest = [(size, many - 2 * merges, [(start + used, ranges[0][1] - used)])] if many > 2 * merges else []
            runs = [*runs[:at], *rest, *runs[at + 1 :], (2 * size, merges, [(start, used)])]
        else:
            merges, to = 1, next(i for i in range(at + 1, len(runs)) if size + runs[i][0] <= max_size)
            merged = (size + runs[to][0], 1, first_of(runs[at]) + first_of(runs[to]))
            runs = [*runs[:at], *without_first(runs[at]), *runs[at + 1 : to], *without_first(runs[to]), *runs[to + 1 :], merged]
        left -= merges
    return runs


def _in_sequence(nodes: DataFrame, n: int, goal: int, max_size: int) -> DataFrame:
    """(id, group_no) by `sequence_runs` over the ids in order."""
    place, group = F.col("_place"), F.lit(None).cast("long")
    for size, many, ranges in sequence_runs(n, goal, max_size):
        for start, length in ranges:
            least = F.lit(min(r[0] for r in ranges)) if many == 1 else place - (place - start) % size
            group = F.when(place.between(start, start + length - 1), least).otherwise(group)
    rows = settle(numbered(nodes.select("id"), ["id"], "_place").select("id", group.alias("g")))
    return rows.join(numbered(rows.select("g").distinct(), ["g"], "group_no"), "g").select("id", "group_no")


def _members(nodes: DataFrame, merged: list[DataFrame], max_size: int) -> DataFrame:
    """(id, g): the group of each node; merged are tables (g, to_g), in which a group stands as g once at most.

    All merges are one table of steps, whose chains are shorter than max_size; steps double, so that a join for each round
    of merges, all in one plan and each with a table of its own in the driver, is not needed.
    """
    at = nodes.select("id", F.col("id").alias("g"))
    if not merged:
        return settle(at)
    steps = settle(reduce(DataFrame.unionByName, merged))
    for _ in range(max(1, max_size - 1).bit_length()):
        ahead = steps.select(F.col("g").alias("to_g"), F.col("to_g").alias("further"))
        steps = settle(steps.join(ahead, "to_g", "left").select("g", F.coalesce("further", "to_g").alias("to_g")))
    return settle(at.join(steps, "g", "left").select("id", F.coalesce("to_g", "g").alias("g")))


def group_once(nodes: DataFrame, target: int = 4, max_size: int = 5, keep: int = 8, block: int | None = None) -> DataFrame:
    """nodes(id, embedding) → (id, group_no): rounds in which groups that are each other's best partner merge.

    Partners are the most similar pair by centroid under the size limit (ties to smaller ids); rounds end at about
    n / target groups or when no pair may merge. Each round at least the closest pair of all merges. Every group keeps a
    list of its `keep` best partners, and where it was cut off, what came last: as long as the list is not used up, its first
    entry is the best of all. So only groups that a round has merged, or whose list is used up, are compared with all
    others again; the rest learns of merged groups from the same tiles. Without any vector but zeros see `sequence_runs`.
    What a round leaves to the next is stored, not checkpointed, so that no guess of its size goes on (see `stored`).
    """
    n, kind = nodes.count(), nodes.schema["id"].dataType.simpleString()
    if n <= max_size:
        return nodes.select("id", F.lit(0).cast("long").alias("group_no"))
    if not nodes.where(F.exists("embedding", lambda x: x != 0)).limit(1).count():
        return _in_sequence(nodes, n, -(-n // target), max_size)
    groups, path = stored(nodes.select(F.col("id").alias("g"), F.col("embedding").cast("array<double>").alias("total"), F.lit(1).alias("size"), F.lit(True).alias("fresh")), "groups")
    paths = [path]
    lists = groups.sparkSession.createDataFrame([], f"x {kind}, y {kind}, s double")
    bounds = groups.sparkSession.createDataFrame([], f"b {kind}, least_s double, least_y {kind}")
    left, goal, merged = n, -(-n // target), []
    while left > goal:
        units = groups.join(bounds, F.col("g") == F.col("b"), "left").select("g", "total", "size", "fresh", "least_s")
        known = _partners(units, keep, max_size, block).unionByName(lists).join(bounds, F.col("x") == F.col("b"), "left")
        known = known.where("least_s IS NULL OR s > least_s OR (s = least_s AND y <= least_y)")
        rank = F.row_number().over(W.partitionBy("x").orderBy(F.col("s").desc(), "y"))
        ranked = settle(known.withColumn("rank", rank).where(F.col("rank") <= keep + 1).select("x", "y", "s", "rank", "least_s", "least_y"))
        cut = ranked.groupBy("x").agg(F.max("rank").alias("n"), F.max_by(F.struct("s", "y"), F.when(F.col("rank") <= keep, F.col("rank"))).alias("last"), F.first("least_s").alias("ls"), F.first("least_y").alias("ly"))
        cut = cut.select(F.col("x").alias("b"), F.when(F.col("n") > keep, F.col("last.s")).otherwise(F.col("ls")).alias("least_s"), F.when(F.col("n") > keep, F.col("last.y")).otherwise(F.col("ly")).alias("least_y"))
        bounds = bounds.join(cut.select("b"), "b", "left_anti").unionByName(cut.where("least_s IS NOT NULL"))
        best = ranked.where("rank = 1").select("x", "y", "s")
        merges = best.join(best.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"]).where("x < y")
        merges = settle(merges)
        found = merges.count()
        if found > left - goal:
            merges = settle(strongest(merges, left - goal))
        if not found:
            break
        gone = merges.select(F.explode(F.array("x", "y")).alias("g"))
        lists, lists_path = stored(ranked.where(F.col("rank") <= keep).select("x", "y", "s").join(gone.withColumnRenamed("g", "x"), "x", "left_anti").join(gone.withColumnRenamed("g", "y"), "y", "left_anti"), "lists")
        bounds = bounds.join(gone.withColumnRenamed("g", "b"), "b", "left_anti")
        used_up = bounds.join(lists.select(F.col("x").alias("b")), "b", "left_anti").select(F.col("b").alias("g"), F.lit(True).alias("again"))
        side = lambda c, name: groups.select(F.col("g").alias(c), F.col("total").alias(f"total_{name}"), F.col("size").alias(f"size_{name}"))
        joined = merges.join(side("x", "a"), "x").join(side("y", "b"), "y").select(F.col("x").alias("g"), F.zip_with("total_a", "total_b", lambda p, q: p + q).alias("total"), (F.col("size_a") + F.col("size_b")).alias("size"), F.lit(True).alias("fresh"))
        rest = groups.join(gone, "g", "left_anti").join(used_up, "g", "left").select("g", "total", "size", F.coalesce("again", F.lit(False)).alias("fresh"))
        groups, groups_path = stored(rest.unionByName(joined), "groups")
        bounds, bounds_path = stored(bounds.join(lists.select(F.col("x").alias("b")), "b", "left_semi"), "bounds")
        discard(*paths)
        paths = [groups_path, lists_path, bounds_path]
        merged.append(merges.select(F.col("y").alias("g"), F.col("x").alias("to_g")))
        left -= min(found, left - goal)
    discard(*paths)
    members = _members(nodes, merged, max_size)
    numbers = numbered(members.groupBy("g").agg(F.min("id").alias("least")), ["least"], "group_no")
    return members.join(numbers, "g").select("id", "group_no")


def build_tree(leaves: DataFrame, topic: str = "", max_size: int = 5, model: Callable | None = None) -> DataFrame:
    """leaves(slug, label, embedding) → TREE: sections over sections until at most max_size nodes hang on the root.

    Single nodes pass up; a section's vector is the mean of its children's, its label the model's or that of `group_label`,
    its slug one that no leaf or earlier section has. No leaves: the root alone.
    """
    spark = leaves.sparkSession
    nodes, path = stored(numbered(leaves.select("slug", "label", "embedding", F.lit("leaf-cluster").alias("kind")), ["slug"]), "nodes")
    done, placed_path = spark.createDataFrame([], TREE), None
    while nodes.count() > max_size:
        grouped = group_once(nodes.select(F.col("no").alias("id"), "embedding"), max_size=max_size)
        rows = settle(nodes.join(grouped, nodes["no"] == grouped["id"]).select("slug", "label", "embedding", "kind", "no", "group_no", F.count("*").over(W.partitionBy("group_no")).alias("size")))
        if not rows.where("size > 1").limit(1).count():
            break
        joined = rows.where("size > 1")
        labels = F.transform(F.sort_array(F.collect_list(F.struct("no", "label"))), lambda x: x["label"])
        named = summarise(joined.groupBy("group_no").agg(labels.alias("labels")), model)
        named = named.withColumn("base", X.slugify(F.lit("section"), F.col("label"), F.col("group_no")))
        named = unique_slugs(named, "base", "group_no", done.select("slug").unionByName(nodes.select("slug"))).drop("base")
        up = named.join(centroids(joined, "group_no"), "group_no")
        ordinal = F.row_number().over(W.partitionBy("group_no").orderBy("no")) - 1
        placed = joined.join(up.select("group_no", F.col("slug").alias("parent_slug")), "group_no").select("slug", "parent_slug", "kind", "label", ordinal.alias("ordinal"))
        done, done_path = stored(done.unionByName(placed), "placed")
        rest = rows.where("size = 1").select("slug", "label", "embedding", "kind", "group_no")
        rest = rest.unionByName(up.select("slug", "label", "embedding", F.lit("intermediate").alias("kind"), "group_no"))
        above, above_path = stored(numbered(rest, ["group_no"]).drop("group_no"), "nodes")
        discard(path, placed_path)
        nodes, path, placed_path = above, above_path, done_path
    root = spark.createDataFrame([("root-" + (topic or "topic"), None, "root", topic or "root", 0)], TREE)
    top = nodes.select("slug", F.lit("root-" + (topic or "topic")).alias("parent_slug"), "kind", "label", F.col("no").cast("int").alias("ordinal"))
    return root.unionByName(top).unionByName(done)


def summarise(groups: DataFrame, model: Callable | None = None, longest: int = 20) -> DataFrame:
    """groups(group_no, labels) → (group_no, label) by group_label, or by a model over batches of pandas frames that returns these
    columns; of its labels those count that are not empty and have at most `longest` characters."""
    own = groups.select("group_no", group_label(F.col("labels")).alias("label"))
    if model is None:
        return own
    kind = groups.schema["group_no"].dataType.simpleString()
    found = groups.mapInPandas(model, f"group_no {kind}, label string").select(F.col("group_no").alias("g"), F.trim("label").alias("l"))
    found = found.where(F.length("l").between(1, longest))
    return own.join(found, own["group_no"] == found["g"], "left").select("group_no", F.coalesce("l", "label").alias("label"))
