"""Page assembly: Markdown and HTML for the whole corpus at once, decisions, incremental rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import text as X
from wikispark.operators.graphs import settle
from wikispark.operators.tree import orders

# Texts that stand for what a page lacks.
NO_QUOTE, NO_ATOMS, SEE_WIKI = "(无)", "(本节点无直接关联的 atom，请基于子节点概要 roll-up 撰写)", "*(详见 wiki)*"


def assemble_pages(ctx: DataFrame, bodies: DataFrame) -> DataFrame:
    """(slug, markdown): head block of slug, quoted title, kind and parent, then the body."""
    rows = ctx.select("slug", "label", "kind", "parent").join(bodies.select("slug", "body"), "slug")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("slug: "), "slug"), F.concat(F.lit('title: "'), "label", F.lit('"')), F.concat(F.lit("kind: "), X.page_kind(F.col("kind"))), F.concat(F.lit("parent: "), F.coalesce("parent", F.lit("null"))), F.lit("---"))
    return rows.select("slug", F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("markdown"))


def bullet_list(pos: str) -> Column:
    """Of a group of atoms, in the order of pos: a line for each, with its quote; rows without pos count for nothing."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "claim", F.lit("\n  证据："), F.coalesce(X.non_empty(F.col("quote")), F.lit(NO_QUOTE)))
    rows = F.collect_list(F.when(F.col(pos).isNotNull(), F.struct(pos, line.alias("t"))))
    return F.array_join(F.transform(F.sort_array(rows), lambda x: x["t"]), "\n")


def atom_bullets(page_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """page_atoms(slug, pos, atom_id) → (slug, bullets): each page's atoms in order with their quotes."""
    rows = page_atoms.join(atoms.select("atom_id", "kind", "claim", "quote"), "atom_id")
    return rows.groupBy("slug").agg(bullet_list("pos").alias("bullets"))


# The parts of the prompt for a page, in order.
ASK = "你是知识页面撰写引擎。请为以下知识节点撰写一个 wiki 页面。\n\n节点："
LEAF, NOT_LEAF = "（叶子（知识点））\nslug：", "（非叶子（概述/总结））\nslug："
ATOMS, ALLOWED = "\n\n关联的知识原子：\n", "\n\n允许引用的页面 slug（白名单，使用 [[slug]] 格式）：\n"
RULES = "\n\n=== 严格规则 ===\n\n【结构】\n1. "
LEAF_STORY = "叶子节点直接写知识点，不需要故事弧。"
STORY = """非叶子节点必须以故事弧开头！按以下5段结构组织：
   1. 目的：为了达成什么目标？
   2. 困难：遇到了什么矛盾/挑战？
   3. 方法：采取什么核心思路/原理？
   4. 结果：取得了什么关键结论？
   5. 局限：有什么未解决的问题？
   每段用 H3 标题分隔。"""
LIMIT = "\n2. 字数硬上限："
STYLE = """ 中文字

【写作风格 — 三条编译规则】
3. **长的变短**：长篇叙述必须拆成短句（≤40 字/句），每句独立一行或用分号隔开。
   用"因为…所以…""但是…""因此…"等逻辑连词串联思路。
   禁止出现连续 3 行以上的"文字墙"（大段密集中文无换行）。
4. **短的变长**：遇到纯名词/术语列表时，每个名词必须展开为：
   **名词** — 一句话解释它是什么、为什么重要。
   多个名词要串联成一个完整的逻辑链（不是罗列，而是因果/递进关系）。
   关键名词用 **加粗** 并前后各加一个空格。
5. **公式和化学式**：
   - 数学公式用 LaTeX 包裹：inline 用 $...$，display 用 $$...$$
   - 化学方程式也用 LaTeX：$A + B \\to C$

【链接与表述】
6. 仅允许引用白名单中的 slug，使用 [[slug]] 格式
7. 用"高中生能充分理解"的语言，但保持专业准确
8. 多引用其他概念（白名单内），让知识变成网
9. 不要写 slug、不要写 frontmatter、不要写标题（系统自动加）
10. **Mermaid 图表规则**（Mermaid v11+）：
   - subgraph 标签必须用引号包裹
   - 节点标签中的 < > | & ; 必须转义或避免使用
   - 箭头语法：`-->` (实线), `-.->` (虚线)

请直接输出 Markdown 正文。"""


def page_prompts(ctx: DataFrame, bullets: DataFrame) -> DataFrame:
    """(slug, prompt, word_limit): what a model is asked for a page: node, atoms, allow-list, then ten rules, of which the first is
    the story in five parts (leaves have none) and the second the limit. Without a label the slug stands for it."""
    allowed = F.array_join(F.array_distinct(F.concat("ancestors", "siblings", "children")), ", ")
    leaf = F.coalesce(F.col("kind") == "leaf-cluster", F.lit(False))
    rows = ctx.join(bullets.withColumnRenamed("slug", "b"), F.col("slug") == F.col("b"), "left")
    limit = X.word_limit(F.col("kind"))
    text = F.concat(
        F.lit(ASK), F.coalesce("label", "slug"), F.when(leaf, LEAF).otherwise(NOT_LEAF), "slug", F.lit(ATOMS), F.coalesce(X.non_empty(F.col("bullets")), F.lit(NO_ATOMS)), F.lit(ALLOWED), allowed,
        F.lit(RULES), F.when(leaf, LEAF_STORY).otherwise(STORY), F.lit(LIMIT), limit.cast("string"), F.lit(STYLE),
    )
    return rows.select("slug", text.alias("prompt"), limit.alias("word_limit"))


def _wrap_lists(html: Column) -> Column:
    """Runs of lines that end a list item and start one, within <ul>; line by line, so that long lists need no deep matching."""
    item = lambda r: r.rlike("<li>.*</li>$")

    def line(x, before, after, last):
        start = F.when(~before, F.regexp_replace(x["r"], "^(.*?)<li>", "$1<ul><li>")).otherwise(x["r"])
        here = F.concat(start, F.when(~after & last, "</ul>").otherwise(""))
        return F.when(x["here"], here).otherwise(F.concat(F.when(before, "</ul>").otherwise(""), x["r"]))

    def wrap(marked):
        at = lambda i: F.coalesce(F.get(marked, i)["here"], F.lit(False))
        return F.array_join(F.transform(marked, lambda x, i: line(x, at(i - 1), at(i + 1), i == F.size(marked) - 1)), "\n")

    return X.let(F.transform(F.split(html, "\n", -1), lambda r: F.struct(r.alias("r"), item(r).alias("here"))), wrap)


def markdown_to_html(body: Column, links: str = "page") -> Column:
    """The rules in their fixed order; anchor mode has no horizontal rules and no clean-up."""
    page = links == "page"
    # fixed values: the rules and their order
    md = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n")
    rules = [(r"(?m)^#### (.+)$", "<h4>$1</h4>"), (r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), (r"`([^`]+)`", "<code>$1</code>"), (r"(?m)^- (.+)$", "<li>$1</li>"), (r"(?m)^> (.+)$", "<blockquote>$1</blockquote>")]
    for pattern, to in rules + [(r"(?m)^---$", "<hr>")] * page:
        md = F.regexp_replace(md, pattern, to)
    html = F.regexp_replace(_wrap_lists(X.link_anchor(md, links)), "\n{2,}", "</p><p>")
    if not page:
        return html
    html = F.regexp_replace(F.concat(F.lit("<p>"), html, F.lit("</p>")), "<p></p>", "")
    for tag in ("h[1-6]", "ul", "blockquote"):
        html = F.regexp_replace(F.regexp_replace(html, f"<p>(<{tag}>)", "$1"), f"(</{tag}>)</p>", "$1")
    return F.regexp_replace(html, "<p>(<hr>)</p>", "$1")


def pages_for_tree(tree: DataFrame, wiki_pages: DataFrame) -> DataFrame:
    """(slug, title, body): every tree node with its page; a missing page is an empty body titled by the slug."""
    pages = wiki_pages.select(F.col("slug").alias("p"), "title", "body")
    return tree.select("slug").distinct().join(pages, F.col("slug") == F.col("p"), "left").select("slug", F.coalesce("title", "slug").alias("title"), F.coalesce("body", F.lit("")).alias("body"))


def site_pages(tree: DataFrame, wiki_pages: DataFrame) -> DataFrame:
    """(slug, title, html) for every tree slug."""
    return pages_for_tree(tree, wiki_pages).select("slug", "title", markdown_to_html(F.col("body")).alias("html"))


def site_index(tree: DataFrame) -> DataFrame:
    """(cnt, slugs): how many pages, and their slugs in tree order."""
    rows = orders(tree)
    return rows.agg(F.count("*").alias("cnt"), F.transform(F.sort_array(F.collect_list(F.struct("pre_no", "slug"))), lambda x: x["slug"]).alias("slugs"))


def handbook_sections(tree: DataFrame, wiki_pages: DataFrame) -> DataFrame:
    """(pre_no, section): a heading of the node's depth and its body, in tree order; one row a section, written in order by range."""
    order = settle(orders(tree))
    kids = tree.where(F.col("parent_slug").isNotNull()).select(F.col("parent_slug").alias("k")).distinct()
    pages = wiki_pages.select(F.col("slug").alias("p"), "body")
    rows = order.join(tree.select("slug", "label"), "slug").join(pages, F.col("slug") == F.col("p"), "left").join(kids, F.col("slug") == F.col("k"), "left")
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), F.coalesce(X.non_empty(F.col("label")), "slug"), F.lit("\n\n"))
    content = F.when(X.non_empty(F.col("body")).isNotNull(), F.concat("body", F.lit("\n\n"))).when(F.col("k").isNotNull(), "").otherwise(F.lit(SEE_WIKI + "\n\n"))
    return rows.select("pre_no", F.concat(heading, content).alias("section"))


def handbook(tree: DataFrame, wiki_pages: DataFrame, date: str, appendix: DataFrame | None = None) -> DataFrame:
    """(pre_no, section): a title block before the sections and the appendix(text) after them; joined by line ends in order, the handbook."""
    n = tree.agg(F.count("*").alias("n"))
    root = tree.where(F.col("parent_slug").isNull()).agg(F.min(X.non_empty(F.col("label"))).alias("label"))
    title = root.crossJoin(n).select(F.lit(-1).alias("pre_no"), F.concat(F.lit("# "), F.coalesce("label", F.lit("知识手册")), F.lit(f"\n\n> 生成时间：{date}\n> 共 "), F.col("n").cast("string"), F.lit(" 个知识节点。\n\n---\n\n")).alias("section"))
    rows = title.unionByName(handbook_sections(tree, wiki_pages))
    if appendix is not None:
        rows = rows.unionByName(appendix.crossJoin(n).select(F.col("n").cast("int").alias("pre_no"), F.concat(F.lit("## 附录：本卷如何被编译出来\n\n> 每个 stage 的工程取舍。\n\n"), "text").alias("section")))
    return rows


def decision_text(decisions: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """(topic, text): the decisions of a topic by position, with limits and conditions as lists; then its audit(topic, key, value), by key."""
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"**{title}**：\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    one = F.concat(F.lit("### ["), "stage", F.lit("] "), "name", F.lit("\n\n**选择**："), "chosen", F.lit("\n\n**理由**："), F.coalesce("rationale", F.lit("")), F.lit("\n\n"), listed("已知限制", F.col("known_limits")), listed("切换条件", F.col("switch_conditions")))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"])
    out = decisions.groupBy("topic").agg(F.array_join(rows, "\n").alias("text"))
    if audit is None:
        return out
    item = F.concat(F.lit("- "), "key", F.lit("："), F.col("value").cast("string"))
    listed_audit = audit.groupBy(F.col("topic").alias("of")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", item.alias("t")))), lambda x: x["t"]), "\n").alias("items"))
    both = out.join(listed_audit, out["topic"] == listed_audit["of"], "full_outer")
    after = F.coalesce(F.concat(F.lit("### 编译审计\n\n"), "items", F.lit("\n\n")), F.lit(""))
    return both.select(F.coalesce("topic", "of").alias("topic"), F.concat(F.coalesce("text", F.lit("")), after).alias("text"))


def upsert_decisions(log: DataFrame, one_per_stage: tuple[str, ...] = ("stage2",)) -> DataFrame:
    """The latest decision by (topic, stage, name), for some stages by stage alone; the place is that of the first one."""
    key = F.when(F.col("stage").isin(*one_per_stage), F.lit("")).otherwise(F.col("name"))
    w = W.partitionBy("topic", "stage", "_key")
    rows = log.withColumn("_key", key).withColumn("pos", F.min("ts").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col("ts").desc())))
    return rows.where("_n = 1").drop("_n", "_key")


def latest_audit(log: DataFrame) -> DataFrame:
    """(topic, key, value): the last value of each audit key."""
    return log.groupBy("topic", "key").agg(F.max_by("value", "ts").alias("value"))


def diff_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, status): new, changed, same or deleted by content hash."""
    a = old.select(F.col("source_id").alias("a"), F.sha2("content", 256).alias("ha"))
    b = new.select(F.col("source_id").alias("b"), F.sha2("content", 256).alias("hb"))
    rows = a.join(b, F.col("a") == F.col("b"), "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("ha") == F.col("hb"), "same").otherwise("changed")
    return rows.select(F.coalesce("a", "b").alias("source_id"), status.alias("status"))


def headings(pages: DataFrame, levels: tuple[int, ...] = (2, 3), ids: str = "section") -> DataFrame:
    """pages(page, html) → (page, pos, level, id, text): the table of contents; a heading keeps its id, others get the next
    section-n that the page has not, or a slug of their text."""
    names = "".join(str(n) for n in levels)
    pattern = rf"(?s)<h([{names}])([^>]*)>(.*?)</h[{names}]>"
    level, inside, text = (F.regexp_extract_all("html", F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    used = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)\sid\s*=\s*[\"']?section-([0-9]{1,9})(?![0-9])"), F.lit(1)), lambda n: n.cast("int")))
    rows = pages.select("page", F.array_sort(used).alias("used"), F.posexplode(F.arrays_zip(level.alias("level"), inside.alias("inside"), text.alias("text"))).alias("pos", "x"))
    own = X.non_empty(F.trim(F.regexp_extract("x.inside", r"(?i)\sid\s*=\s*[\"']?([^\"'\s>]*)", 1)))
    rows = rows.select("page", "used", "pos", "x", own.alias("own"), F.trim(F.regexp_replace("x.text", "<[^>]*>", "")).alias("plain"))
    nth = F.sum(F.col("own").isNull().cast("int")).over(W.partitionBy("page").orderBy("pos")).cast("int")
    free = F.aggregate("used", nth, lambda n, u: F.when(u <= n, n + 1).otherwise(n))  # the nth number that is not in use
    name = F.concat(F.lit("section-"), free.cast("string")) if ids == "section" else X.slugify(F.lit("h"), F.col("plain"), F.col("pos"))
    return rows.select("page", "pos", F.col("x.level").cast("int").alias("level"), F.coalesce("own", name).alias("id"), F.col("plain").alias("text"))

