"""Text functions: Column in, Column out. Lengths and cuts count code points; patterns spell ASCII classes out, because
the engine's word border and digit classes also know letters beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols that mark a formula.
MATH_SYMBOLS = "αβγδεζηθικλμνξπρστυφχψωΔΣΠ∫∂∞≥≤≠≈∈∉⊂⊃∪∩±×÷√∝∀∃⇒⇔→←↑↓"
#: Word limits, badge labels and colours by page type, folder sections and names.
WORD_LIMITS = {"root": 2000, "intermediate": 1200, "leaf-cluster": 600}
TYPE_LABELS = {"entity": "实体", "structure": "结构", "concept": "概念", "source": "来源", "comparison": "对比", "synthesis": "综合", "question": "问答", "page": "页面"}
TYPE_COLOURS = {"concept": ("#e8f4fd", "#1976d2"), "entity": ("#fff3e0", "#e65100"), "structure": ("#e8f5e9", "#2e7d32"), "comparison": ("#fce4ec", "#c62828"), "synthesis": ("#e0f2f1", "#00695c"), "question": ("#e0f7fa", "#00838f"), "source": ("#f3e5f5", "#7b1fa2")}
SECTIONS = {"entities": "实体", "structures": "结构", "sources": "来源"}
FOLDER_NAMES = {"nextjs": "Next.js", "fastapi": "FastAPI", "langchain": "LangChain", "agent": "Agent"}
ATOM_KINDS = ("definition", "example", "formula", "rule", "anti-pattern", "problem")

#: The patterns of formulas and links.
BARE_SUPERSCRIPT = r"(?<![$`A-Za-z0-9_])([A-Za-z]+)([0-9]+)(?![A-Za-z0-9_$`])"
CHEMICAL = r"(?<![A-Za-z0-9_])([A-Z][a-z]?(?:[0-9]+)?(?:[A-Z][a-z]?(?:[0-9]+)?){1,})(?![A-Za-z0-9_])"
WIKI_LINK = r"\[\[([^\]]+)\]\]"
CLICK_LINK = r"click\s+\S+\s+\"([^\"]+\.html)\""


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: what a lambda of an array function captures would be worked out for every element."""
    return F.transform(F.array(value), body)[0]


def ngrams(c: Column, n: int = 3) -> Column:
    """All runs of n characters; a shorter text is one run."""
    runs = lambda ch: F.when(F.size(ch) < n, F.array(F.array_join(ch, ""))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ch) - n, F.lit(0))), lambda i: F.concat(*[F.get(ch, i + k) for k in range(n)])))
    return let(F.split(c, ""), runs)


def slugify(prefix: Column, label: Column, index: Column) -> Column:
    """prefix-label: lower case, runs outside a-z, 0-9 and CJK as one dash, one dash off each end, 40 characters; else the index."""
    s = F.regexp_replace(F.lower(label), "[^a-z0-9一-鿿]+", "-")
    s = F.substring(F.regexp_replace(s, "^-|-$", ""), 1, 40)
    return F.concat(prefix, F.lit("-"), F.coalesce(non_empty(s), index.cast("string")))


def source_slug(c: Column) -> Column:
    """Every character outside ASCII letters and digits as one dash."""
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "-")


def pad3(n: Column) -> Column:
    """At least three digits, never cut."""
    s = n.cast("string")
    return F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def atom_id(source_id: Column, seq: Column) -> Column:
    return F.concat(F.lower(source_slug(source_id)), F.lit("-"), pad3(seq))


def is_skippable(line: Column) -> Column:
    """Fence line, indented code, or a line with a $…$ span."""
    return line.startswith("```") | line.startswith("    ") | line.startswith("\t") | line.rlike(r"\$[^$]+\$")


def has_math_symbol(line: Column) -> Column:
    return line.rlike(r"[^\x00-\x7F]") & line.rlike(f"[{MATH_SYMBOLS}]")  # most lines are ASCII, which the first test tells fast


def has_bare_superscript(line: Column) -> Column:
    return line.rlike("[A-Za-z][0-9]") & line.rlike(BARE_SUPERSCRIPT)


def chem_matches(line: Column) -> Column:
    """Element runs with a letter-digit pair, of 3 to 20 characters."""
    found = F.when(line.rlike("[A-Z][a-z]?[0-9]"), F.regexp_extract_all(line, F.lit(CHEMICAL), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda m: m.rlike("[A-Z][a-z]?[0-9]") & F.length(m).between(3, 20))


def formula_reason(line: Column) -> Column:
    """The first reason that holds, null for none."""
    reason = F.when(has_math_symbol(line), "math_symbol").when(has_bare_superscript(line), "bare_superscript")
    return F.when(~is_skippable(line), reason.when(F.size(chem_matches(line)) > 0, "chemical_formula"))


def embedding_text(claim: Column, tags: Column) -> Column:
    return F.concat(claim, F.lit(" "), F.array_join(tags, " "))


def word_limit(kind: Column) -> Column:
    return F.coalesce(_lookup(WORD_LIMITS, kind), F.lit(600))


def page_kind(kind: Column) -> Column:
    return F.when(kind == "leaf-cluster", "leaf").otherwise(kind)


def confidence_badge(c: Column) -> Column:
    """Percent and colour; the cut between amber and green is 0.8."""
    percent = F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    return F.struct(percent.alias("text"), F.when(c >= 0.8, "green").otherwise("amber").alias("colour"))


def summary_or_excerpt(summary: Column, body: Column, n: int = 100) -> Column:
    return F.coalesce(non_empty(summary), F.concat(F.substring(body, 1, n), F.lit("...")))


def type_label(kind: Column) -> Column:
    return F.coalesce(_lookup(TYPE_LABELS, kind), non_empty(kind), F.lit("页面"))


def humanise(name: Column) -> Column:
    first = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
    return F.coalesce(_lookup(FOLDER_NAMES, F.lower(name)), first)


def breadcrumb(path: Column, title: Column) -> Column:
    """Home, section, project folder (only if the segment after the section is no page and the next one is) and title."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.coalesce(*[F.when(path.contains(f"/{k}/"), F.array_position(parts, k)) for k in SECTIONS])
    label = F.coalesce(*[F.when(path.contains(f"/{k}/"), F.lit(v)) for k, v in SECTIONS.items()])
    html = lambda p: F.lower(p).rlike(r"\.html?$")
    folder, page = F.try_element_at(parts, (at + 1).cast("int")), F.try_element_at(parts, (at + 2).cast("int"))
    project = F.when(~html(folder) & html(page), humanise(folder))
    return F.when(label.isNotNull(), F.array_compact(F.array(F.lit("首页"), label, project, non_empty(title))))


def date_part(ts: Column) -> Column:
    return F.split(ts, "T")[0]


def wiki_targets(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(WIKI_LINK), F.lit(1))


def _found(body: Column, pattern: str) -> Column:
    """(target: the first group, offset in code points from 0) of every match."""
    pieces, whole, targets = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<target:string,offset:int>>").alias("found"))
    matches = F.arrays_zip(targets.alias("t"), whole.alias("w"), F.slice(pieces, 1, F.size(targets)).alias("p"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["p"]) + F.length(x["w"])).cast("int").alias("at"), F.concat(acc["found"], F.array(F.struct(x["t"].alias("target"), (acc["at"] + F.length(x["p"])).cast("int").alias("offset")))).alias("found"))
    return F.aggregate(matches, start, step, lambda acc: acc["found"])


def wiki_links(body: Column) -> Column:
    """(target, offset) of every [[…]]."""
    return _found(body, WIKI_LINK)


def click_links(body: Column) -> Column:
    """(target, offset) of every diagram click on a page, without its .html."""
    return F.transform(_found(body, CLICK_LINK), lambda x: F.struct(F.regexp_replace(x["target"], r"\.html$", "").alias("target"), x["offset"].alias("offset")))


def alias_target(link: Column) -> Column:
    return F.split(link, r"\|", 2)[0]


def alias_label(link: Column) -> Column:
    """What stands after the bar, else the link itself."""
    return F.coalesce(F.try_element_at(F.split(link, r"\|", 2), F.lit(2)), link)


def link_anchor(body: Column, mode: str = "page") -> Column:
    """[[slug]] as a link to slug.html, or to #slug."""
    return F.regexp_replace(body, WIKI_LINK, '<a href="$1.html">$1</a>' if mode == "page" else '<a href="#$1">$1</a>')


def search_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: t != "")


def search_match(terms: Column, haystack: Column) -> Column:
    """Every term is part of the haystack; no terms match nothing."""
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(haystack, t))


def guess_language(code: Column) -> Column:
    """Ordered rules: empty, shebang, JSON, Python, TypeScript, JavaScript, else Markdown."""
    t = F.trim(F.regexp_replace(F.coalesce(code, F.lit("")), "^﻿", ""))
    first = F.split(t, "\n")[0]
    word = lambda names: rf"(?<![A-Za-z0-9_])({names})"
    return (
        F.when(t == "", "markdown")
        .when(first.startswith("#!") & first.rlike("bash|sh|zsh"), "bash")
        .when(F.try_parse_json(t).isNotNull(), "json")
        .when(t.rlike(r"^\s*(\{|\[)") & t.rlike(r'(?s)".*":'), "json")
        .when(t.rlike(r"(?m)^(def |class |import |from )"), "python")
        .when(t.rlike(word("public |private |interface |type |enum ")), "typescript")
        .when(t.rlike(word("const|let|var|function") + r"(?![A-Za-z0-9_])") | t.rlike(r"[A-Za-z0-9_]=>[A-Za-z0-9_]") | t.contains("require("), "javascript")
        .otherwise("markdown")
    )


def parse_atoms(response: Column, schema: str) -> Column:
    """A tool call's {atoms: […]}, else the text from the first [ to the last ] as a list, else empty."""
    tool = F.from_json(response, f"struct<atoms:{schema}>")["atoms"]
    listed = F.from_json(non_empty(F.regexp_extract(response, r"(?s)\[.*\]", 0)), schema)
    return F.coalesce(tool, listed, F.array().cast(schema))
