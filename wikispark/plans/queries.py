"""The registered queries of the knowledge engine: each runs an operator over whole tables; SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikispark.functions import models as M
from wikispark.functions import text as X
from wikispark.functions import vectors as V
from wikispark.operators import atoms as A
from wikispark.operators import links as L
from wikispark.operators import notes as N
from wikispark.operators import pages as P
from wikispark.operators import rebuild as B
from wikispark.operators import registry as R
from wikispark.operators import search as Q
from wikispark.operators import tree as T
from wikispark.operators import vectors as C
from wikispark.operators.graphs import settle
from wikispark.plans import fixtures as fx
from wikispark.plans.fixtures import table, with_tables
from wikispark.sources import readers as S
from wikispark.sources import writers as Wr

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a function under its name, with its SQL over the named fixture tables."""

    def add(fn: Query) -> Query:
        FOUND[fn.__name__] = fn, (with_tables(list(needs), sql) if needs else sql) if sql else None
        return fn

    return add


# sources and sinks


@query("SELECT topic, regexp_replace(source_id || '.v1.md', '\\.[^.]+$', '') AS source_id, length(content) AS chars FROM sources", ("sources",))
def src1_sources(spark, d):
    s = fx.sources(spark, d)
    return s.select("topic", S.source_name(F.concat("source_id", F.lit(".v1.md"))).alias("source_id"), F.length("content").cast("long").alias("chars"))


@query("""SELECT source AS topic, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def src2_first_non_empty(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("topic"), "doc_id")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return S.first_non_empty(docs.join(toxic, "doc_id", "left_semi").select("topic", "doc_id"), docs).select("topic", "doc_id")


def _heads(spark, d):
    text = F.concat(F.lit("---\nslug: "), "slug", F.lit("\ntitle: \""), "title", F.lit(": one\"\nkind: x\nkind:  "), "type", F.lit(" \n---\nBody of "), "title", F.lit("\n"))
    return fx.registry(spark, d).select(F.col("slug").alias("page"), text.alias("text"))


@query("SELECT slug AS page, title || ': one' AS title, type AS kind, 'Body of ' || title || chr(10) AS body FROM registry", ("registry",))
def src4_frontmatter(spark, d):
    rows = S.parse_frontmatter(_heads(spark, d))
    return rows.select("page", F.col("fields")["title"].alias("title"), F.col("fields")["kind"].alias("kind"), "body")


@query("SELECT slug AS page, title, summary, tags, parent_ids FROM registry", ("registry",))
def src5_page_registry(spark, d):
    listed = lambda c: F.concat_ws("", F.transform(c, lambda t: F.concat(F.lit("\n   - \""), t, F.lit("\""))))
    text = F.concat(F.lit("---\nid: "), "slug", F.lit("\n title: \""), "title", F.lit("\"\n summary: "), "summary", F.lit("\n tags:"), listed(F.col("tags")), F.lit("\n parent_ids:"), listed(F.col("parent_ids")), F.lit("\n---\n# Body"))
    rows = S.parse_page_registry(fx.registry(spark, d).select(F.col("slug").alias("page"), text.alias("text")))
    empty = F.array().cast("array<string>")
    return rows.select("page", F.col("fields")["title"].alias("title"), F.col("fields")["summary"].alias("summary"), F.coalesce(F.col("lists")["tags"], empty).alias("tags"), F.coalesce(F.col("lists")["parent_ids"], empty).alias("parent_ids"))


@query("SELECT conv_id AS doc, lpad(CAST(turn AS VARCHAR), 4, '0') AS ts, role AS action, 'conv-' || conv_id AS source, ['n' || length(text)] AS created FROM conversations")
def src6_compile_log(spark, d):
    return S.parse_compile_log(fx.log_lines(spark, d)).select("doc", "ts", "action", "source", "created")


@query("""SELECT conv_id AS doc, lpad(CAST(turn AS VARCHAR), 4, '0') AS ts, 'conv-' || conv_id AS source,
CASE WHEN role = 'user' OR length(text) % 2 = 0 THEN 'question' ELSE 'contradiction' END AS kind, role <> 'user' AND length(text) % 2 = 0 AS done, 'n' || length(text) AS item FROM conversations""")
def src7_journal(spark, d):
    return S.parse_journal(fx.journal_lines(spark, d)).select("doc", "ts", "source", "kind", "done", "item")


@query("""WITH l AS (SELECT source AS topic, count(*) AS pages FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1), p AS (SELECT source AS topic, count(*) AS pages FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT t.topic, CASE WHEN l.pages IS NOT NULL THEN 'live' WHEN p.pages IS NOT NULL THEN 'prebuilt' ELSE 'missing' END AS served_from, coalesce(l.pages, p.pages, 0) AS pages
FROM (SELECT DISTINCT source AS topic FROM documents) t LEFT JOIN l USING (topic) LEFT JOIN p USING (topic)""")
def src8_topic_catalog(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("topic"), "doc_id", "lang")
    count = lambda rows: rows.groupBy("topic").agg(F.count("*").alias("pages"))
    return R.topic_catalog(docs.select("topic").distinct(), count(docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")), count(docs.where("lang = 'en'")))


@query("SELECT lang AS topic, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def snk1_stage_table(spark, d):
    rows = spark.read.parquet(Wr.write_stage(fx.sources(spark, d), Wr.scratch(spark, "stages"), "sources"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("SELECT slug, length(body) AS chars FROM wiki_pages", ("wiki_pages",))
def snk2_page_files(spark, d):
    path = Wr.scratch(spark, "pages")
    Wr.write_pages(fx.wiki_pages(spark, d).select("slug", F.col("body").alias("markdown")), path)
    return Wr.read_pages(spark, path).select("slug", F.length("markdown").cast("long").alias("chars"))


@query("SELECT lang AS topic, count(*) AS rows FROM documents GROUP BY 1")
def snk3_publish(spark, d):
    path, rows = Wr.scratch(spark, "published"), fx.sources(spark, d)
    Wr.publish_topic(rows, path)
    Wr.publish_topic(rows.where("topic = 'en'"), path)  # the other topics stay
    return spark.read.parquet(path).groupBy("topic").agg(F.count("*").alias("rows"))


# lines and formulas


@query(f"""SELECT source_id, line_no, reason FROM (SELECT source_id, line_no, CASE
WHEN text LIKE '```%' OR text LIKE '    %' OR starts_with(text, chr(9)) OR regexp_matches(text, '\\$[^$]+\\$') THEN NULL
WHEN regexp_matches(text, '[{X.MATH_SYMBOLS}]') THEN 'math_symbol'
WHEN regexp_matches(text, '(^|[^$`A-Za-z0-9_])([A-Za-z]+)([0-9]+)($|[^A-Za-z0-9_$`])') THEN 'bare_superscript'
WHEN len(list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]?(?:[0-9]+)?(?:[A-Z][a-z]?(?:[0-9]+)?){{1,}})\\b', 1), lambda m: regexp_matches(m, '[A-Z][a-z]?[0-9]') AND length(m) BETWEEN 3 AND 20)) > 0 THEN 'chemical_formula' END AS reason FROM lines) WHERE reason IS NOT NULL""", ("lines",))
def flt5_formulas(spark, d):
    return N.detect_formulas(fx.sources(spark, d).select("source_id", "content")).select("source_id", F.col("line_no").cast("long").alias("line_no"), "reason")


@query("""SELECT line_no > 1 AS later, count(*) AS n, count(CASE WHEN text LIKE '```%' OR text LIKE '    %' OR starts_with(text, chr(9)) OR regexp_matches(text, '\\$[^$]+\\$') THEN 1 END) AS skipped,
count(CASE WHEN regexp_matches(text, '\\| ') THEN 1 END) AS barred FROM lines GROUP BY 1""", ("lines",))
def flt1_skippable(spark, d):
    rows = N.lines(fx.sources(spark, d))
    return rows.groupBy((F.col("line_no") > 1).alias("later")).agg(F.count("*").alias("n"), F.count_if(X.is_skippable(F.col("text"))).alias("skipped"), F.count_if(F.col("text").rlike(r"\| ")).alias("barred"))


def _fixes(spark, d):
    src = fx.sources(spark, d).select("source_id", "content")
    found = N.assign_batches(N.detect_formulas(src), 20, ["line_no"], ["source_id"])
    return src, found, M.fix_lines(found)


@query()
def fix1_apply(spark, d):
    src, found, fixes = _fixes(spark, d)
    out = N.apply_line_fixes(src, found, fixes)
    return out.select("source_id", F.sha2("content", 256).alias("content_sha"), "fixed")


@query(f""", found AS (SELECT source_id, text, CASE
WHEN text LIKE '```%' OR text LIKE '    %' OR starts_with(text, chr(9)) OR regexp_matches(text, '\\$[^$]+\\$') THEN NULL
WHEN regexp_matches(text, '[{X.MATH_SYMBOLS}]') THEN 'math_symbol'
WHEN regexp_matches(text, '(^|[^$`A-Za-z0-9_])([A-Za-z]+)([0-9]+)($|[^A-Za-z0-9_$`])') THEN 'bare_superscript'
WHEN len(list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]?(?:[0-9]+)?(?:[A-Z][a-z]?(?:[0-9]+)?){{1,}})\\b', 1), lambda m: regexp_matches(m, '[A-Z][a-z]?[0-9]') AND length(m) BETWEEN 3 AND 20)) > 0 THEN 'chemical_formula' END AS reason FROM lines),
marked AS (SELECT source_id, reason, reason <> 'math_symbol' OR trim(regexp_replace(text, '^[0-9]+\\.\\s*', ''), ' ') <> text AS fix FROM found WHERE reason IS NOT NULL),
per AS (SELECT source_id, count(*) AS candidates, CAST(sum(CAST(fix AS INTEGER)) AS BIGINT) AS fixed FROM marked GROUP BY source_id)
SELECT source_id, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(coalesce(sum(fixed), 0) AS BIGINT) AS fixed, CAST(coalesce(sum(CAST(fixed > 0 AS INTEGER)), 0) AS BIGINT) AS changed FROM per GROUP BY ROLLUP (source_id)""", ("lines",))
def agg7_formula_totals(spark, d):
    src, found, fixes = _fixes(spark, d)
    return N.formula_totals(found, N.apply_line_fixes(src, found, fixes))


@query("SELECT source_id, CAST((rn - 1) // 20 AS INTEGER) AS batch_no, count(*) AS n FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY line_no) AS rn FROM lines) GROUP BY ALL", ("lines",))
def win6_batches(spark, d):
    rows = N.assign_batches(N.lines(fx.sources(spark, d)), 20, ["line_no"], ["source_id"])
    return rows.groupBy("source_id", "batch_no").agg(F.count("*").alias("n"))


# chunks and atoms


@query("SELECT source_id, chunk_no, start, length(text) AS chars, md5(text) AS digest FROM chunks", ("chunks",))
def chk1_chunks(spark, d):
    rows = N.chunk(fx.sources(spark, d))
    return rows.select("source_id", "chunk_no", "start", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT source_id, seq, atom_id, claim, md5(quote) AS quote_md5, [at0, at1] AS char_offset, list_distinct_ordered AS draft_tags FROM (SELECT *, CASE WHEN len(words) > 1 AND (list_filter(words, lambda w: w <> words[1]))[1] IS NOT NULL THEN [words[1], (list_filter(words, lambda w: w <> words[1]))[1]] ELSE [words[1]] END AS list_distinct_ordered FROM atoms)", ("atoms",))
def udf1_atoms(spark, d):
    return fx.raw_atoms(spark, d).select("source_id", F.col("seq").cast("long").alias("seq"), "atom_id", "claim", F.md5(F.col("quote").cast("binary")).alias("quote_md5"), F.col("char_offset").cast("array<long>").alias("char_offset"), "draft_tags")


@query("SELECT source_id, seq, atom_id FROM kept", ("kept",))
def win1_dedup_atoms(spark, d):
    return A.dedup_atoms(fx.raw_atoms(spark, d)).select("source_id", F.col("seq").cast("long").alias("seq"), "atom_id")


@query("SELECT source_id, count(*) AS raw, (SELECT count(*) FROM kept k WHERE k.source_id = a.source_id) AS kept FROM atoms a GROUP BY source_id", ("atoms", "kept"))
def agg8_atom_counts(spark, d):
    raw = fx.raw_atoms(spark, d)
    return A.atom_counts(raw, A.dedup_atoms(raw))


_KIND = "[{}][CAST((doc_id + turn) % 7 + 1 AS INTEGER)]".format(", ".join(f"'{k}'" for k in (*X.ATOM_KINDS, "other")))


def _raw_model_atoms(spark, d):
    """Conversation turns as what a model might return for a chunk: quote by one of three paths, sometimes none."""
    c = table(spark, d, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_id"), F.col("turn").alias("start"), "text", "role")
    kinds = F.array(*[F.lit(k) for k in (*X.ATOM_KINDS, "other")])
    kind = F.element_at(kinds, (F.length("text") % 7 + 1).cast("int"))
    none, span = F.lit(None).cast("string"), F.array(F.lit(0).cast("bigint"), F.length("text").cast("bigint"))
    quoted = F.struct(F.when(F.length("text") % 3 == 1, F.col("text")).otherwise(none).alias("quote"), F.lit(None).cast("array<bigint>").alias("char_offset"))
    atom = F.struct(F.substring("text", 1, 150).alias("claim"), F.when(F.length("text") % 3 == 0, F.col("text")).otherwise("").alias("evidence_quote"), quoted.alias("evidence"), none.alias("quote"), F.when(F.col("role") == "user", span).alias("evidence_char_offset"), F.lit(None).cast("array<bigint>").alias("char_offset"), kind.alias("kind"), F.lit(None).cast("array<string>").alias("draft_tags"))
    return c.select("source_id", "start", "text", atom.alias("atom"))


_NORMAL_SQL = """SELECT 'conv-' || conv_id AS source_id, turn AS start, substr(text, 1, 150) AS claim, CASE WHEN length(text) % 3 < 2 THEN text ELSE '' END AS quote,
CASE WHEN role = 'user' THEN [0, length(text)] ELSE [turn, turn + length(text)] END AS char_offset, ['definition', 'example', 'formula', 'rule', 'anti-pattern', 'problem', 'other'][length(text) % 7 + 1] AS raw_kind FROM conversations"""


@query(f"SELECT source_id, start, claim, quote, char_offset, CASE WHEN raw_kind = 'other' THEN 'definition' ELSE raw_kind END AS kind, raw_kind FROM ({_NORMAL_SQL})")
def prj1_normalize_atoms(spark, d):
    return A.normalize_atoms(_raw_model_atoms(spark, d)).select("source_id", "start", "claim", "quote", "char_offset", "kind", "raw_kind")


@query(f"""SELECT source_id, start, list_filter([CASE WHEN claim = '' THEN 'missing claim' END, CASE WHEN length(claim) > 120 THEN 'claim too long' END, CASE WHEN quote = '' THEN 'missing quote' END,
CASE WHEN length(quote) > 600 THEN 'quote too long' END, CASE WHEN raw_kind = 'other' THEN 'invalid kind' END], lambda x: x IS NOT NULL) AS errors FROM ({_NORMAL_SQL})""")
def flt7_validate_atoms(spark, d):
    rows = A.normalize_atoms(_raw_model_atoms(spark, d))
    return rows.select("source_id", "start", A.atom_errors(F.col("claim"), F.col("quote"), F.col("char_offset"), F.col("raw_kind")).alias("errors"))


@query("SELECT conv_id, turn, text AS claim, ['a', role] AS tags FROM conversations")
def fn7_parse_response(spark, d):
    """A turn as a model's answer: a tool call for users, a list within prose for others."""
    c = table(spark, d, "conversations")
    listed = F.to_json(F.array(F.struct(F.col("text").alias("claim"), F.array(F.lit("a"), F.col("role")).alias("draft_tags"))))
    answer = F.when(F.col("role") == "user", F.concat(F.lit('{"atoms":'), listed, F.lit("}"))).otherwise(F.concat(F.lit("Here: "), listed, F.lit(" done")))
    rows = c.select("conv_id", "turn", F.explode(X.parse_atoms(answer, "array<struct<claim:string,draft_tags:array<string>>>")).alias("a"))
    return rows.select("conv_id", "turn", "a.claim", F.col("a.draft_tags").alias("tags"))


# vectors and clusters

_UNIT = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v)"


_PAIRS = f"{_UNIT} SELECT a.vec_id AS atom_a, b.vec_id AS atom_b, round(list_dot_product(a.u, b.u), 6) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.35"


@query(_PAIRS)
def joi2_near_duplicates(spark, d):
    return C.near_duplicates(fx.vecs(spark, d), 0.35).withColumn("similarity", F.round("similarity", 6))


@query(_PAIRS)
def joi2_near_duplicates_lsh(spark, d):
    """The same pairs by many small cells: what was a lossy search is complete now."""
    return C.near_duplicates(fx.vecs(spark, d), 0.35, block=64).withColumn("similarity", F.round("similarity", 6))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH p AS (SELECT min(doc_id) AS id, [{", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in _LETTERS)}] AS e FROM documents WHERE text IS NOT NULL GROUP BY text),
q AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM p WHERE list_sum(e) > 0)
SELECT a.id AS atom_a, b.id AS atom_b, round(list_dot_product(a.u, b.u), 6) AS similarity FROM q a JOIN q b ON a.id < b.id WHERE list_dot_product(a.u, b.u) >= 0.9985""")
def joi2_letter_profiles(spark, d):
    """Distinct texts with nearly the same shares of letters: vectors in narrow clusters, which most pairs of cells leave out."""
    held = [(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).alias(c) for c in _LETTERS]
    texts = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"), *held)  # texts stay where they are
    texts = texts.groupBy("sha").agg(F.min("doc_id").alias("id"), *[F.max(c).alias(c) for c in _LETTERS])
    profiles = settle(texts.select("id", F.array(*[F.col(c).cast("double") for c in _LETTERS]).alias("embedding")))
    return C.near_duplicates(profiles, 0.9985, block=256).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT label, list_transform(list_sort(list({'i': i, 'x': x})), lambda r: round(r.x, 9)) AS embedding FROM
(SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label""")
def agg3_centroids(spark, d):
    return C.centroids(fx.vecs(spark, d), "label").select("label", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


_LABELS = "SELECT vec_id AS atom_id, vec_id AS pos, CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM embeddings"


def _cluster_labels(spark, d):
    return fx.vecs(spark, d).select(F.col("id").alias("atom_id"), F.col("id").alias("pos"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label"))


@query(f"""SELECT atom_id, pos, CASE WHEN label < 0 THEN 'noise' WHEN size > 7 THEN 'cluster-' || label || '-' || ((rn - 1) // 7) ELSE 'cluster-' || label END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS rn, count(*) OVER (PARTITION BY label) AS size FROM ({_LABELS}))""")
def win2_clusters(spark, d):
    return C.finalize_clusters(_cluster_labels(spark, d))


@query("SELECT 'cluster-' || (dense_rank() OVER (ORDER BY source_id) - 1) AS label, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS pos, atom_id FROM kept", ("kept",))
def agg2_clusters_per_source(spark, d):
    return C.clusters_per_source(A.dedup_atoms(fx.raw_atoms(spark, d))).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT atom_id, pos, label, claim FROM (SELECT 'cluster-' || (dense_rank() OVER (ORDER BY source_id) - 1) AS label, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS pos, atom_id, claim FROM kept)", ("kept",))
def joi1_attach_atoms(spark, d):
    kept = A.dedup_atoms(fx.raw_atoms(spark, d))
    members = C.clusters_per_source(kept).withColumn("pos", F.col("pos").cast("long"))
    return A.attach_atoms(members, kept.select("atom_id", "claim"))


@query()
def clu2_reduced(spark, d):
    return C.reduce_dims(fx.vecs(spark, d).select("id", "embedding")).select("id", F.size("embedding").alias("dims"))


@query()
def clu3_kmeans(spark, d):
    return C.kmeans_labels(fx.vecs(spark, d).select("id", "embedding"))


@query()
def clu4_density(spark, d):
    return C.density_labels(fx.vecs(spark, d).select("id", "embedding"), 0.35)


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS length, 0.0 AS none FROM embeddings")
def fn4_cosine(spark, d):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return fx.vecs(spark, d).select("id", F.round(V.norm(F.col("embedding")), 6).alias("length"), V.cosine(F.col("embedding"), zero).alias("none"))


@query(f"{_UNIT} SELECT a.vec_id AS id, round(list_dot_product(a.u, b.u), 6) AS next_one, round(list_dot_product(a.u, c.u), 6) AS mirrored FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = (SELECT max(vec_id) FROM u) - a.vec_id")
def fn4_cosine_pairs(spark, d):
    v = fx.vecs(spark, d).select("id", "embedding")
    last = v.agg(F.max("id").alias("last"))
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"))
    mirrored = v.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("id")).alias("id"), F.col("embedding").alias("c"))
    rows = v.join(nxt, "id").join(mirrored, "id")
    return rows.select("id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("next_one"), F.round(V.cosine(F.col("embedding"), F.col("c")), 6).alias("mirrored"))


@query("SELECT slug, '[' || label || '] ' || length(body) AS body, CASE WHEN label LIKE '%7' THEN 'ValueError: no answer for this page' END AS error FROM (SELECT t.slug, t.label, p.body FROM tree t JOIN wiki_pages p ON t.slug = p.slug WHERE t.label NOT LIKE '%7') UNION ALL SELECT t.slug, '## ' || t.label || chr(10) || chr(10) || p.body, 'ValueError: no answer for this page' FROM tree t JOIN wiki_pages p ON t.slug = p.slug WHERE t.label LIKE '%7'", ("tree", "wiki_pages"))
def udf3_compose(spark, d):
    """Page bodies by a model that gives a text's label and length, and fails where the label ends in a 7."""
    rows = fx.tree(spark, d).select("slug", "label").join(fx.wiki_pages(spark, d).select("slug", F.col("body").alias("bullets")), "slug")

    def model(prompts):
        label, _, text = prompts[0].partition("\0")
        if label.endswith("7"):
            raise ValueError("no answer for this page")
        return [f"[{label}] {len(text)}"]

    return M.compose_pages(rows.withColumn("prompt", F.concat("label", F.lit("\0"), "bullets")), model)


@query()
def udf2_embed(spark, d):
    docs = table(spark, d, "documents")
    rows = M.embed(docs.select("doc_id", F.substring("text", 1, 1 << 30).alias("text")).select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "line")
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.round(F.sum(V.norm(F.col("embedding"))), 6).alias("length"))


# trees


@query("""SELECT t.slug, t.parent_slug AS parent, coalesce((SELECT list(s.slug ORDER BY s.ordinal) FROM tree s WHERE s.parent_slug = t.parent_slug AND s.slug <> t.slug), []) AS siblings,
coalesce((SELECT list(c.slug ORDER BY c.ordinal) FROM tree c WHERE c.parent_slug = t.slug), []) AS children, w.ancestors,
w.pre_no + (SELECT count(*) FROM pre x WHERE x.slug = t.slug OR list_contains(x.ancestors, t.slug)) - 1 - w.depth AS post_no FROM tree t JOIN pre w ON t.slug = w.slug""", ("tree", "pre"))
def joi7_page_context(spark, d):
    return T.page_context(fx.tree(spark, d)).select("slug", "parent", "siblings", "children", "ancestors", "post_no")


@query("SELECT slug, pre_no, depth, path FROM pre", ("pre",))
def top1_preorder(spark, d):
    return T.preorder(fx.tree(spark, d)).select("slug", "pre_no", "depth", "path")


@query("SELECT slug, pre_no + (SELECT count(*) FROM pre x WHERE x.slug = p.slug OR list_contains(x.ancestors, p.slug)) - 1 - depth AS post_no FROM pre p", ("pre",))
def top2_postorder(spark, d):
    return T.postorder(fx.tree(spark, d))


@query("SELECT count(*) AS nodes, max(depth) + 1 AS depth FROM walk", ("walk",))
def agg6_tree_stats(spark, d):
    return T.tree_stats(fx.tree(spark, d))


@query("""SELECT t.slug, w.ancestors || coalesce((SELECT list(s.slug ORDER BY s.ordinal) FROM tree s WHERE s.parent_slug = t.parent_slug AND s.slug <> t.slug), []) || coalesce((SELECT list(c.slug ORDER BY c.ordinal) FROM tree c WHERE c.parent_slug = t.slug), []) AS allowed
FROM tree t JOIN walk w ON t.slug = w.slug""", ("tree", "walk"))
def set1_allowed_links(spark, d):
    return T.allowed_links(T.page_context(fx.tree(spark, d)))


@query("SELECT DISTINCT slug FROM tree", ("tree",))
def set3_slugs(spark, d):
    return fx.tree(spark, d).select("slug").distinct()


@query("SELECT p.pre_no, p.slug, t.label, p.depth FROM pre p JOIN tree t ON p.slug = t.slug", ("pre", "tree"))
def page6_nav_outline(spark, d):
    return T.nav_outline(fx.tree(spark, d))


@query()
def snk4_tree_json(spark, d):
    return T.tree_to_json(fx.tree(spark, d))


@query("""SELECT pos, CASE WHEN n = 1 THEN type || '-2' WHEN n = 2 THEN type ELSE type || '-' || n END AS slug FROM (SELECT pos, type, row_number() OVER (PARTITION BY type ORDER BY pos) AS n FROM registry)""", ("registry",))
def win5_taken_numbers(spark, d):
    rows = fx.registry(spark, d).select("pos", "type", F.row_number().over(W.partitionBy("type").orderBy("pos")).alias("n"))
    rows = rows.select("pos", F.when(F.col("n") == 1, F.concat("type", F.lit("-2"))).otherwise(F.col("type")).alias("base"), F.col("pos").alias("alloc_no"))
    return T.unique_slugs(rows).select("pos", "slug")


@query("""SELECT pos, CASE WHEN n = 1 THEN title ELSE title || '-' || n END AS slug FROM (SELECT pos, title, row_number() OVER (PARTITION BY title ORDER BY pos) AS n FROM registry)""", ("registry",))
def win5_unique_slugs(spark, d):
    rows = fx.registry(spark, d).select("pos", F.col("title").alias("base"), F.col("pos").alias("alloc_no"))
    return T.unique_slugs(rows).select("pos", "slug")


@query(""", first AS (SELECT source_id, CAST(dense_rank() OVER (ORDER BY source_id) - 1 AS BIGINT) AS no, coalesce(nullif(words[1], ''), nullif(substr(claim, 1, 20), '')) AS label FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn FROM kept) WHERE rn = 1),
leaf AS (SELECT 'cluster-' || no AS cluster, row_number() OVER (ORDER BY 'cluster-' || no) - 1 AS leaf_no, label FROM first),
named AS (SELECT *, 'concept-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(label), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40), ''), CAST(leaf_no AS VARCHAR)) AS base FROM leaf)
SELECT cluster, leaf_no, label, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY leaf_no) AS n FROM named)""", ("kept",))
def tre3_leaf_nodes(spark, d):
    kept = A.dedup_atoms(fx.raw_atoms(spark, d))
    return T.leaf_nodes(C.clusters_per_source(kept), kept.select("atom_id", "claim", "draft_tags"))


@query()
def tre3_embedded_leaves(spark, d):
    """Leaves with vectors of their labels by a model that fails for one label: all have the same vector, and group in sequence."""
    kept = A.dedup_atoms(fx.raw_atoms(spark, d))

    def model(labels):
        return [[float(len(t)), 1.0] for t in labels if not t.startswith("a")]  # too few values where a label starts with an a

    leaves = T.embedded_leaves(C.clusters_per_source(kept), kept.select("atom_id", "claim", "draft_tags"), model)
    groups = T.group_once(leaves.select(F.col("leaf_no").alias("id"), "embedding"))
    return leaves.join(groups, leaves["leaf_no"] == groups["id"]).select("cluster", "leaf_no", "label", "slug", "embedding", "group_no")


@query()
def tre1_group_once(spark, d):
    return T.group_once(fx.vecs(spark, d).select("id", "embedding"))


@query()
def tre2_build_tree(spark, d):
    leaves = fx.vecs(spark, d).select(F.format_string("concept-%06d", "id").alias("slug"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return T.build_tree(leaves, "vectors")


# links


@query("SELECT source, type, target, code FROM classified", ("classified",))
def gra1_classify_links(spark, d):
    return L.classify_links(L.all_links(fx.wiki_pages(spark, d)), fx.tree(spark, d).select("slug")).select("source", "type", "target", "code")


@query("SELECT slug AS source, regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)[1] AS target, instr(body, '[[') - 1 AS \"offset\" FROM wiki_pages WHERE body LIKE '%[[%'", ("wiki_pages",))
def fn8_link_offsets(spark, d):
    rows = L.all_links(fx.wiki_pages(spark, d)).where("type = 'wiki'")
    return rows.groupBy("source").agg(F.min_by("target", "offset").alias("target"), F.min("offset").cast("long").alias("offset"))


@query("SELECT slug AS source, regexp_extract(body, 'click node-A \"([^\"]+)\\.html', 1) AS target, CAST(instr(body, 'click node-A') - 1 AS INTEGER) AS \"offset\" FROM wiki_pages WHERE body LIKE '%click node-A%'", ("wiki_pages",))
def fn9_click_links(spark, d):
    return L.all_links(fx.wiki_pages(spark, d)).where("type = 'mermaid-click'").select("source", "target", "offset")


@query("SELECT t.slug, count(c.target) AS cnt FROM tree t LEFT JOIN (SELECT * FROM classified WHERE code IS NULL) c ON t.slug = c.target GROUP BY 1", ("tree", "classified"))
def joi4_incoming(spark, d):
    slugs = fx.tree(spark, d).select("slug")
    return L.incoming_counts(L.classify_links(L.all_links(fx.wiki_pages(spark, d)), slugs), slugs)


@query("SELECT slug FROM tree WHERE slug NOT IN (SELECT target FROM classified WHERE code IS NULL) AND parent_slug IS NOT NULL", ("tree", "classified"))
def gra2_orphans(spark, d):
    t = fx.tree(spark, d)
    return L.orphans(L.incoming_counts(L.classify_links(L.all_links(fx.wiki_pages(spark, d)), t.select("slug")), t), L.root_of(t))


@query("SELECT target AS slug, count(*) AS cnt FROM classified WHERE code IS NULL GROUP BY 1 HAVING count(*) > 30", ("classified",))
def gra3_hubs(spark, d):
    t = fx.tree(spark, d)
    return L.hubs(L.incoming_counts(L.classify_links(L.all_links(fx.wiki_pages(spark, d)), t.select("slug")), t))


@query(""", edge AS (SELECT DISTINCT source AS a, target AS b FROM classified WHERE code IS NULL), reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT e.a AS source, e.b AS target, EXISTS (SELECT 1 FROM tree t WHERE (t.slug = e.a AND t.parent_slug = e.b) OR (t.slug = e.b AND t.parent_slug = e.a)) AS parent_child FROM edge e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.a = e.b AND r.b = e.a)""", ("classified", "tree"))
def gra4_cycle_links(spark, d):
    t = fx.tree(spark, d)
    return L.cycle_links(L.classify_links(L.all_links(fx.wiki_pages(spark, d)), t.select("slug")), t)


@query(""", edge AS (SELECT DISTINCT source AS a, target AS b FROM classified WHERE code IS NULL), reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
cnt AS (SELECT t.slug, t.parent_slug, count(c.target) AS n FROM tree t LEFT JOIN (SELECT * FROM classified WHERE code IS NULL) c ON t.slug = c.target GROUP BY 1, 2)
SELECT (SELECT count(*) FROM wiki_pages) AS total_pages, (SELECT count(*) FROM links) AS total_links,
(SELECT count(*) FROM classified WHERE code IS NOT NULL) + (SELECT count(*) FROM edge e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.a = e.b AND r.b = e.a)) AS p0,
(SELECT count(*) FROM cnt WHERE (n = 0 AND parent_slug IS NOT NULL) OR n > 30) AS p1""", ("classified", "tree"))
def gra5_link_audit(spark, d):
    out = L.link_audit(fx.wiki_pages(spark, d), fx.tree(spark, d))
    return out["totals"].crossJoin(out["audit"])


@query("SELECT code, source, target FROM classified WHERE code IS NOT NULL ORDER BY 1, 2, 3 LIMIT 10", ("classified",))
def top4_errors(spark, d):
    links = L.classify_links(L.all_links(fx.wiki_pages(spark, d)), fx.tree(spark, d).select("slug"))
    return L.top_errors(links.where(F.col("code").isNotNull()).select("code", "source", "target"))


@query("""SELECT l.source, l.target FROM links l WHERE NOT EXISTS (SELECT 1 FROM tree t JOIN walk w ON t.slug = w.slug WHERE t.slug = l.source AND (list_contains(w.ancestors, l.target)
OR EXISTS (SELECT 1 FROM tree o WHERE o.slug = l.target AND o.slug <> t.slug AND o.parent_slug = t.parent_slug) OR EXISTS (SELECT 1 FROM tree o WHERE o.slug = l.target AND o.parent_slug = t.slug)))""", ("links", "walk"))
def set4_links_outside(spark, d):
    return L.links_outside(L.all_links(fx.wiki_pages(spark, d)), fx.tree(spark, d))


@query("SELECT DISTINCT slug, regexp_replace(regexp_replace(body, '\\[\\[(concept-s[0-9]+|concept-n[0-9]+)\\]\\]', '<a href=\"pages/\\1.html\">\\1</a>', 'g'), '\\[\\[([^\\]]*)\\]\\]', '<span class=\"pending\">\\1</span>', 'g') AS html FROM wiki_pages", ("wiki_pages",))
def joi6_resolve_links(spark, d):
    pages = fx.wiki_pages(spark, d)
    known = L.all_links(pages).select(F.col("target").alias("slug")).distinct().where(F.col("slug").startswith("concept-"))
    return L.resolve_links(pages, known.select("slug", F.concat(F.lit("pages/"), "slug", F.lit(".html")).alias("path")))


@query("SELECT DISTINCT source AS slug, target FROM links WHERE type = 'wiki' AND target NOT IN (SELECT slug FROM wiki_pages)", ("links",))
def joi6_unresolved_links(spark, d):
    pages = fx.wiki_pages(spark, d)
    return L.unresolved_links(pages, pages).distinct()


# registry


@query("SELECT type, count(*) AS cnt, CAST(round(count(*) * 100.0 / max(count(*)) OVER ()) AS INTEGER) AS percent FROM registry GROUP BY type", ("registry",))
def agg9_type_histogram(spark, d):
    return R.type_histogram(fx.registry(spark, d))


@query("SELECT (SELECT count(*) FROM registry WHERE type <> 'source') AS knowledge_pages, (SELECT count(*) FROM registry) AS all_pages, (SELECT count(*) FROM links) AS cross_references, (SELECT count(DISTINCT type) FROM registry) AS domains", ("registry", "links"))
def agg10_hero_stats(spark, d):
    r = fx.registry(spark, d)
    return R.hero_stats(r, L.all_links(fx.wiki_pages(spark, d)), r.select(F.col("type").alias("domain")))


@query("""SELECT name, value, CAST(round(value * 100.0 / max(value) OVER ()) AS INTEGER) AS percent FROM (SELECT 'search entries' AS name, count(*) AS value FROM registry
UNION ALL SELECT 'tags', CAST(sum(len(tags)) AS BIGINT) FROM registry UNION ALL SELECT 'wiki links', (SELECT count(*) FROM links))""", ("registry", "links"))
def agg11_size_chart(spark, d):
    return R.size_chart(fx.registry(spark, d), L.all_links(fx.wiki_pages(spark, d)))


@query("SELECT coalesce(type, 'uncategorized') AS type, count(*) AS cnt FROM registry GROUP BY 1", ("registry",))
def agg12_sitemap(spark, d):
    return R.sitemap(fx.registry(spark, d))


@query("SELECT type, count(*) AS cnt, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM registry WHERE type <> 'Brand#11' GROUP BY type", ("registry",))
def agg13_hub_pages(spark, d):
    return R.hub_pages(fx.registry(spark, d), kind="Brand#11")


@query(""", up AS (SELECT slug, parent_ids[1] AS top, 1 AS n FROM registry WHERE len(parent_ids) > 0 UNION ALL SELECT u.slug, r.parent_ids[1], n + 1 FROM up u JOIN registry r ON u.top = r.slug WHERE len(r.parent_ids) > 0),
tops AS (SELECT slug, max_by(top, n) AS top FROM up GROUP BY slug)
SELECT top AS domain, coalesce(any_value(r.title), upper(substr(replace(top, '-', ' '), 1, 1)) || substr(replace(top, '-', ' '), 2)) AS title, count(*) AS cnt FROM tops t LEFT JOIN registry r ON t.top = r.slug GROUP BY top""", ("registry",))
def agg14_domains(spark, d):
    return R.domains(fx.registry(spark, d))


@query("SELECT updated, count(*) AS cnt, list_sort(list(DISTINCT type)) AS types, (list_sort(list(DISTINCT title)))[1:3] AS titles FROM registry GROUP BY updated", ("registry",))
def agg15_activity(spark, d):
    return R.activity(fx.registry(spark, d))


@query(""", e AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM links WHERE source <> target AND source IN (SELECT slug FROM tree) AND target IN (SELECT slug FROM tree)),
dg AS (SELECT n, count(*) AS lc FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n)
SELECT slug, coalesce(lc, 0) AS lc, CAST(2 + coalesce(lc, 0) // 3 AS INTEGER) AS r FROM tree LEFT JOIN dg ON slug = n""", ("links", "tree"))
def agg16_link_graph(spark, d):
    pages = fx.tree(spark, d).select("slug", F.col("kind").alias("type"))
    return R.link_graph(L.all_links(fx.wiki_pages(spark, d)), pages)[0]


@query("SELECT o_orderkey AS pos, o_orderpriority AS name, o_orderkey = (SELECT min(o_orderkey) FROM orders) AS latest FROM orders ORDER BY 1 LIMIT 10")
def agg17_recent_builds(spark, d):
    return R.recent_builds(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name")))


@query("SELECT 'conv-' || conv_id AS source, CASE WHEN role = 'user' THEN 'question' ELSE 'contradiction' END AS kind, count(*) AS cnt FROM conversations WHERE role = 'user' OR length(text) % 2 = 1 GROUP BY ALL")
def agg18_open_items(spark, d):
    return R.open_items(S.parse_journal(fx.journal_lines(spark, d)))


@query(""", t AS (SELECT slug, pos, type, unnest(tags) AS tag FROM registry), s AS (SELECT a.slug, b.slug AS related_slug, b.pos, CAST(count(*) AS DOUBLE) AS score FROM (SELECT DISTINCT slug, tag FROM t) a JOIN t b ON a.tag = b.tag AND a.slug <> b.slug GROUP BY ALL),
y AS (SELECT a.slug, b.slug AS related_slug, b.pos, 0.1 AS score FROM registry a JOIN registry b ON a.type = b.type AND a.slug <> b.slug WHERE NOT list_has_any(a.tags, b.tags))
SELECT slug, related_slug, score, CAST(row_number() OVER (PARTITION BY slug ORDER BY score DESC, pos) AS INTEGER) AS rank FROM (SELECT * FROM s UNION ALL SELECT * FROM y) QUALIFY rank <= 5""", ("registry",))
def win3_related_pages(spark, d):
    return R.related_pages(fx.registry(spark, d))


@query("SELECT slug AS path, lag(slug) OVER w AS prev, lead(slug) OVER w AS next FROM registry WINDOW w AS (PARTITION BY type ORDER BY slug)", ("registry",))
def win4_prev_next(spark, d):
    r = fx.registry(spark, d)
    first = r.select(F.col("type").alias("seq_no"), F.col("slug").alias("path"), F.row_number().over(W.partitionBy("type").orderBy("slug")).alias("pos"))
    return R.prev_next(first)


_ASKED = """WITH i AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), a AS (SELECT item_id * 4 AS query_id, w[1] || ' ' || w[2] AS query FROM i UNION ALL SELECT item_id * 4 + 1, text FROM i
UNION ALL SELECT item_id * 4 + 2, substr(text, 1, 1) FROM i UNION ALL SELECT item_id * 4 + 3, substr(text, 2, 2) FROM i),
q AS (SELECT query_id, list_filter(string_split_regex(lower(trim(query)), '\\s+'), lambda t: t <> '') AS terms FROM a)
SELECT query_id, doc_id AS slug FROM q JOIN (SELECT doc_id, lower(source || ' ' || lang || ' ' || text) AS h FROM documents) ON len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(h, t))) = 0"""


def _searched(spark, d):
    """Each item's first two words, its whole text, its first letter, and the two characters after that; in all documents."""
    words, item = F.split("text", " "), F.col("item_id") * 4
    forms = [(0, F.concat(words[0], F.lit(" "), words[1])), (1, F.col("text")), (2, F.substring("text", 1, 1)), (3, F.substring("text", 2, 2))]
    asked = table(spark, d, "benchmark").select(F.explode(F.array(*[F.struct((item + n).alias("query_id"), q.alias("query")) for n, q in forms])).alias("q")).select("q.*")
    return asked, table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("source").alias("title"), F.col("lang").alias("summary"), F.col("text").alias("keywords"))


@query(_ASKED)
def fn11_search(spark, d):
    return Q.search(*_searched(spark, d))


@query(_ASKED)
def fn11_stored_index(spark, d):
    asked, index = _searched(spark, d)
    path = Wr.scratch(spark, "search-index")
    Q.write_index(index, path)
    return Q.search(asked, Q.read_index(spark, path))


@query("SELECT page_id AS page, CAST(0 AS INTEGER) AS pos, 1 AS level, 'section-1' AS id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS text FROM pages WHERE regexp_matches(html, '(?s)<h1[^>]*>.*</h1>')")
def fn13_headings(spark, d):
    return P.headings(table(spark, d, "pages").select(F.col("page_id").alias("page"), "html"), levels=(1,))


@query()
def fn12_language(spark, d):
    e = table(spark, d, "events").select(F.col("props").alias("code")).unionByName(table(spark, d, "conversations").select(F.col("text").alias("code"))).unionByName(table(spark, d, "pages").select(F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1).alias("code")))
    return e.groupBy(X.guess_language(F.col("code")).alias("language")).agg(F.count("*").alias("n"))


@query("SELECT slug, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%' AS text, CASE WHEN confidence >= 0.8 THEN 'green' ELSE 'amber' END AS colour FROM registry", ("registry",))
def prj5_badges(spark, d):
    return fx.registry(spark, d).select("slug", X.confidence_badge(F.col("confidence")).alias("b")).select("slug", "b.text", "b.colour")


@query("""SELECT page_id, ['首页', '实体'] || CASE WHEN regexp_matches(url, '/[0-9]+') THEN [] ELSE [] END || [upper(substr(h, 1, 1)) || substr(h, 2), 'page ' || page_id] AS crumbs
FROM (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS h FROM pages)""")
def prj7_breadcrumb(spark, d):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    path = F.concat(F.lit("/topic/entities/"), host, F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, d, "pages").select("page_id", X.breadcrumb(path, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("crumbs"))


@query("SELECT doc_id, substr(text, 1, 100) || '...' AS summary FROM documents")
def prj8_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", X.summary_or_excerpt(F.lit(""), F.col("text")).alias("summary"))


@query("SELECT slug, title, type AS label, '#eee' AS background, '#333' AS colour, summary FROM registry", ("registry",))
def joi10_tooltips(spark, d):
    r = fx.registry(spark, d)
    return R.tooltips(r.select("slug"), r)


@query("""SELECT doc_id, 'p-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40), ''), CAST(doc_id AS VARCHAR)) AS slug,
regexp_replace(substr(text, 1, 20), '[^a-zA-Z0-9]', '-', 'g') AS source_slug, CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS padded FROM documents""")
def fn1_slugs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.slugify(F.lit("p"), F.substring("text", 1, 60), F.col("doc_id")).alias("slug"), X.source_slug(F.substring("text", 1, 20)).alias("source_slug"), X.pad3(F.col("doc_id")).alias("padded"))


@query("SELECT kind, CASE kind WHEN 'root' THEN 2000 WHEN 'intermediate' THEN 1200 ELSE 600 END AS word_limit, CASE kind WHEN 'leaf-cluster' THEN 'leaf' ELSE kind END AS printed, count(*) AS n FROM tree GROUP BY kind", ("tree",))
def prj3_word_limits(spark, d):
    k = F.col("kind")
    return fx.tree(spark, d).groupBy("kind", X.word_limit(k).alias("word_limit"), X.page_kind(k).alias("printed")).agg(F.count("*").alias("n"))


@query("SELECT atom_id, claim || ' ' || words[1] AS text FROM kept", ("kept",))
def prj2_embedding_text(spark, d):
    return A.dedup_atoms(fx.raw_atoms(spark, d)).select("atom_id", X.embedding_text(F.col("claim"), F.slice("draft_tags", 1, 1)).alias("text"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def fn14_dates(spark, d):
    return table(spark, d, "events").select("event_id", X.date_part(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


@query(""", e AS (SELECT DISTINCT least(slug, parent_ids[1]) AS a, greatest(slug, parent_ids[1]) AS b FROM registry WHERE len(parent_ids) > 0),
par AS (SELECT slug, 'parent' AS role, 0 AS pos, parent_ids[1] AS target FROM registry WHERE len(parent_ids) > 0),
ch AS (SELECT target AS slug, 'child' AS role, CAST(row_number() OVER (PARTITION BY target ORDER BY slug) - 1 AS INTEGER) AS pos, slug AS target FROM par WHERE target IN (SELECT slug FROM registry)),
sib AS (SELECT DISTINCT least(a.slug, b.slug) AS a, greatest(a.slug, b.slug) AS b FROM registry a JOIN registry b ON a.pos + 1 = b.pos),
nb AS (SELECT a AS slug, b AS target FROM sib UNION SELECT b, a FROM sib),
rel AS (SELECT slug, 'related' AS role, CAST(row_number() OVER (PARTITION BY slug ORDER BY target) - 1 AS INTEGER) AS pos, target FROM nb WHERE (slug, target) NOT IN (SELECT slug, target FROM par) AND (slug, target) NOT IN (SELECT slug, target FROM ch))
SELECT * FROM par UNION ALL SELECT * FROM ch UNION ALL SELECT * FROM rel WHERE pos < 4""", ("registry",))
def top5_nav_neighbours(spark, d):
    r = fx.registry(spark, d)
    return R.nav_neighbours(r, R.next_links(r.select("slug", "pos")))


@query(""", up AS (SELECT slug, parent_ids[1] AS top, 1 AS n FROM registry WHERE len(parent_ids) > 0 UNION ALL SELECT u.slug, r.parent_ids[1], n + 1 FROM up u JOIN registry r ON u.top = r.slug WHERE len(r.parent_ids) > 0)
SELECT top AS domain, count(*) AS cnt, string_agg(slug, ', ' ORDER BY slug) AS pages FROM (SELECT slug, max_by(top, n) AS top FROM up GROUP BY slug) GROUP BY top""", ("registry",))
def dom1_outline(spark, d):
    return R.domain_outline(fx.registry(spark, d))


@query(""", up AS (SELECT slug, parent_ids[1] AS top, 1 AS n FROM registry WHERE len(parent_ids) > 0 UNION ALL SELECT u.slug, r.parent_ids[1], n + 1 FROM up u JOIN registry r ON u.top = r.slug WHERE len(r.parent_ids) > 0),
d AS (SELECT slug, max_by(top, n) AS domain, max(n) AS m FROM up GROUP BY slug), s AS (SELECT d.slug, d.domain, coalesce(u.top, d.slug) AS section FROM d LEFT JOIN up u ON u.slug = d.slug AND u.n = d.m - 1),
o AS (SELECT 1 AS level, domain, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS slug, count(*) AS cnt FROM s GROUP BY domain UNION ALL SELECT 2, domain, section, NULL, count(*) FROM s GROUP BY domain, section UNION ALL SELECT 3, domain, section, slug, 1 FROM s WHERE slug <> section)
SELECT row_number() OVER (ORDER BY domain, section NULLS FIRST, slug NULLS FIRST) - 1 AS pos, level, domain, section, slug, cnt FROM o""", ("registry",))
def dom1_three_levels(spark, d):
    return R.outline(fx.registry(spark, d))


# pages


@query("""SELECT t.slug, '---' || chr(10) || 'slug: ' || t.slug || chr(10) || 'title: "' || label || '"' || chr(10) || 'kind: ' || CASE kind WHEN 'leaf-cluster' THEN 'leaf' ELSE kind END || chr(10) || 'parent: ' || coalesce(parent_slug, 'null') || chr(10) || '---' || chr(10) || chr(10) || body AS markdown
FROM tree t JOIN wiki_pages p ON t.slug = p.slug""", ("tree", "wiki_pages"))
def page1_assemble(spark, d):
    return P.assemble_pages(T.page_context(fx.tree(spark, d)), fx.wiki_pages(spark, d))


@query("SELECT source_id AS slug, string_agg('- [definition] ' || claim || chr(10) || '  证据：' || quote, chr(10) ORDER BY seq) AS bullets FROM kept GROUP BY source_id", ("kept",))
def page2_bullets(spark, d):
    kept = A.dedup_atoms(fx.raw_atoms(spark, d))
    return P.atom_bullets(kept.select(F.col("source_id").alias("slug"), F.col("seq").alias("pos"), "atom_id"), kept)


def _said(text):
    return "'" + text.replace("'", "''") + "'"


_ALLOWED = "array_to_string(w.ancestors || coalesce((SELECT list(s.slug ORDER BY s.ordinal) FROM tree s WHERE s.parent_slug = t.parent_slug AND s.slug <> t.slug), []) || coalesce((SELECT list(c.slug ORDER BY c.ordinal) FROM tree c WHERE c.parent_slug = t.slug), []), ', ')"


@query(f"""SELECT t.slug, {_said(P.ASK)} || t.label || CASE WHEN t.kind = 'leaf-cluster' THEN {_said(P.LEAF)} ELSE {_said(P.NOT_LEAF)} END || t.slug || {_said(P.ATOMS)} || coalesce(nullif(p.body, ''), {_said(P.NO_ATOMS)}) || {_said(P.ALLOWED)} || {_ALLOWED}
|| {_said(P.RULES)} || CASE WHEN t.kind = 'leaf-cluster' THEN {_said(P.LEAF_STORY)} ELSE {_said(P.STORY)} END || {_said(P.LIMIT)} || CASE t.kind WHEN 'root' THEN '2000' WHEN 'intermediate' THEN '1200' ELSE '600' END || {_said(P.STYLE)} AS prompt,
CASE t.kind WHEN 'root' THEN 2000 WHEN 'intermediate' THEN 1200 ELSE 600 END AS word_limit FROM tree t JOIN walk w ON t.slug = w.slug LEFT JOIN wiki_pages p ON p.slug = t.slug""", ("tree", "walk", "wiki_pages"))
def page3_prompts(spark, d):
    tree = fx.tree(spark, d)
    pages = fx.wiki_pages(spark, d).select("slug", F.col("body").alias("bullets"))
    return P.page_prompts(T.page_context(tree), pages)


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?m)^## (.+)$', '<h2>\1</h2>', 'g'), '(?m)^# (.+)$', '<h1>\1</h1>', 'g'), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '\*(.+?)\*', '<em>\1</em>', 'g'),
'(?m)^- (.+)$', '<li>\1</li>', 'g'), '\[\[([^\]]+)\]\]', '<a href="\1.html">\1</a>', 'g'), '((?:<li>.*</li>\n?)+)', '<ul>\1</ul>', 'g')"""
_CLEAN = r"'<p>' || regexp_replace({0}, '\n{{2,}}', '</p><p>', 'g') || '</p>'"
for _a, _b in (("<p></p>", ""), ("<p>(<h[1-6]>)", r"\1"), ("(</h[1-6]>)</p>", r"\1"), ("<p>(<ul>)", r"\1"), ("(</ul>)</p>", r"\1")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_a}', '{_b}', 'g')"


@query("SELECT t.slug, coalesce(p.title, t.slug) AS title, " + _CLEAN.format(_HTML.format("coalesce(p.body, '')")) + " AS html FROM (SELECT DISTINCT slug FROM tree) t LEFT JOIN wiki_pages p ON t.slug = p.slug", ("tree", "wiki_pages"))
def page5_site(spark, d):
    return P.site_pages(fx.tree(spark, d), fx.wiki_pages(spark, d))


_LINES = "regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
_INLINE = [("(?m)^#### (.+)$", r"<h4>\1</h4>"), ("(?m)^### (.+)$", r"<h3>\1</h3>"), ("(?m)^## (.+)$", r"<h2>\1</h2>"), ("(?m)^# (.+)$", r"<h1>\1</h1>"), (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"), ("`([^`]+)`", r"<code>\1</code>"),
    ("(?m)^- (.+)$", r"<li>\1</li>"), ("(?m)^> (.+)$", r"<blockquote>\1</blockquote>"), ("(?m)^---$", "<hr>"), (r"\[\[([^\]]+)\]\]", r'<a href="\1.html">\1</a>'), (r"((?:<li>.*</li>\n?)+)", r"<ul>\1</ul>")]
_WHOLE = _LINES
for _a, _b in [*_INLINE, (r"\n{2,}", "</p><p>")]:
    _WHOLE = f"regexp_replace({_WHOLE}, '{_a}', '{_b}', 'g')"
_WHOLE = f"'<p>' || {_WHOLE} || '</p>'"
for _a, _b in [("<p></p>", ""), ("<p>(<h[1-6]>)", r"\1"), ("(</h[1-6]>)</p>", r"\1"), ("<p>(<ul>)", r"\1"), ("(</ul>)</p>", r"\1"), ("<p>(<blockquote>)", r"\1"), ("(</blockquote>)</p>", r"\1"), ("<p>(<hr>)</p>", r"\1")]:
    _WHOLE = f"regexp_replace({_WHOLE}, '{_a}', '{_b}', 'g')"


@query(f"SELECT doc_id, length(html) AS chars, md5(html) AS html_md5 FROM (SELECT doc_id, {_WHOLE} AS html FROM documents)")
def page4_html(spark, d):
    rows = table(spark, d, "documents").select("doc_id", P.markdown_to_html(F.col("text")).alias("html"))
    return rows.select("doc_id", F.length("html").cast("long").alias("chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("SELECT count(*) AS cnt, list(slug ORDER BY pre_no) AS slugs FROM pre", ("pre",))
def page5_index(spark, d):
    return P.site_index(fx.tree(spark, d))


@query("""SELECT pre_no, repeat('#', least(depth + 1, 6)) || ' ' || t.label || chr(10) || chr(10) || CASE WHEN coalesce(w.body, '') <> '' THEN w.body || chr(10) || chr(10) WHEN EXISTS (SELECT 1 FROM tree k WHERE k.parent_slug = t.slug) THEN '' ELSE '*(详见 wiki)*' || chr(10) || chr(10) END AS section
FROM pre p JOIN tree t ON p.slug = t.slug LEFT JOIN wiki_pages w ON w.slug = t.slug""", ("pre", "tree", "wiki_pages"))
def page7_handbook(spark, d):
    return P.handbook_sections(fx.tree(spark, d), fx.wiki_pages(spark, d))


@query("SELECT -1 AS pre_no, '# Geo' || chr(10) || chr(10) || '> 生成时间：2026-01-01' || chr(10) || '> 共 ' || (SELECT count(*) FROM pre) || ' 个知识节点。' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS section UNION ALL SELECT CAST((SELECT count(*) FROM pre) AS INTEGER), '## 附录：本卷如何被编译出来' || chr(10) || chr(10) || '> 每个 stage 的工程取舍。' || chr(10) || chr(10) || '### 编译审计' || chr(10) || chr(10) || (SELECT string_agg('- ' || event_type || '：' || n, chr(10) ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) || chr(10) || chr(10)", ("pre",))
def page7_title_and_appendix(spark, d):
    audit = table(spark, d, "events").groupBy(F.lit("t").alias("topic"), F.col("event_type").alias("key")).agg(F.count("*").alias("value"))
    none = P.upsert_decisions(fx.decisions(spark, d)).where("topic = 't'")
    book = P.handbook(fx.tree(spark, d), fx.wiki_pages(spark, d), "2026-01-01", P.decision_text(none, audit).select("text"))
    last = book.agg(F.max("pre_no").alias("last"))
    return book.crossJoin(last).where("pre_no = -1 or pre_no = last").select("pre_no", "section")


_UPSERT = """WITH log AS (SELECT 'topic' || (user_id % 5) AS topic, 'stage' || (user_id % 7 + 1) AS stage, event_type AS name, CAST(event_id AS VARCHAR) AS chosen, event_id AS ts FROM events),
last AS (SELECT topic, stage, name, chosen, min(ts) OVER w AS pos FROM log WINDOW w AS (PARTITION BY topic, stage, CASE WHEN stage = 'stage2' THEN '' ELSE name END) QUALIFY row_number() OVER (PARTITION BY topic, stage, CASE WHEN stage = 'stage2' THEN '' ELSE name END ORDER BY ts DESC) = 1)"""


@query(f"{_UPSERT} SELECT topic, stage, name, chosen, pos FROM last")
def dec1_upsert(spark, d):
    return P.upsert_decisions(fx.decisions(spark, d)).select("topic", "stage", "name", "chosen", "pos")


@query(f"""{_UPSERT} SELECT topic, string_agg('### [' || stage || '] ' || name || chr(10) || chr(10) || '**选择**：' || chosen || chr(10) || chr(10) || '**理由**：because' || chr(10) || chr(10) || '**已知限制**：' || chr(10) || '- ' || name || chr(10) || chr(10), chr(10) ORDER BY pos) AS text FROM last GROUP BY topic""")
def page8_decisions(spark, d):
    return P.decision_text(P.upsert_decisions(fx.decisions(spark, d)))


@query("SELECT 'topic' || (user_id % 5) AS topic, event_type AS key, max_by(round(value, 6), event_id) AS value FROM events GROUP BY ALL")
def dec1_audit(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("topic"), (F.col("user_id") % 5).cast("string")).alias("topic"), F.col("event_type").alias("key"), F.round("value", 6).alias("value"), F.col("event_id").alias("ts"))
    return P.latest_audit(e)


@query("""SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.source_id IS NULL THEN 'new' WHEN n.source_id IS NULL THEN 'deleted' WHEN o.content = n.content THEN 'same' ELSE 'changed' END AS status
FROM (SELECT 'doc-' || doc_id AS source_id, trim(text, '.') AS content FROM documents WHERE lang <> 'de') o FULL JOIN (SELECT 'doc-' || doc_id AS source_id, text AS content FROM documents WHERE lang <> 'fr') n ON o.source_id = n.source_id""")
def inc1_diff(spark, d):
    s = fx.sources(spark, d)
    old = s.where("topic <> 'de'").select("source_id", F.trim("content", F.lit(".")).alias("content"))
    return P.diff_sources(old, s.where("topic <> 'fr'").select("source_id", "content"))


@query("""SELECT 'doc-' || doc_id AS source_id, lang AS topic, count(k.seq) AS n, md5(coalesce(string_agg('- [definition] ' || claim || chr(10) || '  证据：' || quote, chr(10) ORDER BY k.seq), '')) AS body_md5
FROM documents LEFT JOIN kept k ON k.source_id = 'doc-' || doc_id WHERE lang <> 'fr' GROUP BY 1, 2""", ("kept",))
def inc1_rebuild(spark, d):
    """Pages built from all but German documents, some with other texts, then brought up to all but French ones."""
    s, root = fx.sources(spark, d), Wr.scratch(spark, "compiled")
    B.build(s.where("topic <> 'de'").withColumn("content", F.trim("content", F.lit("."))), root)
    B.rebuild(s.where("topic <> 'fr'"), root)
    return spark.read.parquet(f"{root}/pages").select("source_id", "topic", "n", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
