"""Tables of the engine's shapes derived from the driver's tables, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikispark.operators.atoms import extract_atoms, sequence_atoms
from wikispark.operators.notes import chunk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, source_id, content): every document as a note of its language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("topic"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("text").alias("content"))


def raw_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_atoms(extract_atoms(chunk(sources(spark, sf_dir).select("source_id", "content"))))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as sections, nations below them, suppliers as leaves."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    section = lambda c: F.concat(F.lit("section-"), F.regexp_replace(F.lower(c), " ", "-"))
    root = r.agg(F.min("r_regionkey")).select(F.lit("root-geo").alias("slug"), F.lit(None).cast("string").alias("parent_slug"), F.lit("root").alias("kind"), F.lit("Geo").alias("label"), F.lit(0).alias("ordinal"))
    regions = r.select(section(F.col("r_name")).alias("slug"), F.lit("root-geo").alias("parent_slug"), F.lit("intermediate").alias("kind"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("int").alias("ordinal"))
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("concept-n"), F.col("n_nationkey").cast("string")).alias("slug"), section(F.col("r_name")).alias("parent_slug"), F.lit("intermediate").alias("kind"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("int").alias("ordinal"))
    suppliers = s.select(F.concat(F.lit("concept-s"), F.col("s_suppkey").cast("string")).alias("slug"), F.concat(F.lit("concept-n"), F.col("s_nationkey").cast("string")).alias("parent_slug"), F.lit("leaf-cluster").alias("kind"), F.col("s_name").alias("label"), F.col("s_suppkey").cast("int").alias("ordinal"))
    return root.unionByName(regions).unionByName(nations).unionByName(suppliers)


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, title, body): supplier pages link to their nation, to another supplier, to the root and by a diagram; nation pages
    link to their even-numbered suppliers and to the root."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    count = s.agg(F.count("*").alias("n"))
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    body = F.concat(F.lit("# "), F.col("s_name"), F.lit("\n\nSee [[concept-n"), text(F.col("s_nationkey")), F.lit("]] and [[concept-s"), text((key * 7) % F.floor(6 * F.col("n") / 5)), F.lit("]].\n\n- up [[root-geo]]\n- **bold** and *soft*\n\nclick node-A \"concept-s"), text((key + 1) % F.col("n")), F.lit(".html\"\nclick B \"callback\"\n"))
    suppliers = s.join(F.broadcast(count)).select(F.concat(F.lit("concept-s"), text(key)).alias("slug"), F.col("s_name").alias("title"), body.alias("body"))
    own = s.where(key % 2 == 0).groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("- [[concept-s"), x.cast("string"), F.lit("]]"))), "\n").alias("items"))
    nations = n.join(own, F.col("n_nationkey") == F.col("k"), "left").select(F.concat(F.lit("concept-n"), text(F.col("n_nationkey"))).alias("slug"), F.col("n_name").alias("title"), F.concat(F.lit("## "), F.col("n_name"), F.lit("\n\n"), F.coalesce("items", F.lit("")), F.lit("\n\nUp: [[root-geo]]\n")).alias("body"))
    return suppliers.unionByName(nations)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registry pages; tags are the words of their names, parents the part with a tenth of the key."""
    p = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("part-"), c.cast("string"))
    key = F.col("p_partkey")
    parent = F.floor(key / 10).cast("long")
    return p.select(
        name(key).alias("slug"), key.alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("type"), F.col("p_type").alias("summary"), F.col("p_brand").alias("keywords"),
        F.split("p_name", " ").alias("tags"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("updated"),
        F.when(parent > 0, F.array(name(parent))).otherwise(F.array().cast("array<string>")).alias("parent_ids"), (F.col("p_size") / 50.0).alias("confidence"),
    )


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, line_no, text): each conversation as a compile log, a header and a bullet for each turn."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn") * 2
    head = c.select(F.col("conv_id").alias("doc"), turn.alias("line_no"), F.concat(F.lit("## ["), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("] "), F.col("role"), F.lit(" | conv-"), F.col("conv_id").cast("string")).alias("text"))
    item = c.select(F.col("conv_id").alias("doc"), (turn + 1).alias("line_no"), F.concat(F.lit("- n"), F.length("text").cast("string")).alias("text"))
    return head.unionByName(item)


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn") * 2
    head = c.select(F.col("conv_id").alias("doc"), turn.alias("line_no"), F.concat(F.lit("## ["), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("] 来自 conv-"), F.col("conv_id").cast("string")).alias("text"))
    mark = F.when(F.col("role") == "user", "- [ ] ").when(F.length("text") % 2 == 0, "- [x] ").otherwise("- ⚠️ ")
    item = c.select(F.col("conv_id").alias("doc"), (turn + 1).alias("line_no"), F.concat(mark, F.lit("n"), F.length("text").cast("string")).alias("text"))
    return head.unionByName(item)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, stage, name, chosen, rationale, known_limits, switch_conditions, ts): a log with repeats, from events."""
    e = table(spark, sf_dir, "events")
    stage = F.concat(F.lit("stage"), (F.col("user_id") % 7 + 1).cast("string"))
    return e.select(F.concat(F.lit("topic"), (F.col("user_id") % 5).cast("string")).alias("topic"), stage.alias("stage"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("chosen"), F.lit("because").alias("rationale"), F.array(F.col("event_type")).alias("known_limits"), F.array().cast("array<string>").alias("switch_conditions"), F.col("event_id").alias("ts"))


SQL = {
    "sources": "SELECT lang AS topic, 'doc-' || CAST(doc_id AS VARCHAR) AS source_id, text AS content FROM documents",
    "lines": "SELECT source_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM sources",
    "chunks": "SELECT source_id, CAST(s / 7800 AS INTEGER) AS chunk_no, s AS start, substr(content, CAST(s AS BIGINT) + 1, 8000) AS text FROM (SELECT source_id, content, CAST(unnest(range(0, length(content), 7800)) AS INTEGER) AS s FROM sources) WHERE trim(substr(content, CAST(s AS BIGINT) + 1, 8000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''",
    "pieces": "SELECT source_id, chunk_no, start, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS piece FROM (SELECT *, string_split(regexp_replace(text, '(\\. )', '\\1' || chr(10), 'g'), chr(10)) AS p FROM chunks)",
    "atoms": "SELECT source_id, seq, lower(regexp_replace(source_id, '[^a-zA-Z0-9]', '-', 'g')) || '-' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS atom_id, chunk_no, pos, substr(quote, 1, 120) AS claim, quote, at0, at0 + length(piece) AS at1, list_filter(string_split_regex(quote, '\\s+'), lambda w: w <> '') AS words FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_no, pos) AS seq FROM (SELECT *, trim(piece, ' ') AS quote, CAST(start + coalesce(sum(length(piece) + CASE WHEN piece LIKE '%. ' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, chunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at0 FROM pieces) WHERE quote <> '')",
    "kept": "SELECT * FROM atoms QUALIFY row_number() OVER (PARTITION BY source_id, substr(quote, 1, 80) ORDER BY seq) = 1",
    "tree": "SELECT 'root-geo' AS slug, CAST(NULL AS VARCHAR) AS parent_slug, 'root' AS kind, 'Geo' AS label, 0 AS ordinal UNION ALL SELECT 'section-' || replace(lower(r_name), ' ', '-'), 'root-geo', 'intermediate', r_name, CAST(r_regionkey AS INTEGER) FROM region UNION ALL SELECT 'concept-n' || n_nationkey, 'section-' || replace(lower(r_name), ' ', '-'), 'intermediate', n_name, CAST(n_nationkey AS INTEGER) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'concept-s' || s_suppkey, 'concept-n' || s_nationkey, 'leaf-cluster', s_name, CAST(s_suppkey AS INTEGER) FROM supplier",
    "walk": "SELECT slug, parent_slug, [ordinal] AS path, 0 AS depth, CAST([] AS VARCHAR[]) AS ancestors FROM tree WHERE parent_slug IS NULL UNION ALL SELECT t.slug, t.parent_slug, list_append(w.path, t.ordinal), w.depth + 1, list_append(w.ancestors, w.slug) FROM tree t JOIN walk w ON t.parent_slug = w.slug",
    "pre": "SELECT *, row_number() OVER (ORDER BY path) - 1 AS pre_no FROM walk",
    "wiki_pages": "SELECT 'concept-s' || s_suppkey AS slug, s_name AS title, '# ' || s_name || chr(10) || chr(10) || 'See [[concept-n' || s_nationkey || ']] and [[concept-s' || ((s_suppkey * 7) % (6 * (SELECT count(*) FROM supplier) // 5)) || ']].' || chr(10) || chr(10) || '- up [[root-geo]]' || chr(10) || '- **bold** and *soft*' || chr(10) || chr(10) || 'click node-A \"concept-s' || ((s_suppkey + 1) % (SELECT count(*) FROM supplier)) || '.html\"' || chr(10) || 'click B \"callback\"' || chr(10) AS body FROM supplier UNION ALL SELECT 'concept-n' || n_nationkey, n_name, '## ' || n_name || chr(10) || chr(10) || coalesce((SELECT string_agg('- [[concept-s' || s_suppkey || ']]', chr(10) ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 2 = 0), '') || chr(10) || chr(10) || 'Up: [[root-geo]]' || chr(10) FROM nation",
    "links": "SELECT slug AS source, 'wiki' AS type, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) AS target FROM wiki_pages UNION ALL SELECT slug, 'mermaid-click', regexp_replace(unnest(regexp_extract_all(body, 'click\\s+\\S+\\s+\"([^\"]+\\.html)\"', 1)), '\\.html$', '') FROM wiki_pages",
    "classified": "SELECT l.*, CASE WHEN l.source = l.target THEN 'E4' WHEN t.slug IS NULL THEN 'E1' END AS code FROM links l LEFT JOIN tree t ON l.target = t.slug",
    "registry": "SELECT 'part-' || p_partkey AS slug, p_partkey AS pos, p_name AS title, p_brand AS type, p_type AS summary, p_brand AS keywords, string_split(p_name, ' ') AS tags, CAST(date '2024-01-01' + CAST(p_size AS INTEGER) AS DATE) AS updated, CASE WHEN p_partkey // 10 > 0 THEN ['part-' || (p_partkey // 10)] ELSE [] END AS parent_ids, p_size / 50.0 AS confidence FROM part",
}
NEEDS = {"lines": ["sources"], "chunks": ["sources"], "pieces": ["chunks"], "atoms": ["pieces"], "kept": ["atoms"], "walk": ["tree"], "pre": ["walk"], "links": ["wiki_pages"], "classified": ["links", "tree"]}


def with_tables(names: list[str], query: str) -> str:
    """query with the named tables, and those they are made of, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + ("" if query.startswith(",") else "\n") + query
