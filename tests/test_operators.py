"""Hand rows for the edges of the knowledge engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from wikispark.functions import models as M
from wikispark.functions import text as X
from wikispark.operators import atoms as A
from wikispark.operators import graphs as G
from wikispark.operators import links as L
from wikispark.operators import notes as N
from wikispark.operators import pages as P
from wikispark.operators import rebuild as B
from wikispark.operators import registry as R
from wikispark.operators import search as Q
from wikispark.operators import tree as T
from wikispark.operators import vectors as C
from wikispark.sources import readers as S
from wikispark.sources import writers as Wr


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_formulas(spark):
    lines = ["αx", "a → b", "x2", "éa2", "$x2$ y", "H2O", "NaOH", "CH3COOH", "```x2", "    x2", "\tx2", "", "α x2"]
    src = spark.createDataFrame([("s", "\n".join(lines))], "source_id string, content string")
    found = {r.line_no: r for r in N.detect_formulas(src).collect()}
    assert {k: v.reason for k, v in found.items()} == {1: "math_symbol", 2: "math_symbol", 3: "bare_superscript", 4: "bare_superscript", 6: "chemical_formula", 8: "chemical_formula", 13: "math_symbol"}
    assert found[8].matches == ["CH3COOH"]
    assert found[4].reason == "bare_superscript"  # the letter before is no ASCII letter


def test_fixes_count_only_whole_batches(spark):
    src = spark.createDataFrame([("a", "x2\nb\ny3"), ("b", "x2\ny3")], "source_id string, content string")
    found = N.assign_batches(N.detect_formulas(src), 20, ["line_no"], ["source_id"])
    fixes = spark.createDataFrame([("a", 0, ["1. X2", "2. y3"]), ("b", 0, ["only one"])], "source_id string, batch_no int, returned array<string>")
    out = {r.source_id: r for r in N.apply_line_fixes(src, found, fixes).collect()}
    assert (out["a"].content, out["a"].fixed, out["b"].content, out["b"].fixed) == ("X2\nb\ny3", 1, "x2\ny3", 0)


def test_model_failures_keep_lines(spark):
    src = spark.createDataFrame([("a", "x2\ny3")], "source_id string, content string")
    found = N.assign_batches(N.detect_formulas(src), 20, ["line_no"], ["source_id"])

    def fail(lines):
        raise RuntimeError

    assert M.fix_lines(found, fail).first().returned == ["x2", "y3"]
    assert M.embed(spark.createDataFrame([("a",)], "t string"), "t", fail).first().embedding is None
    assert abs(sum(x * x for x in M.embed(spark.createDataFrame([("abc",)], "t string"), "t").first().embedding) - 1) < 1e-9


def test_outcomes_of_slow_failing_and_short_answers(spark):
    import time

    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(["ok", "slow", "fail", "short", None, ""])], "id int, t string, error string")

    def model(items):
        if items == ["slow"]:
            time.sleep(30)
        if items == ["fail"]:
            raise ValueError("x" * 500)
        return [] if items == ["short"] else [f"<{t}>" for t in items]

    began = time.time()
    got = {r.id: r for r in M.outcomes(rows, "t", model, "string", 1.0, batch=1, tries=2, suffix="_of_call").collect()}
    assert time.time() - began < 20
    assert [got[i].value_of_call for i in range(6)] == ["<ok>", None, None, None, "<None>", "<>"]
    assert [got[i].attempts_of_call for i in range(6)] == [1, 2, 2, 2, 1, 1]
    assert (got[0].error_of_call, got[1].error_of_call, got[3].error_of_call) == (None, "no answer within 1 s", "0 values for 1 items")
    assert got[2].error_of_call.startswith("ValueError: xxx") and len(got[2].error_of_call) == 200
    assert M.outcomes(rows.limit(0), "t", model, "string", 1.0).count() == 0
    with pytest.raises(Exception, match="0 values for 1 items"):
        M.outcomes(rows.where("t = 'short'"), "t", model, "string", 1.0, on_error="raise").collect()
    ctx = spark.createDataFrame([("a", "A", "- x", "ok"), ("b", None, None, "fail")], "slug string, label string, bullets string, prompt string")
    assert {tuple(r)[:2] for r in M.compose_pages(ctx, model).collect()} == {("a", "<ok>"), ("b", "## b\n\n")}
    assert {r.error for r in M.compose_pages(ctx).collect()} == {None}


def test_leaves_of_a_failing_model_group_in_sequence(spark):
    members = spark.createDataFrame([(f"cluster-{i:02d}", 0, f"a{i}") for i in range(13)], "label string, pos int, atom_id string")
    atoms = spark.createDataFrame([(f"a{i}", f"claim {i}", [f"tag{i}"]) for i in range(12)], "atom_id string, claim string, draft_tags array<string>")

    def model(labels):
        if "tag7" in labels:
            raise RuntimeError
        return [[1.0, 2.0]] * len(labels)

    leaves = T.embedded_leaves(members, atoms, model, batch=1)
    assert {tuple(r.embedding) for r in leaves.collect()} == {(0.0,)} and leaves.where("embedding_error IS NOT NULL").count() == 1
    assert {r.label for r in leaves.collect()} == {*(f"tag{i}" for i in range(12)), "cluster-12"}
    assert {len(r.embedding) for r in T.embedded_leaves(members, atoms).collect()} == {64}
    got = T.group_once(leaves.select(F.col("leaf_no").alias("id"), "embedding")).collect()
    groups = [{r.id for r in got if r.group_no == g} for g in sorted({r.group_no for r in got})]
    assert groups == [{0, 1, 12}, {2, 3, 4, 5}, {6, 7, 8, 9}, {10, 11}]


def test_groups_in_sequence_by_brute_force():
    for n in range(6, 80):
        for target, most in ((4, 5), (3, 7), (2, 2), (4, 6), (5, 9)):
            goal, groups = -(-n // target), [[i] for i in range(n)]
            while len(groups) > goal:
                pair = next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if len(groups[i]) + len(groups[j]) <= most), None)
                if pair is None:
                    break
                merged = groups[pair[0]] + groups[pair[1]]
                groups = [g for i, g in enumerate(groups) if i not in pair] + [merged]
            found = []
            for size, many, ranges in T.sequence_runs(n, goal, most):
                if many > 1:
                    found += [list(range(ranges[0][0] + i * size, ranges[0][0] + (i + 1) * size)) for i in range(many)]
                else:
                    found.append([x for start, length in ranges for x in range(start, start + length)])
            assert sorted(map(sorted, found)) == sorted(map(sorted, groups)), (n, target, most)


def test_chunks(spark):
    rows = [("a", ""), ("b", "x" * 8000), ("c", "x" * 8001), ("d", "x" * 7800), ("e", " \n\t"), ("f", "🙂" * 8001), ("g", None)]
    out = N.chunk(spark.createDataFrame(rows, "source_id string, content string")).collect()
    starts = {}
    for r in out:
        starts.setdefault(r.source_id, []).append((r.start, len(r.text)))
    assert starts == {"b": [(0, 8000), (7800, 200)], "c": [(0, 8000), (7800, 201)], "d": [(0, 7800)], "f": [(0, 8000), (7800, 201)]}


def test_atoms(spark):
    src = spark.createDataFrame([("s", "One two. Three\nfour. five")], "source_id string, content string")
    rows = A.sequence_atoms(A.extract_atoms(N.chunk(src))).orderBy("seq").collect()
    text = src.first().content
    assert [r.quote for r in rows] == ["One two.", "Three", "four.", "five"]
    assert [text[r.char_offset[0] : r.char_offset[1]].strip() for r in rows] == [r.quote for r in rows]
    same = "q" * 80
    raw = spark.createDataFrame([("s", 1, same + "a"), ("s", 2, same + "b"), ("s", 3, "q" * 79 + "x"), ("s", 4, ""), ("s", 5, ""), ("t", 1, same)], "source_id string, seq int, quote string")
    assert {(r.source_id, r.seq) for r in A.dedup_atoms(raw).collect()} == {("s", 1), ("s", 3), ("s", 4), ("t", 1)}
    assert one(spark, X.atom_id(F.lit("例子"), F.lit(999))) == "---999" and one(spark, X.pad3(F.lit(1000))) == "1000" and one(spark, X.pad3(F.lit(7))) == "007"
    assert one(spark, A.atom_errors(F.lit(None).cast("string"), F.lit("q"), F.array(F.lit(1)), F.lit("x"))) == ["missing claim", "bad char_offset", "invalid kind"]


def test_sentences_in_one_pass(spark):
    text = "é. 🙂 b b c.\n\n  . . x\u00a0y\u2003z \n" + "a\n" * 2000 + "end. "
    chunks = spark.createDataFrame([("s", 3, 7800, text), ("e", 0, 0, ""), ("n", 0, 0, None)], "source_id string, chunk_no int, start int, text string")
    found = A.extract_atoms(chunks)
    assert "aggregate(" not in found._jdf.queryExecution().toString()  # no sum over all pieces before each piece
    rows = found.orderBy("pos").collect()
    assert {r.source_id for r in rows} == {"s"} and len(rows) == 2006
    assert all(text[r.char_offset[0] - 7800 : r.char_offset[1] - 7800].strip(" ") == r.quote for r in rows)
    assert [(r.quote, r.draft_tags) for r in rows[:5]] == [("é.", ["é."]), ("🙂 b b c.", ["🙂", "b"]), (".", ["."]), (".", ["."]), ("x\u00a0y\u2003z", ["x\u00a0y\u2003z"])]
    assert (rows[-1].quote, rows[-1].char_offset) == ("end.", [7800 + len(text) - 5, 7800 + len(text)])


def test_slugs(spark):
    assert one(spark, X.slugify(F.lit("c"), F.lit("!!!"), F.lit(5))) == "c-5"
    assert one(spark, X.slugify(F.lit("c"), F.lit("a" * 39 + " b"), F.lit(0))) == "c-" + "a" * 39 + "-"
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a")], "alloc_no int, base string")
    out = [r.slug for r in T.unique_slugs(rows).orderBy("alloc_no").collect()]
    assert out == ["a", "a-2", "a-2-2", "a-3"]
    for seed in range(4):  # the same as taking slugs one by one
        rng = random.Random(seed)
        bases = [rng.choice(["a", "a-2", "a-2-2", "a-3", "b"]) for _ in range(25)]
        held, want = {"a-4", "b"}, []
        for b in bases:
            n, slug = 1, b
            while slug in held:
                n += 1
                slug = f"{b}-{n}"
            held.add(slug)
            want.append(slug)
        rows = spark.createDataFrame(list(enumerate(bases)), "alloc_no int, base string").repartition(3)
        out = T.unique_slugs(rows, taken=spark.createDataFrame([("a-4",), ("b",), ("b",)], "slug string")).orderBy("alloc_no").collect()
        assert [r.slug for r in out] == want and rows.columns + ["slug"] == T.unique_slugs(rows).columns


def test_tops_of_cycles(spark):
    parents = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("x", "y"), ("y", "gone"), ("s", "s"), ("n", None)] + [(f"q{i}", f"q{i + 1}") for i in range(70)]
    got = {r.slug: r.top for r in G.top_ancestors(spark.createDataFrame(parents, "slug string, parent string")).collect()}
    assert got == {x: "a" for x in "abcde"} | {"x": "gone", "y": "gone", "s": "s"} | {f"q{i}": "q70" for i in range(70)}


def test_first_pages_of_a_frequent_value_are_found_in_shards(spark):
    rows = spark.range(500).select(F.format_string("p%d", "id").alias("slug"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("key"), (499 - F.col("id")).alias("pos"))
    found = R._first(rows, ["key"], 3)
    assert {(r.key, r.pos) for r in found.collect()} == {("hot", 0), ("hot", 1), ("hot", 2), ("rare", 49), ("rare", 99), ("rare", 149)}
    pages = spark.range(400).select(F.format_string("p%d", "id").alias("slug"), F.lit("x").alias("type"), F.array(F.lit("a"), F.lit("b"), F.format_string("c%d", F.col("id") % 2)).alias("tags"), F.col("id").alias("pos"))
    got = {r.slug: r.n for r in R.related_pages(pages).groupBy("slug").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 400 and set(got.values()) == {5}


def test_related_pages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):  # one tag that all share, sets that are all distinct, tags twice, many tags, none
        tags = ["hot"] + rng.sample([f"t{k}" for k in range(12)], rng.randrange(4)) + [f"own{i}"]
        tags = tags + ["hot", "t1"] if i % 40 == 7 else tags + [f"m{k}" for k in range(9)] if i % 60 == 9 else [] if i % 11 == 3 else [f"own{i}"] if i % 13 == 4 else tags
        rows.append((f"p{i}", rng.choice("xyz"), tags if i % 23 else None, i))
    got = {}
    for r in R.related_pages(spark.createDataFrame(rows, "slug string, type string, tags array<string>, pos int")).orderBy("slug", "rank").collect():
        got.setdefault(r.slug, []).append((r.related_slug, r.score))
    for slug, kind, tags, _ in rows:
        scored = [(-float(sum(t in (tags or []) for t in (other or []))) or -0.1 * (k == kind), pos, s) for s, k, other, pos in rows if s != slug]
        assert got.get(slug, []) == [(s, -x) for x, _, s in sorted(scored)[:5] if x], slug
    plan = R.related_pages(spark.createDataFrame(rows, "slug string, type string, tags array<string>, pos int"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_heading_ids(spark):
    html = '<h2>A</h2><p id="section-2">x</p><h3 id="own">B</h3><h2 class="c">C <b>d</b></h2><h1>no</h1><h2 id="section-3">E</h2><h2 id="">F</h2>'
    got = P.headings(spark.createDataFrame([(1, html), (2, None)], "page int, html string")).orderBy("pos").collect()
    assert [(r.level, r.id, r.text) for r in got] == [(2, "section-1", "A"), (3, "own", "B"), (2, "section-4", "C d"), (2, "section-3", "E"), (2, "section-5", "F")]


def test_group_labels_of_a_model(spark):
    def model(batches):
        for b in batches:
            yield b.assign(label=["good" if n == 0 else "" if n == 1 else "x" * 21 for n in b["group_no"]])[["group_no", "label"]]

    groups = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b", "c"]), (2, ["a"])], "group_no int, labels array<string>")
    assert [r.label for r in T.summarise(groups, model).orderBy("group_no").collect()] == ["good", "a、b 等", "a"]


def test_tree_json_with_atoms(spark):
    import json

    tree = spark.createDataFrame([("r", None, "root", "R", 0), ("x", "r", "leaf-cluster", 'X"', 0)], T.TREE)
    atoms = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a")], "slug string, pos int, atom_id string")
    leaf = {"page_slug": "x", "kind": "leaf-cluster", "label": 'X"', "atoms": ["a", "b"], "children": []}
    assert json.loads(T.tree_to_json(tree, atoms).first().json) == {"page_slug": "r", "kind": "root", "label": "R", "atoms": [], "children": [leaf]}


def test_decisions_with_an_audit(spark):
    d = spark.createDataFrame([("t", "stage1", "n", "c", None, ["l"], [], 1)], "topic string, stage string, name string, chosen string, rationale string, known_limits array<string>, switch_conditions array<string>, pos int")
    audit = spark.createDataFrame([("t", "P1", 0), ("t", "P0", 3), ("u", "P0", 1)], "topic string, key string, value long")
    got = {r.topic: r.text for r in P.decision_text(d, audit).collect()}
    assert got["t"].endswith("- l\n\n### 编译审计\n\n- P0：3\n- P1：0\n\n") and got["u"] == "### 编译审计\n\n- P0：1\n\n"


def test_frontmatter(spark):
    rows = spark.createDataFrame([(1, '---\ntitle: "a: b"\nk: 1\nk: 2\n---\nbody\n'), (2, "no head"), (3, "---\n---\nx")], "page int, text string")
    out = {r.page: r for r in S.parse_frontmatter(rows).collect()}
    assert out[1].fields == {"title": "a: b", "k": "2"} and out[1].body == "body\n" and out[2].fields == {} and out[2].body == "no head"
    text = "---\nid: x\n title: 't'\n tags:\n   - \"a\"\n   - b\n empty:\n---\n# body"
    got = S.parse_page_registry(spark.createDataFrame([(1, text)], "page int, text string")).first()
    assert got.fields == {"id": "x", "title": "t"} and got.lists == {"tags": ["a", "b"]}


def test_logs(spark):
    log = ["# Log", "## [t1] compile | s1", "created:", "- a", "- b", "## [t2] compile | s2"]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(log)], "doc string, line_no int, text string")
    assert [(r.ts, r.source, r.created) for r in S.parse_compile_log(rows).orderBy("line_no").collect()] == [("t1", "s1", ["a", "b"]), ("t2", "s2", [])]
    notes = ["## [t1] 来自 s1", "- [ ] q", "- [x] done", "- ⚠️ c", "## [t2] 来自 s2"]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(notes)], "doc string, line_no int, text string")
    got = S.parse_journal(rows).orderBy("line_no").collect()
    assert [(r.kind, r.done, r.item) for r in got] == [("question", False, "q"), ("question", True, "done"), ("contradiction", False, "c")]
    assert [(r.kind, r.cnt) for r in R.open_items(S.parse_journal(rows)).orderBy("kind").collect()] == [("contradiction", 1), ("question", 1)]


def test_similar_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, [1.0] * 8), (62, [2.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.6}
    got = {(r.atom_a, r.atom_b) for r in C.near_duplicates(df, 0.6, block=16).collect()}
    assert got == want and (61, 62) in got
    assert C.near_duplicates(df.limit(0), 0.6).count() == C.near_duplicates(df.limit(1), 0.6).count() == 0
    assert {(r.atom_a, r.atom_b) for r in C.near_duplicates(df, -2.0, block=8).collect()} == {(i, j) for i in range(63) for j in range(i + 1, 63)}
    named = df.withColumn("id", F.format_string("v%02d", "id"))
    assert {(r.atom_a, r.atom_b) for r in C.near_duplicates(named, 0.6, block=8).collect()} == {(f"v{i:02}", f"v{j:02}") for i, j in want}


def test_pruned_pairs_are_complete(spark):
    import numpy as np

    rng = np.random.default_rng(21)
    centres = rng.normal(0, 1, (12, 64))
    base = np.concatenate([c + rng.normal(0, 0.12, (40, 64)) for c in centres])  # twelve narrow clusters
    rows = np.concatenate([base, base[:60] + rng.normal(0, 0.02, (60, 64)), rng.normal(0, 1, (100, 64))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "id long, embedding array<double>")
    sims = unit @ unit.T
    for threshold in (0.35, 0.92, 0.99):
        want = {(i, j) for i, j in np.argwhere(sims >= threshold).tolist() if i < j}
        got = {(r.atom_a, r.atom_b) for r in C.near_duplicates(df, threshold, block=20).collect()}
        assert got == want and len(want) > 50
    formed, every = C.pairs_formed(df, 0.99, 20)
    assert every == 640 * 639 // 2 and formed < every / 3


def test_vectors_are_dealt_once(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(C, "TRAVEL_BYTES", 8 * 4 * 20)  # tiles of 20 vectors
    rows = np.random.default_rng(4).normal(0, 1, (300, 4))
    rows[:90] = rows[0]  # a block of several tiles
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id long, embedding array<double>")
    units = C.unit_rows(df, 0.9)
    cells = C.Cells(units, 0.9, 16)
    assert cells.sides.max() > 1 and len(cells.starts) > 3 and C.dealt(units, cells).count().agg(F.sum("count")).first()[0] == 300
    want = {(i, j) for i, j in np.argwhere(unit @ unit.T >= 0.9).tolist() if i < j}
    got = [(r.atom_a, r.atom_b) for r in C.near_duplicates(df, 0.9, block=16).collect()]
    assert len(got) == len(want) and set(got) == want


def test_density_of_a_table_with_renamed_ids(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, i % 2 * 1.0]) for i in range(8)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/v.parquet")
    vecs = spark.read.parquet(f"{tmp_path}/v.parquet").select(F.col("vec_id").alias("id"), "embedding")
    assert sorted(map(tuple, C.density_labels(vecs, 0.99).collect())) == [(i, i % 2) for i in range(8)]


def test_letter_profiles_group_equal_texts(spark, tmp_path):
    from wikispark.plans import queries as Q

    rows = [(5, "abc"), (3, "abc"), (9, "cab"), (7, None), (8, ""), (1, "zz"), (2, "ABC")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in Q.joi2_letter_profiles(spark, str(tmp_path)).collect()] == [(3, 9, 1.0)]


def test_small_cells_travel_in_few_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = rng.normal(0, 1, (600, 16))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id long, embedding array<double>")
    units = C.unit_rows(df, 0.5)
    cells = C.Cells(units, 0.5, 4)
    copies = C.dealt(units, cells).count().agg(F.sum("count")).first()[0]
    assert (cells.members > 0).sum() > 100 and copies <= 600 * 14  # next to nothing is ruled out, yet no vector goes to each cell
    near = unit @ unit.T >= 0.5
    assert {(r.atom_a, r.atom_b) for r in C.near_duplicates(df, 0.5, block=4).collect()} == {(i, j) for i, j in np.argwhere(near).tolist() if i < j}
    core = near.sum(axis=1) >= 3
    want = np.full(600, -1)
    parts = np.arange(600)
    while (new := np.where(core, np.where(near & core[None, :], parts[None, :], 600).min(axis=1), parts)).tolist() != parts.tolist():
        parts = new
    for i in range(600):
        kin = np.flatnonzero(near[i] & core)
        want[i] = parts[i] if core[i] else parts[kin.min()] if len(kin) else -1
    got = {r.id: r.label for r in C.density_labels(df, 0.5).collect()}
    names = {w: got[i] for i, w in enumerate(want.tolist())}
    assert [got[i] for i in range(600)] == [names[w] for w in want.tolist()] and len(set(names.values())) == len(names) and names.get(-1, -1) == -1


def test_cluster_names(spark):
    def names(labels):
        rows = [(i, i, x) for i, x in enumerate(labels)]
        return sorted((r.label, r.pos) for r in C.finalize_clusters(spark.createDataFrame(rows, "atom_id int, pos int, label int")).collect())

    assert {x for x, _ in names([0, 1])} == {"single-cluster"} and {x for x, _ in names([-1] * 4)} == {"all"}
    assert {x for x, _ in names([0] * 7 + [-1] * 9)} == {"cluster-0", "noise"} and {x for x, _ in names([0] * 15)} == {"cluster-0-0", "cluster-0-1", "cluster-0-2"}


def _greedy(vectors, target, max_size, all_mutual):
    """Groups by merging the closest pair that fits, or all pairs that are each other's best at once."""
    import numpy as np

    groups = {i: [i] for i in range(len(vectors))}
    goal = -(-len(vectors) // target)
    while len(groups) > goal:
        ids = sorted(groups)
        mean = np.array([vectors[groups[g]].sum(axis=0) for g in ids])
        mean /= np.linalg.norm(mean, axis=1, keepdims=True)
        s = np.round(mean @ mean.T, 12)
        size = np.array([len(groups[g]) for g in ids])
        s[(size[:, None] + size[None, :] > max_size) | np.eye(len(ids), dtype=bool)] = -np.inf
        best = s.argmax(axis=1)
        pairs = sorted((-s[i, j], ids[i], ids[j]) for i, j in enumerate(best) if s[i, j] > -np.inf and i < j and best[j] == i)
        if not pairs:
            break
        for _, a, b in pairs[: len(groups) - goal] if all_mutual else pairs[:1]:
            groups[a] += groups.pop(b)
    return sorted(map(sorted, groups.values()))


def test_groups_of_kept_partner_lists(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    clusters = np.repeat(rng.normal(0, 1, (6, 8)), 4, axis=0) + rng.normal(0, 0.02, (24, 8))
    for vectors, keep, block in ((np.round(rng.normal(0, 1, (40, 2)), 1), 2, 15), (clusters, 8, 2048)):
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        df = spark.createDataFrame(list(enumerate(vectors.tolist())), "id long, embedding array<double>")
        got = {}
        for r in T.group_once(df, 4, 5, keep, block).collect():
            got.setdefault(r.group_no, []).append(r.id)
        assert sorted(map(sorted, got.values())) == _greedy(vectors, 4, 5, True)
        assert max(map(len, got.values())) <= 5
    assert sorted(map(sorted, got.values())) == _greedy(clusters, 4, 5, False)  # the same as one pair after another where clusters are told apart


def test_strongest_pairs(spark):
    rng = random.Random(2)
    rows = [(i, i + 1, round(rng.uniform(-1, 1), 2)) for i in range(300)] + [(900, 901, 1.0), (902, 903, -1.0)]
    df = spark.createDataFrame(rows, "x long, y long, s double")
    for most in (0, 1, 77, 302, 400):
        assert sorted(map(tuple, T.strongest(df, most, 16).collect())) == sorted(sorted(rows, key=lambda r: (-r[2], r[0]))[:most])


def test_tree_building(spark):
    rng = random.Random(5)
    rows = [(f"concept-{i:03d}", f"l{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(37)]
    df = spark.createDataFrame(rows, "slug string, label string, embedding array<double>")
    tree = T.build_tree(df, "t")
    got = tree.collect()
    assert len({r.slug for r in got}) == len(got) and sum(r.kind == "leaf-cluster" for r in got) == 37
    kids = {}
    for r in got:
        kids.setdefault(r.parent_slug, []).append(r.slug)
    assert max(len(v) for v in kids.values()) <= 5 and T.levels(tree).count() == len(got)
    assert sorted(map(tuple, T.build_tree(df.repartition(3), "t").collect())) == sorted(map(tuple, got))
    assert [r.kind for r in T.build_tree(df.limit(0), "t").collect()] == ["root"]


def test_size_guesses_do_not_grow_with_rounds(spark, monkeypatch):
    def bits(df):
        guess = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return guess.bit_length() if isinstance(guess, int) else guess.bitLength()

    found, partners = [], T._partners

    def watched(units, *rest):
        found.append(bits(units))
        assert found[-1] <= 200  # with checkpoints only, five times more each round
        return partners(units, *rest)

    monkeypatch.setattr(T, "_partners", watched)
    nodes = spark.range(24).select("id", F.array(F.cos("id"), F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding"))
    assert T.group_once(nodes).count() == 24 and len(found) >= 3


def test_cycles(spark):
    def cycle(edges):
        return {(r.a, r.b) for r in G.cycle_edges(spark.createDataFrame(edges, "a string, b string")).collect()}

    assert cycle([("a", "b"), ("b", "a")]) == {("a", "b"), ("b", "a")} and cycle([("a", "a"), ("a", "b")]) == {("a", "a")}
    assert cycle([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]) == {("a", "b"), ("b", "c"), ("c", "a")}
    assert cycle([("a", "b"), ("b", "c"), ("a", "c")]) == set()
    rng = random.Random(7)
    edges = sorted({(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(26)})
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    assert cycle(edges) == {(a, b) for a, b in edges if (b, a) in reach}


def test_long_rings_and_paths_take_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    settle = G.settle
    monkeypatch.setattr(G, "settle", lambda df: rounds.append(1) or settle(df))
    n = 5000
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    assert G.cycle_edges(ring).count() == n and len(rounds) <= 25
    rounds.clear()
    short = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))  # a path, two rings that share a run, a loop, a tail
    more = spark.createDataFrame([(200, 100), (250, 250), (150, 0)], "a long, b long")
    got = {(r.a, r.b) for r in G.cycle_edges(short.unionByName(more)).collect()}
    assert got == {(i, i + 1) for i in range(200)} | {(200, 100), (150, 0), (250, 250)} and len(rounds) <= 60


def test_audit(spark):
    tree = spark.createDataFrame([("r", None, "root", "R", 0), ("x", "r", "leaf-cluster", "X", 0), ("y", "r", "leaf-cluster", "Y", 1)], T.TREE)
    pages = spark.createDataFrame([("r", "[[x]] [[r]]"), ("x", "é[[r]] [[nope]] [[y|Y]]\nclick node-1 \"y.html\" click B \"cb\"")], "slug string, body string")
    got = L.link_audit(pages, tree)
    assert {tuple(r) for r in got["errors"].collect()} == {("E4", "r", "r"), ("E1", "x", "nope"), ("E1", "x", "y|Y"), ("E2", "r", "x"), ("E2", "x", "r")}
    assert got["totals"].first().total_links == 6 and got["warnings"].count() == 0
    assert {(r.target, r.offset) for r in L.all_links(pages, alias=True).where("source = 'x'").collect()} == {("r", 1), ("nope", 7), ("y", 16), ("y", 24)}


def test_html(spark):
    md = "# T\n\nA **b** *c* `d`\n\n- one\n- two\n\n> q\n\n---\n\n[[x]]"
    html = "<h1>T</h1><p>A <strong>b</strong> <em>c</em> <code>d</code></p><ul><li>one</li>\n<li>two</li>\n</ul>\n<blockquote>q</blockquote><hr><p><a href=\"x.html\">x</a></p>"
    assert one(spark, P.markdown_to_html(F.lit(md))) == html
    assert "<ul><li>one</li>\n<li>two</li>" in one(spark, P.markdown_to_html(F.lit(md)))
    assert '<a href="#x">x</a>' in one(spark, P.markdown_to_html(F.lit(md), "anchor")) and "<hr>" not in one(spark, P.markdown_to_html(F.lit(md), "anchor"))


def test_language(spark):
    cases = {"": "markdown", "#!/bin/bash\nls": "bash", '{"a": 1}': "json", '{"a": 1,}x': "json", "def f():": "python", "export interface X {": "typescript", "let x = require('y')": "javascript", "# Title": "markdown"}
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.x for r in rows.select("c", X.guess_language(F.col("c")).alias("x")).collect()} == cases


def test_search(spark, tmp_path):
    index = spark.createDataFrame([("a", "Radar Wave", None, "x"), ("b", "Wave", "radar", ""), ("c", "Other", "", ""), ("d", None, None, None)], "slug string, title string, summary string, keywords string")
    asked = spark.createDataFrame([(1, " RADAR  wave "), (2, ""), (3, "wa x"), (4, "zzz"), (5, "wave radar"), (6, "é"), (7, "O"), (8, None), (9, "er h")], "query_id int, query string")
    want = {(1, "a"), (1, "b"), (3, "a"), (5, "a"), (5, "b"), (7, "c"), (9, "c")}
    assert {(r.query_id, r.slug) for r in Q.search(asked, index).collect()} == want
    Q.write_index(index, f"file://{tmp_path}/index")
    found = Q.search(asked, Q.read_index(spark, f"file://{tmp_path}/index"))
    assert {(r.query_id, r.slug) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_search_with_runs_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    rng = random.Random(1)
    texts = {f"p{i}": " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(6)) for i in range(60)}
    index = spark.createDataFrame([(k, v, None, None) for k, v in texts.items()], "slug string, title string, summary string, keywords string")
    asked = ["a", "ab", "abc", "ca bb", "abcab", "c a b", "bbb aa", "cabc ba"]
    got = {(r.query_id, r.slug) for r in Q.search(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), index).collect()}
    assert got == {(i, k) for i, q in enumerate(asked) for k, v in texts.items() if all(t in v + "  " for t in q.split())}


def test_runs_of_a_shard_are_rows_with_lists(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé漢𝄞 \n\0") for _ in range(rng.randrange(40))) for _ in range(50)] + ["", "a", "ab", "abc", "".join(map(chr, range(200, 900)))]
    want = {}
    for i, t in enumerate(texts):
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                want.setdefault(t[k : k + n], set()).add(i)
    runs, starts, pages = Q.shard_runs(texts)  # with 700 letters, too many runs of three for dense numbers
    assert {r: set(pages[a:b].tolist()) for r, a, b in zip(runs, starts[:-1], starts[1:], strict=True)} == want and len(runs) == len(want) and len(pages) == sum(map(len, want.values()))
    assert Q.shard_runs([])[0] == Q.shard_runs(["", ""])[0] == []
    monkeypatch.setattr(Q, "BLOCK", 20)
    rows = spark.createDataFrame([(i, "x y") for i in range(100)], "slug int, haystack string").coalesce(1)
    found = Q.postings_of(rows).collect()
    assert len(found) == 6 * 5 and {len(r.slugs) for r in found} == {20}  # not a row for each page and run: 600
    asked = Q.postings_of(rows, spark.createDataFrame([("x ",), ("zz",)], "gram string")).collect()
    assert {r.gram for r in asked} == {"x "} and sorted(s for r in asked for s in r.slugs) == list(range(100))


def test_link_graph_radius(spark):
    rows = spark.createDataFrame([(f"p{i}", "concept") for i in range(8)] + [("s", "source")], "slug string, type string")
    links = spark.createDataFrame([("p0", f"p{i}") for i in range(1, 8)] + [("p1", "p0"), ("p0", "s"), ("p2", "p2")], "source string, target string")
    nodes, edges = R.link_graph(links, rows)
    assert edges.count() == 7 and {(r.slug, r.lc, r.r) for r in nodes.where("slug in ('p0', 'p1')").collect()} == {("p0", 7, 4), ("p1", 1, 2)} and nodes.count() == 8


def test_stages_and_publishing(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "topic string, x string")
    assert spark.read.parquet(Wr.write_stage(rows, str(tmp_path), "atoms")).count() == 3
    out = str(tmp_path / "published")
    Wr.publish_topic(rows, out)
    assert Wr.publish_topic(rows.where("x = 'a'"), out).first().rows == 1
    assert {tuple(r) for r in spark.read.parquet(out).select("topic", "x").collect()} == {("t", "a"), ("u", "c")}
    Wr.write_pages(spark.createDataFrame([("s", "# Page")], "slug string, markdown string"), str(tmp_path / "pages"))
    assert spark.read.text(str(tmp_path / "pages")).count() == 1
    notes = tmp_path / "notes"
    notes.mkdir()
    for name in ("a.b.md", "c.txt", "d.html"):
        (notes / name).write_text("text " + name)
    assert {(r.source_id, r.content) for r in S.read_sources(spark, str(notes)).collect()} == {("a.b", "text a.b.md"), ("c", "text c.txt")}
    (notes / "x.json").write_text('[{"id": "1", "claim": "c"}]')
    (notes / "y.json").write_text('{"atoms": [{"id": "2", "claim": "d", "evidence": {"quote": "q", "char_offset": [1, 2]}}]}')
    assert [(r.file, r.pos, r.id) for r in S.read_atoms(spark, str(notes)).orderBy("file").collect()] == [("x.json", 0, "1"), ("y.json", 0, "2")]


def test_streams_of_notes(spark, tmp_path):
    from wikispark.streaming import notes as Stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "n.md").write_text("One. Two")
    (folder / "o.txt").write_text("Three")
    (folder / "p.rst").write_text("Four")
    query = Stream.stream_atoms(Stream.stream_sources(spark, str(folder))).writeStream.format("memory").queryName("atoms").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.quote for r in spark.table("atoms").collect()} == {"One.", "Two", "Three"}


def test_html_of_all_documents(spark, tmp_path):
    from wikispark.plans.queries import page4_html

    texts = ["a `b` c", "> quote", "# t\r\n\r\nx", "plain", None]
    html = ["<p>a <code>b</code> c</p>", "<blockquote>quote</blockquote>", "<h1>t</h1><p>x</p>", "<p>plain</p>", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.chars for r in page4_html(spark, str(tmp_path)).collect()} == {i: len(h) for i, h in enumerate(html)}


TREE_ROWS = "slug string, parent_slug string, ordinal int"


def test_orders_of_random_trees(spark):
    rng = random.Random(11)
    rows = [("r", None, 0), ("alone", None, 1)]
    for i in range(150):
        rows.append((f"n{i}", rng.choice(rows)[0] if i % 3 else rows[-1][0], rng.randrange(40)))
    kids = {}
    for slug, parent, ordinal in rows:
        kids.setdefault(parent, []).append((ordinal, slug))
    want, post = {}, {}

    def walk(slug, depth, path, above, at, left):
        start = at[0]
        at[0] += 1
        for ordinal, kid in sorted(kids.get(slug, [])):
            walk(kid, depth + 1, [*path, ordinal], [*above, slug], at, left)
        want[slug] = (start, depth, path, above, at[0] - start)
        post[slug] = left[0]
        left[0] += 1

    for ordinal, root in kids[None]:
        walk(root, 0, [ordinal], [], [0], [0])
    tree = spark.createDataFrame(rows, TREE_ROWS).repartition(3)
    assert {r.slug: (r.pre_no, r.depth, r.path, r.ancestors, r.size) for r in T.preorder(tree).collect()} == want
    assert {r.slug: r.post_no for r in T.postorder(tree).collect()} == post
    assert T.tree_stats(tree).first() == (152, max(v[1] for v in want.values()) + 1)
    links = [(a, b) for a in ("r", "n3", "n77", "n149", "gone") for b in [*list(want)[::7], a, "gone"]]
    parent = {slug: p for slug, p, _ in rows}

    def allowed(a, b):
        return a in want and b in want and (b in want[a][3] or parent[b] == a or a != b and parent[a] is not None and parent[a] == parent[b])

    out = L.links_outside(spark.createDataFrame(links, "source string, target string"), tree).collect()
    assert sorted(map(tuple, out)) == sorted((a, b) for a, b in links if not allowed(a, b))


def test_orders_of_a_deep_chain_and_a_wide_family(spark, monkeypatch):
    rounds = []
    settle = T.settle
    monkeypatch.setattr(T, "settle", lambda df: rounds.append(1) or settle(df))
    chain = spark.range(10000).select(F.format_string("n%05d", "id").alias("slug"), F.when(F.col("id") > 0, F.format_string("n%05d", F.col("id") - 1)).alias("parent_slug"), F.lit(0).alias("ordinal"))
    got = T.orders(chain).agg(F.max("depth"), F.sum("pre_no"), F.max("size"), F.count("*")).first()
    assert tuple(got) == (9999, 9999 * 5000, 10000, 10000) and len(rounds) <= 15 + 2  # two settle the rows before
    wide = chain.select("slug", F.when(F.col("slug") != "n00000", "n00000").alias("parent_slug"), F.lit(1).alias("ordinal"))
    links = chain.where("parent_slug > 'n00000'").select(F.col("slug").alias("source"), F.col("parent_slug").alias("target"))
    assert L.links_outside(links, wide).count() == 0 and T.orders(wide).where("depth = 1 AND slug = concat('n', lpad(string(pre_no), 5, '0'))").count() == 9999


def test_rows_that_no_root_reaches(spark):
    import pytest

    rows = [("r", None, 0), ("a", "r", 0), ("x", "missing", 0), ("y", "x", 0), ("p", "q", 0), ("q", "p", 0)]
    for fn in (T.orders, T.lineage, T.preorder, T.postorder, T.tree_stats):
        with pytest.raises(ValueError, match="missing parent: x, y; in or below a cycle of parents: p, q"):
            fn(spark.createDataFrame(rows, TREE_ROWS))
    with pytest.raises(ValueError, match="several rows"):
        T.orders(spark.createDataFrame([*rows[:2], ("a", "a", 1)], TREE_ROWS))
    assert T.orders(spark.createDataFrame([], TREE_ROWS)).count() == T.lineage(spark.createDataFrame([], TREE_ROWS)).count() == 0


def test_levels_deeper_than_64(spark):
    import pytest

    chain = [(f"n{i}", f"n{i - 1}" if i else None, 0) for i in range(67)]
    schema = "slug string, parent_slug string, ordinal int"
    deepest = T.levels(spark.createDataFrame(chain, schema)).where("slug = 'n66'").first()
    assert deepest.depth == 66 and deepest.ancestors == [f"n{i}" for i in range(66)]
    with pytest.raises(ValueError):
        T.levels(spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("b", "b", 1)], schema))


def test_rebuild_equals_a_full_build(spark, tmp_path):
    notes = {f"n{i}": ("t%d" % (i % 3), f"First {i}. Second {i}\nThird. First {i}.") for i in range(40)} | {"empty": ("t0", ""), "null": (None, None)}
    frame = lambda own: spark.createDataFrame([(k, *v) for k, v in own.items()], "source_id string, topic string, content string")
    read = lambda root: {n: sorted(map(str, spark.read.parquet(f"{root}/{n}").collect())) for n in ("sources", "atoms", "pages", "topics")}
    files = lambda root: {p: p.stat().st_mtime_ns for p in (tmp_path / root / "atoms").rglob("*.parquet")}
    root, full = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    B.build(frame(notes), root, 16)
    before = files("a")
    assert {r.action: r.sources for r in B.rebuild(frame(notes), root, 16).collect()} == {"left alone": 42} and files("a") == before
    changed = {k: v for k, v in notes.items() if k != "n7"} | {"n3": ("t0", "Other. Text"), "n4": ("t9", notes["n4"][1]), "new": ("t5", "A. B")}
    report = {r.action: (r.sources, r.atoms) for r in B.rebuild(frame(changed), root, 16).collect()}
    assert report["changed"] == (2, 5) and report["new"] == (1, 2) and report["deleted"] == (1, 3)
    assert report["copied"][0] + report["left alone"][0] == 39 and report["left alone"][0] > 20
    B.build(frame(changed), full, 16)
    assert read(root) == read(full)
    after = files("a")
    assert sum(before.get(p) == t for p, t in after.items()) >= 8  # parts that nothing touched keep their files
    stale = spark.read.parquet(f"{root}/sources").withColumn("sha", F.when(F.col("source_id") == "n3", "").otherwise(F.col("sha"))).collect()  # as if cut off before the hashes
    B._write(spark.createDataFrame(stale, "source_id string, topic string, sha string, part int"), root, "sources")
    B.rebuild(frame(changed), root, 16)
    assert read(root) == read(full)
    few = {k: v for k, v in changed.items() if k == "n3"}
    B.rebuild(frame(few), root, 16)
    assert [r.source_id for r in spark.read.parquet(f"{root}/pages").collect()] == ["n3"] and [r.pages for r in spark.read.parquet(f"{root}/topics").collect()] == [1]


def test_rebuild_deals_atoms_once(spark, capsys):
    sources = spark.createDataFrame([("a", "t", "One. Two\nOne. x"), ("b", None, None), ("c", "t", "")], "source_id string, topic string, content string")
    atoms = B.compiled_atoms(sources)
    atoms.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    pages = B.compiled_pages(sources, G.settle(atoms))
    pages.explain()
    assert capsys.readouterr().out.count("Exchange") == 1  # of atoms and sources together; before, joins and groups dealt atoms again
    quoted = lambda *said: "\n".join(f"- [definition] {x}\n  证据：{x}" for x in said)
    assert sorted(tuple(r)[:4] for r in pages.collect()) == [("a", "t", 3, quoted("One.", "Two", "x")), ("b", None, 0, ""), ("c", "t", 0, "")]


def test_outline_of_three_levels(spark):
    rows = [("a", ["top"]), ("b", ["a"]), ("c", ["b"]), ("d", ["top"]), ("lone", []), ("none", None), ("x", ["y"]), ("y", ["x"]), ("b", ["a"])]
    out = [tuple(r) for r in R.outline(spark.createDataFrame(rows, "slug string, parent_ids array<string>")).select("pos", "level", "domain", "section", "slug", "cnt").orderBy("pos").collect()]
    assert out == [
        (0, 1, "top", None, None, 4), (1, 2, "top", "a", None, 3), (2, 3, "top", "a", "b", 1), (3, 3, "top", "a", "c", 1), (4, 2, "top", "d", None, 1),
        (5, 1, "x", None, None, 2), (6, 2, "x", "y", None, 2), (7, 3, "x", "y", "x", 1),  # x lies below y, which hangs on x
    ]
    assert R.outline(spark.createDataFrame([], "slug string, parent_ids array<string>")).count() == 0


def test_prompts_without_label_or_atoms(spark):
    ctx = spark.createDataFrame([("s", None, None, [], [], [])], "slug string, label string, kind string, ancestors array<string>, siblings array<string>, children array<string>")
    got = P.page_prompts(ctx, spark.createDataFrame([("s", "")], "slug string, bullets string")).first()
    assert got.prompt.startswith(P.ASK + "s" + P.NOT_LEAF + "s" + P.ATOMS + P.NO_ATOMS + P.ALLOWED + P.RULES) and f"{P.LIMIT}{got.word_limit}{P.STYLE}" in got.prompt


def test_context_lists_come_last(spark):
    """Rows with the lists of siblings, which grow with the square of a family, are in no shuffle and no broadcast."""
    n = 600
    rows = [("r", None, "root", "R", 0), *[(f"p{i:04d}", "r", "leaf-cluster", "P", n - i) for i in range(n)]]
    out = T.page_context(spark.createDataFrame(rows, T.TREE))
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 2 and all("LeftOuter" in j for j in joins)
    got = {r.slug: r for r in out.collect()}
    assert len(got) == n + 1 and len(got["r"].children) == n and not got["r"].siblings
    assert got["p0005"].siblings == [f"p{i:04d}" for i in range(n - 1, -1, -1) if i != 5]


def test_groups_of_nodes_after_many_rounds(spark):
    """However many rounds of merges there were, the groups of nodes come from one table of steps."""
    rounds = [[(5, 4)], [(4, 3), (9, 8)], [(3, 2)], [(2, 1)], *[[(100 + i, 99)] for i in range(3)]]
    merged = [spark.createDataFrame(r, "g long, to_g long") for r in rounds]
    nodes = spark.createDataFrame([(i,) for i in (*range(1, 11), 99, 100, 101, 102)], "id long")
    got = {r.id: r.g for r in T._members(nodes, merged, 5).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, **dict.fromkeys(range(99, 103), 99)}


def test_best_partners_of_a_slab():
    import numpy as np

    rng = np.random.default_rng(3)
    u = np.round(rng.normal(0, 1, (700, 3)), 1) + 0.05  # many equal similarities
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    size, low = rng.integers(1, 5, 700), rng.uniform(-1, 1, 300)
    of, with_ = np.arange(300), np.arange(700)
    got = sorted(zip(*(c.tolist() for c in T._best(of, with_, u, size, with_, low, 8, 5))))
    want = []
    for i in of:
        s = [(-round(float(u[i] @ u[j]), 12), int(j)) for j in with_ if j != i and size[i] + size[j] <= 5]
        want += [(int(i), j, -v) for v, j in sorted(s)[:9] if -v >= low[i]]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])


def test_nav_neighbours_are_dealt_by_slug(spark):
    """Children of unknown parents and kin among the neighbours go, repeats stay; nothing is broadcast or hashed whole."""
    pages = spark.createDataFrame([("a", 1, []), ("b", 2, ["a"]), ("c", 3, ["a", "x"]), ("d", 4, ["a", None]), ("d", 5, [])], "slug string, pos long, parent_ids array<string>")
    links = R.next_links(pages.select("slug", "pos"))
    assert sorted(map(tuple, links.collect())) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "d")]
    edges = links.unionByName(spark.createDataFrame([("b", "z"), ("b", "y"), ("b", "y"), ("q", "b"), (None, "b")], "a string, b string"))
    out = R.nav_neighbours(pages, edges, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan.replace("SortMergeJoin", "")
    got = {}
    for r in out.collect():
        got.setdefault((r.slug, r.role), []).append((r.pos, r.target))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        ("b", "parent"): [(0, "a")], ("c", "parent"): [(0, "a"), (1, "x")], ("d", "parent"): [(0, "a"), (1, None)], ("a", "child"): [(0, "b"), (1, "c"), (2, "d")],
        ("b", "related"): [(0, None), (1, "c"), (2, "q")], ("c", "related"): [(0, "b"), (1, "d")], ("d", "related"): [(0, "c"), (1, "d"), (2, "d")],
        ("z", "related"): [(0, "b")], ("y", "related"): [(0, "b"), (1, "b")], ("q", "related"): [(0, "b")], (None, "related"): [(0, "b")],
    }


def test_page_files(spark, tmp_path):
    """Any slug and text comes back from its file, repeats included, and there is no folder for each page."""
    rows = [("a", "# A\n\n漢\r\n"), ("a", "second"), ("a", "second"), ("", "empty"), (None, "none"), ("_x/y.%41~2", None), ("概念-" + "漢" * 60, ""), *[(f"p{i}", f"text {i}") for i in range(200)]]
    out = str(tmp_path / "files")
    for path in (out, f"file://{out}"):  # the second replaces the first
        Wr.write_pages(spark.createDataFrame(rows, "slug string, markdown string"), path)
        assert sorted(map(str, map(tuple, Wr.read_pages(spark, path).collect()))) == sorted(str((s, m or "")) for s, m in rows)
    assert spark.read.text(out, wholetext=True).count() == len(rows)
    assert len([p for p in (tmp_path / "files").iterdir() if p.is_dir()]) <= 4


def test_search_of_short_terms_reads_no_text(spark):
    """Up to three terms of up to three characters are answered by the postings alone; longer or more terms are held against the text."""
    index = spark.createDataFrame([(1, "ab", "", "xyz q"), (2, "AB", None, "xy zq"), (3, None, "b a", "漢字"), (4, "abxyz", "qr", "abcd")], "slug int, title string, summary string, keywords string")
    asked = ["a", "AB", "xyz", "a b q", "漢", "ab xyz q", "abcd", "a b x y", "zz", "  ", "ab ab"]
    want = {(0, s) for s in (1, 2, 3, 4)} | {(1, 1), (1, 2), (1, 4), (2, 1), (2, 4), (3, 1), (3, 2), (3, 4), (4, 3), (5, 1), (5, 4), (6, 4), (7, 1), (7, 2), (7, 4), (10, 1), (10, 2), (10, 4)}
    got = Q.search(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), index).collect()
    assert sorted((r.query_id, r.slug) for r in got) == sorted(want)
    built = Q.index_of(index)
    built.pages = built.pages.where("slug < 0")  # no text at hand
    short = Q.asked_terms(spark.createDataFrame([(0, "ab xyz"), (1, "abcd")], "query_id int, query string"))
    assert sorted(map(tuple, Q.lookup(short, built).collect())) == [(0, 1), (0, 4)]


def test_kmeans_with_centres_that_grow(spark):
    import numpy as np

    from wikispark.operators import kmeans as K

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(240, 8)), np.repeat(rng.normal(size=(4, 8)), 20, axis=0)])
    df = spark.createDataFrame([*enumerate(x.tolist()), (900, None), (901, [float("nan")] * 8)], "id long, embedding array<double>")
    got = {r.id: r.label for r in C.kmeans_labels(df, n_init=2).collect()}  # nulls made this fail
    assert len(got) == 322 and got.pop(900) is None and got.pop(901) is None
    label = np.array([got[i] for i in range(320)])
    assert set(label) == set(range(320 // 7))
    means = np.array([x[label == i].mean(0) for i in range(320 // 7)])
    far = ((x[:, None] - means) ** 2).sum(2)
    assert np.allclose(far[np.arange(320), label], far.min(1), atol=1e-3)  # each has its nearest mean
    assert all(len(set(label[i : i + 20])) == 1 for i in range(240, 320, 20))  # copies stay together
    # as plain means and nearest centres from the same seeds, for each start
    points = spark.createDataFrame([(i, i * 7919, bytearray(v.tobytes())) for i, v in enumerate(x)], "row long, h long, x binary")
    run = K.KMeans(points, 320, 45, 42, 2)
    run.candidates()
    weights = np.array([r.w for r in run.state.orderBy("row").collect()])
    assert weights.sum(0).tolist() == [320, 320]
    seeds = run.seeds()
    first = {(r.start, r.key) for r in seeds.collect()}
    assert [sum(s == start for s, _ in first) for start in (0, 1)] == [45, 45] and all(weights[k, s] for s, k in first)
    ended = K.located(run.iterate(seeds, 30)).collect()
    for start in (0, 1):
        w, keys = weights[:, start], sorted(k for s, k in first if s == start)
        c = x[keys]
        for _ in range(30):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([np.average(x[near == i], axis=0, weights=w[near == i]) if w[near == i].sum() else c[i] for i in range(45)])
            moved, c = np.sqrt(((new - c) ** 2).sum(1)).max(), new
            if moved <= 1e-4:
                break
        assert np.allclose(c, [np.frombuffer(r.x) for r in sorted((r for r in ended if r.start == start), key=lambda r: r.key)], atol=1e-3)
    at, distance, bound = K.two_nearest(x, np.concatenate([x[:50], x[:3] + 1e-6]))
    assert (at[:50] == np.arange(50)).all() and (distance[:50] == 0).all() and (bound[:3] < 1e-5).all()
    assert C.kmeans_labels(df.where("id >= 900"), n_init=1).where("label IS NULL").count() == 2
