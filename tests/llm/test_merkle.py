"""The Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest

from wikispark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])


def tree(nodes):
    """Root and, for each node, the list of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            start = at[i] // 16 * 16
            run = nodes[start : start + 16]
            path.append(("".join(run[: at[i] - start]), "".join(run[at[i] - start + 1 :])))
            at[i] //= 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    subs = {s: tree([leaf(r) for r in of[s]]) for s in sources}
    root, over = tree([subs[s][0] for s in sources])
    found = []
    for k, s in enumerate(sources):
        for r, path in zip(of[s], subs[s][1], strict=True):
            steps = path + over[k]
            text = r[1]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf((r[0], text, *r[2:]))
            for b, a in steps:
                folded = h(b, folded, a)
            found.append((r[0], leaf(r), subs[s][0], root, h(*[b + a for b, a in steps]), folded, folded == root))
    return sorted(found, key=str)


def rows_of(sizes):
    rows = []
    for source, n in sizes:
        rows += [(7 * i % 1009 + 1, f"Text {i} É" if i % 11 else None, "en" if i % 3 else None, source, i if i % 5 else None) for i in range(n)]
    return rows + [rows[0]] * 3 + [(None, "Ab", None, None, None), (None, "", "x", "a", 0), (1, "other", "en", "a", 3), (2, "long " * 20000, "en", "é", 1)]


@pytest.mark.parametrize(("sizes", "height"), [([("a", 700), ("B", 16), (None, 17), ("one", 1), ("é", 257)], 3), ([("a", 700), ("B", 16), (None, 17), *[(f"s{i:02}", 1 + i) for i in range(40)]], 1), ([("lone", 1)], 2)])
def test_verify_against_plain(spark, sizes, height):
    rows = rows_of(sizes)
    found = merkle.verify(spark.createDataFrame(rows, SCHEMA).repartition(5), height).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_manifest_witness_folds_to_root(spark):
    rows = rows_of([("a", 40), ("b", 3)])
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as pos", "3 as key", "4 as root")
    found = merkle.manifest(docs, 1).collect()
    assert len(found) == len(rows) and len({r.root for r in found}) == 1
    assert all(merkle.fold(r.leaf, [(s.before, s.after) for s in r.witness]) == r.root for r in found)
    assert {r.source for r in found} == {r[3] for r in rows}


def test_lone_row_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "Only", "en", "s", 4)], SCHEMA)
    r = merkle.verify(docs).collect()[0]
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")
    assert merkle.verify(docs.where("doc_id < 0")).collect() == []
    assert merkle.manifest(docs.where("doc_id < 0")).collect() == []


def test_open_tree_appends_one_by_one():
    nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(300)]
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300):
        tree_ = merkle.Open()
        for d in nodes[:n]:
            tree_.append(d)
        root, paths = tree([d.hex() for d in nodes[:n]])
        assert tree_.close().hex() == root
        assert [list(merkle.witness([bytes(x) for x in tree_.levels], i)) for i in range(n)] == paths
