"""Repeated passages against all windows of all documents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikispark.llm import phrases

SCHEMA = "doc_id long, text string"


def plain(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    found = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        found.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    said = lambda n, of=400: [f"w{rnd.randrange(of)}" for _ in range(n)]
    common = [said(k) for k in (34, 35, 36, 60, 200)]
    rows = [(i, " ".join(said(rnd.randrange(120)) + rnd.choice(common)[rnd.randrange(3) :] + said(rnd.randrange(60)))) for i in range(80)]
    rows += [(100 + i, " ".join(said(80))) for i in range(20)]
    rows += [(200, "la " * 90), (201, "la\tla " * 40), (202, " ".join(said(7) * 12)), (203, None), (204, ""), (205, " \n\v"), (206, "x" * 50000), (207, " ".join(said(30000, 10**6)))]
    rows += [rows[5], rows[5], rows[90], (300, rows[91][1]), (None, rows[92][1]), (301, " ".join(rows[93][1].split()[20:70])), (302, "É ü " * 36)]
    return rows


@pytest.mark.parametrize(("shard", "hot", "pieces"), [(phrases.SHARD, phrases.HOT, 1), (150, 3, 6)])
def test_against_all_windows(spark, shard, hot, pieces):
    rows = corpus(pieces)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(pieces).selectExpr("*", "1 as part", "2 as anchor", "text as kept")
    found = phrases.digest(phrases.cut(docs, 35, shard, hot)).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows, 35)
    assert any(r.n_removed for r in found) and any(r.n_removed < r.n_words for r in found)


def test_spans_and_no_repeats(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(40))
    found = {r.doc_id: r for r in phrases.cut(spark.createDataFrame([(1, f"x {a} y"), (2, f"{a}\n{b}"), (3, b)], SCHEMA)).collect()}
    assert [(s.first, s.last) for s in found[1].spans] == [(1, 50)] and found[1].kept == "x y"
    assert [(s.first, s.last) for s in found[2].spans] == [(0, 89)] and found[2].kept == found[3].kept == ""
    clean = spark.createDataFrame([(1, a), (2, b), (3, "  two\twords ")], SCHEMA)
    assert [(r.n_removed, r.kept) for r in phrases.cut(clean).orderBy("doc_id").collect()] == [(0, a), (0, b), (0, "two words")]
    assert phrases.cut(clean.where("doc_id < 0")).collect() == []


def test_phrases_go_to_the_parts_that_hold_them(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 1)  # two rows a part
    rows = [(2 * i + k, " ".join(f"{i}-{j}" for j in range(80))) for i in range(20) for k in range(2)]  # pairs of copies, each in a part of its own
    rows += [(40, rows[0][1]), (41, "clean"), (42, rows[0][1] + " x"), (43, rows[2][1])]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).select("doc_id", "text", F.lit(None).alias("none"))
    parted = docs.select("doc_id", "text", F.shiftright(F.col("doc_id"), 1).alias("part")).coalesce(1)
    anchors = phrases.by_part(phrases.recurring_anchors(parted, 35), "anchors")
    windows = phrases.by_part(phrases.recurring_windows(parted, anchors, 35), "windows")
    dealt = phrases.phrases_by_part(parted, windows, 35).collect()
    holders = {}
    for r in dealt:
        holders.setdefault(r.anchor, set()).add(r.part)
    assert sorted(map(sorted, {frozenset(v) for v in holders.values()})) == sorted([[0, 20, 21], [1, 21], *([i] for i in range(2, 20))])
    assert len(dealt) == len({(r.part, r.anchor) for r in dealt})
    found = phrases.digest(phrases.cut(docs, 35, 3)).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows, 35)


def test_hashes_of_runs():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 62, 300).astype(np.uint64)
    for size in (1, 2, 8, 28, 35):
        got = phrases.grams(words, size)
        assert len(got) == 301 - size and got[17] == phrases.grams(words[17 : 17 + size], size)[0]
        low = phrases.sliding(words, size, np.minimum)
        assert low.tolist() == [int(words[i : i + size].min()) for i in range(301 - size)]
    assert len(phrases.grams(words[:5], 8)) == 0


def test_word_hashes():
    words = ["a", "b", "aa", "é", "x" * 63, "x" * 64, "x" * 65, "x" * 300, "y" + "x" * 299, "0", "a"]
    hashes, starts, ends = phrases.word_hashes("  ".join(words).encode() + b"\x0b")
    assert len(hashes) == len(words) and hashes[0] == hashes[-1] and len(set(hashes.tolist())) == len(words) - 1
    assert ("  ".join(words).encode()[starts[3] : ends[3]]).decode() == "é"
    assert [len(x) for x in phrases.word_hashes(b"")] == [len(x) for x in phrases.word_hashes(b" \n")] == [0, 0, 0]


def test_pairs_with_equal_first():
    h, m = np.array([1, 2, 2, 2, 5], np.uint64), np.array([9, 3, 4, 7, 1], np.uint64)
    assert phrases.both_held(np.array([2, 2, 5, 6, 1], np.uint64), np.array([7, 5, 1, 1, 9], np.uint64), h, m).tolist() == [True, False, True, False, True]
    assert not phrases.both_held(h, m, h[:0], m[:0]).any()
