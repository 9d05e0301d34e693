"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from wikispark.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, least=3, shortest=5, every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def plain(n):
    near = {w: [x for x in n if abs(len(w) - len(x)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    found = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(found)


def corpus():
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(4, 13))) for _ in range(60)]

    def changed(w):
        i, kind = rnd.randrange(len(w)), rnd.randrange(3)
        return w[:i] + (rnd.choice("abÉü×") if kind else "") + w[i + (kind != 1) :]

    words = [w for s in stems for w in [s] * rnd.randrange(1, 40) + [changed(s)] * rnd.randrange(9) + [changed(changed(s))] * 3]
    rnd.shuffle(words)
    rows = [(i, ", ".join(words[i * 20 : i * 20 + 20]).replace("a", "A", i % 3)) for i in range(len(words) // 20)]
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (None, None), (900, None), (901, ""), (902, " 12 ĀĀ "), (903, "verylong" * 9000), (904, "Straße naïve " * 30)]


@pytest.mark.parametrize(("least", "shortest", "every"), [(3, 5, 97), (1, 5, 3), (2, 6, 2)])
def test_against_all_pairs(spark, least, shortest, every):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as word", "2 as n")
    found = spelling.variants(docs, least, shortest, every).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain(counted(rows, least, shortest, every))
    assert sorted(map(tuple, found)) == want
    assert any(form not in (None, root) for _, form, root, *_ in want)


def test_split_lists_give_the_same_pairs(spark):
    n = counted(corpus(), 1)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((min(a, b), max(a, b)) for a in n for b in n if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b))
    for tile in (spelling.TILE, 7):
        found = spelling.near_pairs(words, 5, tile).collect()
        assert sorted((min(r.word, r.other), max(r.word, r.other)) for r in found) == want
        assert all(n[r.word] == r.n and n[r.other] == r.other_n for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "too rare")], SCHEMA)
    assert spelling.variants(docs.where("doc_id < 0")).collect() == spelling.variants(docs).collect() == []


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    assert {(r.word, r.root) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {(w, "w37") for w, _ in chain}
