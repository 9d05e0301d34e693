"""Every operator against brute force, an exact round trip or held-out accuracy, with the edge rows of each."""

import hashlib
import math
import random
import zlib

import pytest

from wikispark.llm import bpe, extract, langid, lm, mixing, nearest, neardup, quality, simhash, topk, warc
from wikispark.llm.graph import components
from wikispark.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, row string, size int, score string"


def documents(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names clash with computed ones."""
    return spark.createDataFrame([(*r, "r", 1, "s") for r in rows], DOCS)


def english(rng, n=30, words="the of and to in that it was for on with as his they be at one have this from".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "ing", "er"]) for _ in range(n))


# 1


def test_warc(spark):
    long, rng = "x" * 1500, random.Random(1)
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, long), (4, "u\r\nv", "é" * 499), (5, "u", "é" * 499), (6, "", None), (7, "u", ""), (None, "u", long), (8, "u", "é" * 500), (9, "u", "é" * 500)]
    rows += [(20, "u", "rep" * 500), (20, "u", "rep" * 500), (21, "u", "".join(chr(rng.randrange(32, 0x3000)) for _ in range(200_000)))]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.round_trip(pages, payload=True).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, _, html in rows:
        body = (html or "").encode()
        r = by_id[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert {i: by_id[i].refers_to for i in by_id} == {1: 3, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: None, None: 3, 8: 9, 9: None, 20: None, 21: None}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_streams(tmp_path):
    raw = [warc.record(i, f"http://h/{i}", b"p" * (i * 1000), "d", None if i % 2 else 1) for i in range(1, 6)]
    whole = zlib.compressobj(1, wbits=31)
    one = whole.compress(b"".join(raw)) + whole.flush()
    (tmp_path / "a").write_bytes(one + one)  # two members
    with (tmp_path / "a").open("rb") as f:
        assert list(warc.records(warc.inflate(f))) == raw * 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(iter([raw[0][:-10]])))


# 2


def test_inflating_is_bounded_and_ends_whole():
    import gzip
    import io

    members = [gzip.compress(b"\0" * 30_000_000 + b"end"), gzip.compress(b""), gzip.compress(b"x" * 10)]
    pieces = list(warc.inflate(io.BytesIO(b"".join(members))))
    assert b"".join(pieces) == b"\0" * 30_000_000 + b"end" + b"x" * 10 and max(map(len, pieces)) <= warc.PIECE
    for cut in (1, 5, 12):
        with pytest.raises(EOFError):
            list(warc.inflate(io.BytesIO(b"".join(members)[:-cut])))
    assert list(warc.inflate(io.BytesIO(b""))) == []


def test_blocks():
    text = lambda page: extract.main_text(extract.blocks(page), [], 10)[0]
    page = '<body class="nav-open"><div id="cookie-banner">We</div><header>Site</header><main><article><header><h1>T&amp;</h1></header><p>a <b>b</b>c &lt;x&gt; 1<2<p>d<br>e<aside>rel</aside><ul><li class="ad">buy<li>y</ul><div class="comments">hi</div><script>var t="</p>";</script></article></main><form>f</form><footer>f'
    assert text(page) == "T& a bc <x> 1<2 d e y"
    for odd in ("", "<", "<p", "<!--", "a < b", "<script>", "&am", "<p>&#x41;&nbsp; b</p>", "<p " * 1000):
        extract.blocks(odd)
    assert text("<p>&#x41;&nbsp; b</p>") == "A b"
    page = '<article><header class="entry-header"><h1>Title</h1></header><p>Body</p><div class="related-work">Prior results</div><div class="comment-list">Hi</div></article>'
    assert text(page) == "Title Body Prior results"
    assert text("<article><!-- open <p>kept</p></article>") == "kept" and text("<article><script>var a<p>kept</p></article>") == "kept"


def test_repeats_by_brute_force(spark):
    """Every covered token, and no other, lies in a run of `least` tokens that pages of the host with other contents have too."""
    rng, least = random.Random(3), 5
    pieces = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12))) for _ in range(6)]
    rows = []
    for i in range(60):
        blocks = [(rng.choice(["div", "nav", "footer"]), rng.choice(pieces)) for _ in range(rng.randrange(4))] + [("div", f"own {i} " + " ".join(str(rng.random()) for _ in range(rng.randrange(40, 60))))]
        rng.shuffle(blocks)
        body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
        rows.append((i, f"http://h{i % 3}/{i}", f"<article>{body}</article>" if i % 5 == 0 else body))
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), least=least).collect()}
    streams = {i: extract.stream(extract.blocks(h)) for i, _, h in rows}
    where = {}
    for i, url, _ in rows:
        for k in range(len(streams[i][0]) - least + 1):
            where.setdefault((url.split("/")[2], *streams[i][0][k : k + least]), set()).add(i)
    repeated = 0
    for i, url, h in rows:
        tokens, ranks = streams[i]
        covered = {p for k in range(len(tokens) - least + 1) if len(where[(url.split("/")[2], *tokens[k : k + least])]) > 1 for p in range(k, k + least)}
        kept = [t for p, (t, r) in enumerate(zip(tokens, ranks, strict=True)) if t != extract.MARK and (r == extract.TEXT or r != extract.ASIDE and p not in covered)]
        assert got[i].text == " ".join(kept), i
        assert got[i].repeated == sum(t != extract.MARK and r != extract.TEXT and p in covered for p, (t, r) in enumerate(zip(tokens, ranks, strict=True)))
        assert got[i].repeated + got[i].structural + len(kept) == sum(t != extract.MARK for t in tokens)
        repeated += got[i].repeated
    assert repeated > 100


def test_host_repeats(spark):
    menu, rng = " ".join(f"m{i}" for i in range(14)), random.Random(2)
    rows = [(i, f"http://{'h' if i < 6 else f'o{i}'}/p{i}", f"<div>{menu}</div><div>{' '.join(str(rng.random()) for _ in range(40))}</div>") for i in range(8)]
    doubtful = '<article><p>Text {}</p><div class="share-hint">{}</div></article>'
    rows += [(20, "http://h/q", f"<article>{menu}</article>"), (21, None, None), (22, "x", ""), (23, "http://h/r", rows[0][2]), (24, "http://h/s", doubtful.format(1, menu)), (25, "http://h/t", doubtful.format(2, "unique words"))]
    copies = [" ".join(f"w{k if k != 17 * i else -i}" for k in range(200)) for i in range(1, 4)]
    rows += [(30 + i, f"http://copies/{i}", f"<p>{t}</p>") for i, t in enumerate(copies)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    own = {i: h.split("<div>")[2][:-6] for i, _, h in rows[:8]}
    assert all(got[i] == own[i] for i in range(6)) and got[23] == own[0]  # the same page twice is one page
    assert all(got[i] == f"{menu} {own[i]}" for i in (6, 7)) and got[20] == menu and got[21] == got[22] == ""
    assert got[24] == "Text 1" and got[25] == "Text 2 unique words"  # doubtful parts of an article go if they repeat
    assert [got[30 + i] for i in range(3)] == copies  # near copies do not delete each other
    assert extract.extract(pages.limit(0)).count() == 0


def test_article_blocks_on_most_pages_of_a_host_go(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    call, quote = "Subscribe to our newsletter today and never miss a story", words(30)
    rows, want = [], {}
    for i in range(12):
        own = [words(50), words(40)]
        shown = [own[0], quote, own[1]] if i < 5 else own  # a passage that 5 of 12 articles quote stays
        page = f"<p>{shown[0]}</p><p>{call}</p>" + "".join(f"<p>{x}</p>" for x in shown[1:]) + '<div class="discussion">Great post! says Bob</div>'
        page += '<p class="site-notice">We use cookies on this site</p><div class="newsletter-cta">Join now</div></article><article class="teaser">Read next'
        rows.append((i, f"http://one/{i}", f"<body><article>{page}</article></body>"))
        want[i] = " ".join(shown)
    copy = f"<article><p>{call}</p><p>{want[0]}</p></article>"
    rows += [(20 + i, f"http://two/{i}", copy) for i in range(4)] + [(30, "http://three/", f"<article><p>{call}</p></article>")]
    want |= {20 + i: f"{call} {want[0]}" for i in range(4)} | {30: call}  # copies of one page, and a lone one, repeat nothing
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    bare = {i: extract.main_text(extract.blocks(h), [], extract.LEAST)[0] for i, _, h in rows}
    assert sum(bare[i] != want[i] for i in want) == 12  # without the array, the call stays on these pages
    assert all(got[i].repeated >= len(call.split()) for i in range(12))


def test_end_tags_that_nothing_opened_cost_nothing():
    import time

    began = time.process_time()
    assert extract.blocks("<div>" * 20000 + "x" + "</foo>" * 20000) == [(extract.OPEN, "x")]
    assert time.process_time() - began < 0.5


# 3 and 10

VECTORS = [None, [], [float("nan")] * 4, [None, 1.0, 1.0, 1.0], [float("inf")] * 4, [0.0] * 4]


def vectors(spark, n=230, dim=4, seed=3):
    rng = random.Random(seed)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, v) for i, v in enumerate(VECTORS)] + [(None, [1.0] * dim), (5, rows[5][1]), (7000, [3.0] * dim), (7050, [-3.0] * dim)]
    return rows, spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")


def usable(rows):
    import numpy as np

    rows = {(i, tuple(np.float32(x).item() for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    return sorted(rows)


@pytest.mark.parametrize("block", [(7, 40), (None, None)])
def test_topk(spark, block):
    rows, df = vectors(spark)
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in usable(rows)]
    want = {}
    for q, a in (x for x in own if x[0] % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in own if i != q)[:5]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, 50, q_rows=block[0], c_rows=block[1]).collect()}
    assert got == want
    assert topk.search(df.limit(0), 50).count() == 0
    few = topk.search(df.where("vec_id in (0, 1, 2)"), 50).collect()
    assert sorted(r.rank for r in few) == [1, 2]


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e12, 2.0]), (1, [1e9, 1.0]), (2, [1e300, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.search(df, 50, k=2).collect()}
    assert got[1] == min(2**63 - 1, 256 * 10**12 * 256 * 10**9 + 512 * 256) and got[2] == 2**63 - 1


@pytest.mark.parametrize("block", [(7, 40), (None, None)])
def test_nearest(spark, block):
    rows, df = vectors(spark)
    own = [x for x in usable(rows) if any(x[1])]
    want = {}
    for q, a in (x for x in own if x[0] % 100 == 0):
        best = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), i) for i, b in own if i != q)[:10]
        want |= {(q, r): (i, s) for r, (s, i) in enumerate(best, 1)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.search(df, 100, q_rows=block[0], c_rows=block[1]).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert nearest.search(df.limit(0), 100).count() == 0


def test_nearest_of_huge_components_and_ties(spark):
    huge = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [3.0, 1.0]), (3, [-1e308, 1e308])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in nearest.search(huge, 100).orderBy("rank").collect()]
    assert got == [(1, 2, math.sqrt(5)), (2, 1, math.inf), (3, 3, math.inf)]
    rng = random.Random(6)  # a third of all rows are the same, a third nearly
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [1 + rng.random() * 1e-6, 2.0, 3.0] if i % 3 == 1 else [rng.random() * 4 for _ in range(3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, 100, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 3000, 700):
        best = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(rows[q][1], v, strict=True))), i) for i, v in rows if i != q)[:4]
        assert sorted(got[q]) == [(r, i, s) for r, (s, i) in enumerate(best, 1)]


# 4


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, english(rng, rng.randrange(1, 60)), "en", rng.choice(["b", "b", "b", "a", None, "é"])) for i in range(400)]
    rows += [(1000 + i, "w " * 9000, "en", "b") for i in range(3)] + [(2000, None, "en", "a"), (2001, "", "en", "empty"), (2002, " \t\n", "en", "a"), (None, "x y", "en", "a"), (7, rows[7][1], "en", rows[7][3])]
    df = documents(spark, rows)
    got = mixing.mix(df).collect()
    sizes, target, taken = {}, {}, {}
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, want, left, open_ = dict(zip(order, [5, 2, 1] * 9, strict=False)), {}, float(sum(sizes.values())), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(want[s] for s in over)
        open_ -= over
    assert all(abs(target[s] - want[s]) < 1e-6 for s in order)
    largest = {s: max(r.size for r in got if r.source == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.mixed(df.limit(0)).count()


def test_mixing_of_rows_that_repeat_an_id(spark):
    rows = [(1, " ".join("w" * 10), "en", "a")] * 100 + [(2, f"t{i} " * 10, "en", "a") for i in range(50)] + [(None, "n " * 10, "en", "a")] * 50 + [(i, "x " * 10, "en", "b") for i in range(10, 400)]
    df = documents(spark, rows)
    got = mixing.mix(df.repartition(6)).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    for doc_id in (1, 2, None):  # some of the copies of one id are taken once more than others
        assert len({r.taken for r in got if r.doc_id == doc_id}) == 2
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert sum(len(r.text.split()) for r in mixing.mixed(df).collect()) == sum(r.taken for r in got)


# 5


def slow_fingerprint(text, width=3):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(5)
    base = [english(rng, 300) for _ in range(6)]
    texts = [b for b in base for _ in range(4)] + [b.replace(" ", "  ") for b in base] + [" ".join(b.split()[:-k]) for b in base for k in (1, 2, 3, 4)] + [None, "", " ", "One", "one", "One two", "É é", english(rng, 60_000)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, base[0], "en", "s"), (3, base[0], "en", "s")]
    df = documents(spark, rows)
    got = {r.doc_id: r for r in simhash.digest(simhash.groups(df)).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert all(int(got[i].fingerprint, 16) == p for i, p in prints.items())
    least = {i: i for i in prints}
    while True:
        new = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == least:
            break
        least = new
    assert {i: got[i].component_id for i in prints} == least
    kept = simhash.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values())) and kept.columns == df.columns
    assert simhash.groups(df.limit(0)).count() == 0


def test_all_links_within_two_bits(spark):
    rng = random.Random(6)
    fps = {0, -1, 1 << 62}
    for _ in range(40):
        x = rng.getrandbits(64) - (1 << 63)
        fps |= {x, *(int.from_bytes(((x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) & (2**64 - 1)).to_bytes(8, "little"), "little", signed=True) for _ in range(5))}
    pairs = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    links = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert links <= pairs
    roots = lambda e: {(r.node, r.root) for r in components(spark.createDataFrame(sorted(e), "a long, b long")).collect()}
    assert roots(links) == roots(pairs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 150: 100, 200: 100}


def test_near_copies_of_several_words(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = [" ".join(f"{rng.randrange(10**6):x}" for _ in range(400)) for _ in range(20)]
    texts = list(base)
    for b in base:
        for changes in (1, 4, 8, 25):  # each changes five shingles: similarity about 0.98, 0.9, 0.8 and 0.55
            own = b.split()
            for at in rng.sample(range(400), changes):
                own[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(300))
    texts += [f"{passage} " + " ".join(f"{rng.randrange(10**6):x}" for _ in range(80)) for _ in range(60)]  # share a passage, similarity about 0.65
    texts += [passage + f" {i}" for i in range(60)] + ["", None, " ", "one two", "One  two", "three"]
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    least = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    while True:
        new = list(least)
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            break
        least = new
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    assert {r.doc_id: r.component_id for r in neardup.groups(df).collect()} == dict(enumerate(least))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == sorted(set(least)) and len(set(least)) < len(texts) - 100
    assert neardup.groups(df.limit(0)).count() == 0


def test_near_dedup_stage_links_by_fingerprints_too(spark):
    import corpus_pipeline

    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(["a b c", "b c d", "x y z", "x y z", "q r"])])
    a, b = (spark.createDataFrame([(i, i, r) for i, r in enumerate(roots)], "doc_id long, text_hash long, root long") for roots in ([7, 7, 8, 9, 10], [0, 1, 1, 3, 4]))
    assert [r.component_id for r in neardup.joined(a, b).orderBy("doc_id").collect()] == [0, 0, 0, 3, 4]  # linked by one grouping each
    plans = []
    real = simhash.groups
    simhash.groups = lambda docs, *more: plans.append(1) or real(docs, *more)
    try:
        kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, "").collect()
    finally:
        simhash.groups = real
    assert plans and sorted(r.doc_id for r in kept) == [0, 1, 2, 4]


def test_tiles_of_texts_that_pivots_leave_apart(spark, monkeypatch):
    """With tiles far smaller than a bucket, rows that repeat an id and rows without one: the same components as by all pairs."""
    rng = random.Random(5)
    base = [f"{rng.randrange(10**6):x}" for _ in range(120)]
    texts = []
    for i in range(60):  # a chain: each differs from the one before in two words, the far ones share little
        base[rng.randrange(120)], base[rng.randrange(120)] = f"x{i}", f"y{i}"
        texts.append(" ".join(base))
    texts += [" ".join(w if rng.random() > 0.04 else f"z{rng.randrange(10**6)}" for w in base) for _ in range(60)]
    texts += texts[:20] * 3
    sets = [neardup.shingles(t) for t in texts]
    least = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(neardup, "TILE", 1500)
    got = neardup.groups(documents(spark, [*rows, rows[7], rows[7], (None, texts[7], "en", "s"), (None, "alone", "en", "s")])).collect()
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of == dict(enumerate(least)) and len(got) == len(rows) + 4
    assert sorted((r.component_id is None) for r in got if r.doc_id is None) == [False, True]


def test_links_of_a_tile():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(30), rng.randrange(20, 30))), np.uint64) for _ in range(40)] + [np.zeros(0, np.uint64)] * 2
    left = [i % 3 == 0 for i in range(42)]
    tile = pa.table({"left": left, "root": list(range(100, 142)), "found": [x.tobytes() for x in sets]})
    near = {(i, j) for i in range(42) for j in range(42) if left[i] and not left[j] and neardup.similarity(sets[i], sets[j]) >= 0.8}

    def classes(links):
        of = list(range(42))
        for _ in of:
            for i, j in links:
                of[i] = of[j] = min(of[i], of[j])
        return of

    links = {(x - 100, y - 100) for x, y in zip(*neardup.tile_links(tile, 0.8).to_pydict().values(), strict=True)}
    assert links <= near and len(links) < len(near) and classes(links) == classes(near)


# 6


def test_marginals_by_enumeration():
    import numpy as np

    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "ba"])}
    rng = np.random.default_rng(1)
    table = np.vstack([rng.random((7, 2)), [[0, 0]], [[1e-3, 1e-3]]])

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, 4):
            p = word[:n]
            if len(p) == n and (p in pieces or n == 1):
                out += table[pieces.get(p, 8), k] * total(word[n:], k)
        return out

    own = ["▁abab", "▁baba", "▁axab"]
    forward = langid.Lattice(pieces, 3, own).forward(table)[-1]
    assert np.allclose(forward, [[total(w, k) for k in range(2)] for w in own])
    ids, n = langid.Lattice(pieces, 3, own[:1]).expected(table[:, :1], np.ones(1))
    length = {i: len(p) for p, i in pieces.items()}
    assert abs(sum(length.get(int(i), 1) * x for i, x in zip(ids, n, strict=True)) - 5) < 1e-9  # each character is in one piece


def test_words_of_letters():
    assert langid.words("½ ² Ⅷ ① _ 7 a½b नमस्ते x1y") == ["a", "b", "नमस्ते", "x", "y"] and langid.words(None) == []
    assert langid.words("Q" * 100) == ["q" * 48, "q" * 48, "q" * 4]


def test_scores_by_brute_force(spark):
    """Whole texts by sums over segmentations in logarithms, with words that a product of doubles could not hold."""
    rng = random.Random(8)
    texts = [english(rng, 30) for _ in range(20)] + ["z" * 48, "qxzj" * 40, "the " + "ж" * 60, "नमस्ते ½"]
    path = vocabulary("piece_bpe_32k.model")
    model = langid.train(documents(spark, [(i, t, "ab"[i % 2], "s") for i, t in enumerate(texts[:20])]), path)
    pieces, longest = langid.vocabulary(path), max(map(len, langid.vocabulary(path)))
    plus = lambda a, b: max(a, b) + math.log1p(math.exp(min(a, b) - max(a, b))) if min(a, b) > -math.inf else max(a, b)

    def log_word(w, k):
        alpha = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - longest), j):
                p = pieces.get(w[i:j])
                if p is not None or j == i + 1:
                    alpha[j] = plus(alpha[j], alpha[i] + math.log(model.table[p, k] if p is not None else langid.UNKNOWN))
        return alpha[-1]

    logs = langid.Scorer(path, model.table).texts(texts)
    for t, own in zip(texts, logs, strict=True):
        want = [sum(log_word(langid.MARK + w, k) for w in langid.words(t)) for k in range(2)]
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(own, want, strict=True)), t
    out = {r.doc_id: r for r in langid.predict(documents(spark, [(i, t, None, "s") for i, t in enumerate(texts)] * 2), model).collect()}
    for i, own in enumerate(logs):
        assert out[i].lang_pred == "ab"[int(own[1] > own[0])] and math.isclose(out[i].score, 1 / (1 + math.exp(-abs(own[0] - own[1]))), rel_tol=1e-9)
    assert langid.predict(documents(spark, []), model).count() == 0


def test_rare_languages_are_learned(spark):
    rows = [(i, "the of and to in", "en", "s") for i in range(400)] + [(1000 + i, "der die und ist", "de", "s") for i in range(3)]
    assert langid.train(documents(spark, rows), vocabulary("piece_bpe_32k.model"), sample=40).languages == ["de", "en"]


def test_language(spark):
    rng = random.Random(7)
    german = "der die und ist nicht mit ein schule über zwischen wenn auch auf für".split()
    rows = [(i, english(rng) if i % 2 else english(rng, words=german), "en" if i % 2 else "de", "s") for i in range(120)]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "123 !? 4", "en", "s"), (503, "der " * 50_000, "de", "s"), (504, "x" * 5000, None, "s"), (None, "die und", "de", "s"), (1, rows[1][1], "en", "s")]
    df = documents(spark, rows)
    out = langid.learn_and_predict(df, vocabulary("piece_bpe_32k.model")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:120]) and got[503].lang_pred == "de"
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"} and got[500].score == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    model = langid.train(df, vocabulary("piece_bpe_32k.model"))
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() >= len(rows) - 4 and not {500, 501, 502} & {r.doc_id for r in kept.collect()}
    assert langid.train(df.limit(0), vocabulary("piece_bpe_32k.model")) is None
    assert langid.learn_and_predict(df.where("lang is null"), vocabulary("piece_bpe_32k.model")).first().lang_pred == "und"


# 7


def test_bpe(spark):
    from tokenizers import Tokenizer

    path, rng = vocabulary(), random.Random(8)
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|>", "I'm you'RE don't", "ΑΣ İ ǅ", "é a ́ H̱", "日本語 中文123 ½²", "\x1c a\x1cb \x85  z", "🙂👨‍👩‍👧 ***&&&", "word " * 30_000]
    texts += ["".join(chr(rng.choice([rng.randrange(0, 128), rng.randrange(0x80, 0x600), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x20000)])) for _ in range(25)) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(0, 128)) for _ in range(25)) for _ in range(300)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in bpe.digest(bpe.encode(documents(spark, rows), path)).collect()}
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coder = bpe.coder(path)
    assert b"".join(coder.cut("a日b".encode())) == "a日b".encode() and len(coder.cut(b"ab")) == 1
    assert bpe.encode(documents(spark, rows).limit(0), path).count() == 0


# 8


def test_crf_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    crf, x, counts = quality.Crf(rng.normal(size=3), rng.normal(size=(2, 2))), rng.normal(size=(9, 3)), np.array([4, 1, 3, 1])
    good, between = crf.marginals(counts, x, pairs=True)
    want, joint, at = [], np.zeros((2, 2)), 0
    for n in counts:
        e = x[at : at + n] @ crf.weights
        paths = {y: np.exp(sum(e[i] * v for i, v in enumerate(y)) + sum(crf.steps[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(paths.values())
        want += [sum(w for y, w in paths.items() if y[i]) / z for i in range(n)]
        for y, w in paths.items():
            for a, b in zip(y, y[1:], strict=False):
                joint[a, b] += w / z
        at += n
    assert np.allclose(good, want) and np.allclose(between, joint)


def test_blocks_of_lines():
    import numpy as np

    rng, draw = random.Random(4), np.random.default_rng(5)
    crf = quality.Crf(draw.normal(size=3 * quality.OWN + 3), draw.normal(size=(2, 2)))
    texts = ["\n" * 40, "a\n" * 30, None, ""] + ["\n".join(rng.choice(["", "a b", "B!! c", "x" * 30, english(rng, 5)]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    whole = crf.quality(texts)
    for lines in (1, 2, 7, 16):
        assert np.allclose(crf.quality(texts, lines), whole) and np.allclose([crf.long_quality((t or "").encode(), lines) for t in texts], whole)


def test_very_many_lines():
    import resource

    import numpy as np

    crf = quality.Crf(np.ones(3 * quality.OWN + 3) / 9, np.eye(2))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= crf.quality(["\n" * 3_000_000])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_quality(spark):
    rng = random.Random(9)
    junk = lambda: " ".join(w.upper() + "!!" for w in english(rng).split())
    rows = [(i, "\n".join([english(rng), junk() if i % 3 == 0 else english(rng), junk() if i % 3 == 0 else english(rng)]), "en", "s") for i in range(300)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "\n\n", "en", "s"), (903, english(rng, 50_000), "en", "s"), (904, "a\n" * 3000, "en", "s"), (3, rows[3][1], "en", "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5000, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows)
    out = quality.learn_and_score(df, labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [got[i] for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(r.held_out and r.predicted == (r.doc_id % 3 > 0) for r in held) and got[903].predicted == 1
    kept = quality.keep_good(df, quality.train(df, labels))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 3}
    assert quality.train(df, labels.limit(0)) == 1.0 and quality.train(df, labels.where("quality = 0")) == 0.0
    assert quality.score(df.limit(0), 1.0).count() == 0
    model = quality.train(df, labels)
    assert quality.score(df.limit(0), model).count() == 0 and sum(0.01 < r.score < 0.99 for r in held) > len(held) / 2
    twice = quality.score(df.union(df), model).collect()  # repeated rows get the same score each
    assert len(twice) == 2 * len(rows) and len({(r.doc_id, r.score) for r in twice}) == len({(r.doc_id, r.score) for r in quality.score(df, model).collect()})


# 9


def test_quality_learns_from_long_documents_and_very_many_lines(spark):
    rng = random.Random(8)
    junk = lambda n: "\n".join("BUY NOW!!! $$$ " * 4 for _ in range(n))
    good = lambda n: "\n".join(english(rng, 12) for _ in range(n))
    rows = [(i, (junk if i % 2 else good)(600), "en", "s") for i in range(24)] + [(50, junk(20000), "en", "s"), (51, good(5), "en", "s")]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)] + [(50, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.learn_and_score(documents(spark, rows), labels).collect()}
    assert got == {i: 1 - i % 2 for i in range(24)} | {50: 0, 51: 1}
    assert quality.sampled_features(junk(20000).encode()).shape == (quality.SAMPLE_LINES, 3 * quality.OWN + 3)
    import numpy as np

    text = good(300).encode()
    whole, part = quality.features([text])[2], quality.sampled_features(text, 40)
    assert any(np.array_equal(part, whole[i : i + 40]) for i in range(261))
    same = documents(spark, [(1, junk(3), "en", "s")] * 5000 + [(2, good(3), "en", "s")])
    taught = quality.train(same, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    assert isinstance(taught, quality.Crf)


def test_language_model(spark):
    from collections import Counter, defaultdict

    rng = random.Random(10)
    rows = [(i, english(rng, rng.randrange(0, 40)), "en", "s") for i in range(150)] + [(500, None, "en", "s"), (501, "", "en", "s"), (502, "The THE the unseenword", "en", "s"), (503, "the " * 60_000, "en", "s"), (None, "in the", "en", "s"), (3, "in the", "en", "s")]
    docs = documents(spark, rows)
    split = docs.select("doc_id", "text")
    held_out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + ["</s>"]
    c, triples, total = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if not held_out(i):
            own = ["<s>", "<s>", *tokens(t)]
            for u, v, w in zip(own, own[1:], own[2:], strict=False):
                c[w] += 1
                triples[u, v, w] += 1
                total[u, v] += 1
    k2, kinds, kinds2 = Counter(), defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
    for (u, v, w), x in triples.items():
        kinds[u, v][min(x, 3) - 1] += 1
        k2[v, w] += x if v == "<s>" else 1
    k, total2 = Counter(w for _, w in k2), Counter()
    for (v, _), x in k2.items():
        kinds2[v][min(x, 3) - 1] += 1
        total2[v] += x
    d3, d2, d1 = (lm.discounts([sum(x == i for x in z.values()) for i in (1, 2, 3, 4)]) for z in (triples, k2, k))
    left = sum(a * sum(min(x, 3) == i for x in k.values()) for i, a in enumerate(d1, 1)) / len(k2)
    less = lambda x, d: max(x - (d[min(x, 3) - 1] if x else 0), 0)
    back = lambda d, n: sum(a * b for a, b in zip(d, n, strict=True))

    def p(u, v, w):
        p1 = less(k[w], d1) / len(k2) + left / (len(c) + 1)
        p2 = less(k2[v, w], d2) / total2[v] + back(d2, kinds2[v]) / total2[v] * p1 if total2[v] else p1
        return less(triples[u, v, w], d3) / total[u, v] + back(d3, kinds[u, v]) / total[u, v] * p2 if total[u, v] else p2

    assert abs(sum(p("<s>", "<s>", w) for w in c) + p("<s>", "<s>", "never seen") - 1) < 1e-9
    learnt = split.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    for cell_bytes, passes in ((8000, 3), (1 << 30, 1)):
        model = lm.train(learnt, cell_bytes=cell_bytes, passes=passes)
        assert (model.cells > 20) == (passes > 1) and (model.tokens, model.vocabulary, model.pairs) == (sum(c.values()), len(c), len(k2))
        assert (lm.spread(model.folder, lm.word_hashes(b"the")[0])[0] > 1) == (passes > 1)  # dealt over several cells
        for i, got in enumerate(sorted(lm.score(split, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))):
            t = sorted(rows, key=lambda r: (r[0] is None, r[0], len(tokens(r[1]))))[i][1]
            own = tokens(t)
            assert (got.n_tokens, got.n_known) == (len(own), sum(c[w] > 0 for w in own))
            assert math.isclose(got.base_score, sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in own), rel_tol=1e-9)
            assert math.isclose(got.score, sum(math.log10(p(u, v, w)) for u, v, w in zip(["<s>", "<s>", *own], ["<s>", *own], own, strict=False)), rel_tol=1e-9)
    out = lm.train_and_score(docs)
    assert out.count() == len(rows) and out.where("held_out").count() > 0
    none = lm.train(split.limit(0))
    assert {(r.base_score, r.score) for r in lm.score(split.where("doc_id = 501"), none).collect()} == {(0.0, 0.0)}
    assert lm.score(split.limit(0), none).count() == 0


# the pipeline


def test_word_hashes():
    rng = random.Random(11)
    words = ["a", "A", "ab", "ba", "é", "x" * 5000, "x" * 4096 + "y", "y" * 4096 + "x", "z" * (lm.PIECE + 7)] + ["".join(rng.choice("abÉ") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    raw = [w.encode() for w in words for _ in range(3)]
    rng.shuffle(raw)
    text = b"\t".join(raw)
    text += b" \n" * 9 + b"x" * (lm.PIECE - len(text) % lm.PIECE - 30) + b" the \x0b end"
    h, at = lm.word_hashes(text)
    own = text.split()
    assert len(h) == len(own) and all(text[i : i + len(w)] == w for i, w in zip(at.tolist(), own, strict=True))
    of = {}
    assert all(of.setdefault(w.lower(), x) == x for w, x in zip(own, h.tolist(), strict=True)) and len(set(of.values())) == len(of)


def test_sorted_arrays(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 9, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        a, b = rng.integers(1, 4, len(keys)), np.where(rng.random(len(keys)) < 0.01, 1 << 40, 1)
        lm.write_table(f"{tmp_path}/t{n}", keys, [a, b], (1, 1))
        got = lm.table_of(f"{tmp_path}/t{n}", (1, 1)).find(np.concatenate([keys[::-1], keys ^ np.uint64(1 << 50)]))
        assert (got[0] == np.concatenate([a[::-1], a * 0])).all() and (got[1] == np.concatenate([b[::-1], b * 0])).all()
    assert not lm.table_of(f"{tmp_path}/none", (1,)).find(keys)[0].any()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    junk = lambda: " ".join(w.upper() + "!!" for w in english(rng).split())
    texts = {i: junk() if i % 4 == 0 else english(rng, 80) for i in range(120)}
    texts |= {200 + i: texts[i] for i in range(1, 20)} | {300: "12 34", 301: None}
    rows = [(i, t, "en", f"src{i % 3}") for i, t in texts.items()]
    path = str(tmp_path / "sf")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns
        seen[name] = {r.doc_id for r in docs.collect()}
    assert not {300, 301} & seen["language_id"] and seen["language_id"] >= set(range(120))
    assert seen["quality"] == {i for i in seen["language_id"] if i % 4 or i >= 200} - {i for i in seen["language_id"] if i >= 200 and (i - 200) % 4 == 0}
    unique = {t: i for i, t in sorted(((i, texts[i]) for i in seen["quality"]), reverse=True)}
    assert seen["near_dedup"] == set(unique.values()) and seen["mix"] <= seen["near_dedup"]
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.collect()} == seen["mix"] and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in out.collect())


def test_entry_has_every_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
