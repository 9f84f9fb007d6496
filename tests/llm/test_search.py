"""Operators 3, 5, 6 and 7 against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream.llm import brown, components, exchange, jaccard, kernels, queries, substrings, topk


def split(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_op3_oracle(same):
    same(queries.op3_substrings, substrings.SQL)


def brute_removed(rows, width):
    seen, words = Counter(), [split(t) for t in rows]
    for w in words:
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_op3_small(spark, odd, none, width):
    rng = random.Random(width)
    rows = [" ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["p q r s t", "p q r s t"]
    got = [tuple(r) for r in substrings.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), width).orderBy("doc_id").select("n_words", "n_removed", "kept").collect()]
    assert got == brute_removed(rows, width)
    from tests.llm.conftest import ODD

    out = substrings.dedup(odd, width)
    assert {"chunk", "task", "lang", "kept"} <= set(out.columns)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in out.collect())
    assert got == sorted((x[0] or 0, *b) for x, b in zip(ODD, brute_removed([x[1] for x in ODD], width), strict=True))
    assert substrings.dedup(none, width).count() == 0


def test_op3_intervals(spark):
    rows = spark.createDataFrame([(1, "x1 a b c x2"), (2, "y1 a b c y2")], "doc_id long, text string")
    assert [r["removed"] for r in substrings.dedup(rows, 3).collect()] == [[[1, 4]], [[1, 4]]]


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = split(lowered(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    forest = components.Forest()
    for d, s in sets.items():
        for e, i in Counter(e for x in s for e in where[x] if e < d).items():
            if 100 * i >= 80 * (len(s) + len(sets[e]) - i):
                forest.join(d, e)
    return {d: (len(s), forest.root(d)) for d, s in sets.items()}


def test_op5_whole_table(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard_join(spark, sf).collect()}
    assert got == brute_components([x[:2] for x in texts])


@pytest.mark.parametrize("block,size,part,cut", [(256, 1 << 24, 1024, 65536), (4, 1 << 24, 3, 16), (256, 1500, 1024, 40), (2, 1 << 24, 1, 65536)])
def test_op5_chains_and_blocks(spark, monkeypatch, block, size, part, cut):
    """Chains of copies that link only to their neighbours, in blocks so small that hot groups are split."""
    monkeypatch.setattr(jaccard, "SLICE", cut)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(9)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 90))]
        for _ in range(rng.randint(2, 14)):
            rows.append(" ".join(words))
            k = rng.randint(0, len(words) - 1)
            words = words[:k] + [f"n{rng.randint(0, 10**6)}"] + words[k + 1 :]
    rows += ["Same Text", "same text", "one two three four five", "one two three four six", None, "", "x"] * 2
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def repeated_ids(seed, n=1000):
    """Rows whose ids repeat, with equal, near and unrelated texts; some null ids, blank texts and rows that repeat."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 60))] for _ in range(n // 5)]
    rows = []
    for _ in range(n):
        words = list(rng.choice(bases))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        text = " ".join(words) if rng.random() < 0.95 else rng.choice((None, "", " ", "short one"))
        rows.append((None if rng.random() < 0.02 else rng.randint(0, n * 3 // 4), text))
    rows += rng.sample(rows, 20) + [(3, " ".join(bases[0])), (5, " ".join(bases[0])), (5, " ".join(bases[1]))]
    rng.shuffle(rows)
    return rows


def linked_rows(rows):
    """Indexes of rows that link by their texts, each pair once."""
    sets, where, out = [], defaultdict(list), []
    for i, (_, t) in enumerate(rows):
        w = split(lowered(t))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        for x in sets[-1]:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                out.append((i, j))
    return sets, out


@pytest.fixture
def two_hops(monkeypatch):
    """Chunks and buckets of some hundred bytes, so that questions of a small table take both hops."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 400)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 300)
    monkeypatch.setattr(exchange, "FAN_BITS", 2)


def test_op3_two_hops(spark, two_hops):
    rng = random.Random(8)
    rows = [" ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["p q r s t u v w"] * 30 + [None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    size = exchange.text_bytes(df)
    assert exchange.hops(df, size).more >= 3 and size / exchange.CHUNK_BYTES > 2 << exchange.FAN_BITS
    got = [tuple(r) for r in substrings.dedup(df, 4).orderBy("doc_id").select("n_words", "n_removed", "kept").collect()]
    assert got == brute_removed(rows, 4)


def test_op5_two_hops(spark, two_hops):
    rng = random.Random(10)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 40))]
        for _ in range(rng.randint(2, 9)):
            rows.append(" ".join(words))
            words = [*words]
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
    rows += ["Same Text", "same text", "common words that all of these share", "common words that all of these share too", None, ""] * 3
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_exchange_sizes_do_not_grow(spark):
    """Whatever the input, a chunk and a bucket stay the same, no row gets shorter than some hundred bytes, and what a task
    holds (about nine bytes for a byte of a chunk, as measured) stays far below 500 MB."""
    df = spark.range(1)
    for size in (10**9, 10**11, 10**13, 10**14):
        bits, more = exchange.hops(df, size)
        chunks, buckets, asked = size / exchange.CHUNK_BYTES, 1 << (bits + more), 2 * size
        cells = max(1, chunks / (1 << exchange.FAN_BITS)) * (1 << bits)
        assert asked / buckets <= exchange.BUCKET_BYTES * 1.01 and 9 * exchange.CHUNK_BYTES < 100 << 20
        assert asked / (chunks * (1 << bits)) >= 500
        if more:
            assert asked / (cells * (1 << more)) >= 500 and asked / cells <= 16 << 20
            assert 2 * cells / (1 << bits) * 10 <= exchange.BUCKET_BYTES  # what an item of all chunks sends to its bucket


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_op5_repeated_ids(spark, partitions):
    """Components do not depend on how rows are dealt: rows with one id are one node, whatever their texts."""
    rows = repeated_ids(partitions)
    sets, links = linked_rows(rows)
    forest = components.Forest()
    for i, j in links:
        if rows[i][0] is not None and rows[j][0] is not None:
            forest.join(rows[i][0], rows[j][0])
    want = sorted((d is None, d or 0, len(s), -1 if d is None else forest.root(d)) for (d, _), s in zip(rows, sets, strict=True))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want


def test_op5_signature_tree_loses_nothing():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 300), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(120)]
    sizes = np.array([len(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if jaccard.links(sets[i], sets[j], len(sets[i]), len(sets[j]))}
    found = {(min(a, b), max(a, b)) for x, y in jaccard.SignatureTree.of(sets, sizes).pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert want and want <= found
    bits, times = jaccard.stacked([jaccard.bitmap(s) for s in sets])
    assert set(times.tolist()) == {1, 2}
    key = np.array([s.min() for s in sets])
    half = [jaccard.SignatureTree(bits[some], sizes[some], sizes[some], key[some], times[some]) for some in (slice(0, 50), slice(50, 120))]
    both = {(a, b + 50) for x, y in half[0].pairs(half[1]) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert {(i, j) for i, j in want if i < 50 <= j} <= both


@pytest.mark.parametrize("n", [100, 300, 1000, 3000, 10_000])
def test_op5_trees_prune(n):
    """Groups of four sets that link; every group shares a twentieth with the next one, so sizes and numbers of shared
    tokens alone prune nothing."""
    rng = np.random.default_rng(n)
    fresh = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    groups = [fresh(95 * n // 100) for _ in range(64)]
    sets = []
    for g in range(64):
        for _ in range(4):
            own = rng.choice(groups[g], 93 * n // 100, replace=False)
            sets.append(np.unique(np.concatenate([own, groups[(g + 1) % 64][: n // 20], fresh(n // 50)])))
    order = rng.permutation(256)
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    tree = jaccard.SignatureTree.of(sets, size)
    found = {(min(a, b), max(a, b)) for x, y in tree.pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(256) for j in range(i + 1, 256) if order[i] // 4 == order[j] // 4 and jaccard.links(sets[i], sets[j], size[i], size[j])}
    assert len(want) > 300 and want <= found and tree.tests < 0.05 * 256 * 255 / 2
    apart = jaccard.SignatureTree.of([np.unique(fresh(n)) for _ in range(256)], np.full(256, n))
    assert not list(apart.pairs()) and apart.tests == 0


def test_op5_odd_rows(odd, none):
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()}
    assert rows[1] == (0, 1) and rows[2] == (0, 2) and rows[3] == (0, 3) and rows[4] == (1, 4) and rows[5] == (1, 4) and rows[None] == (1, None) and rows[8] == (1, 8)
    assert jaccard.join(odd).count() == odd.count() and jaccard.join(none).count() == 0


@pytest.mark.parametrize("finish", [10**6, 3])
def test_components(spark, finish):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(3), finish).collect()}
    assert got == {x: forest.root(x) for e in edges if e[0] != e[1] for x in e}
    names = [(f"n{a:03}", f"n{b:03}") for a, b in edges]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(names, "a string, b string"), finish).collect()}
    assert got == {f"n{x:03}": f"n{forest.root(x):03}" for e in edges if e[0] != e[1] for x in e}


def test_op6_base_and_gain(spark, sf, texts):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _, _ in texts}
    tokens = {d: [*split(lowered(t)), None] for d, t, _ in texts}
    c = Counter(x for d in tokens if not held[d] for x in tokens[d])
    n, v = sum(c.values()), len(c)
    rows = queries.op6_language_model(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def brute_scores(rows, head, classes):
    """The model of op6 with dictionaries and loops, but for the exchange of the head, which has its own test."""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    tokens = [(d, [*split(lowered(t)), None]) for d, t in rows]
    c = Counter(x for d, ts in tokens if not held[d] for x in ts)
    words = [w for w in c if w is not None and c[w] > 1]
    data, offsets = kernels.utf8(__import__("pyarrow").array(words)) if words else kernels.utf8(__import__("pyarrow").array([""]))
    h = dict(zip(words, kernels.word_hashes(data, offsets[:-1], offsets[1:])[0].tolist(), strict=False))
    top = sorted(words, key=lambda w: (-c[w], h[w]))[:head]
    rank = {w: i for i, w in enumerate(top)}
    bigrams = np.zeros((len(top) + 1, len(top) + 1))
    for d, ts in tokens:
        if not held[d]:
            for x, y in zip([None, *ts], ts, strict=False):
                bigrams[rank.get(x, len(top)), rank.get(y, len(top))] += 1
    of = brown.exchange_classes(bigrams, classes)
    groups = int(of.max()) + 1
    ctx = lambda w: 1 + int(of[rank[w]]) if w in rank else 0
    right = np.zeros((groups + 1, groups + 1))
    for i, w in enumerate([*top, None]):
        for j, v in enumerate([*top, None]):
            right[ctx(w), ctx(v)] += bigrams[i, j]
    value = defaultdict(lambda: np.zeros(groups))
    for d, ts in tokens:
        if not held[d]:
            for i, w in enumerate(ts):
                if w is not None and w not in rank and c[w] > 1:
                    before, after = ctx(ts[i - 1]) if i else 0, ctx(ts[i + 1])
                    for g in range(groups):
                        value[w][g] += math.log((right[before, g + 1] + 0.5) / (right[:, g + 1].sum() + 0.5 * (groups + 1)))
                        value[w][g] += math.log((right[g + 1, after] + 0.5) / (right[g + 1].sum() + 0.5 * (groups + 1)))
    of_word = {w: 2 + int(of[rank[w]]) if w in rank else 2 + int(value[w].argmax()) for w in words}
    of_word[None] = 0
    klass = lambda w: of_word.get(w, 1)
    moves = np.zeros((2 + groups, 2 + groups))
    for d, ts in tokens:
        if not held[d]:
            for x, y in zip([None, *ts], ts, strict=False):
                moves[klass(x), klass(y)] += 1
    each = moves.sum(axis=0)
    share = (each + 0.5) / (each.sum() + 0.5 * len(each))
    once = sum(n == 1 for w, n in c.items() if w is not None)

    def p(x, y):
        move = (moves[klass(x), klass(y)] + 2 * share[klass(y)]) / (moves[klass(x)].sum() + 2)
        own = 1 if y is None else (c[y] + 0.5) / (each[1] + 0.5 * (once + 1)) if klass(y) == 1 else c[y] / each[klass(y)]
        return move * own

    return {d: sum(math.log10(p(x, y)) for x, y in zip([None, *ts], ts, strict=False)) for d, ts in tokens}, p, (moves, each, once, c, klass)


def test_op6_score_equals_a_brute_model(spark, texts):
    rows = [(d, t) for d, t, _ in texts[:120]]
    want, p, (moves, each, once, c, klass) = brute_scores(rows, 30, 6)
    got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 30, 6).collect()}
    assert set(got) == set(want) and all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)
    seen = [*c, "never seen before"]  # probabilities after a word sum to one
    assert sum(p("the", w) for w in seen) == pytest.approx(1, abs=2e-3)


def test_op6_every_word_has_a_class_by_its_contexts(spark):
    """Two kinds of words follow each other in turn; words outside the head join the kind that they behave like."""
    rng = random.Random(3)
    kinds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(rng.choices(kinds[j % 2], weights)[0] for j in range(60))) for i in range(700)]
    _, _, (_, _, _, c, klass) = brute_scores(rows, 8, 2)
    tail = [w for w in c if w is not None and c[w] > 5]
    assert len(tail) > 60 and {klass(w) for w in tail if w[0] == "a"}.isdisjoint({klass(w) for w in tail if w[0] == "b"})
    want = brute_scores(rows, 8, 2)[0]
    got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 8, 2).collect()}
    assert all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)


def test_op6_exchange_raises_likelihood():
    rng = np.random.default_rng(5)
    bigrams = np.zeros((13, 13))
    for _ in range(4000):  # two kinds of words that follow each other in turn
        a = rng.integers(0, 6)
        bigrams[a, 6 + rng.integers(0, 6)] += 1
        bigrams[6 + rng.integers(0, 6), a] += 1
    of = brown.exchange_classes(bigrams, 2)
    assert len(set(of[:6])) == 1 and len(set(of[6:])) == 1 and of[0] != of[6]


def test_op6_odd_rows(odd, none):
    rows = brown.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 1 and brown.score(none).count() == 0


def test_op7_oracle(same):
    same(queries.op7_top_k, topk.SQL)


def test_op7_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (700, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [1, 2]), (950, [10**12] * 6), (951, None)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").where("vector IS NOT NULL")
    got = defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if w and i != q and len(w) == len(v))[:5]
            assert got.get(q, []) == [(i, clip(-s)) for s, i in scores]


@pytest.mark.parametrize("size", [4096, 20])
def test_op7_repeated_rows(spark, duck, monkeypatch, size):
    """Copies of candidates and of queries, against the SQL."""
    monkeypatch.setattr(topk, "CANDIDATES", size)
    rows = [(i, [float(i % 7), float(i % 5) - 2]) for i in range(60)]
    rows += [(7, [90.0, -90.0])] * 5 + [(8, [80.0, -80.0])] * 3 + [(50, rows[50][1])] * 2 + [(50, [-1.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.scaled("embedding", 256).alias("vector"))
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())
    values = ", ".join(f"({i}, {v}::FLOAT[])" for i, v in rows)
    want = sorted(duck.execute(topk.SQL.replace("FROM embeddings", f"FROM (VALUES {values}) t(vec_id, embedding)")).fetchall())
    assert got == want and [r[2] for r in got if r[0] == 0] == [7] * 5


def test_op7_unusable(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [-0.001, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable("embedding")).select("vec_id", topk.scaled("embedding", 256).alias("vector"))
    assert sorted((r["vec_id"], r["vector"]) for r in df.collect()) == [(0, [256, 512]), (5, [-1, 128])]
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 5, -256 + 512 * 128)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_kernels_split_rows_and_long_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kernels, "SPAN", 64)
    texts = ["ab cd " * 40, "", None, "x" * 300 + " y", " lead", "trail "]
    data, offsets = kernels.utf8(pa.array(texts))
    starts, ends, first = kernels.spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in split(t)] and first.tolist() == np.append(0, np.cumsum([len(split(t)) for t in texts])).tolist()
    one, two = kernels.word_hashes(data, starts, ends)
    assert len(set(one.tolist())) == len(set(words)) and len({(a, b) for a, b in zip(one, two, strict=True)}) == len(set(words))
