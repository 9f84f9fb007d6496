"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream.llm import clusters, contamination, merkle, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_clusters", "op13_merkle"])
def test_oracle(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


# operator 11


def brute_hits(docs, items, width):
    """Words, hit words and items of each text, window by window."""
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes, out = {len(k) for k in windows}, []
    for text in docs:
        w, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def spread(spans):
    return {j for a, b in spans for j in range(a, b)}


@pytest.mark.parametrize("seed,width,most", [(1, 3, None), (2, 10, None), (3, 3, 2000), (4, 4, 300)])
def test_op11_brute(spark, monkeypatch, seed, width, most):
    monkeypatch.setattr(contamination, "SOME", 1 << 14 if most is None else 3)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAB9é") for _ in range(rng.choice((1, 1, 2, 3, 9))))
    text = lambda n: "".join(word() + rng.choice((" ", ", ", "\n", "--")) for _ in range(n))
    items = [(i % 40, text(rng.randint(0, 25))) for i in range(60)] + [(None, "a b c"), (7, None), (8, "..."), (9, "x" * 300), (10, "solo")]
    docs = [text(rng.randint(0, 120)) for _ in range(60)] + [None, "", "!!", "x" * 300, "before " + "x" * 300 + " solo", "a b c", " ".join(t or "" for _, t in items)]
    docs += [docs[3] + t for _, t in items[:20]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = contamination.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string"), width, group_bytes=most).orderBy("doc_id").collect()
    want = brute_hits(docs, items, width)
    assert [(r["n_words"], r["n_hit"], list(r["items"])) for r in got] == want
    assert all(len(spread(r["spans"])) == r["n_hit"] and all(a[1] < b[0] for a, b in zip(r["spans"], r["spans"][1:], strict=False)) for r in got)
    assert [r["text"] for r in got] == docs
    assert any(len(r["items"]) > 1 for r in got) and any(r["n_hit"] == 0 for r in got)


def test_op11_classes():
    """Windows of all lengths, from three bytes up, found at once by lanes that begin anywhere."""
    rng = random.Random(5)
    text = " " + " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(3000)) + " "
    places = [i for i, c in enumerate(text) if c == " "]
    listed = sorted({text[a : b + 1] for n in (1, 2, 5, 10, 40) for a, b in ((places[i], places[i + n]) for i in rng.sample(range(len(places) - n), 25))})
    table = contamination.pa.table({"window": contamination.pa.array([x.encode() for x in listed], contamination.pa.binary()), "words": contamination.pa.array([x.count(" ") - 1 for x in listed], contamination.pa.int32()), "item": contamination.pa.array([str(i) for i in range(len(listed))])})
    searcher = contamination.Searcher(contamination.packed(table))
    assert len(searcher.classes) == 5
    raw = np.frombuffer(text.encode(), np.uint8)
    found = {(int(p), int(k)) for c in searcher.classes for p, k in zip(*c.search(contamination._eight(raw)), strict=True)}
    lengths = np.diff(contamination.packed(table)["offsets"])
    data = contamination.packed(table)["data"]
    starts = np.append(0, np.cumsum(lengths))
    want = {(m, k) for k in range(len(listed)) for w in [data[starts[k] : starts[k + 1]].decode()] for m in range(len(text)) if text.startswith(w, m)}
    assert found == want


def test_op11_odd(spark, odd, none):
    items = spark.createDataFrame([("word word", 1, "z"), (None, 2, "z"), ("one", 3, "z"), ("日本語", 4, "z")], "text string, item_id long, chunk string")
    from tests.llm.conftest import ODD

    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], list(r["items"])) for r in contamination.decontaminate(odd, items, 2).collect())
    assert got == sorted((x[0] or 0, *b) for x, b in zip(ODD, brute_hits([x[1] for x in ODD], [(1, "word word"), (3, "one"), (4, "日本語")], 2), strict=True))
    assert contamination.decontaminate(none, items, 2).count() == 0
    clean = contamination.decontaminate(odd, items.limit(0), 2, keep_text=False)
    assert "text" not in clean.columns and clean.where("n_hit > 0").count() == 0 and clean.count() == len(ODD)


# operator 12


def brute_lloyd(vectors, k, rounds, salt="2:"):
    """Exact Lloyd over all rows, one by one: (vec_id, vector) -> cluster, distance; and the centroids."""
    order = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"{salt}{v[0]}".encode()).hexdigest(), v[0] or 0))
    cents = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in vectors]
        for c in range(len(cents)):
            members = [x for (_, x), o in zip(vectors, own, strict=True) if o == c]
            if members:
                cents[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return [near(x)[::-1] for _, x in vectors], cents


@pytest.mark.parametrize("scale", [1.0, 3e4, 2e6, 3e9])
def test_op12_brute(spark, scale):
    rng = random.Random(int(scale))
    few = [[rng.choice((-1, 1)) * rng.random() * scale for _ in range(4)] for _ in range(30)]
    rows = [(i, few[min(int(rng.expovariate(0.2)), 29)]) for i in range(200)] + [(None, few[0]), (5, few[1]), (5, few[1])]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    bad = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0, float("inf"), 2.0, 3.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int")
    got = clusters.cluster(df, 6, 3, dims=4).collect()
    want, cents = brute_lloyd(whole, 6, 3)
    spread_ = Counter()
    for c, d in want:
        spread_[c] += d
    cap = (1 << 63) - 1
    told = [(i, c, min(d, cap), min(spread_[c], cap), min(sum(spread_.values()), cap), sha(",".join(map(str, cents[c])))) for (i, _), (c, d) in zip(whole, want, strict=True)]
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:3]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(told, key=key)


def test_op12_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters.cluster(none, 4, 2).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in clusters.cluster(two, 4, 2, dims=2).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}


def test_op12_pack():
    rows = np.array([[0, -1], [32767, -32768], [32768, 0], [0, -32769], [1 << 31, 0], [-(1 << 31), 5], [(1 << 63) - 1, -(1 << 63)]], np.int64)
    cells = clusters.pack(rows)
    assert [len(c) for c in cells] == [4, 4, 8, 8, 16, 8, 16]
    assert (clusters.unpack(cells, 2) == rows).all()
    assert clusters.floors(np.array([1e300, -1e300, 0.999, -0.001]), 256).tolist() == [(1 << 63) - 1, -(1 << 63), 255, -1]


# operator 13


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha(*at[i : i + 2]) for i in range(0, len(at), 2)])
    return levels


def brute_path(levels, i):
    """Siblings by level, "" where there is none."""
    out = []
    for at in levels[:-1]:
        out.append(at[i ^ 1] if i ^ 1 < len(at) else "")
        i >>= 1
    return out


def leaf_of(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: brute_levels([x[2] for x in groups[g].sort(key=lambda x: x[:3]) or groups[g]]) for g in langs}
    top = brute_levels([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(groups[g]):
            path, places = brute_path(trees[g], i) + brute_path(top, j), [i >> h for h in range(len(trees[g]) - 1)] + [j >> h for h in range(len(top) - 1)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4])
            for other, place in zip(path, places, strict=True):
                node = sha(node) if not other else sha(other, node) if place % 2 else sha(node, other)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(*path), path, node, node == top[-1][0]))
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(df, bits):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(df, FIELDS, tampered=hit, changed={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, bits=bits).collect()
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], list(r["proof"]), r["folded_root"], r["verified"]) for r in rows]


@pytest.mark.parametrize("bits", [1, 2, 3, 9])
def test_op13_brute(spark, bits):
    """Groups of 1 to 70 leaves: whole blocks, part blocks, several tiers; and nine groups above."""
    rng = random.Random(bits)
    sizes = {"a": 1, "b": 2, "ä": 3, None: 4, "": 5, "B": 8, "long": 70, "c": 33, "d": 17}
    rows = [(len(str(lang)) * 1000 + i * 3, rng.choice((None, "s", "")), lang, rng.choice((None, i, (1 << 63) - 1)), rng.choice((None, "", "t" * i, "ü日"))) for lang, n in sizes.items() for i in range(n)]
    rows += [(None, "s", "long", 1, "x"), (None, None, "long", 2, "y"), *([(1007, "s", "a", 1, "same")] * 3), (1007, "s", "a", 1, "other")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, g string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:6])
    assert sorted(manifest(df, bits), key=key) == sorted(brute_manifest(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_op13_traversal(n):
    """Paths equal those read off the whole tree, and stacks stay as small as the tree is high."""
    leaves = [sha(str(i)) for i in range(n)]
    levels = brute_levels(leaves)
    assert [[x or "" for x in p] for p in merkle.traversal(leaves, merkle.depth(n))] == [brute_path(levels, i) for i in range(n)]
    assert merkle.block_root(leaves, merkle.depth(n)) == levels[-1][0]
    stack = merkle.Treehash(leaves, 0, merkle.depth(n))
    most = 0
    while stack.step():
        most = max(most, len(stack.stack))
    assert most <= merkle.depth(n) + 1


def test_op13_odd(spark, odd, none):
    from tests.llm.conftest import ODD

    got = manifest(odd, 2)
    want = brute_manifest([(x[0], x[3], x[2], x[4], x[1]) for x in ODD])
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:6])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert manifest(none, 2) == []
