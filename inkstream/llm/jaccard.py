"""Operator 5: n-gram Jaccard join of whole texts by signature trees.

A text's set holds the distinct shingles of five lower-cased words. Texts with equal sets form a class, and one
document stands for each class. The rest is an exact search for pairs of classes with similarity 0.8 or more:

1. The hash exchange tells, for each shingle, in how many classes it occurs, rounded to a power of two. Two sets that
   link share 0.8 of either, so a class with over a fifth of its shingles to itself has no partner and drops out.
2. Classes are dealt to small blocks by a minimum hash of their shared shingles (twice, with two hashes; blocks of a
   frequent minimum are split at random). In a block, a signature tree finds pairs: leaves hold bitmaps of the tokens
   that occur twice or more in the block, as wide as the block's sets ask for; inner nodes, which gather sets of like size
   and like minimum hash, hold the OR of the bitmaps below and the range of sizes; a dual traversal from the root drops
   pairs of nodes whose largest possible overlap is too small for their sizes. Pairs that survive are compared by their
   shingles, unless they are in one component already. This joins most of what belongs together, at a cost linear in a
   group's size.
3. For the rest, each class lists its rarest shingles, as many as two linked sets cannot both miss. Only shingles
   listed by two provisional components or more matter. Their classes meet, again with signature trees. The classes of
   a frequent shingle are split by size, then at random into parts, and only parts whose sizes can link meet. Surviving
   pairs between different components are compared by their shingles, large sets slice by slice. Together with step 2,
   no link between different components is lost.

Results: each row's number of shingles and its component, the least doc_id reachable by links, itself included. Null
texts and texts without words have no shingles and link with nothing; with fewer than five words the whole sequence is
the one shingle. A class is a node of its own with a number of its own, whatever its ids. Rows with one doc_id count as
one document: ``join`` links all classes that share an id, whatever their texts, and ``groups`` does not. A null doc_id
keeps a null component and links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm import columns, exchange, kernels
from inkstream.llm.components import Forest, components
from inkstream.session import discard, materialise, partitions

#: Classes and bytes of shingles in a block of step 2; classes of a shingle in a part of step 3, and rows in a group of
#: shingles there, about; shingles in a slice of a large set; children of a node; bytes of bitmaps looked at together.
BLOCK, BLOCK_BYTES, PART, ROWS, SLICE, FANOUT, LOOK_BYTES = 256, 16 << 20, 1024, 16384, 65536, 8, 4 << 20
#: Sizes of two sets that link differ by a factor of 1.25 at most, so their classes of size are the same or neighbours.
GROWTH = 1.26
_SEEDS = (0x452821E638D01377, 0xBE5466CF34E90C6C)


def sets(texts: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    data, offsets = kernels.utf8(texts)
    data = kernels.lower(data)
    out = []
    for a, b in kernels.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = kernels.spans(part, offsets[a : b + 1] - offsets[a])
        (words,) = kernels.word_hashes(part, starts, ends, 1)
        n = np.diff(first)
        shingles, _ = kernels.window_hashes(words, first, width)
        edges = np.append(0, np.cumsum(np.maximum(n - width + 1, 0)))
        short = np.flatnonzero((n > 0) & (n < width))
        whole = dict(zip(short.tolist(), kernels.sequence_hashes(words, first[short], n[short]), strict=True))
        for i in range(b - a):
            out.append(np.array([whole[i]], np.uint64) if i in whole else np.unique(shingles[edges[i] : edges[i + 1]]))
    return out


def set_hashes(found: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit hashes of each set; equal sets are told by both and their size."""
    return tuple(pa.array(np.array([int(kernels.mix(s ^ np.uint64(seed)).sum(dtype=np.uint64)) for s in found], np.uint64).view(np.int64)) for seed in _SEEDS)


def hashed(texts: pa.Array) -> pa.Array:
    """(one, two) of each text's set, as ``groups`` gives them; for an Arrow function."""
    return pa.StructArray.from_arrays(set_hashes(sets(pa.chunked_array([texts.cast(pa.string())]), 5)), names=["one", "two"])


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap with any partner: 0.8 of the own size, rounded up."""
    return (4 * n + 4) // 5


class SignatureTree:
    """Bitmaps of sets in a hierarchy. ``size`` is a set's size, ``shared`` how many of its tokens the bitmap covers (no
    partner has the others), ``key`` is alike for like sets; a bitmap repeats itself so many ``times``. ``tests`` counts
    the pairs of leaves that were looked at."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, shared: np.ndarray, key: np.ndarray, times: np.ndarray | None = None):
        self.order = np.lexsort((size, key, size_class(size)))
        times = np.ones(len(size), np.int64) if times is None else times
        bits, size, shared, times = bits[self.order], size[self.order], shared[self.order], times[self.order]
        self.levels, self.tests = [leaves(bits, size, shared, times)], 0
        while len(self.levels[-1][0]) > FANOUT:
            bits, low, times, high, shared, slack = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), *(np.minimum.reduceat(x, at) for x in (low, times)), *(np.maximum.reduceat(x, at) for x in (high, shared, slack))))

    @classmethod
    def of(cls, sets: list[np.ndarray], size: np.ndarray) -> SignatureTree:
        """A tree over sets of tokens. Tokens of one set only are left out; the bitmaps are exact if there is room."""
        n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), n)
        tokens, inverse, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        twice = counts > 1
        number = (np.cumsum(twice) - 1)[inverse]
        keep = twice[inverse]
        owner, number = owner[keep], number[keep]
        shared = np.bincount(owner, minlength=len(sets))
        room = max(64, BLOCK_BYTES * 8 // max(1, len(sets)))
        width = min(power_of_two(min(int(twice.sum()), 128 * int(shared.max(initial=0)))), 1 << (room.bit_length() - 1))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        place = number & (width - 1)
        np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        key = likeness(tokens[twice], number, owner, len(sets)) if len(sets) > FANOUT else np.zeros(len(sets), np.int64)
        return cls(bits, size, shared, key)

    def pairs(self, other: SignatureTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members (of this tree, or of this and the other) that may link, in parts."""
        right = other or self
        top = max(len(self.levels), len(right.levels)) - 1
        a, b = (self._level(top), right._level(top))
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a[0])), np.arange(len(b[0])), indexing="ij"))
        stack = [(top, i, j)]
        step = max(1, LOOK_BYTES // max(8, a[0].shape[1] * 8))
        while stack:
            level, i, j = stack.pop()
            if other is None:
                keep = i <= j if level else i < j
                i, j = i[keep], j[keep]
            self.tests += 0 if level else len(i)
            for at in range(0, len(i), step):
                x, y = self._possible(right, level, i[at : at + step], j[at : at + step])
                if not len(x):
                    continue
                if level == 0:
                    yield self.order[x], right.order[y]
                else:
                    stack.append((level - 1, *self._children(right, level, x, y)))

    def _level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def _children(self, right: SignatureTree, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def under(tree: SignatureTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if level >= len(tree.levels):  # the lower tree waits at its top
                return nodes[:, None], np.ones((len(nodes), 1), bool)
            below = nodes[:, None] * FANOUT + np.arange(FANOUT)
            return below, below < len(tree.levels[level - 1][0])

        (a, real_a), (b, real_b) = under(self, x), under(right, y)
        i, j = np.broadcast_arrays(a[:, :, None], b[:, None, :])
        real = real_a[:, :, None] & real_b[:, None, :]
        return i[real], j[real]

    def _possible(self, right: SignatureTree, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of nodes whose largest possible overlap suffices."""
        return possible(self._level(level), right._level(level), i, j)


def leaves(bits: np.ndarray, size: np.ndarray, shared: np.ndarray, times: np.ndarray) -> tuple:
    """The lowest level: bitmaps, least size, repetitions, largest size, shared tokens, and tokens without an own bit."""
    return bits, size, times, size, shared, shared - np.bitwise_count(bits).sum(axis=1, dtype=np.int64) // times


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) of rows of two levels, those that may link: first by sizes and numbers of shared tokens alone, then
    by bitmaps. Where both bitmaps repeat themselves, so do their common bits."""
    (bits_a, *left), (bits_b, *right) = a, b
    (low_a, times_a, high_a, shared_a, slack_a), (low_b, times_b, high_b, shared_b, slack_b) = ([v[i] for v in left], [v[j] for v in right])
    most = np.minimum(np.minimum(high_a, high_b), np.minimum(shared_a, shared_b))
    keep = np.flatnonzero((9 * most >= 4 * (low_a + low_b)) & (5 * high_a >= 4 * low_b) & (5 * high_b >= 4 * low_a))
    i, j, most = i[keep], j[keep], most[keep]
    common = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1, dtype=np.int64) // np.minimum(times_a[keep], times_b[keep])
    most = np.minimum(most, common + np.minimum(slack_a[keep], slack_b[keep]))
    keep = 9 * most >= 4 * (low_a[keep] + low_b[keep])
    return i[keep], j[keep]


def likeness(tokens: np.ndarray, number: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """A number for each set that like sets have in common: sets with two equal minimum hashes, or a chain of such ones,
    come together. ``number`` and ``owner`` (ascending): indexes of the sets' tokens, and whose they are."""
    out, forest = np.arange(sets), Forest()
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    if not len(first):
        return out
    of = owner[first]
    for band in range(4):
        two = []
        for k in (2 * band, 2 * band + 1):
            h = kernels.mix(tokens + np.uint64(_SEEDS[0] * (k + 1) % (1 << 64)))
            two.append(np.minimum.reduceat(h[number], first))
        order = np.lexsort(two)
        same = (two[0][order][1:] == two[0][order][:-1]) & (two[1][order][1:] == two[1][order][:-1])
        for i in np.flatnonzero(same).tolist():
            forest.join(int(of[order[i]]), int(of[order[i + 1]]))
    return np.array([forest.root(i) for i in range(sets)])


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(GROWTH)).astype(np.int64)


def power_of_two(n: int) -> int:
    """The least power of two that is ``n`` or more, 64 at least."""
    return 1 << max(6, (max(n, 1) - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """A set's tokens as bits, four a token or more, between 1024 and 16384."""
    width = min(max(1024, power_of_two(4 * len(tokens))), 16384)
    out = np.zeros(width, np.uint8)
    out[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def stacked(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps side by side, each repeated to the width of the widest, and how many times."""
    width = max(map(len, bitmaps))
    times = np.array([width // len(b) for b in bitmaps], np.int64)
    return np.stack([np.tile(np.frombuffer(b, np.uint64), n) for b, n in zip(bitmaps, times.tolist(), strict=True)]), times


def links(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> bool:
    """True if two sets link; ``a`` and ``b`` hold, ascending, at least all tokens that both could have."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    overlap = int((b[at] == a).sum()) if len(b) else 0
    return 9 * overlap >= 4 * (size_a + size_b)


def _tokens(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint64)


def _block(table: pa.Table) -> pa.Table:
    """Step 2: edges that join what links in one block."""
    ids, size = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
    found, forest = [], Forest()
    if len(ids) > 1:
        tokens = [_tokens(x) for x in table.column("tokens").to_pylist()]
        for x, y in SignatureTree.of(tokens, size).pairs():
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if forest.root(i) != forest.root(j) and links(tokens[i], tokens[j], int(size[i]), int(size[j])):
                    forest.join(i, j)
                    found.append((ids[i], ids[j]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _meet(table: pa.Table) -> pa.Table:
    """Step 3: pairs of one listed shingle that may link, between different provisional components. A table holds many
    rare shingles, or two parts (one, where they are the same) of a frequent one."""
    token, left = table.column("token").to_numpy(), table.column("left").to_numpy()
    order = np.lexsort((left, token))
    table = table.take(pa.array(order))
    ids, size, shared, key, component = (table.column(c).to_numpy() for c in ("doc_id", "n", "shared", "key", "component"))
    bits, times = stacked(table.column("bits").to_pylist())
    two = table.column("two").to_numpy(zero_copy_only=False)
    del table
    edges = np.append(np.flatnonzero(np.append(True, np.diff(token[order]) != 0)), len(order))
    level, found, few = leaves(bits, size, shared, times), [], []

    def tree(at: np.ndarray) -> SignatureTree:
        return SignatureTree(bits[at], size[at], shared[at], key[at], times[at])

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if two[a]:
            sides = [np.arange(a, b)[left[order[a:b]] == k] for k in (1, 0)]
            if len(sides[0]) and len(sides[1]):
                found += [(sides[0][x], sides[1][y]) for x, y in tree(sides[0]).pairs(tree(sides[1]))]
        elif b - a <= 16:
            few.append((a, b))
        else:
            found += [(a + x, a + y) for x, y in tree(np.arange(a, b)).pairs()]
    starts, ends = (np.array(x, np.int64) for x in (zip(*few, strict=True) if few else ((), ())))
    step = max(1, LOOK_BYTES // max(8, bits.shape[1] * 8))
    for far in range(1, 16):  # small groups: each row and the one so many places after it
        rows = np.arange(far, len(order))
        group = np.searchsorted(starts, rows - far, side="right") - 1
        rows = rows[(group >= 0) & (rows < ends[np.maximum(group, 0)])] if len(starts) else rows[:0]
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            some = some[component[some - far] != component[some]]
            found.append(possible(level, level, some - far, some))
    out = [np.zeros((0, 2), np.int64)]
    for x, y in found:
        keep = component[x] != component[y]
        x, y = ids[x[keep]], ids[y[keep]]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens two slices share."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            out.append(len(np.intersect1d(_tokens(x.as_py()), _tokens(y.as_py()), assume_unique=True)))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "needed": batch.column("needed"), "common": pa.array(out, pa.int64())})


def slices(n: Column) -> Column:
    """Into how many slices a set of so many shingles is cut: a power of two."""
    return F.when(n <= SLICE, F.lit(0)).otherwise(F.ceil(F.log2(n / SLICE))).cast("int")


def _sliced(some: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, cut, slice, tokens): a set cut into 2**cut ranges of hashes, of about ``size`` shingles; twice as many
    besides where a larger partner may be cut so."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            for doc, n, body in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                tokens = _tokens(body.as_py())
                cut = 0 if n <= size else math.ceil(math.log2(n / size))
                for c in (cut, cut + 1) if 5 * n > 4 * (size << cut) else (cut,):
                    edges = np.append(np.searchsorted(tokens, np.arange(1 << c, dtype=np.uint64) << np.uint64(64 - c)) if c else [0], len(tokens))
                    parts = [tokens[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(parts), pa.int64()), "cut": pa.array([c] * len(parts), pa.int32()), "slice": pa.array(range(len(parts)), pa.int32()), "tokens": pa.array(parts, pa.binary())})

    return some.select("doc_id", "n", "tokens").mapInArrow(batches, "doc_id long, cut int, slice int, tokens binary")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each listed shingle."""
    for batch in batches:
        listed = [np.frombuffer(x, np.int64) for x in batch.column("listed").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(listed)), [len(x) for x in listed]))
        yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([np.zeros(0, np.int64), *listed])), **{c: batch.column(c).take(at) for c in ("doc_id", "n", "component")}})


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [_tokens(x) for x in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": batch.column("n"), "key": batch.column("key0"), "shared": pa.array([len(t) for t in tokens], pa.int64()), "bits": pa.array([bitmap(t) for t in tokens], pa.binary())})


def classes(rows: DataFrame, width: int) -> DataFrame:
    """Each row's id, chunk, number of shingles and a 128-bit hash of its set."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            found = sets(batch.column("text"), width)
            one, two = set_hashes(found)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "chunk": batch.column(exchange.CHUNK), "n": pa.array([len(s) for s in found], pa.int64()), "one": one, "two": two})

    return rows.mapInArrow(batches, "doc_id long, chunk int, n long, one long, two long")


def candidates(rows: DataFrame, heads: DataFrame, size: int, width: int) -> DataFrame:
    """Step 1: classes that may have a partner, with the tokens that other classes have too, the listed ones, and the
    keys of step 2. From here on ``doc_id`` is the class's node.

    ``heads``: node, and doc_id, chunk, one and two of the row that stands for the class. Of rows with its id only those
    with its set count, so that what a chunk holds besides plays no part.
    """
    hops = exchange.hops(rows, size // 2)
    bits = hops.bits
    chosen = heads.groupBy("chunk").agg(F.collect_list(F.struct("doc_id", "one", "two", "node")).alias("ids")).select("chunk", F.lit(-1).alias("bucket"), F.lit(b"").alias("body"), "ids")

    def own(table: pa.Table, heads: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nodes and sets of this chunk's heads."""
        wanted = {(h["doc_id"], h["one"], h["two"]): h["node"] for h in heads}
        ids = {h["doc_id"] for h in heads}
        part = table.take(pa.array([i for i, x in enumerate(table.column("doc_id").to_pylist()) if x in ids], pa.int64()))
        found = sets(part.column("text"), width)
        nodes, kept = [], []
        for key, s in zip(zip(part.column("doc_id").to_pylist(), *(h.to_pylist() for h in set_hashes(found)), strict=True), found, strict=True):
            if (node := wanted.pop(key, None)) is not None:  # repeated rows count once
                nodes.append(node)
                kept.append(s)
        return np.array(nodes, np.int64), kept

    def ask(key: tuple, table: pa.Table, chosen: pa.Table) -> pa.Table:
        ids = [x for row in chosen.column("ids").to_pylist() for x in row]
        _, found = own(table, ids)
        h = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
        return exchange.short_questions(key[0].as_py(), _at_most_twice(h), bits)

    def counted(items: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        n = np.bincount(group, minlength=groups)
        return np.frexp(n.astype(float))[1].astype(np.uint8)[group]

    def choose(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
        heads = right.filter(pc.less(right.column("bucket"), 0))
        answers = right.filter(pc.greater_equal(right.column("bucket"), 0))
        ids, found = own(table, [x for row in heads.column("ids").to_pylist() for x in row])
        h = _at_most_twice(np.sort(np.concatenate([np.zeros(0, np.uint64), *found])))
        kinds = exchange.lined_up(answers, h, bits, "u1")
        out: dict[str, list] = {c: [] for c in ("doc_id", "n", "tokens", "listed", "key0", "key1")}
        for i, s in zip(ids.tolist(), found, strict=True):
            kind = kinds[np.searchsorted(h, s)]
            shared = kind > 1
            n, more = len(s), int(shared.sum())
            longest = more - int(needed(np.array(n))) + 1
            if longest <= 0 or not more:
                continue
            tokens, kind = s[shared], kind[shared]
            out["doc_id"].append(i)
            out["n"].append(n)
            out["tokens"].append(tokens.tobytes())
            out["listed"].append(tokens[np.lexsort((tokens, kind))[:longest]].tobytes())
            for k, seed in enumerate(_SEEDS):
                out[f"key{k}"].append(int(kernels.mix(tokens ^ np.uint64(seed)).min().view(np.int64)))
        binary = ("tokens", "listed")
        return pa.table({c: pa.array(v, pa.binary() if c in binary else pa.int64()) for c, v in out.items()})

    asked = rows.groupBy(exchange.CHUNK).cogroup(chosen.groupBy("chunk")).applyInArrow(ask, exchange.QUESTION)
    answers = exchange.answered(asked, counted, 5, hops.more)
    right = answers.unionByName(chosen, allowMissingColumns=True)
    return rows.groupBy(exchange.CHUNK).cogroup(right.groupBy("chunk")).applyInArrow(choose, "doc_id long, n long, tokens binary, listed binary, key0 long, key1 long")


def _at_most_twice(h: np.ndarray) -> np.ndarray:
    """Of sorted values, each once, or twice if it occurs more often."""
    if len(h) < 3:
        return h
    keep = np.ones(len(h), bool)
    keep[2:] = h[2:] != h[:-2]
    return h[keep]


def groups(docs: DataFrame, width: int = 5, by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, n, one and two; and a row a class: one, two, n, class_id (the least doc_id with this set) and
    ``group``, the same for all classes that links join, directly or not.

    With ``by_id`` classes that share a doc_id are joined too. Classes hold rows with words and an id.
    """
    docs = columns.plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = exchange.text_bytes(docs)
    rows = exchange.chunked(docs, size)
    every = materialise(classes(rows, width), "classes")
    named = every.where("n > 0 AND doc_id IS NOT NULL")
    heads = named.groupBy("one", "two", "n").agg(F.min(F.struct("doc_id", "chunk")).alias("head"))
    heads = materialise(heads.select("one", "two", "n", "head.doc_id", "head.chunk", F.monotonically_increasing_id().alias("node")), "heads")
    some = materialise(candidates(rows, heads.select("doc_id", "chunk", "one", "two", "node"), size, width), "candidates")
    found = materialise(_first_links(some), "links")
    known = materialise(components(found), "provisional") if not found.isEmpty() else found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    more = _last_links(some, known)
    if by_id:
        more = materialise(more.union(_shared_ids(named.join(heads.select("one", "two", "n", "node"), ["one", "two", "n"]).select("doc_id", "node"))), "all-links")
    if not more.isEmpty():
        known = materialise(components(found.union(more)), "final")
        discard(found)
    discard(some, more)
    each = heads.join(known, "node", "left")
    return every, each.select("one", "two", "n", F.col("doc_id").alias("class_id"), F.coalesce("component", "node").alias("group"))


def _shared_ids(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes that have one doc_id."""
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("doc_id", "a")
    return nodes.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def join(docs: DataFrame, width: int = 5) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, class_id (the least doc_id with the same set) for every row."""
    every, found = groups(docs, width, by_id=True)
    least = found.groupBy("group").agg(F.min("class_id").alias("component_id"))
    found = materialise(found.join(least, "group").select("one", "two", "n", "class_id", "component_id"), "components")
    named = every.where("n > 0 AND doc_id IS NOT NULL").join(found, ["one", "two", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    blank = every.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "n")
    elsewhere = named.join(blank.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    blank = blank.join(elsewhere, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id"), "doc_id")
    none = F.lit(None).cast("long")
    return named.union(blank).union(every.where("doc_id IS NULL").select("doc_id", "n", none, none))


def _first_links(some: DataFrame) -> DataFrame:
    """Step 2."""
    keys = F.posexplode(F.array("key0", "key1")).alias("seed", "key")
    dealt = some.select("doc_id", "n", "tokens", keys)
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("long")
    large = some.select(F.octet_length("tokens").alias("bytes"), keys).groupBy("seed", "key").agg(parts.alias("parts")).where("parts > 1")
    dealt = dealt.join(large, ["seed", "key"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "seed"), F.coalesce("parts", F.lit(1))))
    return dealt.select("seed", "key", "part", "doc_id", "n", "tokens").groupBy("seed", "key", "part").applyInArrow(_block, "a long, b long")


def _met(some: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (token, group, left, two, doc_id, component) of step 3: what meets in one group.

    Rare shingles are gathered by a hash. Of a frequent one, the classes of each class of size are dealt to parts at
    random; a part meets itself, the other parts of its class of size, and those of the next one.
    """
    listed = some.select("doc_id", "n", "listed").join(known, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "listed", F.coalesce("component", "doc_id").alias("component"))
    listed = materialise(listed.mapInArrow(_exploded, "token long, doc_id long, n long, component long"), "listed")
    mixed = listed.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token", "m")
    mixed = materialise(mixed, "mixed")  # apart from the join, whose frequent shingles can then be split
    met = materialise(listed.join(mixed, "token").withColumn("class", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(GROWTH))), "met")
    discard(listed, mixed)
    groups = max(partitions(some.sparkSession), math.ceil(met.where(F.col("m") <= PART).count() / ROWS))
    rare = met.where(F.col("m") <= PART).select("token", F.pmod(F.xxhash64("token"), F.lit(groups)).cast("string").alias("group"), F.lit(1).alias("left"), F.lit(False).alias("two"), "doc_id", "component")
    hot = met.where(F.col("m") > PART)
    sizes = hot.groupBy("token", "class").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    after = sizes.select("token", (F.col("class") - 1).alias("class"), F.col("parts").alias("parts_after"))
    before = sizes.select("token", (F.col("class") + 1).alias("class"), F.col("parts").alias("parts_before"))
    hot = hot.join(sizes, ["token", "class"]).join(after, ["token", "class"], "left").join(before, ["token", "class"], "left")
    hot = hot.withColumn("part", F.pmod(F.xxhash64("doc_id", "token"), "parts"))
    others = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    own = F.transform(others(F.col("parts")), lambda k: F.struct(F.lit(0).alias("step"), F.least("part", k).alias("low"), F.greatest("part", k).alias("high"), (k >= F.col("part")).cast("int").alias("left")))
    up = F.transform(others(F.col("parts_after")), lambda k: F.struct(F.lit(1).alias("step"), F.col("part").alias("low"), k.alias("high"), F.lit(1).alias("left")))
    down = F.transform(others(F.col("parts_before")), lambda k: F.struct(F.lit(-1).alias("step"), k.alias("low"), F.col("part").alias("high"), F.lit(0).alias("left")))
    hot = hot.select("token", "class", "doc_id", "component", F.explode(F.concat(own, up, down)).alias("g"))
    first = F.when(F.col("g.step") < 0, F.col("class") - 1).otherwise(F.col("class"))
    two = (F.col("g.step") != 0) | (F.col("g.low") != F.col("g.high"))
    return rare.union(hot.select("token", F.concat_ws("/", "token", first, F.abs("g.step"), "g.low", "g.high"), "g.left", two, "doc_id", "component"))


def _last_links(some: DataFrame, known: DataFrame) -> DataFrame:
    """Step 3: links that were found, as a table in the shared folder."""
    n = partitions(some.sparkSession)
    signed = some.select("doc_id", "n", "key0", "tokens").mapInArrow(_signed, "doc_id long, n long, key long, shared long, bits binary")
    met = _met(some, known).join(signed, "doc_id").repartition(n, "group")  # by number: the work is not in the bytes
    pairs = materialise(met.groupBy("group").applyInArrow(_meet, "a long, b long").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    sizes = some.select("doc_id", "n")
    both = pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b")
    both = both.withColumns({"cut": F.greatest(slices(F.col("n_a")), slices(F.col("n_b"))), "needed": F.ceil(4 * (F.col("n_a") + F.col("n_b")) / 9)})
    both = both.select("a", "b", "needed", "cut", F.explode(F.expr("sequence(0, shiftleft(1, cut) - 1)")).alias("slice"))
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    parts = _sliced(some.join(wanted, "doc_id", "left_semi"), SLICE)
    for side in ("a", "b"):
        both = both.join(parts.select(F.col("doc_id").alias(side), "cut", "slice", F.col("tokens").alias(f"tokens_{side}")), [side, "cut", "slice"])
    common = both.select("a", "b", "needed", "tokens_a", "tokens_b").mapInArrow(_overlaps, "a long, b long, needed long, common long")
    found = materialise(common.groupBy("a", "b", "needed").agg(F.sum("common").alias("common")).where("common >= needed").select("a", "b"), "more-links")
    discard(pairs)
    return found
