"""Operator 1: byte-level BPE encoding and decoding.

Every match of the split pattern is encoded by itself. A segment tree over its byte positions holds, at leaf i, the
rank of the pair that begins there, and at each inner node the leftmost pair of least rank below it. The root names the
next merge; the merge changes three leaves at most (its own, the swallowed neighbour's, the live neighbour's on the
left), so each costs a logarithmic number of point updates. Trees of many pieces of like size are kept side by side in
arrays, and one step merges the best pair of each. Pieces are encoded once and kept in a bounded cache of the worker.

Results: a null or empty text has no ids; ids and texts of any length are handled whole, a text at a time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkstream.llm import columns, kernels

#: Pieces of more bytes are encoded one at a time; more cached pieces than the bound empty the cache.
SIDE_BY_SIDE, CACHED = 64, 250_000
_NONE = np.int64(1) << 40


class BytePairs:
    """A vocabulary of byte strings with merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        most = max(ranks.values()) + 1
        self.base = most
        self.single = np.zeros(256, np.int64)
        for b in range(256):
            self.single[b] = ranks[bytes([b])]
        lengths = np.zeros(most, np.int64)
        for t, i in ranks.items():
            lengths[i] = len(t)
        self.lengths, self.starts = lengths, np.append(0, np.cumsum(lengths))
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(most)), np.uint8)
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self._hash()
        self.cache: dict[str, bytes] = {}

    def _hash(self) -> None:
        """An open-addressing table of the pairs; at most a fifth of it is in use."""
        keys = np.array([a * self.base + b for a, b in self.pairs], np.int64)
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        size = 1 << int(5 * max(1, len(keys))).bit_length()
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several, the last one stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, ``_NONE`` for those that never merge."""
        keys = left * self.base + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = 2
        while size <= SIDE_BY_SIDE:
            chosen = np.flatnonzero((lengths <= size) & (lengths > (size >> 1 if size > 2 else 0)))
            for at in range(0, len(chosen), 8192):
                some = chosen[at : at + 8192]
                for i, ids in zip(some.tolist(), self._side_by_side([pieces[i] for i in some.tolist()], lengths[some], size), strict=True):
                    out[i] = ids
            size *= 2
        for i in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
            out[i] = self._alone(pieces[i])
        return out

    def _side_by_side(self, pieces: list[bytes], lengths: np.ndarray, size: int) -> list[bytes]:
        n, shift = len(pieces), size.bit_length() - 1
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        column, place = np.arange(n), np.arange(size)
        token = np.ascontiguousarray(self.single[raw].T)
        live = place[:, None] < lengths[None, :]
        after = np.repeat((place + 1)[:, None], n, axis=1)
        before = np.repeat((place - 1)[:, None], n, axis=1)
        tree = np.full((2 * size, n), _NONE, np.int64)
        for i in range(size - 1):
            at = np.flatnonzero(lengths > i + 1)
            if len(at):
                r = self.rank(token[i, at], token[i + 1, at])
                tree[size + i, at] = np.where(r < _NONE, (r << shift) | i, _NONE)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        active = column[tree[1] < _NONE]
        while len(active):
            best = tree[1, active]
            left, rank = best & (size - 1), best >> shift
            right = after[left, active]
            beyond, first = after[right, active], before[left, active]
            token[left, active] = rank
            live[right, active] = False
            after[left, active] = beyond
            inside = beyond < lengths[active]
            before[beyond[inside], active[inside]] = left[inside]
            self._point(tree, size, shift, right, active, None)
            value = np.full(len(active), _NONE, np.int64)
            value[inside] = self.rank(rank[inside], token[beyond[inside], active[inside]])
            self._point(tree, size, shift, left, active, value)
            has = first >= 0
            self._point(tree, size, shift, first[has], active[has], self.rank(token[first[has], active[has]], rank[has]))
            active = active[tree[1, active] < _NONE]
        ids = token.T[live.T].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=0)) * 4
        return [ids[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def _point(tree: np.ndarray, size: int, shift: int, leaf: np.ndarray, column: np.ndarray, rank: np.ndarray | None) -> None:
        """Set one leaf in each tree and mend the path above it."""
        node = leaf + size
        tree[node, column] = _NONE if rank is None else np.where(rank < _NONE, (rank << shift) | leaf, _NONE)
        for _ in range(shift):
            node = node >> 1
            tree[node, column] = np.minimum(tree[2 * node, column], tree[2 * node + 1, column])

    def _alone(self, piece: bytes) -> bytes:
        """The same for one long piece, node by node over flat arrays: some 40 bytes a byte of the piece."""
        n, none = len(piece), 1 << 62
        shift = (n - 1).bit_length()
        size, mask = 1 << shift, (1 << shift) - 1
        tokens = self.single[np.frombuffer(piece, np.uint8)].astype(np.int64)
        nodes = np.full(2 * size, none, np.int64)
        ranks = self.rank(tokens[:-1], tokens[1:])
        nodes[size : size + n - 1] = np.where(ranks < _NONE, (ranks << shift) | np.arange(n - 1), none)
        top = size
        while top > 1:
            nodes[top >> 1 : top] = np.minimum(nodes[top : 2 * top : 2], nodes[top + 1 : 2 * top : 2])
            top >>= 1
        token, tree, live = array("q", tokens.tobytes()), array("q", nodes.tobytes()), bytearray(b"\1") * n
        del tokens, nodes, ranks
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        get = self.pairs.get

        def point(leaf: int, rank: int | None) -> None:
            node = leaf + size
            value = none if rank is None else rank << shift | leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < value:
                    value = other
                tree[node] = value

        while (value := tree[1]) != none:
            rank, left = value >> shift, value & mask
            right = after[left]
            beyond, first = after[right], before[left]
            token[left], live[right], after[left] = rank, 0, beyond
            point(right, None)
            r = None
            if beyond < n:
                before[beyond] = left
                r = get((rank, token[beyond]))
            point(left, r)
            if first >= 0:
                point(first, get((token[first], rank)))
        return np.frombuffer(token, np.int64)[np.frombuffer(live, bool)].astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian 32-bit integers; new pieces of all of them are encoded together."""
        split = [self.pattern.findall(t) for t in texts]
        here: set[str] = set()
        for pieces in split:
            here.update(pieces)
        new = list(here.difference(self.cache))
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = list(here)
        self.cache.update(zip(new, self.encode_many([p.encode() for p in new]), strict=True))
        get = self.cache.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        for piece in new:  # long pieces rarely come again; without them the cache is bounded in bytes too
            if len(piece) > SIDE_BY_SIDE:
                del self.cache[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        numbers = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(numbers), 1 << 17):
            some = numbers[at : at + (1 << 17)]
            n = self.lengths[some]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.starts[some] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


@cache
def load(path: str, pattern: str) -> BytePairs:
    """The vocabulary of a rank file; once in each worker."""
    with open(path, "rb") as f:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Each document's ids, and digests of the ids and of the bytes they decode to.

    ``path`` is a rank file that every executor has. Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with
    ``keep_ids``, ids (array of int). Null texts count as empty; rows that repeat are encoded each.
    """

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in tables:
            column = batch.column("text").fill_null("")
            _, offsets = kernels.utf8(column)
            for a, b in kernels.slices(offsets, 1 << 20):
                texts = column.slice(a, b - a).to_pylist()
                n, digests, decoded, all_ids = [], [], [], []
                for ids in bpe.encode(texts):
                    n.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if keep_ids:
                        all_ids.append(np.frombuffer(ids, "<i4"))
                out = {"doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if keep_ids:
                    out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    docs = columns.plain(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of each row's ``ids`` (array of int): columns doc_id, decoded (binary). Null ids count as none."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in tables:
            decoded = [bpe.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(decoded, pa.binary())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(batches, f"doc_id {kind}, decoded binary")
