"""Operator 2: token counts, and the ids of whole texts for packing.

The library encodes batches in Arrow functions and only lengths leave them. Batches hold a like number of bytes, not of
rows, and texts are split at boundaries that no token crosses: at white space where the tokenizer drops it, before a
single space where that space leads the next word. Between such boundaries the tokens of a piece depend on the piece
alone, so each distinct piece of a batch is encoded once, in one call, and kept in a bounded cache of the worker.
Tokenizers without such a boundary get whole texts.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstream.llm import columns, kernels

#: Bytes in a batch (a longer text makes a batch of its own); slots of the worker's cache, how many may be used, and how
#: many ids it may hold before it starts anew.
BATCH_BYTES, SLOTS, FULL, MOST_IDS = 1 << 20, 1 << 21, 1_300_000, 8_000_000
_LEADING = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z])")


def boundary(path: str) -> str | None:
    """Where texts can be split: "dropped" white space, a "leading" space, or None (nowhere)."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        steps = json.load(f).get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    if any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s\p{L}" in (r := s["pattern"].get("Regex", "")) and " ?" not in r for s in steps):
        return "dropped"
    if any(s.get("type") == "ByteLevel" and s.get("use_regex", True) and not s.get("add_prefix_space") for s in steps):
        return "leading"
    return None


class Memo:
    """The ids of pieces that were encoded lately: an open-addressing table over two hashes of a piece, in arrays.

    When it is ``FULL``, or holds ``MOST_IDS`` ids, it starts anew, so its memory is bounded: about 24 bytes a slot and four
    an id.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.used, self.filled = 0, 0
        self.one, self.two = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.start, self.length = np.zeros(SLOTS, np.uint32), np.full(SLOTS, -1, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each piece's slot, or -1."""
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.full(len(one), -1, np.int64)
        rest = np.arange(len(one))
        while len(rest):
            s = slot[rest]
            there = self.length[s] >= 0
            hit = there & (self.one[s] == one[rest]) & (self.two[s] == two[rest])
            out[rest[hit]] = s[hit]
            rest = rest[there & ~hit]
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[list[int]]) -> None:
        """Enter distinct pieces that are not there."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        start = (self.used + np.cumsum(lengths) - lengths).astype(np.uint32)
        self.used += total
        self.filled += len(ids)
        rest, slot = np.arange(len(ids)), (one & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(rest):
            s = slot[rest]
            free = np.flatnonzero(self.length[s] < 0)
            first = free[np.unique(s[free], return_index=True)[1]]
            won, at = rest[first], s[first]
            self.one[at], self.two[at], self.start[at], self.length[at] = one[won], two[won], start[won], lengths[won]
            rest = np.delete(rest, first)
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)


class Encoder:
    """One tokenizer in one worker."""

    def __init__(self, path: str):
        self.split_at = boundary(path)
        self.memo = Memo()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.batch = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of some texts, and each text's first piece (and the end)."""
        if self.split_at == "dropped":
            return kernels.spans(data, offsets)
        starts = offsets[:-1]
        if self.split_at == "leading":
            raw = data.tobytes()
            cuts = np.array([m.start() for m in _LEADING.finditer(raw)], np.int64)
            starts = np.union1d(starts, cuts)
        ends = np.append(starts[1:], len(data))
        starts, ends = starts[ends > starts], ends[ends > starts]
        return starts, ends, np.searchsorted(starts, offsets)

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece of some texts, after encoding those that are new; and each text's first piece."""
        starts, ends, first = self.pieces(data, offsets)
        one, two = kernels.word_hashes(data, starts, ends)
        slot = self.memo.find(one, two)
        new = np.flatnonzero(slot < 0)
        if len(new):
            a, b, at = self._distinct(one, two, new)
            if self.memo.filled + len(at) > FULL or self.memo.used > MOST_IDS:
                self.memo.clear()
                a, b, at = self._distinct(one, two, np.arange(len(one)))
                new = np.arange(len(one))
            for k in range(0, len(at), 4096):
                some = at[k : k + 4096]
                self.memo.add(a[k : k + 4096], b[k : k + 4096], self.batch([data[starts[i] : ends[i]].tobytes().decode() for i in some.tolist()]))
            slot[new] = self.memo.find(one[new], two[new])
        return slot, first

    @staticmethod
    def _distinct(one: np.ndarray, two: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, _, inverse = kernels.distinct(one[some], two[some])
        at = np.empty(len(a), np.int64)
        at[inverse] = some
        return a, b, at

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        slot, first = self.slots(data, offsets)
        total = np.append(0, np.cumsum(self.memo.length[slot], dtype=np.int64))
        return np.diff(total[first])

    def all_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of the texts in it."""
        slot, first = self.slots(data, offsets)
        n = self.memo.length[slot].astype(np.int64)
        ends = np.append(0, np.cumsum(n))
        ids = self.memo.ids[np.repeat(self.memo.start[slot].astype(np.int64) - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[first]


@cache
def load(path: str) -> Encoder:
    return Encoder(path)


def balanced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with a like number of bytes; their texts' bytes and offsets (null: empty)."""
    data, offsets = kernels.utf8(batch.column("text"))
    for a, b in kernels.slices(offsets, BATCH_BYTES):
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit for each row; a null text counts as empty.

    ``path``: a tokenizer file that every executor has (.json or .model). Rows that repeat are counted each; other
    columns of ``docs`` play no part.
    """

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for table in tables:
            for part, data, offsets in balanced(table):
                n = encoder.lengths(data, offsets)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    docs = columns.plain(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
