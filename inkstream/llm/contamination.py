"""Operator 11: benchmark decontamination by Wu-Manber multi-pattern search.

Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. Every ``width`` consecutive
words of an item are a window; an item of fewer words, but not none, is one window. A text is written as its words with one
space before, between and after them, so that a window's occurrences are occurrences of a byte string.

Windows are split by length into classes, so that short ones do not shorten the others' shifts. A class looks at the first
m bytes of its windows, m being the shortest one's length (128 at most). A table says for each hashed block of some bytes
how far the search may move on when that block ends the m bytes under it: past every position that no window can begin
at. Where the shift is zero, the block's bucket lists the windows that may stand there, and their bytes are compared.
Texts are cut into lanes which all move at once, each by its own shift.

Distinct windows are dealt to groups of about ``GROUP_BYTES``; a group is collected, broadcast and searched in one pass
over the documents, which are never shuffled. One group does for all but huge benchmarks; ``PASSES`` groups follow each
other in one stage, before documents are written to the shared folder for the next ones.

Results: null texts have no words. Rows that repeat give repeated rows; items that repeat or share an id count once. Items
without an id mark words but are not listed. A row's memory is about six times its text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from inkstream.llm import columns, kernels
from inkstream.session import discard, materialise

#: Bytes of windows and item ids in a group, about; groups searched in one stage; bytes of text searched at once.
GROUP_BYTES, PASSES, SLICE = 16 << 20, 4, 4 << 20
#: Text positions of a lane; window bytes that shifts look at, at most; pairs of position and window compared at once;
#: windows of an item in a batch.
LANE, LOOK, PAIRS, SOME = 1024, 128, 1 << 18, 1 << 14
MADE = ("n_words", "n_hit", "spans", "items")
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words with a space before, between and after them, and where each row begins (and the end)."""
    edges = offsets + 2 * np.arange(len(offsets))
    padded = kernels.lower(np.insert(data, np.repeat(offsets, 2), 0x20))
    inside = _WORD[padded]
    padded[~inside] = 0x20
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[edges + 1] = True  # the space before a row's first word
    keep[edges[-1] + 1] = False
    counts = np.add.reduceat(keep, edges[:-1] + 1, dtype=np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
    return padded[keep], np.append(0, np.cumsum(counts))


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as numbers; eight zeros are thought behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), 0, (1,))


class Shifts:
    """The tables of one class of windows: ``data`` and ``offsets`` hold their bytes, ``ids`` their numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        lengths = np.diff(offsets)
        self.m = m = int(min(lengths.min(), LOOK))
        places = len(ids) * m
        self.block = b = min(8, max(1, m // 2), max(2, math.ceil(math.log(4 * places, 6))))
        self.bits = min(22, max(10, (4 * places).bit_length()))
        self.mask = np.uint64((1 << 8 * b) - 1)
        words, first = _eight(data), offsets[:-1]
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint8)
        for j in range(m - b + 1):
            last = self._hash(words[first + j])
            self.shift[last] = m - b - j
        order = np.argsort(last, kind="stable")
        self.hashes, at = np.unique(last[order], return_index=True)
        self.buckets = np.append(at, len(order))
        self.first, self.length, self.ids, self.words = first[order], lengths[order], ids[order], words
        self.head = words[self.first] & self._low(self.length)
        self.tail = words[self.first + np.maximum(self.length - 8, 0)]

    def _hash(self, eight: np.ndarray) -> np.ndarray:
        return ((eight & self.mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    @staticmethod
    def _low(length: np.ndarray) -> np.ndarray:
        """Masks of the first eight bytes of so long windows."""
        return np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(length, 8))).astype(np.uint64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and window number of all occurrences in a text, given as ``_eight`` gives it."""
        n = len(words) - 1
        at = np.arange(0, max(0, n - self.m + 1), LANE)
        end = np.minimum(at + LANE, n - self.m + 1)
        stops, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(at):
            h = self._hash(words[at + (self.m - self.block)])
            step = self.shift[h]
            if len(zero := np.flatnonzero(step == 0)):
                stops.append(at[zero])
                keys.append(h[zero])
            at = at + np.maximum(step, 1)
            if not (live := at < end).all():
                at, end = at[live], end[live]
        return self._confirmed(words, np.concatenate(stops), np.concatenate(keys))

    def _confirmed(self, words: np.ndarray, stops: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.searchsorted(self.hashes, keys)
        begin, sizes = self.buckets[bucket], self.buckets[bucket + 1] - self.buckets[bucket]
        total, out = np.cumsum(sizes), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        i = 0
        while i < len(stops):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
            some = sizes[i:j]
            k = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin[i:j], some)
            p = np.repeat(stops[i:j], some)
            good = np.flatnonzero((words[p] & self._low(self.length[k])) == self.head[k])
            p, k = p[good], k[good]
            good = np.flatnonzero(p + self.length[k] < len(words))
            p, k = p[good], k[good]
            good = np.flatnonzero((self.length[k] < 8) | (words[p + np.maximum(self.length[k] - 8, 0)] == self.tail[k]))
            p, k, o = p[good], k[good], 8
            while len(k) and o < self.length[k].max() - 8:
                open_ = o < self.length[k] - 8
                good = np.flatnonzero(~open_ | (words[np.where(open_, p + o, 0)] == self.words[np.where(open_, self.first[k] + o, 0)]))
                p, k, o = p[good], k[good], o + 8
            out[0].append(p)
            out[1].append(self.ids[k])
            i = j
        return np.concatenate(out[0]), np.concatenate(out[1])


class Searcher:
    """All classes of one group of windows; ``group`` is what ``packed`` made."""

    def __init__(self, group: dict):
        data, offsets = np.frombuffer(group["data"], np.uint8), group["offsets"]
        self.words, self.edges, self.items, self.names = group["words"], group["edges"], group["items"], group["names"]
        lengths = np.diff(offsets)
        kind = np.digitize(lengths, (8, 16, 32, 64))
        self.classes = []
        for c in np.unique(kind).tolist():
            at = np.flatnonzero(kind == c)
            parts = np.repeat(offsets[at] - np.append(0, np.cumsum(lengths[at])[:-1]), lengths[at]) + np.arange(lengths[at].sum())
            self.classes.append(Shifts(data[parts], np.append(0, np.cumsum(lengths[at])), at))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, list[str]]]]:
        """Words of each row; and of rows with occurrences, hit intervals of words and items."""
        text, first = normalised(data, offsets)
        words = _eight(text)
        places = np.flatnonzero(text == 0x20)
        row = np.searchsorted(places, first)
        n_words = np.diff(row) - 1
        found = [c.search(words) for c in self.classes]
        begin, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        if not len(begin):
            return n_words, {}
        at = np.searchsorted(places, begin)
        own = np.searchsorted(row, at, side="right") - 1
        order = np.argsort(own, kind="stable")
        at, own, which = at[order], own[order], which[order]
        hits = {}
        edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = int(own[a])
            here = np.unique(which[a:b])
            listed = np.unique(np.concatenate([self.items[self.edges[w] : self.edges[w + 1]] for w in here.tolist()]))
            hits[i] = (merged(np.stack([at[a:b] - row[i], at[a:b] - row[i] + self.words[which[a:b]]], axis=1)), [self.names[x] for x in listed.tolist()])
        return n_words, hits


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint ascending intervals [first, end) that cover the same words; neighbours become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _windows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item").to_pylist()
            data, offsets = kernels.utf8(batch.column("text"))
            for a, b in kernels.slices(offsets):
                text, first = normalised(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw, places = text.tobytes(), np.flatnonzero(text == 0x20)
                row = np.searchsorted(places, first)
                for i in range(b - a):
                    here = places[row[i] : row[i + 1]].tolist()
                    n = min(width, len(here) - 1)
                    for j in range(0, len(here) - n, SOME) if n > 0 else ():
                        found = sorted({raw[here[k] : here[k + n] + 1] for k in range(j, min(j + SOME, len(here) - n))})
                        yield pa.RecordBatch.from_pydict({"window": pa.array(found, pa.binary()), "words": pa.array([n] * len(found), pa.int32()), "item": pa.array([names[a + i]] * len(found), pa.string())})

    return rows


def packed(table: pa.Table) -> dict:
    """Windows of a table (window, words, item) and each one's items, as few arrays."""
    window = table.column("window").combine_chunks()
    coded = (pa.concat_arrays(window.chunks) if isinstance(window, pa.ChunkedArray) else window).dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    words = np.zeros(len(distinct), np.int64)
    words[code] = table.column("words").to_numpy()
    item = table.column("item").to_pylist()
    names = sorted({x for x in item if x is not None})
    place = {x: i for i, x in enumerate(names)}
    pairs = np.array(sorted({(c, place[x]) for c, x in zip(code.tolist(), item, strict=True) if x is not None}), np.int64).reshape(-1, 2)
    lengths = np.array([len(x) for x in distinct.to_pylist()], np.int64)
    return {"data": b"".join(distinct.to_pylist()), "offsets": np.append(0, np.cumsum(lengths)), "words": words, "edges": np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), "items": pairs[:, 1].copy(), "names": names}


def groups(benchmark: DataFrame, width: int, item_id: str = "item_id", most: int | None = None) -> Iterator[dict]:
    """The packed windows of a benchmark (columns ``item_id`` and text), a group at a time; none if it has no words."""
    rows = columns.plain(benchmark, item_id, "text").select(F.col(item_id).cast("string").alias("item"), "text")
    windows = materialise(rows.mapInArrow(_windows(width), "window binary, words int, item string").distinct(), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    n = math.ceil(size / (most or GROUP_BYTES))
    for g in range(n):
        table = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == g).toArrow()  # about ``most`` bytes
        if table.num_rows:
            yield packed(table)
    discard(windows)


_compiled: dict[str, Searcher] = {}


def _search(docs: DataFrame, group: dict | None, keep: list[str]) -> DataFrame:
    """One pass: ``docs`` with the results of one group, added to those of the groups before."""
    shared, name = docs.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex
    before = MADE[0] in docs.columns

    def searched(batch: pa.RecordBatch, searcher: Searcher) -> pa.RecordBatch:
        data, offsets = kernels.utf8(batch.column("text"))
        rows = batch.num_rows
        n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        spans: list[list] = [[] for _ in range(rows)]
        items: list[list[str]] = [[] for _ in range(rows)]
        if before:
            n_hit = batch.column("n_hit").to_numpy().copy()
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        for a, b in kernels.slices(offsets, SLICE):
            n_words[a:b], hits = searcher.rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i, (own, listed) in hits.items():
                if before and spans[a + i]:
                    own = merged(np.concatenate([np.array(spans[a + i], np.int64), own]))
                    listed = sorted({*items[a + i], *listed})
                n_hit[a + i] = (own[:, 1] - own[:, 0]).sum()
                spans[a + i], items[a + i] = own.tolist(), listed
        made = (pa.array(n_words), pa.array(n_hit), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *MADE])

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _compiled:
            _compiled.clear()
            _compiled[name] = Searcher(shared.value)
        for batch in tables:
            yield searched(batch, _compiled[name])

    kinds = (LongType(), LongType(), ArrayType(ArrayType(LongType())), ArrayType(StringType()))
    return docs.mapInArrow(batches, StructType([docs.schema[c] for c in keep] + [StructField(n, k) for n, k in zip(MADE, kinds, strict=True)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep_text: bool = True, group_bytes: int | None = None) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit (words inside any occurrence), spans (array of [first word, end)
    intervals of hit words) and items (ids, as strings in ascending order, whose windows occur).

    Other columns pass through whatever their names, but those with the new names are replaced; ``text`` itself is left out
    if ``keep_text`` is false.
    """
    docs = docs.select(*[columns.named(c) for c in docs.columns if c not in MADE])
    rows = columns.plain(docs, "text")
    own, waiting, passes = rows.columns, _NOTHING, 0
    for group in groups(benchmark, width, most=group_bytes):  # one ahead: the last pass may leave the text out
        if passes:
            rows = _search(rows, waiting, own)
        if passes and passes % PASSES == 0:
            rows = materialise(rows, "searched")
        waiting, passes = group, passes + 1
    rows = _search(rows, waiting, [c for c in own if c != "text" or keep_text])
    return rows.toDF(*[c for c, plain in zip(docs.columns, own, strict=True) if plain != "text" or keep_text], *MADE)


#: A benchmark without words.
_NOTHING = {"data": b"", "offsets": np.zeros(1, np.int64), "words": np.zeros(0, np.int64), "edges": np.zeros(1, np.int64), "items": np.zeros(0, np.int64), "names": []}

#: The query for DuckDB, with windows as text.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM g JOIN p USING (n, k)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""
