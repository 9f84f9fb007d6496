"""Questions and answers between chunks of documents and buckets of hashes.

Many operators must know, for each hashed item of a document, something about that item in the whole corpus: its count,
whether it occurs elsewhere. A join of all items would shuffle items with their positions. Here documents are dealt to
chunks of a few MB by a hash of their own values. A chunk asks each bucket of the hash space about its distinct items,
in ascending order; the bucket sees the questions of all chunks together and answers in the same order. An answer needs
no keys, so it may be one bit an item. The chunk is computed again and lines the answers up with its distinct items.

Chunks and buckets have a fixed size. A chunk that asked every bucket by itself would send ever shorter rows as the
input grows, so beyond ``1 << FAN_BITS`` buckets questions take two hops (``Hops``): a chunk asks groups of buckets; a cell,
which is what many chunks ask one group, merges their questions and asks the group's buckets; answers come back the same
way. A row keeps some hundred bytes in either hop, and what a task holds stays a few times a chunk or a bucket, up to some
200 TB of text. An item that stands in all chunks reaches its bucket twice from each cell at most.

``sizes`` and ``bucket_bits`` are of a caller that sums more than presence and takes one hop: its chunks and buckets grow
with the square root of the input, so that a row between them keeps ``ROW_ITEMS`` items or more.

Chunks, cells and buckets depend on values alone, so a task that is run again after a lost executor asks and answers the
same; only rows without an id, or where repeated rows are to be dealt out too (``salted``), depend on the partition that
they come from. Questions carry 80 bits of two hashes besides the bucket's own bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm import kernels
from inkstream.session import partitions

#: Bytes of text in a chunk, on average, and of questions in a bucket, at least; items in a row between them.
CHUNK_BYTES, BUCKET_BYTES, ROW_ITEMS = 3 << 20, 6 << 20, 64
#: Groups of buckets that a chunk asks, and chunks in a cell, as a power of two.
FAN_BITS = 13
CHUNK = "__chunk"


class Hops(NamedTuple):
    """Bits of a hash that tell what a chunk asks, and further ones that tell a bucket within it (0: one hop)."""

    bits: int
    more: int


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def sizes(size: int) -> tuple[float, float]:
    """Bytes of text in a chunk and of questions in a bucket for so many bytes of text, at an item of ten bytes for about
    five bytes of text."""
    side = math.sqrt(10 * ROW_ITEMS * size)
    return max(CHUNK_BYTES, side), max(BUCKET_BYTES, side)


def chunked(docs: DataFrame, size: int, salted: bool = False) -> DataFrame:
    """``docs`` with a column ``__chunk``, a function of the id and the text (and of the partition, if there is no id or
    with ``salted``)."""
    n = max(partitions(docs.sparkSession), math.ceil(size / CHUNK_BYTES))
    place = F.spark_partition_id()
    salt = place if salted else F.when(F.col("doc_id").isNull(), place).otherwise(F.lit(-1))
    return docs.withColumn(CHUNK, F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(n)).cast("int"))


def hops(docs: DataFrame, size: int) -> Hops:
    """How chunks of so many bytes of text ask buckets of a fixed size, at one item for about five bytes, of ten bytes each."""
    bits = max(1, math.ceil(math.log2(max(partitions(docs.sparkSession), 2 * size / BUCKET_BYTES))))
    return Hops(min(bits, FAN_BITS), max(0, bits - FAN_BITS))


def bucket_bits(docs: DataFrame, size: int) -> int:
    """The number of buckets, as a power of two; at one item for about five bytes, of ten bytes each."""
    return max(1, math.ceil(math.log2(max(partitions(docs.sparkSession), 2 * size / sizes(size)[1]))))


def questions(chunk: int, h1: np.ndarray, h2: np.ndarray, bits: int, extra: np.ndarray | None = None) -> pa.Table:
    """Rows (bucket, chunk, body) for distinct ascending hashes; ``extra`` adds one little array entry to each item."""
    edges = np.searchsorted(h1, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.append(edges, len(h1))
    full = np.flatnonzero(np.diff(edges))
    high = ((h1 << np.uint64(bits)) | (h2 >> np.uint64(64 - bits))).view(np.uint8).reshape(-1, 8)
    low = h2.astype(np.uint16).view(np.uint8).reshape(-1, 2)
    parts = [high, low]
    if extra is not None:
        parts.append(np.ascontiguousarray(extra).view(np.uint8).reshape(len(h1), -1))
    body = np.concatenate(parts, axis=1)
    offsets = np.append(edges[full], len(h1)) * body.shape[1]
    return pa.table({"bucket": pa.array(full.astype(np.int32)), "chunk": pa.array(np.full(len(full), chunk, np.int32)), "body": kernels.binary_array(body.reshape(-1), offsets)})


def short_questions(chunk: int, h: np.ndarray, bits: int) -> pa.Table:
    """The same with five bytes of one hash, where taking two items for one now and then does no harm."""
    edges = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h))
    full = np.flatnonzero(np.diff(edges))
    body = np.ascontiguousarray((h << np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, 3:])
    offsets = np.append(edges[full], len(h)) * 5
    return pa.table({"bucket": pa.array(full.astype(np.int32)), "chunk": pa.array(np.full(len(full), chunk, np.int32)), "body": kernels.binary_array(body.reshape(-1), offsets)})


QUESTION = "bucket int, chunk int, body binary"
ANSWER = "chunk int, bucket int, body binary"


def bodies(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The items of all rows as a matrix of bytes, and each row's first item (and the end)."""
    column = table.column("body").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(-1, width), (offsets - offsets[0]) // width


def groups(items: np.ndarray) -> tuple[np.ndarray, int]:
    """For each item the number of its group of equal hashes, and how many groups there are."""
    if items.shape[1] == 5:
        high = _high(items)
        order = np.argsort(high, kind="stable")
        new = np.append(True, np.diff(high[order]) > 0) if len(high) else np.zeros(0, bool)
        inverse = np.empty(len(high), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return inverse, int(new.sum())
    high = _high(items)
    low = np.ascontiguousarray(items[:, 8:10]).view(np.uint16).reshape(-1).astype(np.uint64)
    *_, counts, inverse = kernels.distinct(high, low)
    return inverse, len(counts)


Answer = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def answered(asked: DataFrame, answer: Answer, width: int, more: int = 0, bitwise: bool = False) -> DataFrame:
    """Rows (chunk, bucket, body) with the answers to all questions, items of ``width`` bytes.

    ``answer`` gets a bucket's items, each one's group and the number of groups and returns an array with one
    entry an item; ``bitwise`` packs truth values, eight to a byte. With ``more`` bits questions take the second hop; an
    item then reaches ``answer`` twice at most from each cell, however many chunks of it ask.
    """

    def bucket(table: pa.Table) -> pa.Table:
        items, edges = bodies(table, width)
        return _rows(table.column("chunk"), table.column("bucket"), answer(items, *groups(items)), edges, bitwise)

    if not more:
        return asked.groupBy("bucket").applyInArrow(bucket, ANSWER)

    def cell(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A cell's questions by chunk, their edges, each item's group, how often each group asks, and its first item."""
        table = table.sort_by("chunk")
        items, edges = bodies(table, width)
        group, n = groups(items)
        first = np.zeros(n, np.int64)
        first[group[::-1]] = np.arange(len(items))[::-1]
        twice = np.minimum(np.bincount(group, minlength=n), 2)
        return table, edges, group, twice, items[first]

    def parts(items: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """Where each bucket's questions begin among a cell's merged ones (and the end)."""
        place = (_high(items) >> np.uint64(64 - more)).astype(np.int64)
        return np.searchsorted(np.repeat(place, twice), np.arange((1 << more) + 1))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, _, _, twice, items = cell(table)
        edges, merged = parts(items, twice), np.repeat(items, twice, axis=0)
        full = np.flatnonzero(np.diff(edges))
        buckets = (key[1].as_py() << more) + full
        body = kernels.binary_array(merged.reshape(-1), np.append(edges[full], len(merged)) * width)
        return pa.table({"bucket": pa.array(buckets.astype(np.int32)), "chunk": pa.array(np.full(len(full), key[0].as_py(), np.int32)), "part": pa.array(np.full(len(full), key[1].as_py(), np.int32)), "body": body})

    def spread(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, edges, group, twice, items = cell(table)
        begin, answers = parts(items, twice), answers.sort_by("bucket")
        values = []
        for b, body in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True):
            k = b & ((1 << more) - 1)
            n = int(begin[k + 1] - begin[k])
            raw = np.frombuffer(body, np.uint8)
            values.append(np.unpackbits(raw, count=n).reshape(n, 1) if bitwise else raw.reshape(n, -1))
        merged = np.concatenate(values)[np.cumsum(twice) - twice]  # of two equal questions either's answer
        return _rows(table.column("chunk"), table.column("bucket"), merged[group], edges, bitwise)

    placed = asked.withColumns({"cell": F.shiftright("chunk", FAN_BITS), "part": F.col("bucket")})
    sent = placed.groupBy("cell", "part").applyInArrow(ask, QUESTION.replace("body", "part int, body"))
    told = sent.drop("part").groupBy("bucket").applyInArrow(bucket, ANSWER)
    back = told.select(F.col("chunk").alias("cell"), F.shiftright("bucket", more).alias("part"), "bucket", "body")
    return placed.groupBy("cell", "part").cogroup(back.groupBy("cell", "part")).applyInArrow(spread, ANSWER)


def _high(items: np.ndarray) -> np.ndarray:
    """The leading hash of items, as numbers in their order."""
    if items.shape[1] == 5:
        wide = np.zeros((len(items), 8), np.uint8)
        wide[:, 3:] = items
        return wide.view(np.uint64).reshape(-1)
    return np.ascontiguousarray(items[:, :8]).view(np.uint64).reshape(-1)


def _rows(chunks: pa.ChunkedArray, buckets: pa.ChunkedArray, values: np.ndarray, edges: np.ndarray, bitwise: bool) -> pa.Table:
    """Answers as rows, cut at the edges."""
    if bitwise:
        packed = [np.packbits(values[a:b].reshape(-1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        offsets = np.append(0, np.cumsum([len(p) for p in packed]))
        body = kernels.binary_array(np.concatenate(packed), offsets)
    else:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1)
        body = kernels.binary_array(raw, edges * (len(raw) // max(1, len(values))))
    return pa.table({"chunk": chunks, "bucket": buckets, "body": body})


def lined_up(answers: pa.Table, h1: np.ndarray, bits: int, dtype: str | None) -> np.ndarray:
    """The answers to a chunk's distinct ascending hashes, in their order; ``dtype`` None: truth values, packed."""
    edges = np.append(np.searchsorted(h1, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h1))
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True))
    full = np.flatnonzero(np.diff(edges))
    if dtype is None:
        parts = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=int(edges[b + 1] - edges[b])) for b in full.tolist()]
    else:
        parts = [np.frombuffer(got[b], dtype) for b in full.tolist()]
    if not parts:
        return np.zeros(0, np.uint8 if dtype is None else dtype)
    return np.concatenate(parts)
