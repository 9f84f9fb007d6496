"""Operator 3: substring dedup.

All windows of a fixed number of words get Rabin-Karp hashes (two, from prefix sums over word hashes). Chunks of
documents ask the buckets of the hash space which of their windows start more than once in the whole input; a window
that a chunk holds several times is asked twice. The answer is one bit a window. Repeated windows of a document merge
into maximal intervals of words, which are removed.

Results: null and empty texts have no words; texts shorter than a window keep all words; rows that repeat remove each
other's windows (the same row twice is two places); kept words are joined by one space. Windows are judged on the input.
Equal windows are told by 80 or more bits of two independent hashes, so unequal windows are taken for equal with a
chance of 2**-80 a pair.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from inkstream.llm import columns, exchange, kernels


def _windows(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all windows of a chunk, each one's first word, and the first word of each row (and the end)."""
    data, offsets = kernels.utf8(texts)
    one, two, at, rows = [], [], [], [np.zeros(1, np.int64)]
    words = 0
    for a, b in kernels.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = kernels.spans(part, offsets[a : b + 1] - offsets[a])
        h1, h2 = kernels.word_hashes(part, starts, ends)
        w1, begin = kernels.window_hashes(h1, first, width, 0)
        one.append(w1)
        two.append(kernels.window_hashes(h2, first, width, 1)[0])
        at.append(begin + words)
        rows.append(first[1:] + words)
        words += len(starts)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *one]), np.concatenate([none, *two]), np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate(rows)


def dedup(docs: DataFrame, width: int = 35, digest: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed, removed (array of [first word, end) intervals) and kept.

    ``kept`` is the text that is left, or with ``digest`` its SHA-256 (and ``text`` itself is left out). Other columns pass
    through whatever their names, but those with the new names are replaced.
    """
    made = ("n_words", "n_removed", "removed", "kept")
    docs = docs.select(*[columns.named(c) for c in docs.columns if c not in made])
    size = exchange.text_bytes(docs)
    hops = exchange.hops(docs, size)
    bits = hops.bits
    rows = exchange.chunked(columns.plain(docs, "doc_id", "text"), size, salted=True)

    own = [c for c in rows.columns if c != exchange.CHUNK and not (digest and c == "text")]

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        h1, h2, _, _ = _windows(table.column("text"), width)
        h1, h2, n, _ = kernels.distinct(h1, h2)
        twice = np.minimum(n, 2)
        return exchange.questions(key[0].as_py(), np.repeat(h1, twice), np.repeat(h2, twice), bits)

    def repeated(items: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        return np.bincount(group, minlength=groups)[group] > 1

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        h1, h2, at, first = _windows(table.column("text"), width)
        ordered, _, n, inverse = kernels.distinct(h1, h2)
        twice = np.minimum(n, 2)
        marks = exchange.lined_up(answers, np.repeat(ordered, twice), bits, None)[np.cumsum(twice) - twice] > 0
        hit = at[marks[inverse]]
        total = int(first[-1])
        cover = np.bincount(hit, minlength=total + 1)[: total + 1] - np.bincount(hit + width, minlength=total + 1)[: total + 1]
        gone = np.cumsum(cover)[:total] > 0
        texts = table.column("text").to_pylist()
        lost, cuts, kept = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            words = (text or "").encode().split()
            here = gone[first[i] : first[i + 1]]
            if here.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
                cuts.append(edge.reshape(-1, 2).tolist())
                lost[i] = here.sum()
                words = compress(words, (~here).tolist())
            else:
                cuts.append([])
            left = b" ".join(words)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
        table = table.select(own)
        new = (pa.array(np.diff(first)), pa.array(lost), pa.array(cuts, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string()))
        for name, column in zip(made, new, strict=True):
            table = table.append_column(name, column)
        return table

    kinds = (LongType(), LongType(), ArrayType(ArrayType(LongType())), StringType())
    schema = StructType([rows.schema[c] for c in own] + [StructField(n, k) for n, k in zip(made, kinds, strict=True)])
    answers = exchange.answered(rows.groupBy(exchange.CHUNK).applyInArrow(ask, exchange.QUESTION), repeated, 10, hops.more, bitwise=True)
    out = rows.groupBy(exchange.CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(remove, schema)
    return out.toDF(*[c for c in docs.columns if not (digest and c == "text")], *made)


#: The query for DuckDB, with windows of 35 words as text.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS k FROM g),
d AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM h SEMI JOIN d USING (k)),
gone AS (SELECT r, list(j) AS places, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, j: NOT list_contains(places, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""
