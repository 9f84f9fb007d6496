"""Operator 10: language identification by prediction by partial matching.

For each language, a context tree of order four is grown from the bytes of training texts (four virtual zero bytes stand
before each text). A byte's code length under a frozen tree is minus the binary logarithm of its probability: in the
longest context that has seen it n of T times with D distinct successors, n / (T + D); each context that has not seen
it contributes its escape probability D / (T + D), and bytes seen there are excluded below. Contexts that were never seen
are passed over. Under the root all 256 bytes are equally likely. The language with the shortest code wins.

Since the statistics are frozen, the exclusion is a factor of each context, so the code length of a (context, byte) pair
is one number. Trees are sparse: a hash table holds the pairs and contexts that some language of the table has seen, each
with a row of one code length a language, and a byte is looked up from its longest context down.

The model is fitted on a sample of the labelled rows that is bounded in bytes (``SAMPLE_BYTES`` a language, and
``SAMPLE_TOTAL`` in all), drawn by a hash of id and text from all training rows of each language; whole texts count, and
languages below their bound count in full. Every value of ``lang`` is learned. Languages are dealt to as many tables as
keep each of them below ``TABLE_BYTES`` (or at one language); workers hold one table at a time and take texts in batches
of ``BATCH_BYTES`` if there are more. How languages are dealt changes no code length.

Results: a null text, or one without a letter, gets ``und`` and score 0; so does every text if nothing was learned.
Ties go to the first language by name. The score is the posterior probability of the winner under equal priors. Other
columns play no part and pass through ``screen`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inkstream.llm import columns, kernels

#: Bytes of context; bytes of training text a language and in all, about; bytes of a table and of a batch.
ORDER, SAMPLE_BYTES, SAMPLE_TOTAL = 4, 4 << 20, 64 << 20
TABLE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
_LETTER = regex.compile(r"\p{L}")


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the ``ORDER`` bytes before it in its row (0 before the first) and itself, as one number."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.uint64)
    for j in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j]
        before[place < j] = 0
        out |= before << np.uint64(8 * j)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, key, n) of one task."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            data, offsets = kernels.utf8(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
            parts = [found[lang]] if lang in found else []
            for a, b in kernels.slices(offsets):
                parts.append(np.unique(_keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), return_counts=True))
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            found[lang] = keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    for lang, (keys, n) in found.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "key": pa.array(keys.astype(np.int64)), "n": pa.array(n)})


class Table:
    """Code lengths of the (context, byte) pairs of some languages, in bits.

    Rows 0 to 255 are the bytes without context. ``slots`` maps the other pairs, and contexts, to their rows: a context's
    row holds what an escape from it costs. Numbers of pairs and contexts carry their length in the top byte.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.unique(np.concatenate([k.astype(np.uint64) for k, _ in counts]))
        n = np.zeros((len(keys), len(counts)))
        for i, (k, m) in enumerate(counts):
            n[np.searchsorted(keys, k.astype(np.uint64)), i] = m
        levels = [(keys, n)]
        for k in range(ORDER - 1, -1, -1):  # counts of a shorter context are sums
            above, n = levels[-1]
            keys, inverse = np.unique(above & self._mask(k), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            levels.append((keys, np.add.reduceat(n[order], np.searchsorted(inverse[order], np.arange(len(keys))), axis=0) if len(keys) else n[:0]))
        levels.reverse()
        root = np.zeros((256, len(counts)))
        root[levels[0][0].astype(np.int64)] = levels[0][1]
        below, shorter = self._escaped(root, np.full_like(root, 1 / 256), np.zeros(1, np.int64))[0], np.arange(256, dtype=np.uint64)
        rows, numbers = [below], []
        for k in range(1, ORDER + 1):
            keys, n = levels[k]
            contexts = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(keys) else np.zeros(0, np.int64)
            p, escape = self._escaped(n, below[np.searchsorted(shorter, keys & self._mask(k - 1))], first)
            rows += [p, escape]
            numbers += [keys | self._tag(k), contexts[first] | self._tag(k + 8)]
            below, shorter = p, keys
        with np.errstate(divide="ignore"):
            self.lengths = -np.log2(np.concatenate(rows)).astype(np.float32)
        self._hash(np.concatenate(numbers))

    @staticmethod
    def _mask(k: int) -> np.uint64:
        """Of a pair, the part with ``k`` bytes of context."""
        return np.uint64((1 << 8 * (k + 1)) - 1)

    @staticmethod
    def _tag(k: int) -> np.uint64:
        return np.uint64(k << 56)

    @staticmethod
    def _escaped(n: np.ndarray, below: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of pairs, given those with one byte of context less; and each context's factor for bytes that it
        has not seen. ``first``: the first pair of each context."""
        if not len(n):
            return n, n
        seen = n > 0
        total, kinds, taken = (np.add.reduceat(x, first, axis=0) for x in (n, seen.astype(float), np.where(seen, below, 0.0)))
        whole = np.maximum(total + kinds, 1)
        factor = np.where(total > 0, kinds / whole / np.maximum(1 - taken, 1e-12), 1.0)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
        return np.where(seen, n / whole[of], factor[of] * below), factor

    def _hash(self, numbers: np.ndarray) -> None:
        """An open-addressing table from numbers to rows; less than half of it is in use."""
        self.shift = np.uint64(64 - max(4, (2 * len(numbers)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.numbers, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        rows, slot = np.arange(256, 256 + len(numbers), dtype=np.int32), self._slot(numbers)
        while len(numbers):
            free = self.numbers[slot] == 0
            self.numbers[slot[free]] = numbers[free]  # of several, the last one stays
            won = self.numbers[slot] == numbers
            self.slots[slot[won]] = rows[won]
            numbers, rows, slot = numbers[~won], rows[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, numbers: np.ndarray) -> np.ndarray:
        """The row of each number, or -1."""
        slot = self._slot(numbers)
        found = self.numbers[slot]
        out = np.where(found == numbers, self.slots[slot], -1)
        rest = np.flatnonzero((found != numbers) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            found = self.numbers[slot[rest]]
            hit = found == numbers[rest]
            out[rest[hit]] = self.slots[slot[rest[hit]]]
            rest = rest[~hit & (found != 0)]
        return out

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each byte with its context, in each language."""
        out = np.zeros((len(keys), self.lengths.shape[1]), np.float32)
        rest = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            some = keys[rest] & self._mask(k)
            row = self._find(some | self._tag(k))
            hit = row >= 0
            out[rest[hit]] += self.lengths[row[hit]]
            rest, some = rest[~hit], some[~hit]
            row = self._find((some >> np.uint64(8)) | self._tag(k + 8))
            known = row >= 0
            out[rest[known]] += self.lengths[row[known]]
        out[rest] += self.lengths[(keys[rest] & np.uint64(255)).astype(np.int64)]
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length of each row in each language."""
        langs = self.lengths.shape[1]
        out, step = np.zeros((len(offsets) - 1, langs)), max(1 << 14, (1 << 20) // langs)
        for a, b in kernels.slices(offsets, step):
            for at in range(int(offsets[a]), int(offsets[b]), step):  # a long row in steps that know the bytes before
                to = min(at + step, int(offsets[b]))
                back = min(ORDER, at - int(offsets[a])) if b == a + 1 else 0
                edges = np.clip(offsets[a : b + 1], at - back, to) - (at - back)
                costs = self._costs(_keys(data[at - back : to], edges)[back:])
                rows = np.flatnonzero(np.diff(np.maximum(edges - back, 0)) > 0)
                if len(rows):
                    out[a + rows] += np.add.reduceat(costs, np.maximum(edges[rows] - back, 0), axis=0, dtype=np.float64)
        return out


class Model:
    """The counts of all languages, and how these are dealt to tables."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.counts, self.size = langs, counts, 256
        self.groups: list[tuple[int, int]] = []
        self._table: tuple[int, Table] | None = None
        first, pairs = 0, 0
        for i, (keys, _) in enumerate(counts):
            pairs += 3 * len(keys)  # with shorter contexts
            if i > first and pairs * (4 * (i + 1 - first) + 24) > TABLE_BYTES:
                self.groups.append((first, i))
                first, pairs = i, 3 * len(keys)
        if langs:
            self.groups.append((first, len(langs)))

    def table(self, group: int) -> Table:
        """The last one stays, for the next batch."""
        if self._table is None or self._table[0] != group:
            self._table = None
            a, b = self.groups[group]
            self._table = group, Table(self.counts[a:b])
        return self._table[1]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length of each row in each language."""
        parts = [self.table(g).bits(data, offsets) for g in range(len(self.groups))]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(offsets) - 1, 0))


def held_out() -> Column:
    """True for rows that training must not see."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def sampled(docs: DataFrame) -> DataFrame:
    """Columns lang, text of the training rows that the model is fitted on."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row a language
    each = min(SAMPLE_BYTES, SAMPLE_TOTAL // max(1, len(sizes)))
    if all(r["bytes"] <= each for r in sizes):
        return rows.select("lang", "text")
    shares = docs.sparkSession.createDataFrame([(r["lang"], each / max(each, r["bytes"])) for r in sizes], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    return rows.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select("lang", "text")


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of rows that are not held out."""
    summed = sampled(docs).mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most a row for each byte of the sample
    coded = table.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    order = np.argsort(code, kind="stable")
    keys, n = table.column("key").to_numpy()[order], table.column("n").to_numpy()[order]
    edges = np.searchsorted(code[order], np.arange(len(names) + 1))
    learned = sorted(range(len(names)), key=names.__getitem__)
    return Model([names[i] for i in learned], [(keys[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]]) for i in learned])


def _joined(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_BYTES`` each."""
    held: list[pa.RecordBatch] = []
    for batch in tables:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, whose columns ``columns.plain`` has named, with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _joined(tables) if len(model.groups) > 1 else tables:
            data, offsets = kernels.utf8(batch.column("text"))
            bits = model.bits(data, offsets)
            found, score = ["und"] * len(bits), np.zeros(len(bits))
            if model.langs:
                best = bits.argmin(axis=1)
                sure = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if text is not None and _LETTER.search(text):
                        found[i], score[i] = model.langs[best[i]], sure[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score for every row; the model learns from the others' lang alone."""
    docs = columns.plain(docs, "doc_id", "text", "lang").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def screen(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least this score, with their own columns."""
    rows = columns.plain(docs, "doc_id", "text", "lang")
    found = predict(rows, train(rows)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(rows.columns).toDF(*docs.columns)
