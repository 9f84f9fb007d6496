"""Operator 6: language-model scores by a class-based bigram model.

Tokens are lower-cased words and one end token a text. Texts are tokenised once, into chunks: each holds its distinct
words' hashes and its tokens as indexes among them, and is written to the shared folder.

1. Chunks send the training counts of their words to the buckets of the hash space, which report sums and their most
   frequent words.
2. The ``HEAD`` most frequent words are assigned to classes by the exchange algorithm: each word moves to the class that
   raises the likelihood of a class bigram model of the head's bigrams most, until no word moves.
3. Chunks send the counts of all other words again, with how often the head's classes stand before and after each. The
   word's bucket moves it to the class where the likelihood rises most, the head's classes being fixed, and answers with
   its count and class. So every word that occurs twice or more belongs to an exchange class by its own contexts; words
   seen once and unseen ones share a class. The end token has its own, which also stands before each text.

P(token | previous) = P(class | previous class) * P(token | class). Transitions are smoothed towards the class's own
share (``PRIOR`` pseudo counts); emissions are relative frequencies, but in the class of rare words every word's count is
raised by a half and one unseen word has a half. Transition and emission counts cover all training tokens.

Results: a null text counts as empty and consists of the end token; rows that repeat are scored (and learned from)
each; without training rows every token is unseen and scores stay finite; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm import columns, exchange, kernels
from inkstream.session import discard, materialise

#: Chunks here are so many times as large as the exchange's, as a word's questions come once a chunk; and words that a task
#: sums up at a time.
LARGER, MOST_WORDS = 4, 1_000_000
#: Words that the full exchange algorithm clusters, its classes (250 at most), pseudo counts of the transitions, and of
#: contexts when other words are assigned.
HEAD, CLASSES, PRIOR, ALPHA = 1000, 48, 2.0, 0.5
#: The classes of the end token and of rare words; exchange classes come after them.
END, RARE, FIRST = 0, 1, 2
_END = (np.uint64(0x243F6A8885A308D3), np.uint16(0x7344))
_STATS = np.dtype([("hash", "<u8"), ("n", "<i8")])
_ANSWER = np.dtype([("n", "<i8"), ("class", "u1")])


def held_out() -> Column:
    """True for rows that training must not see."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """80 bits of hashes of all tokens of some texts, and each row's first token (and the end)."""
    data, offsets = kernels.utf8(texts)
    data = kernels.lower(data)
    one, two, rows, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)], 0
    for a, b in kernels.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = kernels.spans(part, offsets[a : b + 1] - offsets[a])
        h = kernels.word_hashes(part, starts, ends)
        one.append(np.insert(h[0], first[1:], _END[0]))
        two.append(np.insert(h[1].astype(np.uint16), first[1:], _END[1]))
        rows.append(first[1:] + np.arange(1, b - a + 1) + n)
        n += len(starts) + b - a
    return np.concatenate(one), np.concatenate(two), np.concatenate(rows)


class Chunk:
    """Some documents' tokens: ``place`` are indexes among the distinct hashes, ``first`` each row's first token (and the
    end), ``learn`` true for the tokens of training rows.

    In a table, places are ranks by frequency, their low bytes first and then their high ones, which are mostly zero and
    shrink when they are written; ``ranked`` leads back to the order of hashes.
    """

    SCHEMA = "chunk long, doc_id array<{kind}>, held array<boolean>, first binary, place binary, ranked binary, one binary, two binary"

    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int = 0):
        get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
        self.first, self.one = get("first", np.int64), get("one", np.uint64)
        self.two = get("two", np.uint16) if "two" in batch.schema.names else None
        kind = np.dtype(np.uint16 if len(self.one) <= 1 << 16 else np.uint32)
        planes = get("place", np.uint8).reshape(kind.itemsize, -1)
        self.place = get("ranked", kind)[np.ascontiguousarray(planes.T).view(kind).reshape(-1)]
        self.held = np.array(batch.column("held")[i].as_py(), bool)
        self.learn = np.repeat(~self.held, np.diff(self.first))

    @staticmethod
    def of(chunk: int, batches: list[pa.RecordBatch], kind: pa.DataType) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        one, two, first = _tokens(table.column("text"))
        a, b, n, place = kernels.distinct(one, two)
        small = np.uint16 if len(a) <= 1 << 16 else np.uint32
        ranked = np.argsort(-n, kind="stable").astype(small)
        rank = np.empty(len(a), small)
        rank[ranked] = np.arange(len(a), dtype=small)
        planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(len(place), -1).T) if len(place) else place
        raw = (first, planes, ranked, a, b)
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(k)) for c, k in (("doc_id", kind), ("held", pa.bool_()))]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in raw)], names=["chunk", "doc_id", "held", "first", "place", "ranked", "one", "two"])

    def counts(self) -> np.ndarray:
        """Training occurrences of each distinct word."""
        return np.bincount(self.place[self.learn], minlength=len(self.one))

    def ranks(self, heads: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Each distinct word's rank in the head, or the head's size. ``heads[order]`` ascends."""
        out = np.full(len(self.one), len(heads), np.int64)
        if len(heads):
            at = np.minimum(np.searchsorted(heads[order], self.one), len(heads) - 1)
            hit = heads[order][at] == self.one
            out[hit] = order[at[hit]]
        return out


def _chunks(docs: DataFrame, size: float) -> DataFrame:
    """Chunks of about so many bytes of text, without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, total = TaskContext.get().partitionId(), 0, [], 0
        for table in tables:
            _, offsets = kernels.utf8(table.column("text"))
            for a, b in kernels.slices(offsets):
                held.append(table.slice(a, b - a))
                total += int(offsets[b] - offsets[a])
                if total >= size:
                    yield Chunk.of(task << 32 | n, held, table.column("doc_id").type)
                    n, held, total = n + 1, [], 0
        if held:
            yield Chunk.of(task << 32 | n, held, held[0].column("doc_id").type)

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(batches, Chunk.SCHEMA.format(kind=kind))


def _buckets(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that ascending hashes fall into, and where each begins (and the end)."""
    edges = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h))
    full = np.flatnonzero(np.diff(edges))
    return full, np.append(edges[full], len(h))


def _items(*parts: np.ndarray) -> np.ndarray:
    """Arrays side by side, as bytes; one row an item."""
    return np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), p.dtype.itemsize) for p in parts], axis=1)


def _summary(chunks: DataFrame, bits: int, head: int) -> np.ndarray:
    """Numbers of distinct words, of words seen once (the end token aside) and of tokens in training, then the most
    frequent words. Buckets are merged 32 by 32, packed all the way."""

    def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b, _, place = kernels.distinct(one, two)
        return a, b, np.bincount(place, n, len(a)).astype(np.int64)

    def rows(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        full, edges = _buckets(one, bits)
        body = _items(one, two, n.astype("<i8"))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(full.astype(np.int32)), "body": kernels.binary_array(body.reshape(-1), edges * 18)})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []  # a task sums its chunks' words, but no more than so many at a time
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, i)
                parts = [summed([*parts, (c.one, c.two, c.counts())])]
                if len(parts[0][0]) >= MOST_WORDS:
                    yield rows(*parts.pop())
        if parts:
            yield rows(*parts[0])

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        items, _ = exchange.bodies(table, 18)
        group, groups = exchange.groups(items)
        total = np.bincount(group, np.ascontiguousarray(items[:, 10:18]).view("<i8").reshape(-1), groups).astype(np.int64)
        hashes = np.empty(groups, np.uint64)
        hashes[group] = np.ascontiguousarray(items[:, :8]).view(np.uint64).reshape(-1)
        top = np.lexsort((hashes, -total))[: head + 1]
        top = top[(total[top] > 1) & (hashes[top] != _END[0])]
        stats = np.zeros(3 + len(top), _STATS)
        stats["n"][:3] = (total > 0).sum(), ((total == 1) & (hashes != _END[0])).sum(), total.sum()
        stats["hash"][3:], stats["n"][3:] = hashes[top], total[top]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([stats.tobytes()], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, _STATS) for b in table.column("body").to_pylist()]
        words = np.concatenate([p[3:] for p in parts])
        words = words[np.lexsort((words["hash"], -words["n"]))[:head]]
        sums = np.zeros(3, _STATS)
        sums["n"] = sum(p["n"][:3] for p in parts)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([np.concatenate([sums, words]).tobytes()], pa.binary())})

    stats = chunks.mapInArrow(ask, "bucket int, body binary").groupBy("bucket").applyInArrow(bucket, "bucket int, body binary")
    for _ in range(-(-bits // 5)):
        stats = stats.groupBy(F.shiftright("bucket", 5).alias("part")).applyInArrow(merge, "bucket int, body binary")
    rows = stats.collect()  # one row
    return np.frombuffer(rows[0]["body"], _STATS) if rows else np.zeros(3, _STATS)


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = 20) -> np.ndarray:
    """A class for each word, from a square matrix of bigram counts whose last row and column stand for all else.

    Words start in order of frequency, dealt round; each in turn moves to the class of highest likelihood.
    """
    words = len(bigrams) - 1
    classes = max(1, min(classes, words))
    member = np.arange(words) % classes
    of = np.append(member, classes)  # all else has a class of its own
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    loglike = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    def worth(t: np.ndarray) -> np.ndarray:
        """Sum of n log n over bigrams, less that of both margins; for a stack of tables."""
        return loglike(t).sum(axis=(-2, -1)) - loglike(t.sum(axis=-1)).sum(axis=-1) - loglike(t.sum(axis=-2)).sum(axis=-1)

    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            right, left = np.bincount(of, bigrams[w], classes + 1), np.bincount(of, bigrams[:, w], classes + 1)
            own, same = of[w], bigrams[w, w]
            right[own] -= same
            left[own] -= same
            base = table.copy()
            base[own, :] -= right
            base[:, own] -= left
            base[own, own] -= same
            rows, columns = base.sum(axis=1), base.sum(axis=0)
            c = np.arange(classes)
            # a move changes one row, one column and their crossing, besides both margins
            gain = (loglike(base[c] + right) - loglike(base[c])).sum(axis=1) + (loglike(base[:, c].T + left) - loglike(base[:, c].T)).sum(axis=1)
            d = base[c, c]
            gain += loglike(d + right[c] + left[c] + same) - loglike(d + right[c]) - loglike(d + left[c]) + loglike(d)
            out_rows = loglike(rows + left) - loglike(rows)  # rows of words before w grow by one each
            out_columns = loglike(columns + right) - loglike(columns)
            size_r, size_l = right.sum() + same, left.sum() + same
            gain -= out_rows.sum() - out_rows[c] + loglike(rows[c] + left[c] + size_r) - loglike(rows[c])
            gain -= out_columns.sum() - out_columns[c] + loglike(columns[c] + right[c] + size_l) - loglike(columns[c])
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            base[best, :] += right
            base[:, best] += left
            base[best, best] += same
            table, of[w] = base, best
        if not moved:
            break
    return of[:-1]


def _before(classes: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The class before each token; ``start`` before each row's first."""
    out = np.empty_like(classes)
    out[1:] = classes[:-1]
    out[first[:-1][np.diff(first) > 0]] = start
    return out


def _matrix(df: DataFrame, pairs, size: int) -> np.ndarray:
    """How often each of ``size`` numbers follows each; ``pairs`` yields arrays of (before, after) from a batch. At most
    size * size sums reach the driver."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in tables:
            for before, after in pairs(batch):
                total += np.bincount(before.astype(np.int64) * size + after, minlength=size * size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(full.astype(np.int32)), "n": pa.array(total[full])})

    found = df.mapInArrow(batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def context_scores(bigrams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What one occurrence of a context is worth to each class: the exchange criterion's slope, with the head's classes
    fixed. Rows: the contexts before a word (all else, then the head's classes), then those after it."""
    classes = int(of.max()) + 1 if len(of) else 1
    context = np.append(of + 1, 0)
    sums = np.zeros((2, classes + 1, classes + 1))
    np.add.at(sums[0], (context[:, None], context[None, :]), bigrams)
    sums[1] = sums[0].T
    out = [np.log((side[:, 1:] + ALPHA) / (side[:, 1:].sum(axis=0) + ALPHA * (classes + 1))) for side in sums]
    return np.concatenate(out)


def _assigned(chunks: DataFrame, bits: int, heads: np.ndarray, of: np.ndarray, worth: np.ndarray) -> DataFrame:
    """Rows (chunk, bucket, body): the count and the class of each word of a chunk, in the order of its hashes."""
    order, sides = np.argsort(heads), len(worth) // 2
    narrow = np.dtype("u1" if len(worth) <= 256 else "<u2")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = np.append(of + 1, 0).astype(np.uint16)
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, i)
                rank = c.ranks(heads, order)
                near = context[rank][c.place]
                before = _before(near, c.first, 0)
                other = c.learn & ((rank == len(heads)) & (c.one != _END[0]))[c.place]  # such tokens are never a row's last
                parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for a in range(0, len(other), 1 << 18):
                    at = np.flatnonzero(other[a : a + (1 << 18)]) + a
                    word = c.place[at].astype(np.int64) * (2 * sides)
                    parts.append(np.unique(np.concatenate([word + before[at], word + sides + near[np.minimum(at + 1, len(near) - 1)]]), return_counts=True))
                cells, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                times = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(cells)).astype(np.int64)
                contexts = np.bincount(cells // (2 * sides), minlength=len(c.one))
                ends = np.append(0, np.cumsum(contexts))
                full, edges = _buckets(c.one, bits)
                words = _items(c.one, c.two, c.counts().astype("<i4"), contexts.astype("<u2"))
                seen = _items((cells % (2 * sides)).astype(narrow), np.minimum(times, 255).astype(np.uint8))
                more = np.flatnonzero(times > 254)  # the few large numbers stand apart, in the order of their marks
                large = times[more].astype("<u4").view(np.uint8)
                far = np.searchsorted(more, ends[edges])
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full.astype(np.int32)), "chunk": pa.array(np.full(len(full), batch.column("chunk")[i].as_py())),
                    "body": kernels.binary_array(words.reshape(-1), edges * 16), "seen": kernels.binary_array(seen.reshape(-1), ends[edges] * seen.shape[1]), "large": kernels.binary_array(large, far * 4),
                })

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        items, edges = exchange.bodies(table, 16)
        group, groups = exchange.groups(items)
        raw = b"".join(table.column("seen").to_pylist())
        seen = np.frombuffer(raw, np.uint8).reshape(-1, narrow.itemsize + 1)
        context, times = np.ascontiguousarray(seen[:, :-1]).view(narrow).reshape(-1).astype(np.int64), seen[:, -1].astype(np.int64)
        times[times == 255] = np.frombuffer(b"".join(table.column("large").to_pylist()), "<u4")
        owner = np.repeat(group, np.ascontiguousarray(items[:, 14:16]).view("<u2").reshape(-1))
        by = np.argsort(owner, kind="stable")
        owner, context, times = owner[by], context[by], times[by]
        out = np.zeros(groups, _ANSWER)
        out["n"] = np.bincount(group, np.ascontiguousarray(items[:, 10:14]).view("<i4").reshape(-1), groups)
        for a in range(0, groups, 8192):
            b = min(a + 8192, groups)
            x, y = np.searchsorted(owner, (a, b))
            counts = np.bincount((owner[x:y] - a) * 2 * sides + context[x:y], times[x:y], (b - a) * 2 * sides).reshape(-1, 2 * sides)
            out["class"][a:b] = (counts @ worth).argmax(axis=1)
        answers = kernels.binary_array(out[group].view(np.uint8), edges * _ANSWER.itemsize)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "body": answers})

    return chunks.mapInArrow(ask, "bucket int, chunk long, body binary, seen binary, large binary").groupBy("bucket").applyInArrow(bucket, "chunk long, bucket int, body binary")


class Model:
    """Smoothed class transitions and class totals, as decimal logarithms."""

    def __init__(self, once: int, moves: np.ndarray):
        """``moves``: how often each class follows each; ``once``: how many words were seen once."""
        each = moves.sum(axis=0)
        share = (each + 0.5) / (each.sum() + 0.5 * len(each))
        self.transition = np.log10((moves + PRIOR * share) / (moves.sum(axis=1, keepdims=True) + PRIOR))
        self.whole = np.log10(np.maximum(each, 1))
        self.whole[END], self.whole[RARE] = 0.0, np.log10(each[RARE] + 0.5 * (once + 1))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Classes of the tokens of a few documents, each one's first (and the end), and which documents."""
    column = batch.column("classes")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    for a in range(0, len(column), 256):
        b = min(a + 256, len(column))
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, b


def score(docs: DataFrame, head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""
    if not 1 <= classes <= 250:
        raise ValueError("classes must be between 1 and 250")
    docs = columns.plain(docs, "doc_id", "text").select("doc_id", "text")
    size = exchange.text_bytes(docs)
    bits = exchange.bucket_bits(docs, size // 4)  # far fewer distinct words than words
    chunks = materialise(_chunks(docs, LARGER * exchange.sizes(size)[0]), "chunks", "zstd", wide=True)
    stats = _summary(chunks, bits, head)
    types, once, total = (int(n) for n in stats["n"][:3])
    heads, ranked = stats["hash"][3:].copy(), np.argsort(stats["hash"][3:])
    h, unit = len(heads), total + 0.5 * (types + 1)

    def head_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(batch.num_rows):
            c = Chunk(batch, i)
            code = c.ranks(heads, ranked)[c.place]  # the end token and the rest together
            yield _before(code, c.first, h)[c.learn], code[c.learn]

    bigrams = _matrix(chunks, head_pairs, h + 1)
    of = exchange_classes(bigrams, classes) if h else np.zeros(0, np.int64)
    answers = _assigned(chunks, bits, heads, of, context_scores(bigrams, of))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        found = exchange.lined_up(right, c.one, bits, _ANSWER)
        n, rank = found["n"].astype(np.int64), c.ranks(heads, ranked)
        of_word = np.where(n > 1, FIRST + found["class"].astype(np.int64), RARE)
        of_word[rank < h] = FIRST + of[rank[rank < h]]
        of_word[c.one == _END[0]] = END
        own = np.log10(np.where(of_word == RARE, n + 0.5, np.maximum(n, 1)))
        own[of_word == END] = 0.0
        base = np.log10((n + 0.5) / unit)
        sums = lambda x: np.add.reduceat(x[c.place], c.first[:-1]) if len(c.first) > 1 else np.zeros(0)  # noqa: E731  each row has its end token
        known = np.append(0, np.cumsum((n > 0)[c.place]))
        return pa.table({
            "doc_id": left.column("doc_id").combine_chunks().flatten(), "held_out": pa.array(c.held), "n_tokens": pa.array(np.diff(c.first)), "n_known": pa.array(np.diff(known[c.first])),
            "base_score": pa.array(sums(base)), "own": pa.array(sums(own)), "classes": kernels.binary_array(of_word.astype(np.uint8)[c.place], c.first),
        })

    coded = chunks.drop("two").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(code, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, own double, classes binary")
    coded = materialise(coded, "coded", "zstd")
    discard(chunks)

    def class_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for c, first, _, _ in _rows(batch):
            yield _before(c, first, END), c

    k = FIRST + (int(of.max()) + 1 if h else 1)
    model = Model(once, _matrix(coded.where("NOT held_out").select("classes"), class_pairs, k))

    def scores(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            out = batch.column("own").to_numpy().copy()
            for c, first, a, b in _rows(batch):
                out[a:b] += np.add.reduceat(model.transition[_before(c, first, END), c] - model.whole[c], first[:-1])
            n = batch.column("n_tokens").to_numpy()
            kept = batch.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out), pa.array(10.0 ** np.minimum(-out / n, 300))], names=[*kept.schema.names, "score", "perplexity"])

    scored = coded.mapInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, perplexity double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
