"""Vectorised byte kernels: words, hashes and windows of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words get two independent 64-bit hashes
(polynomials modulo 2**64 over the bytes, then mixed); words of over ``LONG_WORD`` bytes are hashed by BLAKE2,
since a polynomial modulo 2**64 has known collisions between long strings. Memory is bounded by ``SPAN``, and the
tables of powers, which workers keep, by ``STEP`` (four bases, 2 MB each).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, and bytes or words that one table of powers spans.
SPAN, STEP = 1 << 20, 1 << 16
LONG_WORD = 256
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_STEPS = (0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of ``base`` and of its inverse modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if (base, size) not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[base, size] = tuple(both)
    return _powers[base, size]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (a null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SPAN):
    """Ranges of rows of at most ``most`` bytes together; a longer row comes alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    inside = _IN_WORD[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int = 2) -> tuple[np.ndarray, ...]:
    """Two 64-bit hashes of every word (or only the first)."""
    out = tuple(np.empty(len(starts), np.uint64) for _ in _BASES[:hashes])
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, at + STEP, side="right")))
        stop = int(ends[last - 1])
        if stop - at <= STEP:
            piece = data[at:stop].astype(np.uint64) + np.uint64(1)
            s, e = starts[first:last] - at, ends[first:last] - at
            for k, base in enumerate(_BASES[:hashes]):
                power, inverse = _tables(base, STEP)
                total = np.empty(len(piece) + 1, np.uint64)
                total[0] = 0
                np.cumsum(piece * power[: len(piece)], out=total[1:])
                out[k][first:last] = mix((total[e] - total[s]) * inverse[s] + np.uint64(k))
        first = last
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        for k in range(hashes):
            out[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all ``width``-word windows within rows, and the index of each one's first word.

    ``words`` holds one hash per word, ``rows`` the first word of each row (and the end).
    """
    ends = np.repeat(rows[1:], np.diff(rows))
    first = np.flatnonzero(np.arange(len(words), dtype=np.int64) + width <= ends)
    return sequence_hashes(words, first, np.full(len(first), width, np.int64), which), first


def sequence_hashes(words: np.ndarray, first: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the word sequences that begin at the (ascending) indexes ``first``."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        begin = int(first[at])
        to = max(at + 1, int(np.searchsorted(first, begin + (STEP >> 1))))
        f, n = first[at:to] - begin, lengths[at:to]
        stop = int((f + n).max())
        power, inverse = _tables(_STEPS[which], max(STEP, stop))
        total = np.empty(stop + 1, np.uint64)
        total[0] = 0
        np.cumsum(words[begin : begin + stop] * power[:stop], out=total[1:])
        out[at:to] = mix((total[f + n] - total[f]) * inverse[f] + n.astype(np.uint64))
        at = to
    return out


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h1, h2) in ascending order, how often each occurs, and for each input its index among them."""
    if not len(h1):
        return h1, h2, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.empty(len(a), bool)
    new[0] = True
    np.not_equal(a[1:], a[:-1], out=new[1:])
    new[1:] |= b[1:] != b[:-1]
    at = np.flatnonzero(new)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[at], b[at], np.diff(np.append(at, len(a))), inverse


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer; copies nothing."""
    if len(data) >= 1 << 31:
        raise ValueError("one batch of payloads must stay under 2 GiB; use smaller chunks")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
