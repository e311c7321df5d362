"""Vectorised helpers over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, found on the UTF-8 bytes of a whole
batch at once. Nulls count as empty texts. A word is represented by a 64-bit hash: a sum of random
byte codes times powers of an odd number, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with low lines behind it until no column is called so (Spark's names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the hash's base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        n = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)

        def of(base: int) -> np.ndarray:
            factors = np.full(n + 1, base, U64)
            factors[0] = 1
            return np.cumprod(factors, dtype=U64)

        _powers = (of(_BASE), of(inverse))
    return _powers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column in one buffer, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_blocks(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20):
    """Cuts a batch into runs of rows with about ``most`` bytes of text; a longer row stands alone."""
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row boundary the number of words before it."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SEP[buf]
    full = off[1:] > off[:-1]
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first], stop[last] = word[first], word[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the lower-cased rows, and the word offsets of the rows."""
    s, e, at = word_spans(buf, off)
    if not len(s):
        return np.zeros(0, U64), at
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_CODES[_LOWER[buf]] * up[: len(buf)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U64)), at


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of one row, sorted; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, U64)
    for i in range(k):
        out = mix(out + words[i : len(words) - k + 1 + i] * U64(2 * i + 3) + U64(k))
    return np.unique(out)


def lowered_word_ends(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The last two bytes of each word, lower-cased, as a number; the first of them is 0 for words of one byte."""
    s, e, _ = word_spans(buf, off)
    if not len(s):
        return np.zeros(0, U64)
    last = _LOWER[buf[e - 1]].astype(U64)
    return np.where(e - s > 1, _LOWER[buf[np.maximum(e - 2, 0)]], 0).astype(U64) << U64(8) | last
