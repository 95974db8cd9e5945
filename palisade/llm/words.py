"""Vectorised words of whole Arrow text columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, with A-Z
lower-cased.  Texts are never turned into Python strings: the UTF-8 buffer of the column is
scanned with numpy, in segments of bounded size, so that one very long text costs a bounded
amount of scratch memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
SEGMENT = 1 << 18
#: Bytes of text handled at a time by :func:`chunks`.
CHUNK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x41:0x5B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, SEGMENT + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", _P_INV)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(same: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row offsets."""
    n = len(same)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets[offsets <= n]] = True
    starts = same.copy()
    starts[1:] &= ~same[:-1] | first[1:n]
    ends = same.copy()
    ends[:-1] &= ~same[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans are sorted and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
            stop = ends[to - 1]
            up, down = _power(stop - base + 1)
            total = np.zeros(stop - base + 1, np.uint64)
            np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (total[e] - total[s]) * down[s]
            at = to
    return mix(out)


@dataclass
class Words:
    """hashes[lo[i]:lo[i + 1]] are the word hashes of row i."""

    hashes: np.ndarray
    lo: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def words(column: pa.Array) -> Words:
    """The words of every row of a string column."""
    raw, offsets = text_buffer(column)
    starts, ends = runs(IS_WORD[raw], offsets)
    data = LOWER[raw]
    lo = np.searchsorted(starts, offsets, "left")
    lo[-1] = len(starts)
    return Words(hash_spans(data, starts, ends), lo, starts, ends, raw, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k hashes (a polynomial in their order)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * np.uint64(1)
        for j in range(1, k):
            out = out * _P + hashes[j : j + n]
    return mix(out)


def shingles(w: Words, row: int, k: int = 5) -> np.ndarray:
    """The sorted distinct k-word shingles of a row; one shingle of all words if it has fewer."""
    h = w.hashes[w.lo[row] : w.lo[row + 1]]
    return np.unique(grams(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def chunks(batches, text: str = "text"):
    """Slices of Arrow batches of about CHUNK bytes of text, or of a single row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_buffer(column)
        at, n = 0, len(column)
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)
