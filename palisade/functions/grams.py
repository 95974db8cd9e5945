"""Hashed grams and pattern tests over whole Arrow batches of texts.

Every step is one numpy or Arrow call over about ``PIECE`` bytes of texts, so there is no object for a gram
and no Python loop over signs.  The buckets are those of Spark's HashingTF.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import lexicon as L
from .rules import BIT, SURE

#: Bytes of texts that are worked on at a time; a longer text is worked on alone, its grams in parts of this size.
PIECE = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Signs of words: letters, digits and _ of ASCII, and every byte beyond it.
_WORD = np.array([b > 127 or b == 95 or chr(b).isalnum() for b in range(256)])
_TAIL = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)


def _turn(x, by):
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed(k):
    return _turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur3(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Murmur3 (seed 42) of the byte ranges; words: the four bytes from each position on as one number."""
    h = np.full(len(start), 42, np.uint32)
    blocks, k = size >> 2, 0
    if len(size) and size.min() == size.max():
        for k in range(blocks[0]):
            h = _turn(h ^ _mixed(words[start + 4 * k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        at = blocks[:0]
    else:
        at = np.flatnonzero(blocks > 0)
    while len(at):
        h[at] = _turn(h[at] ^ _mixed(words[start[at] + 4 * k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        k += 1
        at = at[blocks[at] > k]
    h ^= _mixed(words[start + 4 * blocks] & _TAIL[size & 3])
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _fours(b: np.ndarray) -> np.ndarray:
    """The four bytes from each position on, the end's too, as one number; zeros follow the end."""
    x = np.concatenate([b, np.zeros(5, np.uint8)]).astype(np.uint32)
    return x[:-4] | x[1:-3] << np.uint32(8) | x[2:-2] << np.uint32(16) | x[3:-1] << np.uint32(24)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before, between and after them, and the row of each byte (a blank: of the text before it)."""
    b = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    return b, np.concatenate([np.zeros(1, np.int32), row])


def _word_grams(texts: list[bytes]):
    """The buffer of words of two signs or more, and (start, end, row) of words and of pairs of them."""
    b, row = _joined(texts)
    inside = _WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    long = last - first >= 2
    first, last = first[long], last[long]
    # words one after the other, a blank behind each
    step = np.zeros(len(b) + 1, np.int8)
    step[first] += 1
    step[last + 1] -= 1
    kept = np.cumsum(step[:-1], dtype=np.int8) > 0
    packed = np.where(inside, b, np.uint8(32))[kept]
    size = last - first
    end = np.cumsum(size + 1) - 1
    start, of = end - size, row[first]
    pair = np.flatnonzero(of[1:] == of[:-1])
    return packed, [(start, end, of), (start[pair], end[pair + 1], of[pair])]


def _char_grams(texts: list[bytes]):
    """The buffer of words with a blank on each side, and (start, end, row) of runs of three and of four signs in them."""
    b, row = _joined(texts)
    blank = _BLANK[b]
    kept = np.concatenate([[True], ~(blank[1:] & blank[:-1])])
    b, row, blank = np.where(blank, np.uint8(32), b)[kept], row[kept], blank[kept]
    sign = np.flatnonzero((b & 0xC0) != 0x80)
    gap, end, row = blank[sign], np.append(sign, len(b)), row[sign]
    runs = lambda at, n: (sign[at], end[at + n], row[at + 1])
    whole = ~gap[1:-1]
    # a word of one sign has no run of four; it counts as it is
    return b, [
        runs(np.flatnonzero(whole), 3),
        runs(np.flatnonzero(whole & gap[:-2] & gap[2:]), 3),
        runs(np.flatnonzero(~(gap[1:-2] | gap[2:-1])), 4),
    ]


def _scaled(texts: list[bytes], grams, weights: np.ndarray) -> np.ndarray:
    """For each text the sum of weights over its grams, divided by the norm of its counts."""
    b, found = grams(texts)
    words, size, n, mask = _fours(b), len(weights), len(texts), np.uint32(len(weights) - 1)
    parts = [[x[i : i + PIECE] for x in f] for f in found for i in range(0, len(f[0]), PIECE)]
    hashed = ((murmur3(words, start, end - start) & mask, row) for start, end, row in parts)
    if n == 1:
        count = np.zeros(size, np.int64)
        for bucket, _ in hashed:
            count += np.bincount(bucket, minlength=size)
        norm, total = np.sqrt(np.array([(count * count).sum()], float)), np.array([count @ weights])
    else:
        key = np.concatenate([np.zeros(0, np.int64), *(row * np.int64(size) + bucket for bucket, row in hashed)])
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count, key = np.diff(np.append(at, len(key))).astype(float), key[at]
        of = key // size
        norm, total = np.sqrt(np.bincount(of, count * count, n)), np.bincount(of, count * weights[key % size], n)
    return np.divide(total, norm, out=np.zeros(n), where=norm > 0)


def margins(low: pa.Array, tokens: pa.Array, word_weights: np.ndarray, char_weights: np.ndarray) -> pa.Array:
    """What words, pairs and character runs add to a text's margin; null for a null.

    low: texts in lower case whose blanks are ASCII's; tokens: the words of a text, joined by blanks, or null where
    the text is ASCII and its words can be found here.
    """
    out, group, room = [np.zeros(0)], [], 0

    def flush():
        if group:
            chars, words = zip(*group)
            out.append(_scaled(list(chars), _char_grams, char_weights) + _scaled(list(words), _word_grams, word_weights))

    for text, own in zip(low.cast(pa.binary()), tokens.cast(pa.binary())):
        text = text.as_py() or b""
        if room and room + len(text) > PIECE:
            flush()
            group, room = [], 0
        group.append((text, own.as_py() if own.is_valid else text))
        room += len(text) + 1
    flush()
    return pa.array(np.concatenate(out), mask=np.asarray(pc.is_null(low)))


# ---- which patterns can occur -----------------------------------------------------------------------------

_BEYOND = r"\x{80}-\x{10FFFF}"


def _linear(pattern: str, cased: bool, wide: bool) -> str:
    """A pattern for Arrow's matcher, which takes time in proportion to the text.

    On ASCII texts it matches where Java's does.  wide: for other texts, where it matches at least there: every sign
    beyond ASCII counts as of any class, and words may end anywhere.
    """
    out, inside, negated = [], False, False
    for x in re.findall(r"\\.|\[\^?|.", pattern, re.S):
        if x == "\\b":
            out.append("" if wide else x)
        elif x in ("\\w", "\\s", "\\d"):
            more = (r"\x0B" if x == "\\s" else "") + (_BEYOND if wide else "")
            out.append(x if negated or not more else x + more if inside else f"[{x}{more}]")
        else:
            if x.startswith("[") and not inside:
                inside, negated = True, x == "[^"
            elif x == "]":
                inside = negated = False
            out.append(x)
    return ("(?m)" if cased else "(?im)") + "".join(out)


def _linear_patterns(wide: bool) -> dict[str, str]:
    return {n: _linear(L.CASED.get(n) or L.PATTERNS[n], n in L.CASED, wide) for n in BIT}


def may(view: pa.Array) -> np.ndarray:
    """A bit for each pattern that can occur in a text, and one (``rules.SURE`` places higher) for each that does.

    On ASCII texts both are the same.  Where letter case is odd every pattern can occur, in a null none.
    """
    plain = np.asarray(pc.fill_null(pc.string_is_ascii(view), True))
    out = np.zeros(len(view), np.int64)
    for rows, wide in ((np.flatnonzero(plain), False), (np.flatnonzero(~plain), True)):
        if len(rows):
            texts = view.take(pa.array(rows))
            for name, pattern in _linear_patterns(wide).items():
                found = np.asarray(pc.fill_null(pc.match_substring_regex(texts, pattern), False))
                out[rows[found]] |= (1 if wide else 1 + (1 << SURE)) << BIT[name]
    odd = pc.match_substring_regex(view, f"[{L.ODD_CASE}]")
    out[np.asarray(pc.fill_null(odd, False))] = (1 << SURE) - 1
    return out
