"""Words, word hashes and shingles of many texts at once, with numpy.

A batch of texts is one byte buffer with offsets.  Words are maximal runs of bytes
outside 0x20 and 0x09-0x0D; hashes are 64 bits wide and equal on every machine."""

from __future__ import annotations

import functools

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 7)


SLICE = 1 << 18  # bytes that are hashed together


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_MULT, -1, 2**64)
    up, down = np.full(2 * SLICE + 1, _U(_MULT)), np.full(2 * SLICE + 1, _U(inv))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words; a text's words are
    ``first[i]:first[i + 1]``."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)  # a text begins here
    edge[off] = True
    start = ~space
    start[1:] &= space[:-1] | edge[1:-1]
    end = ~space
    end[:-1] &= space[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (in ascending order, apart): a polynomial over random byte
    values, then mixed.  Spans are taken in runs of 2 * SLICE bytes, a longer span in pieces,
    so memory doesn't grow with the text."""
    out = np.zeros(len(starts), _U)
    up, down = _powers()
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, a + int(np.searchsorted(ends[a:], lo + 2 * SLICE, "right")))
        hi = int(ends[b - 1])
        if hi - lo <= 2 * SLICE:
            total = np.zeros(hi - lo + 1, _U)
            np.cumsum(_BYTE[buf[lo:hi]] * up[:hi - lo], dtype=_U, out=total[1:])
            out[a:b] = (total[ends[a:b] - lo] - total[starts[a:b] - lo]) * down[starts[a:b] - lo]
        else:
            value, factor, step = 0, 1, pow(_MULT, SLICE, 2**64)
            for s in range(lo, hi, SLICE):
                e = min(s + SLICE, hi)
                value += int(np.sum(_BYTE[buf[s:e]] * up[:e - s], dtype=_U)) * factor
                factor = factor * step % 2**64
            out[a] = value % 2**64
        a = b
    return mix(out + (ends - starts).astype(_U))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (hashes sorted within a text, offsets).
    A text with fewer words is one shingle; without words it has none."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    off = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(off[-1]) - off[doc] + first[doc]
    room = first[doc + 1] - at  # words from here to the text's end
    coef = mix(np.arange(k, dtype=_U), 11) | _U(1)
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    out = np.minimum(room, k).astype(_U)
    for j in range(k):
        out += np.where(j < room, padded[at + j] * coef[j], _U(0))
    out = mix(out, 3)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    counts = np.bincount(doc[keep], minlength=len(n))
    return out[keep], np.concatenate([[0], np.cumsum(counts)])


def lower_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the A-Z-lowered words, first word of each text)."""
    s, e, first = word_spans(buf, off)
    return word_hashes(LOWER[buf], s, e), first


def segment_reduce(op: np.ufunc, values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """``op`` over the rows of each segment; ``empty`` for a segment without rows."""
    n = np.diff(off)
    out = np.full((len(n), *values.shape[1:]), empty, values.dtype)
    if (n > 0).any():
        out[n > 0] = op.reduceat(values, off[:-1][n > 0])
    return out
