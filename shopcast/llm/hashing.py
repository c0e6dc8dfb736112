"""Vectorised hashes of words and byte n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(values: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int = 1 << 19) -> np.ndarray:
    """A hash of each segment values[begin:end] (small integers, segments in order) that depends on its content and length only.

    A running sum of value * base**position gives a segment's sum as a
    difference; the power of its beginning is divided out. Arithmetic is modulo
    2**64. Segments are taken together as far as ``span`` values reach.
    """
    out, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + span, side="right")))
        first = int(begin[i])
        part = values[first:int(end[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(part)), out=sums[1:])
        b, e = begin[i:j] - first, end[i:j] - first
        out[i:j] = mixed((sums[e] - sums[b]) * _powers(_INVERSE, len(part) + 1)[b] + (e - b).astype(np.uint64))
        i = j
    return out


class Joined:
    """Texts with a line feed before, between and after them, and the words (maximal runs of bytes for which ``is_word`` holds) of all."""

    def __init__(self, texts: list[str | None], is_word: np.ndarray):
        parts = [(t or "").encode() for t in texts]
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        self.stop = np.cumsum(sizes) + 1  # after each text's line feed
        self.start = self.stop - sizes
        word = np.concatenate([[False], is_word[self.raw], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.stop, self.begin, side="right")  # of each word


def by_size(texts: list, most: int = 1 << 20):
    """Runs (from, to) of texts of about ``most`` characters each; a longer text is a run of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if texts:
        yield at, len(texts)
