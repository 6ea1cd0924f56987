"""Sketches of word sets: SetSketch registers and bit fingerprints of minimum hashes.

Both are maxima or minima over the words of a text, so they are merged by taking maxima or minima,
and both start from one table row per distinct word that a task computes once.
"""

from __future__ import annotations

import numpy as np

from .textcodes import mix64

#: SetSketch: base of the exponential spacing, register shift (so that sets from 20 words on are
#: not truncated below; sets beyond 600,000 words are truncated above), largest register value.
BASE, SHIFT, TOP = 1.05, 20, 255

#: Bytes of table rows that a task keeps at most (more if one block of texts has more words).
TABLE_BYTES = 64_000_000


class WordTable:
    """Rows of ``width`` hash-derived values by word code, computed once for each new word."""

    def __init__(self, width: int, dtype, make):
        self.width, self.dtype, self.make = width, dtype, make
        self.most = TABLE_BYTES // (width * np.dtype(dtype).itemsize)
        self._clear()

    def _clear(self):
        self.codes, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.rows, self.used = np.zeros((1024, self.width), dtype=self.dtype), 0

    def look_up(self, vocabulary: np.ndarray) -> np.ndarray:
        """Row numbers of sorted distinct codes; ``rows`` may be replaced by the call."""
        at = np.searchsorted(self.codes, vocabulary)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == vocabulary) if len(self.codes) else np.zeros(len(vocabulary), dtype=bool)
        if self.used + (~known).sum() > max(self.most, len(vocabulary)):
            self._clear()
            known[:] = False
        new = vocabulary[~known]
        if len(new):
            need = self.used + len(new)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.width), dtype=self.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            for s in range(0, len(new), 1024):
                part = new[s:s + 1024]
                self.rows[self.used + s: self.used + s + len(part)] = self.make(part)
            codes = np.concatenate((self.codes, new))
            place = np.concatenate((self.place, np.arange(self.used, need)))
            order = np.argsort(codes, kind="stable")
            self.codes, self.place, self.used = codes[order], place[order], need
        return self.place[np.searchsorted(self.codes, vocabulary)]


def register_values(codes: np.ndarray, width: int) -> np.ndarray:
    """SetSketch register value of each word in each of ``width`` registers.

    An exponential variable from the word's hash, rounded down on a scale of powers of BASE; the
    register of a set is the largest of its words' values, i.e. its truncated minimum.
    """
    u = mix64(codes[:, None] ^ mix64(np.arange(width, dtype=np.uint64), 5)[None, :], 6)
    v = ((u >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
    x = np.log(-np.log1p(-v)) * np.float32(-1 / np.log(BASE))
    return np.clip(np.floor(x + 1) - SHIFT, 0, TOP).astype(np.uint8)


def hash_values(codes: np.ndarray, width: int) -> np.ndarray:
    """A 32-bit hash of each word under each of ``width`` functions."""
    u = mix64(codes[:, None] ^ mix64(np.arange(width, dtype=np.uint64), 15)[None, :], 16)
    return (u >> np.uint64(32)).astype(np.uint32)


def set_codes(vocabulary: np.ndarray, doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit code for each text's set of words (empty sets get the same)."""
    out = np.zeros(n, dtype=np.uint64)
    if len(doc):
        used, starts = np.unique(doc, return_index=True)
        out[used] = np.add.reduceat(mix64(vocabulary, 41)[word], starts)
    return mix64(out, 43)


def pack_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (n x 128) as two signed 64-bit columns."""
    b = np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=1)).view(np.int64)
    return b[:, 0].copy(), b[:, 1].copy()


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(n1: np.ndarray, n2: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons of two SetSketches.

    ``above``, ``below``, ``equal``: in how many registers the first is larger, smaller, the same;
    ``n1``, ``n2``: sizes of the sets.  The likelihood is concave, a ternary search finds its top.
    """
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j):
        p, q = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(28):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2
