"""Vectorised plain-form tokenising of text batches with NumPy.

A batch of texts becomes flat arrays: one 64-bit code per word occurrence, in reading order,
with the number of the text it stands in.  Everything is computed over whole batches, a
Python loop runs over texts only to join them.

* *plain form*: every character lower-cased on its own, decomposed canonically, combining
  marks dropped (so ``É``, ``é`` and ``e`` + U+0301 are all ``e``);
* *word*: a maximal run of letters or digits (Unicode categories L* and N*) of the plain form;
* *word code*: a 64-bit hash of the word's plain form.

Null texts count as empty.  Characters beyond the BMP take part through a small per-batch table.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Characters handled in one go; bounds the working memory of a task (about 60 bytes a character).
BLOCK_CHARS = 250_000

_MARK, _OTHER, _WORD = 2, 0, 1
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def fold_char(ch: str) -> str:
    """The plain form of one character ('' for a combining mark)."""
    out = [c for c in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(c) != "Mn"]
    if not out:
        return "" if unicodedata.category(ch) == "Mn" else ch
    return out[0] if len(out) == 1 else ch.lower()[:1]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    return _mix(x.astype(np.uint64, copy=False) + np.uint64((seed * _MULT + 0x632BE59BD9B4E019) & _MASK))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the BMP: folded character, its class, its random 64-bit code."""
    fold = np.arange(65536, dtype=np.uint32)
    kind = np.zeros(65536, dtype=np.uint8)
    for i in range(65536):
        if 0xD800 <= i < 0xE000:
            continue
        ch = chr(i)
        f = fold_char(ch)
        if f == "":
            kind[i] = _MARK
        else:
            fold[i] = ord(f)
            kind[i] = _WORD if unicodedata.category(f)[0] in "LN" else _OTHER
    code = mix64(np.arange(65536, dtype=np.uint64), 17)
    return fold, kind, code[fold & 0xFFFF]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    n = BLOCK_CHARS + 1024
    inverse = pow(_MULT, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n, np.uint64(_MULT)); up[0] = 1
        down = np.full(n, np.uint64(inverse)); down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one space, and the n + 1 offsets of the texts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word code) of every word occurrence, in order."""
    points, offsets = code_points(texts)
    fold, kind, code = _tables()
    if len(points) and points.max() >= 65536:
        values, where = np.unique(points, return_inverse=True)
        plain = [fold_char(chr(int(v))) if not 0xD800 <= v < 0xE000 else chr(0xFFFD) for v in values]
        k = np.array([_MARK if p == "" else (_WORD if unicodedata.category(p)[0] in "LN" else _OTHER) for p in plain], dtype=np.uint8)[where]
        h = mix64(np.array([ord(p) if p else 0 for p in plain], dtype=np.uint64), 17)[where]
    else:
        k, h = kind[points], code[points]
    if (k == _MARK).any():
        keep = k != _MARK
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        k, h = k[keep], h[keep]
    word = (k == _WORD).view(np.int8)
    edge = np.diff(word, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = _powers()
    n = len(h)
    with np.errstate(over="ignore"):
        if n <= len(up):
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)))
            codes = (total[ends] - total[starts]) * down[starts]
        else:  # one very long text: the same sums, with the powers counted from each word's start
            flat = np.flatnonzero(word)
            lengths = ends - starts
            first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            at = np.arange(len(flat)) - np.repeat(first, lengths)
            long = int(lengths.max())
            if long > len(up):
                up = np.full(long, np.uint64(_MULT)); up[0] = 1
                up = np.cumprod(up, dtype=np.uint64)
            codes = np.add.reduceat(h[flat] * up[at], first)
        codes = _mix(codes ^ (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts, side="right") - 1, codes


def blocks(texts: list[str | None]):
    """Yields (first, texts) with at most BLOCK_CHARS characters each, or one longer text."""
    part: list[str] = []
    first = size = 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) + 1 > BLOCK_CHARS:
            yield first, part
            part, first, size = [], i, 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield first, part


def word_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: (vocabulary codes, text numbers, vocabulary numbers), by text, then code."""
    doc, codes = word_spans(texts)
    vocabulary, number = np.unique(codes, return_inverse=True)
    if not len(vocabulary):
        return vocabulary, doc, doc
    pair = doc * len(vocabulary) + number
    pair.sort()
    pair = pair[np.diff(pair, prepend=-1) != 0]
    return vocabulary, pair // len(vocabulary), pair % len(vocabulary)


def plain_letters(texts: list[str]) -> list[str]:
    """The bare form of each text: its plain form without anything but letters and digits."""
    points, offsets = code_points(texts)
    fold, kind, _ = _tables()
    if len(points) and points.max() >= 65536:
        values, where = np.unique(points, return_inverse=True)
        plain = [fold_char(chr(int(v))) if not 0xD800 <= v < 0xE000 else chr(0xFFFD) for v in values]
        keep = np.array([p != "" and unicodedata.category(p)[0] in "LN" for p in plain], dtype=bool)[where]
        folded = np.array([ord(p) if p else 0 for p in plain], dtype=np.uint32)[where]
    else:
        keep, folded = kind[points] == _WORD, fold[points]
    ends = np.concatenate(([0], np.cumsum(keep)))[offsets].tolist()
    text = folded[keep].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[a:z] for a, z in zip(ends, ends[1:])]
