r"""The public word-and-punctuation tokenizer, vectorised: matches of ``\w+|[^\w\s]+`` with Unicode classes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .textcodes import code_points

SPACE, WORD, OTHER = 0, 1, 2
_END, _CLOSE, _FEED = 4, 8, 16
_ENDS, _CLOSES = ".!?", "\"')]»”’"


def _kind(ch: str) -> int:
    k = WORD if ch.isalnum() or ch == "_" else SPACE if ch.isspace() else OTHER
    return k | (_END if ch in _ENDS else 0) | (_CLOSE if ch in _CLOSES else 0) | (_FEED if ch == "\n" else 0)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(65536)], dtype=np.uint8)


class Tokens:
    """Tokens of a block of texts as flat arrays.

    ``doc`` text number, ``start`` and ``end`` characters in ``text``'s own count, ``first`` the number of each
    text's first token and, last, the number of all; ``cut_doc, cut`` natural boundaries inside the texts,
    as the number of the text's tokens before them.
    """

    def __init__(self, texts: list[str], boundaries: bool = True):
        points, offsets = code_points(texts)
        if len(points) and points.max() >= 65536:
            values, where = np.unique(points, return_inverse=True)
            kind = np.array([_kind(chr(int(v))) for v in values], dtype=np.uint8)[where]
        else:
            kind = _table()[points]
        base = kind & 3
        if not len(base):
            base = np.zeros(0, dtype=np.uint8)
        change = np.flatnonzero(np.diff(base, prepend=np.uint8(SPACE)))
        begin = change[base[change] != SPACE]
        stop = np.append(change[1:], len(base))[base[change] != SPACE] if len(change) else begin
        self.doc = np.searchsorted(offsets, begin, side="right") - 1
        shift = offsets[self.doc] if len(begin) else begin
        self.start, self.end = begin - shift, stop - shift
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.count = np.diff(self.first)
        if not boundaries:
            return
        space = np.flatnonzero(base == SPACE)
        place = np.arange(len(kind))
        plain = np.maximum.accumulate(np.where((kind & _CLOSE) == 0, place, -1)) if len(kind) else place
        before = plain[np.maximum(space - 1, 0)]
        natural = ((kind[space] & _FEED) > 0) | ((space > 0) & (before >= 0) & ((kind[np.maximum(before, 0)] & _END) > 0))
        at = space[natural]
        doc = np.searchsorted(offsets, at, side="right") - 1
        cut = np.searchsorted(begin, at) - self.first[doc]
        inside = (cut > 0) & (cut < self.count[doc])
        doc, cut = doc[inside], cut[inside]
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(cut) != 0)) if len(doc) else np.zeros(0, dtype=bool)
        self.cut_doc, self.cut = doc[new], cut[new]
