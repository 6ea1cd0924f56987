"""Joins on 64-bit keys of which a row has many, with packed entries.

A row's entries (key, row) cost six bytes each on their way to their part: a part holds the keys with equal low bits, what is
left of a key is 32 bits, and rows are 16-bit offsets from a number that the entries of a batch share.  Parts are
sorted and met by NumPy.  The number of parts follows the number of entries, so a part stays of one size as the data grow.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Entries of a part (expected), registers or codes of a fingerprint that bands are taken from.
PART_ENTRIES = 500_000
WIDTH = 512
#: Rows up to which bands of 6 codes suffice, and the factor in rows for one code more: unrelated texts agree in a code
#: with a chance of about one in seven.
FIRST_ROWS, FACTOR = 175_000, 7

SCHEMA = "part int, kind int, base bigint, refs binary, rems binary"


def codes_for(rows: int) -> int:
    """Codes of a band, such that a row meets about seven unrelated ones at most, however many ``rows`` there are."""
    return max(4, 6 + math.ceil(math.log(max(rows, 1) / FIRST_ROWS) / math.log(FACTOR) - 1e-9))


@lru_cache(maxsize=64)
def bands_for(codes: int, likeness: float = 0.7, miss: float = 1e-3, width: int = WIDTH) -> int:
    """The least number of bands, each of ``codes`` of ``width`` codes, by which two texts of that likeness meet but for ``miss``."""
    hits = np.arange(width + 1)
    log_c = np.array([math.lgamma(n + 1) for n in range(width + 1)])
    pmf = np.exp(log_c[width] - log_c - log_c[::-1] + hits * math.log(likeness) + (width - hits) * math.log1p(-min(likeness, 1 - 1e-12)))
    log_choose = np.where(hits >= codes, log_c - log_c[codes] - log_c[np.maximum(hits - codes, 0)], -np.inf)
    meet = np.exp(log_choose - log_choose[width])
    low, high = 0, 1
    missed = lambda b: float((pmf * (1 - meet) ** b).sum())
    while missed(high) > miss:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > miss else (low, mid)
    return high


def band_columns(codes: int, bands: int, width: int = WIDTH) -> np.ndarray:
    """Which codes make up each band: the first ``codes`` of a permutation (bands x codes)."""
    r = np.random.default_rng(1_000 * codes + bands)
    return np.stack([r.permutation(width)[:codes] for _ in range(bands)])


def band_keys(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(rows x width) bytes -> (rows x bands) keys."""
    from .textcodes import mix64

    key = np.broadcast_to(np.arange(len(columns), dtype=np.uint64), (len(matrix), len(columns))).copy()
    for j in range(columns.shape[1]):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += matrix[:, columns[:, j]]
        key ^= key >> np.uint64(29)
    return mix64(key, 51)


def matrix(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """A binary column of ``width`` bytes a row, without nulls, as (rows x width)."""
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start:start + len(column) * width].reshape(-1, width)


def parts_for(entries: int) -> int:
    """A power of two."""
    return 1 << max(4, math.ceil(math.log2(max(entries, 1) / PART_ENTRIES + 1e-9)))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32) * np.int32(data.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def pack(keys: np.ndarray, refs: np.ndarray, parts: int, kind: int = 0) -> pa.RecordBatch:
    """Entries (key uint64, row int64) -> one record a part and range of 65,536 rows; rows too far apart for that are kept whole (base null)."""
    part = (keys & np.uint64(parts - 1)).astype(np.int64)
    span, number = np.unique((refs.view(np.uint64) - refs.min().view(np.uint64)) >> np.uint64(16) if len(refs) else np.zeros(0, np.uint64), return_inverse=True)
    wide = len(span) > 1 and len(span) * parts > len(refs) // 8
    group = part if wide else part + number * parts
    order = np.argsort(group, kind="stable")
    group, part = group[order], part[order]
    start = np.flatnonzero(np.append(True, np.diff(group) != 0)) if len(group) else np.zeros(0, dtype=np.int64)
    ends = np.append(start[1:], len(group)) if len(group) else start
    rems = (keys[order] >> np.uint64(32)).astype(np.uint32)
    if wide:
        base, data = pa.nulls(len(start), pa.int64()), refs[order]
    else:
        low = (refs.min().view(np.uint64) + (span[number[order][start]] << np.uint64(16))).view(np.int64) if len(refs) else np.zeros(0, dtype=np.int64)
        base = pa.array(low, pa.int64())
        data = (refs[order] - np.repeat(low, ends - start)).astype(np.uint16)
    return pa.record_batch([pa.array(part[start].astype(np.int32)), pa.array(np.full(len(start), kind, dtype=np.int32)), base, _binaries(data, ends), _binaries(rems, ends)], names=["part", "kind", "base", "refs", "rems"])


def unpack(table: pa.Table, kind: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rest of the key uint32, row int64, kind) of all entries of the records."""
    rems, rows, kinds = [], [], []
    for k, base, refs, rem in zip(*(table.column(c).to_pylist() for c in ("kind", "base", "refs", "rems"))):
        if kind is not None and k != kind:
            continue
        r = np.frombuffer(rem, dtype=np.uint32)
        rems.append(r)
        rows.append(np.frombuffer(refs, dtype=np.int64) if base is None else np.frombuffer(refs, dtype=np.uint16).astype(np.int64) + base)
        kinds.append(np.full(len(r), k, dtype=np.int8))
    if not rems:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(rems), np.concatenate(rows), np.concatenate(kinds)


def short(keys: np.ndarray, parts: int) -> np.ndarray:
    """What an entry keeps of its key: the upper half and the part."""
    return keys & np.uint64(0xFFFFFFFF00000000) | keys & np.uint64(parts - 1)


def crowded(keys: np.ndarray, local: int) -> np.ndarray:
    """Which of the keys of a batch occur more than ``local`` times in it."""
    cell = ((keys >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)
    out = np.zeros(len(keys), dtype=bool)
    many = np.bincount(cell, minlength=1 << 20) > local
    if many.any():
        at = np.flatnonzero(many[cell])
        _, number, n = np.unique(keys[at], return_inverse=True, return_counts=True)
        out[at] = n[number] > local
    return out


def lists(keys: np.ndarray, refs: np.ndarray) -> pa.RecordBatch:
    """Entries as one list of rows a key: (key, rows)."""
    order = np.argsort(keys, kind="stable")
    key, row = keys[order], refs[order]
    start = np.flatnonzero(np.append(True, np.diff(key) != 0))
    return pa.record_batch([pa.array(key[start].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(row))], names=["key", "rows"])


def slices(sizes: np.ndarray, most: int = 4_000_000):
    """(start, end) of neighbouring sizes that come to about ``most`` together."""
    if len(sizes):
        cut = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + most, most), "left")
        for s, e in zip(cut, np.append(cut[1:], len(sizes))):
            if e > s:
                yield int(s), int(e)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))
    return a[new], b[new]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


def met(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], most: int = 4_000_000):
    """Distinct pairs (left row, right row) of entries with equal keys; works in slices of about ``most`` pairs."""
    order = np.argsort(right[0], kind="stable")
    keys, rows = right[0][order], right[1][order]
    low, high = np.searchsorted(keys, left[0], "left"), np.searchsorted(keys, left[0], "right")
    live = np.flatnonzero(high > low)
    size = (high - low)[live]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in slices(size, most):
        x, y = unique_pairs(np.repeat(left[1][live[s:e]], size[s:e]), rows[ranges(low[live[s:e]], size[s:e])])
        a.append(x)
        b.append(y)
    return unique_pairs(np.concatenate(a), np.concatenate(b))
