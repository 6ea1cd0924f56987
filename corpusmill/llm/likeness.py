"""Exact likeness of candidate pairs: the words both texts hold over the words either holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcodes import blocks, word_sets


def word_arrays(texts: DataFrame) -> DataFrame:
    """``(id BIGINT, text STRING)`` -> ``(id, words ARRAY<BIGINT>)``, the distinct word codes."""
    def run(batches):
        for b in batches:
            for first, part in blocks(b.column(1).to_pylist()):
                vocabulary, doc, word = word_sets(part)
                ends = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(vocabulary[word].view(np.int64)))
                yield pa.record_batch([b.column(0).slice(first, len(part)), lists], names=["id", "words"])
    return texts.mapInArrow(run, "id bigint, words array<bigint>")


def likeness(a: str, b: str) -> Column:
    """Likeness of two arrays of distinct word codes."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_bits(limit: int) -> Column:
    """Whether two 128-bit fingerprints ``(x1, x2)``, ``(y1, y2)`` differ in at most ``limit`` bits."""
    return F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2"))) <= limit
