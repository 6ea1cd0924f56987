"""Records that stand in an evaluation split and in the training split (problem 1).

Method: similarity-hash bit fingerprints.  A text's fingerprint has ``WIDTH`` codes of 8 bits, those of its minimum word
hashes, so that two texts agree in a code with their likeness as the chance.  Code blocks, each the first codes of a
permutation of the fingerprint, are joined across the splits; a candidate stays if 128 of the fingerprint's bits
differ in at most ``RADIUS`` places, and then the likeness of the texts themselves is computed.

The codes of a block grow with the logarithm of the evaluation texts' number, so that a training row meets a bounded
number of unrelated ones however large the tables are, and the number of blocks with them, so that a pair at the
threshold is missed with a chance of 1e-3 (at most 7e-5 at a likeness of 0.75, 2e-6 at 0.8, where it is 0.7); it lies beyond the radius
with 1e-6.  All blocks of all rows take part, as packed entries of six bytes (``packed``); nothing is broadcast.

Copies of a word set take part once per task and are put back at the end by a salted join.  A block code that more than
``LOCAL`` rows of a batch share travels apart, as one list of rows a batch, spread over ``SALTS`` tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..operators.skew import salted_join
from . import packed
from .likeness import likeness, near_bits, word_arrays
from .sketch import WordTable, hash_values, pack_bits, set_codes
from .textcodes import blocks, word_sets

RADIUS, LOCAL, SALTS = 40, 64, 32
MIN_LIKENESS, MIN_WORDS = 0.7, 20

_ROWS = "id {}, code bigint, f1 bigint, f2 bigint, codes binary"


def fingerprints(min_words: int):
    """(id, text) -> (id, code, f1, f2, codes); texts under ``min_words`` words are left out.

    ``codes`` is null for a text whose word set came before in the task.
    """
    def run(batches):
        table = WordTable(packed.WIDTH, np.uint32, lambda c: hash_values(c, packed.WIDTH))
        seen: set[int] = set()
        for b in batches:
            for first, part in blocks(b.column(1).to_pylist()):
                vocabulary, doc, word = word_sets(part)
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                good = np.flatnonzero(np.diff(ends) >= min_words)
                if not len(good):
                    continue
                code = set_codes(vocabulary, doc, word, len(part))[good].view(np.int64)
                if len(seen) > 500_000:  # what is forgotten only takes part once more
                    seen.clear()
                fresh = np.array([not (c in seen or seen.add(c)) for c in code.tolist()], dtype=bool)
                place = table.look_up(vocabulary)[word]
                low = np.empty((fresh.sum(), packed.WIDTH), dtype=np.uint32)
                for i, d in enumerate(good[fresh].tolist()):
                    table.rows[place[ends[d]:ends[d + 1]]].min(axis=0, out=low[i])
                byte = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                f1, f2 = np.zeros(len(good), dtype=np.int64), np.zeros(len(good), dtype=np.int64)
                f1[fresh], f2[fresh] = pack_bits(byte[:, :128] & 1)
                values = iter(byte)
                binary = pa.array([next(values).tobytes() if f else None for f in fresh], pa.binary())
                yield pa.record_batch([b.column(0).take(pa.array(first + good)), pa.array(code), pa.array(f1), pa.array(f2), binary], names=["id", "code", "f1", "f2", "codes"])
    return run


def _entries(columns: np.ndarray, parts: int, local: int | None, apart: bool = False):
    """(ref, codes) -> packed entries without the crowded ones, or, with ``apart``, the crowded ones as (key, rows)."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            refs, keys = b.column(0).to_numpy(zero_copy_only=False), packed.band_keys(packed.matrix(b.column(1)), columns)
            flat, ref = keys.ravel(), np.repeat(refs, keys.shape[1])
            hot = packed.crowded(flat, local) if local is not None else np.zeros(len(flat), dtype=bool)
            if not apart:
                yield packed.pack(flat[~hot], ref[~hot], parts)
            elif hot.any():
                yield packed.lists(flat[hot], ref[hot])
    return run


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    a, b = packed.met(packed.unpack(left)[:2], packed.unpack(right)[:2])
    return pa.table({"row_id": pa.array(a, pa.int64()), "test_code": pa.array(b, pa.int64())})


def candidates(rows: DataFrame, items: DataFrame, scratch: Scratch, codes: int, bands: int, local: int = LOCAL) -> DataFrame:
    """``(row_id, test_code)``: the pairs of ``rows(id, codes)`` and ``items(code, codes)`` with a block in common; pairs may repeat."""
    columns = packed.band_columns(codes, bands)
    left, right = rows.where("codes is not null").select("id", "codes"), items.where("codes is not null").select("code", "codes")
    parts = packed.parts_for((rows.count() + items.count()) * bands)
    hot = scratch.keep(left.mapInArrow(_entries(columns, parts, local, True), "key bigint, rows array<bigint>"), "crowded")
    x = left.mapInArrow(_entries(columns, parts, local), packed.SCHEMA).groupBy("part")
    y = right.mapInArrow(_entries(columns, parts, None), packed.SCHEMA)
    pairs = x.cogroup(y.groupBy("part")).applyInArrow(_meet, "row_id bigint, test_code bigint")
    if not hot.isEmpty():
        test_keys = right.mapInArrow(_entries(columns, parts, 0, True), "key bigint, rows array<bigint>").select("key", F.explode("rows").alias("test_code"))
        wanted = test_keys.join(hot.select("key").distinct(), "key", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lists = hot.withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(SALTS)).cast("int"))
        pairs = pairs.unionByName(lists.join(wanted, ["key", "salt"]).select(F.explode("rows").alias("row_id"), "test_code"))
    return pairs


def overlapping_pairs(train: DataFrame, tests: DataFrame, min_likeness: float = MIN_LIKENESS, min_words: int = MIN_WORDS, codes: int | None = None, bands: int | None = None, local: int = LOCAL) -> DataFrame:
    """``(row_id BIGINT, test_id STRING)``: rows of both splits whose texts are alike.

    ``train`` needs ``row_id, text``, ``tests`` needs ``id, text``; other columns are ignored.  Texts with
    fewer than ``min_words`` distinct words (null and empty ones too) match nothing, nor do null ids.
    Each pair comes out once; empty tables give an empty result.  ``codes`` a block and the number of blocks
    (``bands``) follow from the number of tests and the likeness unless given.
    """
    scratch = Scratch(train.sparkSession, "overlap")
    t = tests.select(F.col("id").cast("string").alias("id"), "text").where("id is not null and text is not null")
    items = scratch.keep(t.mapInArrow(fingerprints(min_words), _ROWS.format("string")), "tests")
    texts = train.select(F.col("row_id").cast("bigint").alias("id"), "text").where("row_id is not null and text is not null")
    rows = scratch.keep(texts.mapInArrow(fingerprints(min_words), _ROWS.format("bigint")), "rows")
    codes = codes or packed.codes_for(items.count())
    met = candidates(rows, items, scratch, codes, bands or packed.bands_for(codes, min_likeness), local).repartition("row_id").distinct()

    x = rows.where("codes is not null").select(F.col("id").alias("row_id"), "code", F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    y = items.where("codes is not null").select(F.col("code").alias("test_code"), F.col("f1").alias("y1"), F.col("f2").alias("y2")).distinct()
    near = scratch.keep(met.join(x, "row_id").join(y, "test_code").where(near_bits(RADIUS)).groupBy("code", "test_code").agg(F.min("row_id").alias("row_id")), "near")

    wanted = near.select(F.col("row_id").alias("id")).distinct()
    left = word_arrays(texts.join(wanted, "id", "left_semi")).select(F.col("id").alias("row_id"), F.col("words").alias("a"))
    coded = tests.select("text").where("text is not null").mapInArrow(_coded, "id bigint, text string").dropDuplicates(["id"])
    right = word_arrays(coded).select(F.col("id").alias("test_code"), F.col("words").alias("b"))
    alike = scratch.keep(near.join(left, "row_id").join(right, "test_code").where(likeness("a", "b") >= min_likeness).select("code", "test_code"), "alike")

    members = rows.select(F.col("id").alias("row_id"), "code").distinct()
    named = alike.join(items.select(F.col("id").alias("test_id"), F.col("code").alias("test_code")).distinct(), "test_code").select("code", "test_id").distinct()
    sized = scratch.keep(named.join(rows.groupBy("code").agg(F.count("*").alias("n")), "code"), "named")
    return salted_join(members, sized, "code", "n", "row_id").select("row_id", "test_id")


def _coded(batches):
    for b in batches:
        for first, part in blocks(b.column(0).to_pylist()):
            code = set_codes(*word_sets(part), len(part))
            yield pa.record_batch([pa.array(code.view(np.int64)), b.column(0).slice(first, len(part))], names=["id", "text"])


def overlap_report(train: DataFrame, tests: DataFrame, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """Overlaps per ``split_name`` of the tests and ``source`` of the training rows.

    ``(split_name, source, pairs, train_rows, test_items)``; a null split or source is a group of its own.
    An id that occurs under several splits counts in each.
    """
    pairs = overlapping_pairs(train, tests, min_likeness)
    of = tests.select(F.col("id").cast("string").alias("test_id"), "split_name").distinct()
    full = pairs.join(of, "test_id").join(train.select("row_id", "source"), "row_id")
    return full.groupBy("split_name", "source").agg(F.count("*").alias("pairs"), F.countDistinct("row_id").alias("train_rows"), F.countDistinct("test_id").alias("test_items"))
