"""Groups of records with nearly the same words (problem 2).

Method: SetSketch registers.  Each text gets ``WIDTH`` registers (truncated minima on an exponential scale); bands
of registers are hashed into buckets; texts of a bucket are candidates.  128 register bits first drop most chance
meetings, then the two sketches give a maximum-likelihood estimate of the likeness, and what that leaves is verified on
the texts' words.  Verified links are closed to groups by distributed connected components.

The registers of a band grow with the logarithm of the rows, so that a row meets a bounded number of unrelated ones
however many there are, and the number of bands with them, so that a pair at the threshold shares no band with a
chance of 1e-3 (at most 7e-5 at a likeness of 0.75, 2e-6 at 0.8, where it is 0.7); it falls outside ``RADIUS`` with 1e-6, and below the
estimate's margin (six standard errors) with 1e-9.  Entries travel packed, six bytes each (``packed``); nothing is broadcast.

Skew.  Copies of a word set carry a sketch once per task; the rest are linked by their code in a salted join.  In a
bucket of up to ``BUCKET`` texts all pairs are candidates.  In a larger one only a star around one member
is, at first, also inside a map task before the shuffle; afterwards the members that are still in
another group than the bucket's largest are compared with all its members, in salted blocks.
So a group holding a third of all rows costs its size, and no candidate of a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.scratch import Scratch
from ..operators.skew import salted_join
from . import packed
from .likeness import likeness, near_bits
from .packed import WIDTH
from .sketch import WordTable, joint_estimate, pack_bits, register_values, set_codes
from .textcodes import blocks, word_sets

RADIUS = 40
MIN_LIKENESS, MIN_WORDS = 0.7, 20
BUCKET, LOCAL = 256, 64
#: Registers that a candidate's joint estimate is made from.
ESTIMATED = 256

_SKETCHES = "row_id bigint, code bigint, n int, d1 bigint, d2 bigint, registers binary"
_PLAIN, _PIVOT, _STAR = 0, 1, 2


def sketches(min_words: int):
    """(row_id, text) -> a row for each text with ``min_words`` distinct words; registers null for a copy seen in the task."""
    def run(batches):
        table = WordTable(WIDTH, np.uint8, lambda c: register_values(c, WIDTH))
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
                sketch = np.empty((int(fresh.sum()), WIDTH), dtype=np.uint8)
                for i, d in enumerate(good[fresh].tolist()):
                    table.rows[place[ends[d]:ends[d + 1]]].max(axis=0, out=sketch[i])
                d1, d2 = np.zeros(len(good), dtype=np.int64), np.zeros(len(good), dtype=np.int64)
                d1[fresh], d2[fresh] = pack_bits(sketch[:, :128] & 1)
                values = iter(sketch)
                binary = pa.array([next(values).tobytes() if f else None for f in fresh], pa.binary())
                yield pa.record_batch([b.column(0).take(pa.array(first + good)), pa.array(code), pa.array(np.diff(ends)[good].astype(np.int32)), pa.array(d1), pa.array(d2), binary], names=["row_id", "code", "n", "d1", "d2", "registers"])
    return run


def band_entries(columns: np.ndarray, parts: int, local: int):
    """(row_id, registers) -> packed band entries.

    A run of more than ``local`` equal keys in a batch becomes a star on the spot: its first row enters the bucket as a
    pivot; the others travel apart, as (key, pivot, row) of a part of their own.
    """
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, keys = b.column(0).to_numpy(zero_copy_only=False), packed.band_keys(packed.matrix(b.column(1)), columns)
            key, row = keys.ravel(), np.repeat(rows, keys.shape[1])
            hot = packed.crowded(key, local)
            yield packed.pack(key[~hot], row[~hot], parts, _PLAIN)
            if hot.any():
                order = np.lexsort((row[hot], key[hot]))
                key, row = key[hot][order], row[hot][order]
                start = np.flatnonzero(np.append(True, np.diff(key) != 0))
                yield packed.pack(key[start], row[start], parts, _PIVOT)
                size = np.diff(np.append(start, len(key)))
                leaf = np.ones(len(key), dtype=bool)
                leaf[start] = False
                three = np.stack((key.view(np.int64), np.repeat(row[start], size), row), axis=1)[leaf]
                # parts below zero only pass the stars on
                own = -1 - int(rows[0] % 1024)
                yield pa.record_batch([pa.array([own], pa.int32()), pa.array([_STAR], pa.int32()), pa.nulls(1, pa.int64()), pa.array([three.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["part", "kind", "base", "refs", "rems"])
    return run


def bucket_pairs(bucket: int):
    """All entries of a part -> (a, b, key): candidate pairs, or members of large buckets (b null)."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            three = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for x in table.column("refs").to_pylist()])
            stars_a, stars_b = packed.unique_pairs(three[:, 1], three[:, 2])
            return _met([(stars_a, stars_b)], three[:, 0], three[:, 2])
        rem, row, kind = packed.unpack(table)
        order = np.argsort(rem, kind="stable")
        rem, row, pivot = rem[order], row[order], kind[order] == _PIVOT
        start = np.flatnonzero(np.append(True, np.diff(rem) != 0)) if len(rem) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(start, len(rem)))
        large = size > bucket
        if pivot.any():
            large |= np.logical_or.reduceat(pivot, start)
        out = []
        small, n = start[~large], size[~large]
        for k in range(1, int(n.max()) if len(n) else 0):
            live = n > k
            i = packed.ranges(small[live], n[live] - k)
            out.append((row[i], row[i + k]))
        member = packed.ranges(start[large], size[large])
        out.append((np.repeat(row[start[large]], size[large]), row[member]))
        keys = (rem[member].astype(np.uint64) << np.uint64(32) | np.uint64(part)).view(np.int64)
        return _met(out, keys, row[member])
    return run


def _met(pairs, keys: np.ndarray, members: np.ndarray) -> pa.Table:
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    live = a != b
    a, b = packed.unique_pairs(np.minimum(a, b)[live], np.maximum(a, b)[live])
    return pa.table([pa.array(np.concatenate((a, members)), pa.int64()), pa.array(np.concatenate((b, np.zeros(len(members), np.int64))), pa.int64(), mask=np.arange(len(a) + len(members)) >= len(a)),
                     pa.array(np.concatenate((np.zeros(len(a), np.int64), keys)), pa.int64(), mask=np.arange(len(a) + len(members)) < len(a))], names=["a", "b", "key"])


def _estimated(min_likeness: float):
    """Keeps the pairs whose joint estimate does not rule out the threshold."""
    def run(batches):
        for b in batches:
            s = packed.matrix(b.column(2), ESTIMATED).astype(np.int16) - packed.matrix(b.column(3), ESTIMATED)
            above, below = (s > 0).sum(axis=1), (s < 0).sum(axis=1)
            na, nb = b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            j = joint_estimate(na, nb, above, below, ESTIMATED - above - below)
            margin = 6 * np.sqrt(min_likeness * (1 - min_likeness) / ESTIMATED)
            yield b.filter(pa.array(j >= min_likeness - margin))
    return run


def _sketched_words():
    """(id, text) -> (id, n, registers, words)."""
    def run(batches):
        table = WordTable(ESTIMATED, np.uint8, lambda c: register_values(c, ESTIMATED))
        for b in batches:
            for first, part in blocks(b.column(1).to_pylist()):
                vocabulary, doc, word = word_sets(part)
                ends = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                place = table.look_up(vocabulary)[word]
                sketch = [table.rows[place[s:e]].max(axis=0).tobytes() if e > s else bytes(ESTIMATED) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(vocabulary[word].view(np.int64)))
                yield pa.record_batch([b.column(0).slice(first, len(part)), pa.array(np.diff(ends)), pa.array(sketch, pa.binary()), lists], names=["id", "n", "registers", "words"])
    return run


def _linked(pairs: DataFrame, texts: DataFrame, scratch: Scratch, min_likeness: float) -> DataFrame:
    """The candidate pairs (a, b) that pass the estimate and then hold on the texts' words.

    Sketches and words are made of the candidates' texts only, after a semi join by row.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    table = scratch.keep(texts.join(ids, "id", "left_semi").mapInArrow(_sketched_words(), "id bigint, n int, registers binary, words array<bigint>"), "words")
    sketch, words = table.select("id", "n", "registers"), table.select("id", "words")
    both = (pairs.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
            .join(sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b").select("a", "b", "ra", "rb", "na", "nb"))
    likely = scratch.keep(both.mapInArrow(_estimated(min_likeness), both.schema).select("a", "b"), "likely")
    full = likely.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    links = scratch.keep(full.where(likeness("wa", "wb") >= min_likeness).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    scratch.drop(table)
    return links


def _digests(table: DataFrame, row: str, x: str) -> DataFrame:
    return table.where("registers is not null").select(F.col("row_id").alias(row), F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"))


def candidates(table: DataFrame, registers: int, bands: int, bucket: int = BUCKET, local: int = LOCAL) -> DataFrame:
    """``(a, b, key)``: pairs of ``table(row_id, registers)`` that share a band; rows with b null are the members of large buckets."""
    fresh = table.where("registers is not null").select("row_id", "registers")
    parts = packed.parts_for(table.count() * bands)
    return fresh.mapInArrow(band_entries(packed.band_columns(registers, bands), parts, local), packed.SCHEMA).groupBy("part").applyInArrow(bucket_pairs(bucket), "a bigint, b bigint, key bigint")


def near_duplicate_groups(records: DataFrame, min_likeness: float = MIN_LIKENESS, min_words: int = MIN_WORDS, bucket: int = BUCKET, local: int = LOCAL, registers: int | None = None, bands: int | None = None) -> DataFrame:
    """``(group_row_id BIGINT, row_id BIGINT)`` for every member of a group of two or more.

    ``records`` needs ``row_id, text``; other columns are ignored.  Rows whose texts reach ``min_likeness`` are
    linked, links are closed transitively, a group goes by its smallest ``row_id``.  Texts with fewer than
    ``min_words`` distinct words (null and empty ones too) and null ids are in no group; a row id that occurs
    twice comes out once.  An empty table gives an empty result.  ``registers`` of a band and the number of
    ``bands`` follow from the number of rows and the likeness unless given.
    """
    scratch = Scratch(records.sparkSession, "neardup")
    texts = records.select(F.col("row_id").cast("bigint").alias("id"), "text").where("row_id is not null and text is not null")
    table = scratch.keep(texts.mapInArrow(sketches(min_words), _SKETCHES), "sketches")

    registers = registers or packed.codes_for(table.count())
    met = scratch.keep(candidates(table, registers, bands or packed.bands_for(registers, min_likeness), bucket, local), "met")
    pairs = met.where("b is not null").select("a", "b").repartition("a").distinct()
    near = pairs.join(_digests(table, "a", "x"), "a").join(_digests(table, "b", "y"), "b").where(near_bits(RADIUS)).select("a", "b")
    links = _linked(scratch.keep(near, "near"), texts, scratch, min_likeness)

    first = scratch.keep(table.groupBy("code").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    copies = salted_join(table.select("row_id", "code"), first, "code", "n", "row_id").select(F.col("row_id").alias("u"), F.col("first").alias("v"))
    edges = links.unionByName(copies)
    groups = connected_components(edges, scratch)

    crowd = met.where("key is not null").select("key", F.col("a").alias("row")).distinct()
    if not crowd.isEmpty():
        crowd = scratch.keep(crowd, "crowd")
        label = groups.select(F.col("id").alias("row"), "component")
        of = scratch.keep(crowd.join(label, "row", "left").select("key", "row", F.coalesce("component", "row").alias("component")), "crowd-groups")
        sizes = of.groupBy("key", "component").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("key")))
        main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("all").alias("all"), F.max("n").alias("most")).where("most < all").select("key", "main", F.ceil(F.col("all") / bucket).cast("int").alias("ways"))
        full = of.join(main, "key").join(_digests(table, "row", "x"), "row")
        block = full.withColumn("block", F.pmod(F.xxhash64("row"), F.col("ways")))
        rest = full.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
        other = rest.select("key", "block", F.col("row").alias("other"), F.col("component").alias("group"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
        more = block.join(other, ["key", "block"]).where("component <> `group`").where(near_bits(RADIUS)).select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
        links = _linked(scratch.keep(more, "more"), texts, scratch, min_likeness)
        groups = connected_components(groups.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(links), scratch)

    size = groups.groupBy("component").count().where("count > 1").select("component")
    return groups.join(size, "component", "left_semi").select(F.col("component").alias("group_row_id"), F.col("id").alias("row_id"))


def group_report(records: DataFrame, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """``(members, groups)``: how many groups have how many members."""
    g = near_duplicate_groups(records, min_likeness)
    return g.groupBy("group_row_id").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))
