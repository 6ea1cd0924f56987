"""Records that are the same but for their looks (problem 3).

Method: recursive radix partitioning on canonical bytes, then counting in tries.

* A record's canonical form is the two bare forms of its fields (plain form, letters and digits only) in
  sorted order, so field order does not count.
* Records fall into buckets by the first bytes of the canonical form; a bucket with more than
  ``BUCKET_ROWS`` records is split by further bytes, level by level, until each fits or its records
  end: what has no further bytes is one record, however many rows it has.  The first levels read a stored head only, and a
  level's table holds oversized prefixes only.
* Each bucket's records go into a compressed trie whose terminals count copies and keep the
  smallest row id.

Copies inside one task are folded before the shuffle, so a record that a third of all rows repeat
costs one shuffled row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .textcodes import blocks, plain_letters

BUCKET_ROWS = 20_000
#: Bytes of the first level (each further one looks at twice as many), and bytes of the head that is stored apart.
FIRST_LEVEL, HEAD = 2, 32
#: Characters of distinct canonical forms that a task holds at most before it passes them on.
FOLD_CHARS = 40_000_000


def bare_forms(texts: list[str]) -> list[str]:
    """Bare forms of texts: the plain form with nothing but letters and digits."""
    return [s for _, part in blocks(texts) for s in plain_letters(part)]


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, a, b) -> (row_id, first, low, n, canon): low, n and canon only for a record's first row in the task.

    ``low`` is the smallest row id that the task has of the record, ``n`` its rows there.
    """
    seen: dict[str, list[int]] = {}
    held = 0

    def flush():
        rows = list(seen.items())
        seen.clear()
        for s in range(0, len(rows), 2000):
            part = rows[s:s + 2000]
            first = pa.array([r[0] for _, r in part], pa.int64())
            yield pa.record_batch([first, first, pa.array([r[2] for _, r in part], pa.int64()), pa.array([r[1] for _, r in part], pa.int64()), pa.array([k for k, _ in part], pa.string())], names=["row_id", "first", "low", "n", "canon"])

    for b in batches:
        ids, x, y = b.column(0).to_pylist(), bare_forms(b.column(1).to_pylist()), bare_forms(b.column(2).to_pylist())
        row, first = [], []
        for i, p, q in zip(ids, x, y):
            key = f"{p} {q}" if p <= q else f"{q} {p}"
            got = seen.get(key)
            if got is None:
                seen[key] = [i, 1, i]
                held += len(key) + 100
            else:
                got[1] += 1
                got[2] = min(got[2], i)
                row.append(i)
                first.append(got[0])
        if row:
            yield pa.record_batch([pa.array(row, pa.int64()), pa.array(first, pa.int64()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.string())], names=["row_id", "first", "low", "n", "canon"])
        if held > FOLD_CHARS:
            yield from flush()
            held = 0
    yield from flush()


class Trie:
    """A compressed trie: edges carry strings, terminals the rows that end there and their count."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: list = ["", {}, None]  # label, children by first character, terminal

    def add(self, key: str, row: int, n: int, low: int | None = None) -> None:
        """Adds ``row``, which stands for ``n`` copies of which ``low`` is the smallest."""
        low = row if low is None else low
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = [0, low, []]
                t = node[2]
                t[0] += n
                t[1] = min(t[1], low)
                t[2].append(row)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [n, low, [row]]]
                return
            label = child[0]
            if not key.startswith(label, at):
                common, most = 0, min(len(label), len(key) - at)
                while common < most:
                    mid = (common + most + 1) // 2
                    if key.startswith(label[:mid], at):
                        common = mid
                    else:
                        most = mid - 1
                lower = [label[common:], child[1], child[2]]
                child[0], child[1], child[2] = label[:common], {label[common]: lower}, None
                label = child[0]
            node, at = child, at + len(label)

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            _, children, terminal = stack.pop()
            if terminal is not None:
                yield terminal
            stack.extend(children.values())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, row, low, n, canon) sorted by bucket -> (row, first_row, copies, lead); one row of each record leads."""
    trie, open_bucket = Trie(), None

    def close():
        rows, first, copies, lead = [], [], [], []
        for n, low, members in trie.terminals():
            rows += members
            first += [low] * len(members)
            copies += [n] * len(members)
            lead += [True] + [False] * (len(members) - 1)
        for s in range(0, len(rows), 10_000):
            yield pa.record_batch([*[pa.array(x[s:s + 10_000], pa.int64()) for x in (rows, first, copies)], pa.array(lead[s:s + 10_000], pa.bool_())], names=["row", "first_row", "copies", "lead"])

    for b in batches:
        for bucket, row, low, n, canon in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != open_bucket:
                yield from close()
                trie, open_bucket = Trie(), bucket
            trie.add(canon, row, n, low)
    yield from close()


def _bucketed(table: DataFrame, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """Adds ``bucket``, the shortest prefix on the ladder of levels that at most ``bucket_rows`` records share.

    A prefix counts as oversized only by records that go on behind it, so the ladder ends with the longest of them.
    """
    source = table.where("canon is not null")
    spread, tops, level = source, [], FIRST_LEVEL
    while True:
        text = F.col("head") if level < HEAD else F.col("canon").cast("binary")
        counted = source.select(F.substring(text, 1, level).alias("prefix"), F.octet_length(text).alias("size"), *[F.substring(text, 1, level // 2).alias("up")] * bool(tops))
        if tops:
            counted = counted.join(tops[-1][1].select(F.col("prefix").alias("up")), "up", "left_semi")
        over = scratch.keep(counted.where(F.col("size") > level).groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("prefix"), f"over-{level}")
        if over.isEmpty():
            break
        tops.append((level, over))
        level *= 2
    whole = F.col("canon").cast("binary")
    bucket = F.substring(whole, 1, FIRST_LEVEL)
    for level, over in tops:
        mark = f"_over{level}"
        spread = spread.withColumn("_p", F.substring(whole, 1, level)).join(over.select(F.col("prefix").alias("_p"), F.lit(True).alias(mark)), "_p", "left").drop("_p")
        bucket = F.when(F.col(mark), F.substring(whole, 1, 2 * level)).otherwise(bucket)
    return spread.select(bucket.alias("bucket"), F.col("row_id").alias("row"), "low", "n", "canon")


def _grouped(records: DataFrame, a: str, b: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their task's first copy; first copies with their group's first row and copies)."""
    scratch = Scratch(records.sparkSession, "copies")
    blank = F.regexp_replace(F.col(b), r"[\s\x1c-\x1f\x85\p{Z}]+", "") == ""
    rows = records.where(F.col("row_id").isNotNull() & F.col(b).isNotNull() & ~blank).select(F.col("row_id").cast("bigint").alias("row_id"), F.coalesce(F.col(a), F.lit("")).alias("a"), F.col(b).alias("b"))
    table = scratch.keep(rows.mapInArrow(_canonical, "row_id bigint, first bigint, low bigint, n bigint, canon string").withColumn("head", F.substring(F.col("canon").cast("binary"), 1, HEAD)), "canonical")
    buckets = _bucketed(table, scratch, bucket_rows).repartition("bucket").sortWithinPartitions("bucket")
    firsts = scratch.keep(buckets.mapInArrow(_count, "row bigint, first_row bigint, copies bigint, lead boolean"), "counts")
    return table.select("row_id", "first"), firsts


def copy_sets(records: DataFrame, a: str = "termo", b: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(first_row_id BIGINT, row_id BIGINT)`` for each member of a set of two or more copies.

    Two rows are copies if the bare forms of the fields ``a`` and ``b`` are the same two values in either
    order.  A null ``a`` counts as empty; rows with a null or blank ``b``, or a null ``row_id``, are left out.
    Other columns are ignored.  A set goes by its smallest ``row_id``.  An empty table gives an empty result.
    """
    rows, firsts = _grouped(records, a, b, bucket_rows)
    sets = firsts.where("copies > 1").select(F.col("row").alias("first"), F.col("first_row").alias("first_row_id"))
    return rows.join(sets, "first").select("first_row_id", "row_id")


def one_of_each(records: DataFrame, a: str = "termo", b: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(row_id, copies)``: the first row of each record, and how many rows it stands for (itself included)."""
    _, firsts = _grouped(records, a, b, bucket_rows)
    return firsts.where("lead").select(F.col("first_row").alias("row_id"), "copies")
