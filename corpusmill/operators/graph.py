"""Connected components of an edge table, distributed.

``connected_components`` first contracts each partition to a spanning forest, then runs
large-star / small-star rounds (Kiveris et al. 2014, public) until nothing changes; a vertex with many edges is
spread over tasks.  A contracted
graph of at most ``one_task`` edges is finished by a single task, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join

ONE_TASK = 2_000_000
FOREST_EDGES = 1_000_000


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) over an edge list in memory."""
    ids, number = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = number[: len(u)], number[len(u):]
    label = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        live = low != high
        if not live.any():
            break
        a, b = low[live], high[live]
        np.minimum.at(label, b, a)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return ids, ids[label]


def _forest(batches: Iterator[pa.RecordBatch], keep_roots: bool, bound: int | None) -> Iterator[pa.RecordBatch]:
    us, vs, n = [], [], 0

    def flush():
        ids, root = local_components(np.concatenate(us), np.concatenate(vs))
        if not keep_roots:
            ids, root = ids[ids != root], root[ids != root]
        return pa.record_batch({"u": pa.array(ids, pa.int64()), "v": pa.array(root, pa.int64())})

    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        n += len(us[-1])
        if bound and n >= bound:
            yield flush()
            us, vs, n = [], [], 0
    if n:
        yield flush()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 8))).first()
    return r[0], r[1] or 0


def connected_components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """``edges(u BIGINT, v BIGINT)`` -> ``(id BIGINT, component BIGINT)``.

    Every vertex of an edge comes out once, with the smallest id of its component.  Nulls on either
    side drop the edge, loops give a component of their own vertex, repeated edges are harmless, an
    empty table gives an empty result.
    """
    e = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u is not null and v is not null")
    loops = None
    e = scratch.keep(e.mapInArrow(lambda it: _forest(it, True, FOREST_EDGES), "u bigint, v bigint"), "forest")
    count = e.where("u <> v").count()
    if count <= one_task:
        return scratch.keep(e.coalesce(1).mapInArrow(lambda it: _forest(it, True, None), "u bigint, v bigint").toDF("id", "component"), "components")
    loops = e.select(F.col("u").alias("id")).distinct()
    e = e.where("u <> v")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = scratch.keep(salted_join(both, low, "u", "n", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = scratch.keep(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = salted_join(down, low, "u", "n", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = scratch.keep(small, "small")
        scratch.drop(large)
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    return scratch.keep(loops.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
