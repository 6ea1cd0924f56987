"""Train, validation and test splits that keep related records together (problem 4).

Method: connected components, then largest differencing.

* Rows that name the same term, directly or through other rows, form a unit.  The graph is built on
  distinct ``termo`` values, not on rows, so a term with a third of all rows is one vertex.
* Units are dealt into ``BINS`` bins of near-equal weight by multiway largest differencing (Karmarkar
  and Karp): the two partial solutions with the largest spread are combined, the heaviest bins of one
  with the lightest of the other.  It runs over chunks of ``CHUNK`` units in parallel and then, the same way,
  over the chunks' solutions, level by level, until one is left.
* Whole bins go to the splits by target share, class by class as evenly as whole bins allow.

What reaches the driver is the last solution: ``BINS`` bins by class.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.scratch import Scratch
from ..operators.skew import salted_join
from .copies import bare_forms

BINS, CHUNK = 256, 20_000
MAX_NAME = 120
#: Splits a target table may list; each gets whole bins.
MAX_SPLITS = 64
#: Author classes (fixed values); other and null labels count as one class more.
CLASSES = ("anthropic", "google", "human", "meta", "openai")
#: Rows that name no term are their own units; they are dealt in this many lots by a hash of the row.
LOOSE_LOTS = 512


def _names(batches):
    for b in batches:
        values = b.column(0).to_pylist()
        parts = [v.split(";") if v is not None and len(v) <= MAX_NAME else [] for v in values]
        flat = bare_forms([p for ps in parts for p in ps])
        it = iter(flat)
        names = [list(dict.fromkeys(n for n in itertools.islice(it, len(ps)) if n)) for ps in parts]
        yield pa.record_batch([b.column(0), pa.array(names, pa.list_(pa.string()))], names=["termo", "names"])


def units(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(termo, component, unit, variants, rows)`` for each distinct ``termo`` that names a term.

    ``unit`` is the smallest bare name of the component, ``variants`` its number of distinct ``termo``
    values, ``rows`` the rows of this ``termo``.
    """
    values = records.where("termo is not null").groupBy("termo").agg(F.count("*").alias("rows"))
    named = scratch.keep(values.select("termo").mapInArrow(_names, "termo string, names array<string>").where(F.size("names") > 0), "names")
    coded = named.select("termo", F.expr("transform(names, n -> xxhash64(n))").alias("codes"), "names")
    edges = coded.select(F.col("codes")[0].alias("u"), F.explode("codes").alias("v")).distinct()
    parts = connected_components(edges, scratch)
    of = coded.select("termo", F.col("codes")[0].alias("id"), F.array_min("names").alias("name")).join(parts, "id").select("termo", "component", "name")
    of = scratch.keep(of, "components")
    about = of.groupBy("component").agg(F.min("name").alias("unit"), F.count("*").alias("variants"))
    return scratch.keep(of.join(about, "component").join(values, "termo").select("termo", "component", "unit", "variants", "rows"), "units")


def linked_units(records: DataFrame) -> DataFrame:
    """``(row_id BIGINT, unit STRING)``: rows of units in which at least two ``termo`` values occur.

    ``records`` needs ``row_id, termo``; other columns are ignored.  A ``termo`` names the terms between its
    semicolons, compared by bare form; empty names do not count, a null ``termo`` or one of more than
    120 characters names nothing.  An empty table gives an empty result.
    """
    scratch = Scratch(records.sparkSession, "units")
    u = units(records, scratch).where("variants > 1").select("termo", "unit", "rows")
    return salted_join(records.select("row_id", "termo"), u, "termo", "rows", "row_id").select("row_id", "unit")


def largest_differencing(items: list[list[tuple[float, object]]], bins: int) -> list[list]:
    """Multiway largest differencing: for each of ``bins`` bins, the members dealt to it.

    An item is a partial solution, up to ``bins`` pairs of a weight and a member.  Ties are broken
    by the items' order, so equal input gives equal output.
    """
    heap = []
    for k, item in enumerate(items):
        full = sorted(item, key=lambda x: -x[0])[:bins]
        sums = np.zeros(bins)
        sums[: len(full)] = [w for w, _ in full]
        slots = [(m, None) for _, m in full] + [None] * (bins - len(full))
        heap.append((sums.min() - sums.max(), k, sums, slots))
    heapq.heapify(heap)
    number = len(items)
    while len(heap) > 1:
        _, _, a, p = heapq.heappop(heap)
        _, _, b, q = heapq.heappop(heap)
        total, merged = a + b[::-1], [(x, y) if x is not None and y is not None else (x if y is None else y) for x, y in zip(p, reversed(q))]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        number += 1
        heapq.heappush(heap, (total[-1] - total[0], number, total, [merged[i] for i in order]))

    def members(slot):
        out, stack = [], [slot]
        while stack:
            s = stack.pop()
            if s is None:
                continue
            if s[1] is None and not isinstance(s[0], tuple):
                out.append(s[0])
            else:
                stack += [x for x in s if x is not None]
        return out

    return [members(s) for s in heap[0][3]] if heap else [[] for _ in range(bins)]


def _deal(bins: int):
    """One chunk of (chunk, item, weight) -> (item, place): items dealt into bins; item may be a whole solution."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["solution", "weight", "item"], ascending=[True, False, True])
        items = [list(zip(g["weight"].tolist(), g["item"].tolist())) for _, g in pdf.groupby("solution", sort=True)]
        dealt = largest_differencing(items, bins)
        chunk = int(pdf["chunk"].iloc[0]) if len(pdf) else 0
        rows = [(m, chunk * bins + b) for b, ms in enumerate(dealt) for m in ms]
        return pd.DataFrame(rows, columns=["item", "place"]).astype({"item": "int64", "place": "int64"})
    return run


def balanced_bins(weights: DataFrame, scratch: Scratch, bins: int = BINS, chunk: int = CHUNK) -> DataFrame:
    """``(item BIGINT, weight DOUBLE)`` -> ``(item, bin)``, bins of near-equal weight."""
    n = weights.count()
    chunks = max(1, -(-n // chunk))
    state = weights.select("item", F.col("weight").cast("double").alias("weight"), F.col("item").alias("solution"), F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk"))
    where, level = None, 0
    while True:
        placed = scratch.keep(state.groupBy("chunk").applyInPandas(_deal(bins), "item bigint, place bigint"), f"level-{level}")
        if where is None:
            where = placed.select("item", F.col("place").alias("bin"))
        else:
            where = where.join(placed.select(F.col("item").alias("bin"), "place"), "bin").select("item", F.col("place").alias("bin"))
        if chunks == 1:
            return where
        group = max(2, chunk // bins)
        summed = scratch.keep(where.join(weights, "item").groupBy("bin").agg(F.sum("weight").alias("weight")), f"sums-{level}")
        chunks = -(-chunks // group)
        old = F.floor(F.col("bin") / bins)
        state = summed.select(F.col("bin").alias("item"), "weight", old.alias("solution"), F.floor(old / group).alias("chunk"))
        level += 1


def allocate(bins: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Whole bins (rows: bins, columns: classes) to splits by share: the split of each bin.

    The heaviest bin goes first, each to the split in which the squared distance to the wanted
    class counts, taken relative to them, falls most; then single moves and swaps lower it further.
    """
    shares = shares / shares.sum()
    total = bins.sum(axis=0)
    want = np.outer(shares, total)
    scale = 1 / np.maximum(want, 1e-9) * (total > 0)
    weigh = np.append(np.ones(bins.shape[1]), 2.0 * bins.shape[1])  # the last column holds all rows
    full = np.column_stack((bins, bins.sum(axis=1)))
    want = np.outer(shares, full.sum(axis=0))
    scale = weigh * (full.sum(axis=0) > 0) / np.maximum(want, 1e-9) ** 2 * np.maximum(shares, 1e-9)[:, None]
    have = np.zeros_like(want)
    to = np.full(len(full), -1)

    def cost(h):
        return (scale * (h - want) ** 2).sum()

    for i in np.argsort(-full[:, -1], kind="stable"):
        costs = [((scale[s] * ((have[s] + full[i] - want[s]) ** 2 - (have[s] - want[s]) ** 2)).sum()) for s in range(len(shares))]
        to[i] = int(np.argmin(costs))
        have[to[i]] += full[i]
    while True:  # every move lowers the cost, so it ends
        now, better = cost(have), False
        for i in range(len(full)):
            for s in range(len(shares)):
                if s == to[i]:
                    continue
                trial = have.copy()
                trial[to[i]] -= full[i]
                trial[s] += full[i]
                c = cost(trial)
                if c < now * (1 - 1e-9) - 1e-12:
                    have, now, better = trial, c, True
                    to[i] = s
        if not better:
            break
    return to


def _class_of(label: str = "label"):
    plain = F.lower(F.regexp_replace(F.col(label), r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", ""))
    return F.when(plain.isin(*CLASSES), plain).otherwise(F.lit("other"))


def split_assignment(records: DataFrame, targets: DataFrame, bins: int = BINS, chunk: int = CHUNK) -> DataFrame:
    """``(row_id, split_name)`` for every row with a ``row_id``; a unit is never divided.

    ``records`` needs ``row_id, termo, label``, ``targets`` needs ``split_name, share`` (null or non-positive shares
    are left out; no target at all is an error).  Rows that name no term are units of their own.
    """
    spark = records.sparkSession
    goals = [(r[0], float(r[1])) for r in targets.select("split_name", "share").where("share > 0 and split_name is not null").orderBy("split_name").limit(MAX_SPLITS + 1).collect()]
    if not goals or len(goals) > MAX_SPLITS:
        raise ValueError(f"from 1 to {MAX_SPLITS} splits must have a share")
    scratch = Scratch(spark, "splits")
    u = units(records, scratch)
    loose = F.lit(-1) - F.pmod(F.xxhash64("row_id"), F.lit(LOOSE_LOTS))
    # item: the component's number, or below zero in a space of its own for a lot of loose rows
    of = salted_join(records.select("row_id", "termo", "label"), u.select("termo", "component", "rows"), "termo", "rows", "row_id")
    named = of.select("row_id", F.col("component").alias("item"), _class_of().alias("class"), F.lit(False).alias("loose"))
    rest = records.select("row_id", "termo", "label").join(u.select("termo"), "termo", "left_anti").select("row_id", loose.alias("item"), _class_of().alias("class"), F.lit(True).alias("loose"))
    rows = scratch.keep(named.unionByName(rest).where("row_id is not null").withColumn("item", F.xxhash64("item", "loose")), "rows")
    counts = scratch.keep(rows.groupBy("item", "class").agg(F.count("*").alias("n")), "counts")
    weights = counts.groupBy("item").agg(F.sum("n").alias("weight"))
    placed = scratch.keep(balanced_bins(weights, scratch, bins, chunk), "bins")
    table = placed.join(counts, "item").groupBy("bin", "class").agg(F.sum("n").alias("n")).toPandas()  # at most bins x classes rows
    wide = table.pivot_table(index="bin", columns="class", values="n", aggfunc="sum", fill_value=0).sort_index()
    to = allocate(wide.to_numpy(dtype=float), np.array([s for _, s in goals])) if len(wide) else []
    chosen = spark.createDataFrame([(int(b), goals[k][0]) for b, k in zip(wide.index, to)], "bin bigint, split_name string")
    item_split = placed.join(F.broadcast(chosen), "bin").join(weights, "item").select("item", "split_name", "weight")
    return salted_join(rows.select("row_id", "item"), item_split, "item", "weight", "row_id").select("row_id", "split_name")


def split_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows per split and class with the share reached: ``(split_name, class, rows, share, target_share)``."""
    got = split_assignment(records, targets).join(records.select("row_id", _class_of().alias("class")), "row_id").groupBy("split_name", "class").agg(F.count("*").alias("rows"))
    whole = got.groupBy("class").agg(F.sum("rows").alias("all"))
    return got.join(whole, "class").join(targets.select("split_name", F.col("share").alias("target_share")), "split_name").select("split_name", "class", "rows", F.round(F.col("rows") / F.col("all"), 6).alias("share"), "target_share")


def assignment_faults(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``(what, n)``: divided units, assigned rows, rows assigned more than once, splits further from their share than the heaviest bin allows."""
    scratch = Scratch(records.sparkSession, "split-faults")
    got = scratch.keep(split_assignment(records, targets), "assigned")
    u = units(records, scratch)
    of = salted_join(records.select("row_id", "termo"), u.select("termo", "component", "rows"), "termo", "rows", "row_id").join(got, "row_id")
    divided = of.groupBy("component", "split_name").agg(F.count("*").alias("n")).groupBy("component").agg(F.count("*").alias("splits"), F.sum("n").alias("n"))
    heaviest = divided.agg(F.coalesce(F.max("n"), F.lit(0)).alias("heaviest"))
    shares = targets.where("share > 0 and split_name is not null").select("split_name", (F.col("share") / F.sum("share").over(Window.partitionBy())).alias("share"))  # a few splits
    whole = got.agg(F.count("*").alias("all"), (F.count("*") - F.count_distinct("row_id")).alias("again"))
    # the heaviest unit or an equal part of all rows, whichever is more, is what a bin may weigh
    off = shares.join(got.groupBy("split_name").agg(F.count("*").alias("n")), "split_name", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(heaviest))
    off = off.where(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("all")) > F.greatest("heaviest", F.col("all") / BINS) + 1)
    rows = [divided.where("splits > 1").agg(F.count("*").alias("n")).select(F.lit("units divided").alias("what"), "n"), whole.select(F.lit("rows assigned").alias("what"), F.col("all").alias("n")),
            whole.select(F.lit("rows more than once").alias("what"), F.col("again").alias("n")), off.agg(F.count("*").alias("n")).select(F.lit("splits off their share by more than a bin").alias("what"), "n")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
