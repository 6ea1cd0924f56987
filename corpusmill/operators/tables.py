"""Relational steps of corpus assembly: first rows, anti joins, ids, histograms, combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import global_rank, seeded


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by the columns ``order`` (ascending, nulls first), which must be a total order.

    Null keys form a key of their own.  It is an aggregate, so a key with a large part of all rows is reduced
    by every task before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return got.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_sequential_ids(df: DataFrame, key: str, prefix: str, name: str = "new_id", seed: int = 42) -> DataFrame:
    """Adds ``{prefix}-{i}`` from 1 in seeded order."""
    return global_rank(df, [seeded(key, seed), F.col(key)], "_i").withColumn(name, F.concat(F.lit(prefix + "-"), F.col("_i").cast("string"))).drop("_i")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Rows per equal-width bin; the last bin is closed on the right, values outside and nulls are dropped."""
    v = df.select(*by, value.cast("double").alias("_v")).where((F.col("_v") >= low) & (F.col("_v") <= high))
    bin_ = F.least(F.floor((F.col("_v") - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return v.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def combinations(sources: DataFrame, group: str, name: str, order: list[str]) -> DataFrame:
    """Every choice of one ``name`` from each group, as columns named by the groups, plus ``combo`` joined by ' + '.

    The groups are few and small (file lists, parameter values): the product is their sizes' product.
    """
    out = None
    for g in order:
        part = sources.where(F.col(group) == g).select(F.col(name).alias(g))
        out = part if out is None else out.crossJoin(part)
    return out.withColumn("combo", F.array_join(F.array(*order), " + "))


def grid(spark, **choices) -> DataFrame:
    """Hyper-parameter product, one row a configuration (the choices are literals)."""
    import itertools

    return spark.createDataFrame(list(itertools.product(*choices.values())), list(choices))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 over the rows; null where all are equal."""
    ends = df.agg(*[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns])
    j = df.crossJoin(F.broadcast(ends))  # one row
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c in columns}).select(*df.columns)


def running_best(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds the best (smallest) value before the row, whether the row improves on it, and the epochs since the last that did."""
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = history.withColumn("best_before", F.min(value).over(before)).withColumn("improved", F.col("best_before").isNull() | (F.col(value) < F.col("best_before")))
    return h.withColumn("last_improved", F.max(F.when(F.col("improved"), F.col(order))).over(w)).withColumn("waited", F.col(order) - F.col("last_improved")).drop("last_improved")
