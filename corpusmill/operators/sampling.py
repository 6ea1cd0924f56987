"""Deterministic shuffles, splits, folds and samples.

The order is that of ``md5(seed:id)``, the same on every engine and for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _order(key: str, seed: int):
    return [seeded(key, seed), F.col(key)]


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def stratified_rank(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Adds ``rank`` in its class (from 1) and the class's size ``n``; a null label is a class of its own.

    The place in the order (class, seeded) less the rows of the classes before, so that a class with a large
    part of all rows is ranked by many tasks.
    """
    ranked = global_rank(df, [F.col(label), *_order(key, seed)], "_place")
    sizes = class_sizes(df, label).select(F.col(label).alias("_label"), "n")
    before = sizes.withColumn("_before", F.sum("n").over(Window.orderBy("_label")) - F.col("n"))  # one row a class
    return ranked.join(before, F.col(label).eqNullSafe(F.col("_label"))).withColumn("rank", F.col("_place") - F.col("_before")).drop("_place", "_before", "_label")


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part``: in each class ``max(1, int(n * test_size))`` rows are 'test', the others 'train'."""
    r = stratified_rank(df, key, label, seed)
    n_test = F.greatest(F.lit(1), F.floor(F.col("n") * test_size))
    return r.withColumn("part", F.when(F.col("rank") <= n_test, "test").otherwise("train")).drop("rank", "n")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's place (from 1) in a total order without one task seeing all rows.

    Rows are range-partitioned, sorted and written once with their place in the range; the number of rows of the
    ranges before (one number a partition) is added when they are read.
    """
    # the number that a sorted row gets in its range, with the range's number in the upper bits
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    from .scratch import Scratch

    kept = Scratch(df.sparkSession, "rank").keep(parts, "sorted").withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(before), "_part").withColumn(name, (place + F.col("_before")).cast("bigint")).drop("_part", "_before", "_at")


def plain_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part``: the first ``int(n * test_size)`` rows in seeded order are 'test'."""
    n = int(df.count() * test_size)
    return global_rank(df, _order(key, seed)).withColumn("part", F.when(F.col("rank") <= n, "test").otherwise("train")).drop("rank")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1; class by class fold sizes differ by one at most, larger folds first."""
    r = stratified_rank(df, key, label, seed)
    i, base, more = F.col("rank") - 1, F.floor(F.col("n") / k), F.col("n") % k
    edge = (base + 1) * more
    fold = F.when(i < edge, F.floor(i / (base + 1))).otherwise(more + F.floor((i - edge) / F.greatest(base, F.lit(1))))
    return r.withColumn("fold", fold.cast("int")).drop("rank", "n")


def fold_roles(folds: DataFrame, k: int = 3) -> DataFrame:
    """Each row once per run 0..k-1 with ``role`` 'val' in its own fold's run and 'train' in the others."""
    return folds.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.when(F.col("run") == F.col("fold"), "val").otherwise("train"))


def per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``min(n, n_c)`` rows of each class in seeded order (each task passes on at most ``n`` of a class)."""
    w = Window.partitionBy(label).orderBy(*_order(key, seed))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def complement(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def first_in_order(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in seeded order, of a given number; a smaller ``n`` gives a prefix of a larger one."""
    return df.orderBy(*_order(key, seed)).limit(n)


def _first_part(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """As ``first_in_order`` for an ``n`` that grows with the data: no task takes all ``n`` rows."""
    return global_rank(df, _order(key, seed), "_rank").where(F.col("_rank") <= n).drop("_rank")


def cap_class_share(df: DataFrame, key: str, label: str, value: str, share: float, seed: int = 42) -> DataFrame:
    """Thins class ``value`` to ``min(int(share * others / (1 - share)), n)`` rows; the others stay (null labels too)."""
    n = df.agg(F.count_if(F.col(label).eqNullSafe(value)).alias("own"), F.count("*").alias("all")).first()
    keep = min(int(share * (n["all"] - n["own"]) / (1 - share)), n["own"])
    own, rest = df.where(F.col(label).eqNullSafe(value)), df.where(~F.col(label).eqNullSafe(value))
    return rest.unionByName(_first_part(own, key, keep, seed))


def keep_class_part(df: DataFrame, key: str, label: str, value: str, part: float, seed: int = 42) -> DataFrame:
    """Keeps ``int(n * part)`` rows of class ``value`` and all others."""
    n = df.where(F.col(label).eqNullSafe(value)).count()
    return df.where(~F.col(label).eqNullSafe(value)).unionByName(_first_part(df.where(F.col(label).eqNullSafe(value)), key, int(n * part), seed))


def mini_batches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Adds ``batch`` from 0; all batches but the last hold ``size`` rows."""
    return global_rank(df, _order(key, seed)).withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def round_robin(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Adds ``worker`` 0..n-1 in turn."""
    return global_rank(df, order).withColumn("worker", F.pmod(F.col("rank") - 1, F.lit(n))).drop("rank")
