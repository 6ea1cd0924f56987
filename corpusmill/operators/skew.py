"""Equi-joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task is to get at most.
KEY_ROWS = 200_000
#: Hot keys that are still sent to every executor.
SENT_KEYS = 100_000


def salted_join(many: DataFrame, one: DataFrame, key: str, rows: str, spread: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has in ``rows`` the number of the key's rows in ``many``.

    A key with more than ``key_rows`` rows is spread over several tasks by a hash of the column ``spread``;
    the rows of ``one`` go to each of them.  Rows get their salt from a broadcast table of the hot keys (at most
    rows / ``key_rows``; beyond ``SENT_KEYS`` of them from a shuffle), so that no task meets a whole hot key.  Keys
    compare as in an equi-join: null matches nothing.  ``rows`` is dropped.
    """
    ways = F.greatest(F.lit(1), F.ceil(F.col(rows) / key_rows)).cast("bigint")
    small = one.withColumn("_ways", ways).drop(rows)
    hot = small.where("_ways > 1").groupBy(key).agg(F.max("_ways").alias("_ways"))
    n_hot = hot.limit(SENT_KEYS + 1).count()
    if not n_hot:
        return many.join(small.drop("_ways"), key)
    left = many.join(F.broadcast(hot) if n_hot <= SENT_KEYS else hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_ways", F.lit(1).cast("bigint")))).drop("_ways")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ways") - 1))).drop("_ways")
    return left.join(right, [key, "_salt"]).drop("_salt")
