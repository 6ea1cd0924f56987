"""Scoring with stored weights as joins and aggregates: affine layers, ReLU, softmax, argmax, loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a layer that are still sent to every executor (some 50 MB).
SENT_WEIGHTS = 2_000_000


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_WEIGHTS + 1).count() <= SENT_WEIGHTS else df


def affine(features: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """``(doc, idx, value)`` times ``weights(idx, j, w)`` plus ``bias(j, b)`` -> ``(doc, idx, value)`` with idx = j.

    Weights are the size of a layer; up to ``SENT_WEIGHTS`` are sent to every executor, larger layers are joined by a shuffle.  Features stay sparse, so a document with no
    feature at all still gets its bias through ``docs`` in ``network``.
    """
    dot = features.join(_sent(weights), "idx").groupBy("doc", "j").agg(F.sum(F.col("value") * F.col("w")).alias("x"))
    docs = features.select("doc").distinct()
    full = docs.crossJoin(F.broadcast(bias)).join(dot, ["doc", "j"], "left")  # documents x units of the layer
    return full.select("doc", F.col("j").alias("idx"), (F.coalesce("x", F.lit(0.0)) + F.col("b")).alias("value"))


def relu(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.greatest("value", F.lit(0.0)))


def softmax(x: DataFrame) -> DataFrame:
    """Adds ``p``, the shares of the exponentials of each document's values, shifted by the largest."""
    w = Window.partitionBy("doc")
    e = x.withColumn("_e", F.exp(F.col("value") - F.max("value").over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def argmax(x: DataFrame, value: str = "value") -> DataFrame:
    """``(doc, pred)``: the index of the largest value, the lowest on ties."""
    return x.groupBy("doc").agg(F.max_by("idx", F.struct(value, (-F.col("idx")).alias("i"))).alias("pred"))


def cross_entropy(probabilities: DataFrame, truth: DataFrame) -> DataFrame:
    """``(loss)``: mean of ``-ln p`` of the true class, p kept within 1e-15 of 0 and 1."""
    p = probabilities.join(truth.select("doc", F.col("gold").alias("idx")), ["doc", "idx"])
    clipped = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    return p.agg(F.avg(-F.log(clipped)).alias("loss"))


def network(features: DataFrame, layers: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Class probabilities ``(doc, idx, value, p)``: affine layers with ReLU between and softmax at the end."""
    x = features
    for k, (w, b) in enumerate(layers):
        x = affine(x, w, b)
        if k < len(layers) - 1:
            x = relu(x)
    return softmax(x)
