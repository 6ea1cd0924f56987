"""Choosing training corpora: combinations of sources ranked by a baseline classifier's accuracy on evaluation texts.

A combination is judged on the first rows of each of its sources (the operator's own sample, a parameter), so one fit has a
bounded table: it is a group of one task, and all combinations are fitted side by side.  The evaluation texts are not
bounded; they are scored in one pass by all fitted models, which are sent to the executors.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Combinations whose models (terms x classes each) are sent to the executors at once; more are an error.
MOST_COMBINATIONS = 500
#: Rows of a source that a combination is fitted on, its first ones.
ROWS_A_SOURCE = 500


class _Descent:
    """L-BFGS with backtracking; ``at`` is the point whose loss and gradient are wanted next."""

    def __init__(self, size: int, tolerance: float, memory: int = 5):
        self.x, self.f, self.g, self.pairs = np.zeros(size), np.inf, None, []
        self.at, self.t, self.d, self.tolerance, self.memory = self.x, 0.0, None, tolerance, memory
        self.steps, self.converged, self.ended = 0, False, False

    def take(self, f: float, g: np.ndarray) -> None:
        if self.d is not None and not f <= self.f + 1e-4 * self.t * float(self.g @ self.d) + 1e-12 * abs(self.f):
            self.t /= 2
            self.ended = self.t < 1e-10
            self.at = self.x + self.t * self.d
            return
        if self.d is not None:
            s, y = self.at - self.x, g - self.g
            if float(s @ y) > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-self.memory:]
            self.steps += 1
        self.x, self.f, self.g = self.at, f, g
        self.converged = float(np.abs(g).max()) <= self.tolerance
        self.ended = self.converged
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        else:
            q /= max(float(np.linalg.norm(g)), 1e-30)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += (a - float(y @ q) / float(s @ y)) * s
        self.d, self.t = -q, 1.0
        self.at = self.x + self.d


def fit_regression(x: np.ndarray, y: np.ndarray, classes: int, c: float, iterations: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """Weights ((features + intercept) x classes) of multinomial logistic regression, and whether it converged.

    Minimises ``c`` times the summed cross entropy plus half the squared weights (not the intercepts) by L-BFGS, until no
    gradient of the mean loss is above ``tolerance``.  A class without rows is never said.
    """
    n, d = x.shape
    there = np.bincount(y, minlength=classes) > 0
    run = _Descent((d + 1) * classes, tolerance)
    at = np.arange(n)
    while not run.ended and run.steps < iterations:
        w = run.at.reshape(d + 1, classes)
        z = x @ w[:-1] + w[-1]
        z[:, ~there] = -np.inf
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1, keepdims=True)
        loss = float((np.log(total[:, 0]) - z[at, y]).sum()) + 0.5 * float((w[:-1] ** 2).sum()) / c
        r = e / total
        r[at, y] -= 1
        g = np.vstack((x.T @ r + w[:-1] / c, r.sum(axis=0)))
        run.take(loss / n, g.ravel() / n)
    w = run.x.reshape(d + 1, classes).copy()
    w[-1, ~there] = -np.inf
    return w, run.converged


def _unit_rows(counts: list[dict], terms: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length (zeros where no term is known)."""
    x = np.zeros((len(counts), len(terms)))
    for i, n in enumerate(counts):
        for t, k in n.items():
            j = terms.get(t)
            if j is not None:
                x[i, j] = k
    x *= idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _counted(tokens) -> list[dict]:
    out = []
    for t in tokens:
        n: dict[str, int] = {}
        for w in t:
            n[w] = n.get(w, 0) + 1
        out.append(n)
    return out


def rank_combinations(rows: DataFrame, tests: DataFrame, combos: list[tuple[str, list[str]]], tokens: Column, classes: list[str], max_features: int = 3000, c: float = 1.0, iterations: int = 500, tolerance: float = 1e-4,
                      rows_a_source: int = ROWS_A_SOURCE, order: str = "text") -> DataFrame:
    """``(combo, hits, n, accuracy, place, converged)``: every combination of sources, ranked by accuracy on ``tests``.

    ``rows(source, class, text, <order>)``, ``tests(class, text)``; ``combos`` are names with their sources.  Each combination
    is fitted on the first ``rows_a_source`` rows of each source by ``order``: raw-count TF-IDF of the ``max_features`` most
    frequent terms (ties by term, smoothed idf, unit length) and multinomial logistic regression with inverse penalty ``c``.
    Rows of other classes, or without text, are left out after the first rows were taken.  All ``tests`` are scored.
    Ties in accuracy go to the first name; a combination without rows has no hits.
    """
    spark = rows.sparkSession
    schema = "combo string, hits bigint, n bigint, accuracy double, place int, converged boolean"
    if len(combos) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations of sources")
    if not combos:
        return spark.createDataFrame([], schema)
    k = len(classes)
    y = (F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("class")).cast("int") - 1).alias("y")
    pairs = spark.createDataFrame([(s, i) for i, (_, parts) in enumerate(combos) for s in sorted(set(parts))], "source string, i int")
    listed = pairs.select("source").distinct()
    first = rows.join(F.broadcast(listed), "source", "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy("source").orderBy(order))).where(F.col("_place") <= rows_a_source)
    used = first.select("source", y, tokens.alias("t"), "_place").where("y >= 0 and t is not null")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "_place"])
        counts = _counted(pdf["t"])
        tf: dict[str, int] = {}
        df: dict[str, int] = {}
        for n in counts:
            for t, m in n.items():
                tf[t] = tf.get(t, 0) + m
                df[t] = df.get(t, 0) + 1
        top = sorted(tf, key=lambda t: (-tf[t], t))[:max_features]
        idf = np.log((1 + len(counts)) / (1 + np.array([df[t] for t in top], dtype=float))) + 1
        x = _unit_rows(counts, {t: j for j, t in enumerate(top)}, idf)
        w, converged = fit_regression(x, pdf["y"].to_numpy(), k, c, iterations, tolerance)
        return pd.DataFrame({"i": [key[0]], "terms": [json.dumps(top)], "idf": [idf.tobytes()], "w": [w.tobytes()], "converged": [converged]})

    # a given number of partitions, so that small tables stay spread over the tasks
    spread = used.join(F.broadcast(pairs), "source").repartition(min(len(combos), 4 * spark.sparkContext.defaultParallelism), "i")
    fitted = {r["i"]: r for r in spread.groupBy("i").applyInPandas(fit, "i int, terms string, idf binary, w binary, converged boolean").collect()}  # max_features rows a combination
    models = spark.sparkContext.broadcast({i: (json.loads(r["terms"]), np.frombuffer(r["idf"]), np.frombuffer(r["w"]).reshape(-1, k)) for i, r in fitted.items()})

    def hits(batches):
        known = {i: ({t: j for j, t in enumerate(terms)}, idf, w) for i, (terms, idf, w) in models.value.items()}
        found, n = dict.fromkeys(known, 0), 0
        for b in batches:
            truth = b.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, b.num_rows, 2000):
                counts, own = _counted(b.column(1).slice(s, 2000).to_pylist()), truth[s:s + 2000]
                n += len(own)
                for i, (terms, idf, w) in known.items():
                    found[i] += int(((_unit_rows(counts, terms, idf) @ w[:-1] + w[-1]).argmax(axis=1) == own).sum())
        yield pa.record_batch([pa.array([*found, -1], pa.int32()), pa.array([*found.values(), n], pa.int64())], names=["i", "hits"])

    judged = tests.select(y, tokens.alias("t")).where("y >= 0 and t is not null").repartition(max(spark.sparkContext.defaultParallelism, tests.rdd.getNumPartitions()))
    got = dict(judged.mapInArrow(hits, "i int, hits bigint").groupBy("i").agg(F.sum("hits")).collect())
    models.destroy()
    n = got.get(-1, 0)
    order_ = sorted(range(len(combos)), key=lambda i: (-got.get(i, 0), combos[i][0]))
    ranked = [(combos[i][0], got.get(i, 0), n, got.get(i, 0) / n if n else None, p + 1, bool(fitted[i]["converged"]) if i in fitted else False) for p, i in enumerate(order_)]
    return spark.createDataFrame(ranked, schema)
