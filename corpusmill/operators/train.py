"""Training: dense networks in NumPy inside ``applyInPandas`` (one task a configuration and fold), and spark.ml.

The NumPy trainer is for data of bounded size (a fold of a sample, stacked predictions); whole corpora are fitted
with ``softmax_regression``, which is distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows (with their runs) that one task may train on, and distinct rows of a leave-one-out; more are an error.
MOST_ROWS, MOST_DISTINCT = 500_000, 20_000
OPTIMIZERS = ("adam", "adamw", "sgd")


@dataclass
class Config:
    """One training configuration; ``l2`` is part of the gradient, but with AdamW weights decay by ``lr * l2`` apart from it.

    ``plateau``: epochs without a lower validation loss after which the rate is halved; ``warmup``: share of all steps in which
    the rate rises to its value, to fall to 0 at the end; ``clip``: largest norm of a step's gradient (each 0: not used).
    ``best``: whether the epoch kept is that of the lowest validation loss or of the highest accuracy.
    """

    hidden: tuple[int, ...] = (128, 64)
    lr: float = 0.001
    optimizer: str = "adam"
    momentum: float = 0.9
    dropout: float = 0.0
    l2: float = 0.0
    epochs: int = 30
    batch: int = 64
    patience: int = 5
    seed: int = 42
    plateau: int = 0
    warmup: float = 0.0
    clip: float = 0.0
    best: str = "loss"


class Network:
    """Dense layers with ReLU, inverted dropout and a softmax output, trained on mini-batches."""

    def __init__(self, n_in: int, n_out: int, c: Config):
        if c.optimizer not in OPTIMIZERS:
            raise ValueError(f"optimizer {c.optimizer!r} is none of {', '.join(OPTIMIZERS)}")
        self.c, self.rng = c, np.random.default_rng(c.seed)
        sizes = [n_in, *c.hidden, n_out]
        self.params = [p for a, b in zip(sizes, sizes[1:]) for p in (self.rng.normal(0, np.sqrt(2 / max(a, 1)), (a, b)), np.zeros(b))]
        self.m = [np.zeros_like(p) for p in self.params]
        self.v = [np.zeros_like(p) for p in self.params]
        self.steps, self.rate = 0, 1.0
        self.history: list[dict] = []

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, False)[0]

    def _forward(self, x, train):
        kept = []
        n = len(self.params) // 2
        for i in range(n):
            kept.append(x)
            x = x @ self.params[2 * i] + self.params[2 * i + 1]
            if i < n - 1:
                mask = x > 0
                if train and self.c.dropout:
                    mask = mask * (self.rng.random(x.shape) >= self.c.dropout) / (1 - self.c.dropout)
                x = x * mask
                kept.append(mask)
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), kept

    def loss(self, p: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(np.clip(p[np.arange(len(y)), y], 1e-15, 1 - 1e-15)).mean())

    def _gradients(self, x, y):
        p, kept = self._forward(x, True)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        out = [None] * len(self.params)
        for i in reversed(range(len(self.params) // 2)):
            out[2 * i] = kept[2 * i].T @ d + (0.0 if self.c.optimizer == "adamw" else self.c.l2) * self.params[2 * i]
            out[2 * i + 1] = d.sum(axis=0)
            if i:
                d = (d @ self.params[2 * i].T) * kept[2 * i - 1]
        return out

    def _step(self, gradients):
        self.steps += 1
        lr = self.c.lr * self.rate
        if self.c.clip:
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            gradients = [g * min(1.0, self.c.clip / max(norm, 1e-12)) for g in gradients]
        for i, g in enumerate(gradients):
            if self.c.optimizer in ("adam", "adamw"):
                if self.c.optimizer == "adamw" and i % 2 == 0:
                    self.params[i] = self.params[i] * (1 - lr * self.c.l2)
                self.m[i] = 0.9 * self.m[i] + 0.1 * g
                self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
                self.params[i] = self.params[i] - lr * (self.m[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[i] / (1 - 0.999**self.steps)) + 1e-8)
            else:
                self.m[i] = self.c.momentum * self.m[i] + g
                self.params[i] = self.params[i] - lr * self.m[i]

    def _state(self):
        return [p.copy() for p in self.params]

    def _restore(self, state) -> None:
        self.params = state

    def fit(self, x, y, x_val=None, y_val=None) -> "Network":
        """Stops after ``patience`` epochs without a better validation and goes back to the best epoch."""
        best, best_params, waited = np.inf, None, 0
        plain, bad, lowest = 1.0, 0, np.inf
        all_steps = self.c.epochs * -(-len(x) // self.c.batch)
        for epoch in range(self.c.epochs):
            order = self.rng.permutation(len(x))
            for s in range(0, len(x), self.c.batch):
                at = order[s:s + self.c.batch]
                up = self.c.warmup * all_steps
                self.rate = plain * (min(1.0, (self.steps + 1) / max(up, 1.0), (all_steps - self.steps) / max(all_steps - up, 1.0)) if self.c.warmup else 1.0)
                self._step(self._gradients(x[at], y[at]))
            p = self.probabilities(x)
            row = {"epoch": epoch, "loss": self.loss(p, y), "acc": float((p.argmax(1) == y).mean())}
            if x_val is not None and len(x_val):
                q = self.probabilities(x_val)
                row |= {"val_loss": self.loss(q, y_val), "val_acc": float((q.argmax(1) == y_val).mean())}
                score = row["val_loss"] if self.c.best == "loss" else -row["val_acc"]
                if score < best:
                    best, best_params, waited = score, self._state(), 0
                else:
                    waited += 1
                if row["val_loss"] < lowest * (1 - 1e-4):
                    lowest, bad = row["val_loss"], 0
                else:
                    bad += 1
                if self.c.plateau and bad > self.c.plateau:
                    plain, bad = plain / 2, 0
            self.history.append(row)
            if best_params is not None and waited >= self.c.patience:
                break
        if best_params is not None:
            self._restore(best_params)
        return self


def dense(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature arrays and class indices of a pandas frame with ``features`` and ``y``."""
    x = np.zeros((len(pdf), width))
    for i, f in enumerate(pdf["features"]):
        x[i, : len(f)] = f
    return x, pdf["y"].to_numpy().astype(int)


def _bounded(rows: DataFrame, most: int) -> None:
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; fit on a sample, or with softmax_regression")


HISTORY = "config bigint, run int, epoch int, loss double, acc double, val_loss double, val_acc double"


def cross_validate(rows: DataFrame, configs: list[Config], width: int, classes: int) -> DataFrame:
    """Training history of every configuration on every fold run: ``rows(run, role, features ARRAY<DOUBLE>, y)``.

    One task trains one configuration on one run, so the rows are a bounded sample: more than ``MOST_ROWS`` are an error.
    """
    _bounded(rows, MOST_ROWS)
    spark = rows.sparkSession
    ids = spark.createDataFrame([(i,) for i in range(len(configs))], "config bigint")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = configs[int(pdf["config"].iloc[0])]
        train, val = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "val"]
        x, y = dense(train, width)
        xv, yv = dense(val, width)
        h = pd.DataFrame(Network(width, classes, c).fit(x, y, xv, yv).history)
        h["config"], h["run"] = int(pdf["config"].iloc[0]), int(pdf["run"].iloc[0])
        for col in ("val_loss", "val_acc"):
            if col not in h:
                h[col] = np.nan
        return h[["config", "run", "epoch", "loss", "acc", "val_loss", "val_acc"]].astype({"epoch": "int32", "run": "int32"})

    spread = rows.crossJoin(F.broadcast(ids)).repartition(2 * len(configs), "config", "run")  # a given number: small tables stay spread
    return spread.groupBy("config", "run").applyInPandas(fit, HISTORY)


def retrain_all(rows: DataFrame, configs: list[Config], width: int, classes: int, history: DataFrame) -> DataFrame:
    """``(config, cv_acc, val_acc, test_acc)``: every configuration trained again on the training part, next to its cross-validation.

    ``rows(role, features, y)`` with roles ``train``, ``val`` (for stopping) and ``test``, a bounded sample; ``history`` as ``cross_validate`` gives it.
    """
    _bounded(rows, MOST_ROWS)
    ids = rows.sparkSession.createDataFrame([(i,) for i in range(len(configs))], "config bigint")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["config"].iloc[0])
        parts = {role: dense(pdf[pdf["role"] == role], width) for role in ("train", "val", "test")}
        net = Network(width, classes, configs[k]).fit(*parts["train"], *parts["val"])
        accuracy = [float((net.probabilities(x).argmax(1) == y).mean()) if len(y) else None for x, y in (parts["val"], parts["test"])]
        return pd.DataFrame([[k, *accuracy]], columns=["config", "val_acc", "test_acc"]).astype({"val_acc": "float64", "test_acc": "float64"})

    again = rows.crossJoin(F.broadcast(ids)).repartition(len(configs), "config").groupBy("config").applyInPandas(fit, "config bigint, val_acc double, test_acc double")
    return ranking(history).select("config", F.col("mean_acc").alias("cv_acc")).join(again, "config")


def ranking(history: DataFrame) -> DataFrame:
    """``(config, mean_acc, std_acc, min_acc, max_acc, place)`` by the best validation accuracy of each run."""
    from pyspark.sql import Window

    best = history.groupBy("config", "run").agg(F.max("val_acc").alias("a"))
    s = best.groupBy("config").agg(F.avg("a").alias("mean_acc"), F.stddev_pop("a").alias("std_acc"), F.min("a").alias("min_acc"), F.max("a").alias("max_acc"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_acc"), "config")))  # one row a configuration


def learning_curve(history: DataFrame) -> DataFrame:
    """Mean and deviation over the runs of each epoch, cut to the shortest run."""
    last = history.groupBy("config", "run").agg(F.max("epoch").alias("e")).groupBy("config").agg(F.min("e").alias("last"))
    h = history.join(last, "config").where("epoch <= last")
    return h.groupBy("config", "epoch").agg(F.avg("val_loss").alias("val_loss"), F.stddev_pop("val_loss").alias("val_loss_std"), F.avg("val_acc").alias("val_acc"))


def _left_out(rows: DataFrame, predict, groups: int) -> DataFrame:
    """``(id, y, pred)`` by leave-one-out over all of ``rows(id, features, y)``.

    Rows with the same features and class leave the same training table behind, so one model is fitted
    for each distinct row (``predict(table)(i)``, the table with the copies ``n``) and its prediction goes to every copy.
    Every task holds the distinct rows and fits the models of its share of them.
    """
    shares = rows.sparkSession.createDataFrame([(g,) for g in range(groups)], "share int")
    distinct = rows.groupBy("features", "y").agg(F.count("*").alias("n"))
    _bounded(distinct, MOST_DISTINCT)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[tuple(f) for f in pdf["features"]]).sort_values(["key", "y"]).reset_index(drop=True)
        mine = range(int(pdf["share"].iloc[0]), len(pdf), groups)
        choose = predict(pdf)
        out = [(pdf["key"][i], int(pdf["y"][i]), choose(i)) for i in mine]
        return pd.DataFrame(out, columns=["features", "y", "pred"])

    spread = distinct.crossJoin(F.broadcast(shares)).repartition(groups, "share")  # a given number: small tables stay spread
    fitted = spread.groupBy("share").applyInPandas(fit, "features array<double>, y int, pred int")
    return rows.select("id", "features", "y").join(fitted, ["features", "y"]).select("id", "y", "pred")


def leave_one_out(rows: DataFrame, config: Config, width: int, classes: int, groups: int = 64) -> DataFrame:
    """``(id, y, pred)`` of stacking with a network by leave-one-out on ``rows(id, features, y)``; one fit a distinct row."""
    def predict(pdf):
        x, y = dense(pdf, width)
        n = pdf["n"].to_numpy()

        def choose(i):
            left = np.repeat(np.arange(len(n)), n - (np.arange(len(n)) == i))
            return int(Network(width, classes, config).fit(x[left], y[left]).probabilities(x[i:i + 1]).argmax())
        return choose

    return _left_out(rows, predict, groups)


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, classes: int, c: float, start: np.ndarray | None = None, tolerance: float = 1e-8, steps: int = 1000) -> np.ndarray:
    """Weights ((features + intercept) x classes) of multinomial logistic regression on rows of ``n`` copies.

    Minimises ``c`` times the summed cross entropy plus half the squared weights (not the intercepts), by damped
    Newton steps until no gradient is above ``tolerance``; an error if that is not reached.  Classes without rows get
    the intercept -inf.
    """
    x = np.hstack((x, np.ones((len(x), 1))))
    there = np.flatnonzero(np.bincount(y, weights=n, minlength=classes))
    k, d = len(there), x.shape[1]
    out = np.zeros((d, classes))
    out[-1] = -np.inf
    target = (y[:, None] == there).astype(float)
    ridge = np.repeat(np.arange(d) < d - 1, k).reshape(d, k).astype(float)
    w = np.zeros((d, k)) if start is None else start[:, there].copy()

    def value(w):
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -c * (n[:, None] * target * log_p).sum() + 0.5 * (ridge * w * w).sum(), np.exp(log_p)

    f, p = value(w)
    for _ in range(steps):
        g = c * (x.T @ (n[:, None] * (p - target))) + ridge * w
        if np.abs(g).max() < tolerance * max(1.0, c * n.sum()):
            out[:, there] = w
            return out
        h = np.zeros((d, k, d, k))
        for a in range(k):
            for b in range(a, k):
                h[:, a, :, b] = h[:, b, :, a] = c * (x.T * (n * p[:, a] * ((a == b) - p[:, b]))) @ x
        # the intercepts may move together: a trace on the diagonal fixes that direction, in which the gradient is 0
        h = h.reshape(d * k, d * k) + np.diag(ridge.ravel() + 1e-8)
        move, t = np.linalg.solve(h, g.ravel()).reshape(d, k), 1.0
        down = (move * g).sum()
        while True:
            f_new, p_new = value(w - t * move)
            if f_new <= f - 1e-4 * t * down + 1e-12 * abs(f) or t < 1e-10:
                break
            t /= 2
        w, f, p = w - t * move, f_new, p_new
    raise ValueError(f"no convergence in {steps} Newton steps")


def leave_one_out_regression(rows: DataFrame, width: int, classes: int, c: float = 1.0, groups: int = 64) -> DataFrame:
    """``(id, y, pred)`` of stacking with multinomial logistic regression (inverse penalty ``c``) by leave-one-out.

    Every fit starts at the weights of all rows and is solved to convergence, so that the start does not matter.
    """
    def predict(pdf):
        x, y = dense(pdf, width)
        n = pdf["n"].to_numpy().astype(float)
        whole = _newton(x, y, n, classes, c)

        def choose(i):
            left = n - (np.arange(len(n)) == i)
            if not left.any():
                return 0
            w = _newton(x, y, left, classes, c, whole)
            return int((x[i] @ w[:-1] + w[-1]).argmax())
        return choose

    return _left_out(rows, predict, groups)


def softmax_regression(rows: DataFrame, features: str = "features", label: str = "y", l2: float = 0.0, iterations: int = 100):
    """Distributed multinomial logistic regression over vector features (spark.ml)."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=l2, maxIter=iterations).fit(rows)


def dense_rows(features: DataFrame, width: int) -> DataFrame:
    """Long ``(doc, idx, value)`` features as ``(doc, features ARRAY<DOUBLE>)``, zeros filled in; an ``idx`` outside the width is an error."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            at, value = b.column(1), b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
            x = np.zeros((b.num_rows, width))
            x[row, at.flatten().to_numpy()] = value.flatten().to_numpy()
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * width, pa.int32()), pa.array(x.ravel()))], names=["doc", "features"])

    sorted_ = features.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("f"))  # as long as a document
    parts = sorted_.select("doc", F.transform("f", lambda x: x["idx"].cast("int")).alias("at"), F.transform("f", lambda x: x["value"].cast("double")).alias("value"))
    return parts.mapInArrow(run, f"doc {features.schema['doc'].dataType.simpleString()}, features array<double>")
