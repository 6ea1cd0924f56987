"""Named classifiers in NumPy: rebuilt from stored weights by their class name, scored in batches, and trained.

Weights are arrays by name, sent to the executors once (``MOST_WEIGHTS`` at most); rows are scored by ``predict_batch_udf``, a
batch of feature or id arrays at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .train import Config, Network

#: Weights of a model that are still sent to every executor (400 MB).
MOST_WEIGHTS = 100_000_000


@dataclass(frozen=True)
class Tabular:
    """Hidden sizes, dropout after each, activation, and whether batches are normalised before it."""

    hidden: tuple[int, ...]
    dropout: tuple[float, ...]
    activation: str = "relu"
    normalised: bool = True


# The named models' layers and dropouts.
TABULAR = {
    "DNNWide": Tabular((256, 128), (0.5, 0.4)),
    "DNNNarrow": Tabular((128, 64), (0.5, 0.5)),
    "DNNDeep": Tabular((256, 128, 64), (0.5, 0.4, 0.3)),
    "DNNLeakyReLU": Tabular((256, 128), (0.5, 0.4), "leaky"),
    "DNNELU": Tabular((256, 128), (0.5, 0.4), "elu"),
    "DNNSimple": Tabular((128, 32), (0.5, 0.5), normalised=False),
    "DNNVeryDeep": Tabular((256, 128, 64, 32), (0.5, 0.4, 0.3, 0.2)),
    "DNNGrid": Tabular((256, 128), (0.5, 0.5), "leaky"),
}
EMBEDDED = Tabular((128, 64), (0.5, 0.4))
LEAK, EPSILON = 0.1, 1e-5


def activate(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "leaky":
        return np.where(x > 0, x, LEAK * x)
    if kind == "elu":
        return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))
    if kind == "gelu":
        return 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x ** 3)))
    return np.maximum(x, 0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def folded(weights: dict, prefix: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    """Affine layers ``<prefix><i>.w, .b`` in order, the normalisation of their outputs (``.gamma, .beta, .mean, .var``) worked in."""
    out, i = [], 0
    while f"{prefix}{i}.w" in weights:
        w, b = weights[f"{prefix}{i}.w"], weights[f"{prefix}{i}.b"]
        if f"{prefix}{i}.gamma" in weights:
            scale = weights[f"{prefix}{i}.gamma"] / np.sqrt(weights[f"{prefix}{i}.var"] + EPSILON)
            w, b = w * scale, (b - weights[f"{prefix}{i}.mean"]) * scale + weights[f"{prefix}{i}.beta"]
        out.append((w, b))
        i += 1
    return out


def _dense(x: np.ndarray, layers, activation: str) -> np.ndarray:
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = activate(x, activation)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: dict, p: str) -> np.ndarray:
    """Hidden states (rows, steps, units); gates in the order input, forget, cell, output."""
    units = w[p + "wh"].shape[0]
    h, c = np.zeros((len(x), units)), np.zeros((len(x), units))
    ahead, out = x @ w[p + "wi"] + w[p + "bi"] + w[p + "bh"], np.empty((*x.shape[:2], units))
    for t in range(x.shape[1]):
        i, f, g, o = np.split(ahead[:, t] + h @ w[p + "wh"], 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out


def _gru(x: np.ndarray, w: dict, p: str) -> np.ndarray:
    """Hidden states (rows, steps, units); gates in the order reset, update, new."""
    units = w[p + "wh"].shape[0]
    h = np.zeros((len(x), units))
    ahead, out = x @ w[p + "wi"] + w[p + "bi"], np.empty((*x.shape[:2], units))
    for t in range(x.shape[1]):
        (a, b, c), (d, e, g) = np.split(ahead[:, t], 3, axis=1), np.split(h @ w[p + "wh"] + w[p + "bh"], 3, axis=1)
        z = _sigmoid(b + e)
        h = (1 - z) * np.tanh(c + _sigmoid(a + d) * g) + z * h
        out[:, t] = h
    return out


def _both_ways(ids: np.ndarray, w: dict, cell, layers: int) -> np.ndarray:
    """The last hidden states of both directions of a stack; padding (id 0) has a zero vector and is read like any step."""
    table = w["embedding"].copy()
    table[0] = 0
    x = table[ids]
    for k in range(layers):
        there = cell(x, w, f"layer{k}.")
        back = cell(x[:, ::-1], w, f"layer{k}.back.")[:, ::-1]
        x = np.concatenate((there, back), axis=2)
    return np.concatenate((there[:, -1], back[:, 0]), axis=1)


def _pooled(ids: np.ndarray, w: dict) -> np.ndarray:
    """Mean vector of the ids that are not padding (zeros where all are)."""
    known = (ids != 0)[:, :, None]
    return (w["embedding"][ids] * known).sum(axis=1) / np.maximum(known.sum(axis=1), 1)


def _norm(x: np.ndarray, w: dict, p: str) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + 1e-12) * w[p + "gamma"] + w[p + "beta"]


def _encoder(ids: np.ndarray, w: dict, heads: int, layers: int) -> np.ndarray:
    """The first token's state of an attention encoder (normalised after each block); padding (id 0) is not attended to."""
    x = _norm(w["embedding"][ids] + w["position"][: ids.shape[1]], w, "embedding.")
    hidden = np.where(ids != 0, 0.0, -1e9)[:, None, None, :]
    n, steps, width = x.shape
    split = lambda a: a.reshape(n, steps, heads, width // heads).transpose(0, 2, 1, 3)
    for k in range(layers):
        p = f"layer{k}."
        q, key, v = (split(x @ w[p + c + "w"] + w[p + c + "b"]) for c in "qkv")
        a = softmax(q @ key.transpose(0, 1, 3, 2) / np.sqrt(width // heads) + hidden) @ v
        x = _norm(x + a.transpose(0, 2, 1, 3).reshape(n, steps, width) @ w[p + "ow"] + w[p + "ob"], w, p + "attended.")
        x = _norm(x + activate(x @ w[p + "upw"] + w[p + "upb"], "gelu") @ w[p + "downw"] + w[p + "downb"], w, p + "fed.")
    return x[:, 0]


def rebuild(name: str, weights: dict[str, np.ndarray], layers: int = 2, heads: int = 12) -> Callable[[np.ndarray], np.ndarray]:
    """The class probabilities of a named model from its stored weights; an unknown name is an error.

    Tabular models take feature rows; ``EmbeddingDNN``, ``BiLSTM``, ``BiGRU``, ``BiLSTMVectors`` and ``Encoder`` take id rows of one length.
    """
    size = sum(v.size for v in weights.values())
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights; at most {MOST_WEIGHTS} are sent to the executors")
    if name in TABULAR:
        stack = folded(weights)
        return lambda x: softmax(_dense(x, stack, TABULAR[name].activation))
    stack = folded(weights, "head.")
    if name == "EmbeddingDNN":
        return lambda x: softmax(_dense(_pooled(x.astype(int), weights), stack, "relu"))
    if name in ("BiLSTM", "BiGRU", "BiLSTMVectors"):
        cell = _gru if name == "BiGRU" else _lstm
        return lambda x: softmax(_dense(_both_ways(x.astype(int), weights, cell, layers), stack, "relu"))
    if name == "Encoder":
        return lambda x: softmax(_dense(_encoder(x.astype(int), weights, heads, layers), stack, "relu"))
    raise ValueError(f"unknown model {name!r}")


def predict(rows: DataFrame, key: str, column: str, width: int, name: str, weights: dict[str, np.ndarray], batch: int = 256, **shape) -> DataFrame:
    """``(key, p ARRAY<DOUBLE>, pred INT)`` of rows whose ``column`` is an array of ``width`` numbers; null arrays are left out.

    ``batch`` rows are scored at once; ties go to the lowest class.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    rebuild(name, weights, **shape)  # errors come here and not in a task
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def make():
        return rebuild(name, sent.value, **shape)

    score = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    p = rows.where(F.col(column).isNotNull()).select(key, score(F.col(column).cast("array<double>")).alias("p"))
    return p.withColumn("pred", (F.array_position("p", F.array_max("p")) - 1).cast("int"))


def vectors_of(vocabulary: DataFrame, pretrained: DataFrame, width: int, seed: int = 42, deviation: float = 0.6) -> DataFrame:
    """``(idx, vector ARRAY<DOUBLE>)`` by row of an embedding table: padding (0) is zeros, a known word its vector, others drawn from N(0, ``deviation``).

    ``vocabulary(term, idx)`` with ids from 1; ``pretrained(word, vector)``.  Id 1, the unknown word, and words without a
    vector (or with one of another width) are drawn by a hash of seed, id and place (Box and Muller).
    """
    unit = lambda k, i: (F.pmod(F.xxhash64(F.lit(seed), "idx", i, F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.lit(deviation) * F.sqrt(-2 * F.log(unit(1, i))) * F.cos(F.lit(2 * np.pi) * unit(2, i)))
    own = pretrained.where(F.size("vector") == width).groupBy("word").agg(F.first("vector").alias("vector"))
    listed = vocabulary.select("term", F.col("idx").cast("int").alias("idx"))
    rest = rest_ids(listed.sparkSession)
    j = listed.unionByName(rest).join(own, F.col("term") == F.col("word"), "left")
    return j.select("idx", F.when(F.col("idx") == 0, F.array_repeat(F.lit(0.0), width)).otherwise(F.coalesce(F.col("vector").cast("array<double>"), drawn)).alias("vector"))


def rest_ids(spark) -> DataFrame:
    """Rows of the padding and the unknown word."""
    return spark.createDataFrame([(None, 0), (None, 1)], "term string, idx int")


class TabularNetwork(Network):
    """A named tabular model under training: affine layers, batch normalisation, activation and dropout of its own."""

    MOMENTUM = 0.1

    def __init__(self, name: str, n_in: int, n_out: int, c: Config):
        self.spec = TABULAR[name]
        super().__init__(n_in, n_out, replace(c, hidden=self.spec.hidden))
        hidden = self.spec.hidden if self.spec.normalised else ()
        self.params += [p for h in hidden for p in (np.ones(h), np.zeros(h))]
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.seen = [[np.zeros(h), np.ones(h)] for h in hidden]

    def _forward(self, x, train):
        kept, n = [], len(self.spec.hidden) + 1
        for i in range(n):
            step = {"x": x}
            x = x @ self.params[2 * i] + self.params[2 * i + 1]
            if i < n - 1:
                if self.spec.normalised:
                    if train:
                        mean, var = x.mean(axis=0), x.var(axis=0)
                        wide = var * len(x) / max(len(x) - 1, 1)
                        self.seen[i] = [(1 - self.MOMENTUM) * a + self.MOMENTUM * b for a, b in zip(self.seen[i], (mean, wide))]
                    else:
                        mean, var = self.seen[i]
                    step["over"] = np.sqrt(var + EPSILON)
                    step["unit"] = (x - mean) / step["over"]
                    x = step["unit"] * self.params[2 * n + 2 * i] + self.params[2 * n + 2 * i + 1]
                step["before"] = x
                x = activate(x, self.spec.activation)
                if train and self.spec.dropout[i]:
                    step["mask"] = (self.rng.random(x.shape) >= self.spec.dropout[i]) / (1 - self.spec.dropout[i])
                    x = x * step["mask"]
            kept.append(step)
        return softmax(x), kept

    def _slope(self, x):
        if self.spec.activation == "leaky":
            return np.where(x > 0, 1.0, LEAK)
        return np.where(x > 0, 1.0, np.exp(np.minimum(x, 0)) if self.spec.activation == "elu" else 0.0)

    def _gradients(self, x, y):
        p, kept = self._forward(x, True)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        out, n = [None] * len(self.params), len(kept)
        for i in reversed(range(n)):
            step = kept[i]
            if i < n - 1:
                d = d * step.get("mask", 1.0) * self._slope(step["before"])
                if self.spec.normalised:
                    g = 2 * n + 2 * i
                    out[g], out[g + 1] = (d * step["unit"]).sum(axis=0), d.sum(axis=0)
                    d = d * self.params[g]
                    d = (d - d.mean(axis=0) - step["unit"] * (d * step["unit"]).mean(axis=0)) / step["over"]
            out[2 * i], out[2 * i + 1] = step["x"].T @ d, d.sum(axis=0)
            d = d @ self.params[2 * i].T
        if self.c.optimizer != "adamw" and self.c.l2:
            out = [g + self.c.l2 * p for g, p in zip(out, self.params)]
        return out

    def _state(self):
        return [p.copy() for p in self.params], [[a.copy() for a in s] for s in self.seen]

    def _restore(self, state) -> None:
        self.params, self.seen = state

    def weights(self) -> dict[str, np.ndarray]:
        """The arrays that ``rebuild`` takes."""
        n, out = len(self.spec.hidden) + 1, {}
        for i in range(n):
            out[f"{i}.w"], out[f"{i}.b"] = self.params[2 * i], self.params[2 * i + 1]
        for i, (mean, var) in enumerate(self.seen):
            out |= {f"{i}.gamma": self.params[2 * n + 2 * i], f"{i}.beta": self.params[2 * n + 2 * i + 1], f"{i}.mean": mean, f"{i}.var": var}
        return out


def subword_ids(docs: DataFrame, key: str, text: str, path: str, length: int = 128, start: int | None = None, end: int | None = None, padding: int = 0) -> DataFrame:
    """``(key, ids ARRAY<INT>, mask ARRAY<INT>)``: subword ids of a public tokenizer file (``tokenizers`` format), cut and padded to ``length``.

    ``path`` must be readable by the executors.  ``start`` and ``end`` are put around the ids if given; strings of special tokens in a
    text are ordinary text.  A null text is all padding (between ``start`` and ``end``).
    """
    import pyarrow as pa

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        first, last = [start] * (start is not None), [end] * (end is not None)
        room = length - len(first) - len(last)
        for b in batches:
            got = [[*first, *e.ids[:room], *last] for e in t.encode_batch([x or "" for x in b.column(1).to_pylist()], add_special_tokens=False)]
            ids, mask = [g + [padding] * (length - len(g)) for g in got], [[1] * len(g) + [0] * (length - len(g)) for g in got]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int32()))], names=[key, "ids", "mask"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, mask array<int>")
