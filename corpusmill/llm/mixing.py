"""Mixing sources to target shares of all tokens (problem 6).

Method: soft membership.  A classifier fitted on a bounded sample of labelled rows gives each row without a
source its posteriors over the target sources; a labelled row belongs to its source for certain.
Projected-gradient least squares then fits a rate between 0 and the source's repeats for every document, so
that the expected tokens of each source come nearest to its share of all tokens.

Rows that belong to one source for certain, and thus all have the same gradient, are summed to one row a
source before the fit; rows with soft membership are passed over once a step, each task replaying the
steps since their rates were last stored from the list of their residuals.  So a source with a third of all rows is a partial sum.
What the driver holds is the classifier and one number a source and step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .textcodes import blocks, mix64, word_sets
from .tokens import Tokens

#: Labelled rows the classifier is fitted on at most, hashed word features, training steps.
SAMPLE_ROWS, FEATURES, TRAIN_STEPS = 4_000, 2_048, 80
#: Step length of the fit, the change of expected tokens (as a part of what a source may give) below which it ends, and the steps after which
#: it gives up and says so; rates of rows without a source are stored once in so many steps.
STEP, TOLERANCE, MOST_STEPS, STORED = 0.8, 1e-5, 1_000, 12
#: Sources a target table may list; the fit's state is of this size.
MAX_SOURCES = 10_000


def token_counts(documents: DataFrame, *carried: str) -> DataFrame:
    """``(carried..., tokens BIGINT)``: tokens of ``text``, 0 for a null or blank one."""
    def run(batches):
        for b in batches:
            for first, part in blocks(b.column(0).to_pylist()):
                yield pa.record_batch([b.column(i).slice(first, len(part)) for i in range(1, b.num_columns)] + [pa.array(Tokens(part, boundaries=False).count, pa.int64())], names=[*carried, "tokens"])
    source = documents.select("text", *carried)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{types}, tokens bigint")


def _features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for first, part in blocks(texts):
        vocabulary, doc, word = word_sets(part)
        column = (mix64(vocabulary, 61) % np.uint64(FEATURES)).astype(np.int64)
        out[first + doc, column[word]] = 1
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-6)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _train(classes: int):
    """Multinomial logistic regression by full-batch gradient steps, with a small ridge; rows in id order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x, y = _features(pdf["text"].tolist()), np.eye(classes, dtype=np.float32)[pdf["k"].to_numpy()]
        w, bias = np.zeros((FEATURES, classes), dtype=np.float32), np.log((y.sum(axis=0) + 1) / (len(y) + classes)).astype(np.float32)
        for _ in range(TRAIN_STEPS):
            g = (_softmax(x @ w + bias) - y) / max(len(y), 1)
            w -= np.float32(20) * (x.T @ g + np.float32(1e-4) * w)
            bias -= np.float32(0.5) * g.sum(axis=0)
        return pd.DataFrame({"w": [np.vstack((w, bias[None, :])).astype(np.float32).tobytes()]})
    return run


def fit_classifier(documents: DataFrame, sources: list[str], n_rows: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights ((features + 1) x sources) from at most ``sample_rows`` labelled rows, the first by a hash of the id.

    ``n_rows``, the number of labelled rows, sets a bound on the hash under which twice the sample is
    expected, so that tasks pass on their part of the sample only.
    """
    known = documents.where(F.col("source").isin(sources) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if n_rows > 2 * sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * 2 * sample_rows / n_rows))
    number = documents.sparkSession.createDataFrame([(n, k) for k, n in enumerate(sources)], "source string, k int")
    first = known.select("doc_id", "source", "text").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample_rows)
    sample = first.join(F.broadcast(number), "source").select("doc_id", "text", "k")
    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_train(len(sources)), "w binary").first()
    return np.frombuffer(got[0], dtype=np.float32).reshape(FEATURES + 1, len(sources)) if got else None


def _posteriors(weights: np.ndarray):
    """(doc_id, text) -> (doc_id, tokens, posterior)."""
    def run(batches):
        for b in batches:
            for first, part in blocks(b.column(1).to_pylist()):
                p = _softmax(_features(part) @ weights[:-1] + weights[-1])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.astype(np.float64).ravel()))
                yield pa.record_batch([b.column(0).slice(first, len(part)), pa.array(Tokens(part, boundaries=False).count, pa.int64()), flat], names=["doc_id", "tokens", "posterior"])
    return run


def replay(rate: np.ndarray, posterior: np.ndarray, cap: np.ndarray, residuals: np.ndarray, step: float = STEP) -> np.ndarray:
    """Rates of documents after further projected-gradient steps, whose relative residuals are given."""
    for r in residuals:
        rate = np.clip(rate - step * (posterior @ r), 0, cap)
    return rate


def _rates(batch: pa.RecordBatch, residuals: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, rates) of a batch of (doc_id, tokens, posterior, rate)."""
    p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(repeats))
    cap = repeats[p.argmax(axis=1)] if len(p) else np.zeros(0)
    return p, replay(np.minimum(batch.column(3).to_numpy(zero_copy_only=False), cap), p, cap, residuals)


def _soft_totals(residuals: np.ndarray, repeats: np.ndarray):
    def run(batches):
        total = np.zeros(len(repeats))
        for b in batches:
            p, rate = _rates(b, residuals, repeats)
            total += (p * (b.column(1).to_numpy(zero_copy_only=False) * rate)[:, None]).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(len(repeats)), pa.int64()), pa.array(total)], names=["k", "tokens"])
    return run


def _moved(residuals: np.ndarray, repeats: np.ndarray):
    """The rows with their rates after the given steps."""
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(_rates(b, residuals, repeats)[1])], names=["doc_id", "tokens", "posterior", "rate"])
    return run


class Mix:
    """A fitted mix; see ``fit_mix``."""

    def __init__(self, names, shares, repeats, tokens, total, rates, soft, soft_totals, documents, steps, converged):
        self.names, self.shares, self.repeats, self.tokens, self.total = names, shares, repeats, tokens, total
        self.rates, self.soft, self.soft_totals, self.documents = rates, soft, soft_totals, documents
        self.steps, self.converged = steps, converged

    def report(self) -> DataFrame:
        """``(source, target_share, tokens, max_repeats, wanted_tokens, reached_tokens, reached_share, at_cap, reachable, converged)``.

        ``reached_tokens`` are the expected tokens at the fitted rates, ``reached_share`` their part of all reached
        ones, which is above the target for the others where a source at its cap falls short: what is wanted of each is its part of
        all tokens there are.  ``converged`` is false in all rows if the fit gave up.  A source is not reachable if its rows, all drawn as often as they may, hold less than its share.
        """
        spark = self.documents.sparkSession
        wanted = self.shares * self.total
        reached = self.tokens * self.rates + self.soft_totals
        whole = max(reached.sum(), 1e-9)
        rows = [(n, float(s), int(t), int(c), float(w), float(x), float(x / whole), bool(r >= c - 1e-9), bool(not (t * c < w)), bool(self.converged)) for n, s, t, c, w, x, r in zip(self.names, self.shares, self.tokens, self.repeats, wanted, reached, self.rates)]
        return spark.createDataFrame(rows, "source string, target_share double, tokens bigint, max_repeats bigint, wanted_tokens double, reached_tokens double, reached_share double, at_cap boolean, reachable boolean, converged boolean")

    def draw(self) -> DataFrame:
        """``(doc_id, source, repeats)``: how often each document is drawn, none left out.

        A rate's whole part, and once more with the probability of its fraction, by a hash of ``doc_id``, so a
        document is never drawn more often than its source may be repeated.  Rows without a source
        are drawn by their posteriors' rates; rows of unlisted sources 0 times.
        """
        spark = self.documents.sparkSession
        rates = spark.createDataFrame([(n, float(r)) for n, r in zip(self.names, self.rates)], "source string, rate double")
        once = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
        hard = self.documents.select("doc_id", "source").where("source is not null").join(F.broadcast(rates), "source", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
        drawn = hard.select("doc_id", "source", "rate").unionByName(self.soft.select("doc_id", F.lit(None).cast("string").alias("source"), "rate"))
        whole = F.floor(F.col("rate") + 1e-9)
        return drawn.select("doc_id", "source", (whole + F.when(once < F.col("rate") - whole, 1).otherwise(0)).cast("bigint").alias("repeats"))

    def faults(self) -> DataFrame:
        """``(what, n)``: documents drawn more often than their source may be, rates not settled, sources with room more than 1 % off what is wanted."""
        spark = self.documents.sparkSession
        most = spark.createDataFrame([(n, int(c)) for n, c in zip(self.names, self.repeats)], "source string, most bigint")
        often = self.draw().join(F.broadcast(most), "source", "left").where(F.col("repeats") > F.coalesce("most", F.lit(int(self.repeats.max())))).agg(F.count("*").alias("n"))
        wanted = self.shares * self.total
        off = np.abs(self.tokens * self.rates + self.soft_totals - wanted) > 0.01 * wanted
        fixed = [("rates not settled", int(not self.converged)), ("sources with room off their share", int((off & (self.rates > 1e-9) & (self.rates < self.repeats - 1e-9)).sum()))]
        return often.select(F.lit("documents drawn too often").alias("what"), "n").unionByName(spark.createDataFrame(fixed, "what string, n bigint"))


def fit_mix(documents: DataFrame, targets: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = MOST_STEPS) -> Mix:
    """Fits document rates to the target shares.

    ``documents`` needs ``doc_id, text, source``, ``targets`` ``source, target_share, max_repeats``; other columns
    are ignored.  A target with a null source or share is left out, null repeats count as 1, a source listed
    twice has its shares added and the larger repeats.  Null texts have no tokens.  All tokens are those of
    the listed sources' rows.  No documents: all rates stay at 1, nothing is reached.
    """
    goal = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.sum("target_share"), F.max(F.coalesce("max_repeats", F.lit(1)))).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if not goal or len(goal) > MAX_SOURCES:
        raise ValueError(f"from 1 to {MAX_SOURCES} target sources are needed")
    names, shares, repeats = [g[0] for g in goal], np.array([float(g[1]) for g in goal]), np.array([float(g[2]) for g in goal])
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "mixing")
    counted = token_counts(documents, "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "source string, k int")
    by_source = {r[0]: (r[1], r[2]) for r in counted.join(F.broadcast(listed), "source").select("k", "tokens", "rows").collect()}
    tokens = np.array([float(by_source.get(k, (0, 0))[0]) for k in range(len(names))])
    n_rows = sum(r for _, r in by_source.values())
    total = tokens.sum()

    unknown = documents.where("source is null and doc_id is not null")
    schema = "doc_id bigint, tokens bigint, posterior array<double>, rate double"
    soft = spark.createDataFrame([], schema)
    weights = None if unknown.isEmpty() else fit_classifier(documents, names, n_rows, sample_rows)
    if weights is not None:
        texts = unknown.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        soft = scratch.keep(texts.mapInArrow(_posteriors(weights), "doc_id bigint, tokens bigint, posterior array<double>").withColumn("rate", F.lit(1.0)), "soft")

    wanted = shares * total
    none = np.zeros((0, len(names)))

    def totals(pending: np.ndarray, caps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names))
        if weights is not None:
            for k, x in soft.mapInArrow(_soft_totals(pending, caps), "k bigint, tokens double").groupBy("k").agg(F.sum("tokens")).collect():
                out[k] = x
        return out

    mass = np.maximum(tokens + totals(none, np.ones(len(names))), 1e-9)
    pending, rates = none, np.minimum(1.0, repeats)
    soft_totals = totals(pending, repeats)
    done, converged = 0, False
    while not converged and done < steps:
        new = (tokens * rates + soft_totals - wanted) / mass
        moved = np.clip(rates - STEP * new, 0, repeats)
        pending = np.vstack((pending, new))
        if weights is not None and len(pending) == STORED:
            soft, old = scratch.keep(soft.mapInArrow(_moved(pending, repeats), schema), "soft"), soft
            scratch.drop(old)
            pending = none
        after = totals(pending, repeats)
        change = np.abs(tokens * (moved - rates) + after - soft_totals) / mass
        rates, soft_totals, done = moved, after, done + 1
        converged = float(change.max(initial=0)) < TOLERANCE
    if weights is not None and len(pending):
        soft = scratch.keep(soft.mapInArrow(_moved(pending, repeats), schema), "soft")
    return Mix(names, shares, repeats, tokens, total, rates, soft, soft_totals, documents, done, converged)


def unreachable_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source)``: the sources that cannot reach their share; see ``Mix.report``."""
    return fit_mix(documents, targets).report().where("not reachable").select("source")


def drawn_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, drawn_tokens, drawn_share)`` of the documents as drawn; rows without a source are the null group."""
    mix = fit_mix(documents, targets)
    sized = token_counts(documents, "doc_id").join(mix.draw(), "doc_id").where("repeats > 0")
    by = sized.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"))
    whole = by.agg(F.sum("drawn_tokens").alias("all"))
    return by.crossJoin(F.broadcast(whole)).select("source", "drawn_tokens", (F.col("drawn_tokens") / F.col("all")).alias("drawn_share"))
