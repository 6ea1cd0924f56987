"""Vocabularies, TF-IDF, scalers and encoders in long, sparse form.

A fitted model is a value (a small DataFrame or a list); transforming never looks at the fitted
data again.  Documents come as ``(doc, ...)`` with one row each; features as ``(doc, idx, value)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from .scratch import Scratch

#: Rows of a vocabulary that is still sent to every executor.
BROADCAST_TERMS = 200_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def token_counts(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``(doc, term, n)`` of each document's token array; null arrays give no rows."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))


def first_occurrences(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``(term, tf, df, first_doc, first_pos)`` over the corpus, ordered by ``doc`` and position."""
    at = docs.select(F.col(doc).alias("doc"), F.posexplode(tokens).alias("pos", "term"))
    per_doc = at.groupBy("term", "doc").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    # min and min_by keep flat buffers, so the aggregates stay hash-based
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"), F.min("doc").alias("first_doc"), F.min_by("pos", "doc").alias("first_pos"))


@dataclass
class Vocabulary:
    """``table(term, idx, tf, df, idf)`` with ``rows`` of at most ``size`` terms; ``n_docs`` documents were fitted."""

    table: DataFrame
    size: int
    n_docs: int
    rows: int

    def joined(self, counts: DataFrame) -> DataFrame:
        return counts.join(_sent(self.table.select("term", "idx", "idf"), self.rows), "term")

    def listed(self) -> tuple[pa.Array, np.ndarray]:
        """Terms and idf in the order of idx; only for what may be sent to every executor."""
        t = self.table.select("term", "idx", "idf").toArrow().sort_by("idx")
        return t.column("term").combine_chunks().cast(pa.string()), t.column("idf").to_numpy()


def smooth_idf(df: Column, n_docs: int) -> Column:
    return F.log((1 + F.lit(n_docs)) / (1 + df)) + 1


def vocabulary(stats: DataFrame, n_docs: int, max_features: int, min_df: int, max_df: float, order: list[Column]) -> Vocabulary:
    """The ``max_features`` first terms by ``order`` with ``min_df <= df <= int(max_df * n_docs)``; idx from 0.

    The result is written, so that the corpus is fitted once however often the model is applied.
    """
    top = stats.where((F.col("df") >= min_df) & (F.col("df") <= int(max_df * n_docs))).orderBy(*order).limit(max_features)
    ranked = top.withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)  # over max_features rows
    fitted = Scratch(stats.sparkSession, "vocabulary").keep(ranked.withColumn("idf", smooth_idf(F.col("df"), n_docs)), "vocabulary")
    return Vocabulary(fitted, max_features, n_docs, fitted.count())


def fit_words(docs: DataFrame, doc: str, tokens: Column, max_features: int = 5000, min_df: int = 2, max_df: float = 0.95) -> Vocabulary:
    """Word or word n-gram vocabulary by corpus frequency, ties by first occurrence."""
    order = [F.desc("tf"), F.asc("first_doc"), F.asc("first_pos")]
    return vocabulary(first_occurrences(docs, doc, tokens), docs.count(), max_features, min_df, max_df, order)


class _Grams:
    """Character n-grams of words, each word taken apart once: numbers of n-grams word after word."""

    def __init__(self, low: int, high: int, terms: list[str] | None = None):
        self.low, self.high = low, high
        self.number = {} if terms is None else {t: i for i, t in enumerate(terms)}
        self.grows = terms is None
        self.word: dict[str, int] = {}
        self.parts: list[np.ndarray] = []

    def _of(self, word: str) -> np.ndarray:
        w, out = f" {word} ", []
        for n in range(self.low, self.high + 1):
            for i in range(len(w) - n + 1):
                g = w[i:i + n]
                k = self.number.setdefault(g, len(self.number)) if self.grows else self.number.get(g, -1)
                if k >= 0:
                    out.append(k)
        return np.array(out, dtype=np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of all words, one after the other; how many each word has)."""
        for w in words:
            if w not in self.word:
                self.word[w] = len(self.parts)
                self.parts.append(self._of(w))
        got = [self.parts[self.word[w]] for w in words]
        return np.concatenate(got) if got else np.zeros(0, np.int64), np.array([len(g) for g in got], dtype=np.int64)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


def _tokens_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each token, its number in the distinct tokens, those); null lists have none."""
    flat = column.flatten().dictionary_encode()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary


def _counted(row: np.ndarray, item: np.ndarray, n: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, how often) of the distinct pairs, by row, then item."""
    key, where, count = np.unique(row * most + item, return_inverse=True, return_counts=True)
    if n is not None:
        count = np.bincount(where, weights=n, minlength=len(key)).astype(np.int64)
    return key // most, key % most, count


#: Documents handled at once, and n-grams a task keeps counts of before it passes them on.
_DOCS, _KEPT = 1_000, 500_000


def _pieces(batches):
    for b in batches:
        for s in range(0, b.num_rows, _DOCS):
            yield b.slice(s, _DOCS)


def char_stats(docs: DataFrame, doc: str, text: str, low: int, high: int) -> DataFrame:
    """``(term, tf, df)`` of character n-grams inside words.

    One pass: a task takes each distinct word apart once, and passes on one row for each n-gram it has met, so the corpus's
    n-grams are shuffled neither by occurrence nor by document.
    """
    def run(batches):
        grams, tf, df = _Grams(low, high), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush():
            return pa.record_batch([pa.array(list(grams.number), pa.string()), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])

        for b in _pieces(batches):
            row, code, words = _tokens_of(b.column(0))
            flat, size = grams.of(words.to_pylist())
            if not len(row):
                continue
            first = np.cumsum(size) - size
            row, word, n = _counted(row, code, None, len(words))
            each = size[word]
            gram = flat[_spread(first[word], each)]
            more = len(grams.number) - len(tf)
            tf, df = np.append(tf, np.zeros(more, np.int64)), np.append(df, np.zeros(more, np.int64))
            tf += np.bincount(gram, weights=np.repeat(n, each), minlength=len(tf)).astype(np.int64)
            key = np.unique(np.repeat(row, each) * len(tf) + gram)
            df += np.bincount(key % len(df), minlength=len(df))
            if len(tf) > _KEPT:
                yield flush()
                grams, tf, df = _Grams(low, high), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield flush()

    parts = docs.select(T.char_words(F.col(text)).alias("w")).mapInArrow(run, "term string, tf bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fit_chars(docs: DataFrame, doc: str, text: str, low: int = 2, high: int = 4, max_features: int = 2000, min_df: int = 2, max_df: float = 0.98) -> Vocabulary:
    """Character n-gram vocabulary by corpus frequency, ties by the n-gram itself."""
    return vocabulary(char_stats(docs, doc, text, low, high), docs.count(), max_features, min_df, max_df, [F.desc("tf"), F.asc("term")])


def char_counts(docs: DataFrame, doc: str, text: str, low: int, high: int, vocabulary: Vocabulary) -> DataFrame:
    """``(doc, term, n)`` of the vocabulary's n-grams.

    Each distinct word of the corpus is expanded once, to the vocabulary's n-grams in it; a document's words are
    looked up there.
    """
    per_word = docs.select(F.col(doc).alias("doc"), F.explode(T.char_words(F.col(text))).alias("w")).groupBy("doc", "w").agg(F.count("*").alias("n"))
    grams = per_word.select("w").distinct().select("w", F.explode(T.char_ngrams_of_word(F.col("w"), low, high)).alias("term"))
    kept = grams.join(_sent(vocabulary.table.select("term"), vocabulary.rows), "term", "left_semi").groupBy("w", "term").agg(F.count("*").alias("k"))
    of_word = kept.groupBy("w").agg(F.collect_list(F.struct("term", "k")).alias("g"))  # as long as a word
    found = per_word.join(of_word, "w").select("doc", "n", F.explode("g").alias("g"))
    return found.groupBy("doc", F.col("g.term").alias("term")).agg(F.sum(F.col("n") * F.col("g.k")).alias("n"))


def bag_of_words(counts: DataFrame, model: Vocabulary) -> DataFrame:
    """``(doc, idx, n)``; terms outside the vocabulary are dropped."""
    return model.joined(counts).select("doc", "idx", "n")


def _weighed(row, idx, n, idf, sublinear, normalise):
    value = (1 + np.log(n) if sublinear else n.astype(float)) * idf[idx]
    if normalise and len(row):
        value = value / np.sqrt(np.bincount(row, weights=value * value))[row]
    return value


def _vectors(docs: DataFrame, doc: str, tokens: Column, model: Vocabulary, sublinear: bool, normalise: bool, grams: tuple[int, int] | None) -> DataFrame:
    """TF-IDF of each row from its own tokens, or their character n-grams: a row's tokens are together, so nothing is shuffled."""
    terms, idf = model.listed()
    sent = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches):
        terms, idf = sent.value
        parts = _Grams(*grams, terms.to_pylist()) if grams else None
        for b in _pieces(batches):
            row, code, words = _tokens_of(b.column(1))
            if not len(row):
                continue
            row, word, n = _counted(row, code, None, len(words))
            if parts:
                flat, size = parts.of(words.to_pylist())
                each = size[word]
                row, idx, n = _counted(np.repeat(row, each), flat[_spread((np.cumsum(size) - size)[word], each)], np.repeat(n, each), max(len(idf), 1))
            else:
                at = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)[word]
                row, idx, n = row[at >= 0], at[at >= 0].astype(np.int64), n[at >= 0]
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(idx.astype(np.int32)), pa.array(_weighed(row, idx, n, idf, sublinear, normalise))], names=["doc", "idx", "value"])

    held = docs.select(F.col(doc).alias("doc"), tokens.alias("t"))
    return held.mapInArrow(run, f"doc {held.schema['doc'].dataType.simpleString()}, idx int, value double")


def token_tf_idf(docs: DataFrame, doc: str, tokens: Column, model: Vocabulary, sublinear: bool = True, normalise: bool = True) -> DataFrame:
    """As ``tf_idf`` over ``token_counts``, for documents of one row each; without a shuffle unless the vocabulary is too large to be sent."""
    if model.rows > BROADCAST_TERMS:
        return tf_idf(token_counts(docs, doc, tokens), model, sublinear, normalise)
    return _vectors(docs, doc, tokens, model, sublinear, normalise, None)


def char_tf_idf(docs: DataFrame, doc: str, text: str, low: int, high: int, model: Vocabulary) -> DataFrame:
    """As ``tf_idf`` over ``char_counts``, for documents of one row each; without a shuffle unless the vocabulary is too large to be sent."""
    if model.rows > BROADCAST_TERMS:
        return tf_idf(char_counts(docs, doc, text, low, high, model), model)
    return _vectors(docs, doc, T.char_words(F.col(text)), model, True, True, (low, high))


def tf_idf(counts: DataFrame, model: Vocabulary, sublinear: bool = True, normalise: bool = True) -> DataFrame:
    """``(doc, idx, value)``: ``1 + ln n`` or ``n``, times idf, each document scaled to length 1."""
    tf = 1 + F.log("n") if sublinear else F.col("n").cast("double")
    raw = model.joined(counts).select("doc", "idx", (tf * F.col("idf")).alias("value"))
    if not normalise:
        return raw
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc")))
    return raw.withColumn("value", F.col("value") / norm)


def fit_relative(docs: DataFrame, doc: str, tokens: Column, max_features: int = 1500) -> Vocabulary:
    """Vocabulary by document frequency, ties by term, for ``relative_tf_idf``."""
    stats = token_counts(docs, doc, tokens).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    return vocabulary(stats, docs.count(), max_features, 1, 1.0, [F.desc("df"), F.asc("term")])


def relative_tf_idf(docs: DataFrame, doc: str, tokens: Column, model: Vocabulary) -> DataFrame:
    """``(doc, idx, value)``: share of the document's tokens, times idf, not normalised."""
    sized = docs.select(F.col(doc).alias("doc"), F.size(tokens).alias("len"))
    return model.joined(token_counts(docs, doc, tokens)).join(sized, "doc").select("doc", "idx", (F.col("n") / F.col("len") * F.col("idf")).alias("value"))


def fit_scaler(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population deviation (1 where it is 0) of each column."""
    sd = lambda c: F.stddev_pop(c)
    return features.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.when(sd(c) == 0, 1.0).otherwise(sd(c)).alias(f"{c}_std") for c in columns])


def scale(features: DataFrame, columns: list[str], scaler: DataFrame) -> DataFrame:
    """The columns less their mean over their deviation."""
    joined = features.crossJoin(F.broadcast(scaler))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(*features.columns)


def fit_classes(df: DataFrame, label: str, most: int = 10_000) -> list[str]:
    """Sorted distinct non-null labels; more than ``most`` are an error."""
    found = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} classes in {label}")
    return found


def one_hot(label: Column, classes: list[str]) -> Column:
    """Array of 0.0 and 1.0 by class; all zeros for an unknown or null label."""
    return F.array(*[F.when(label == c, 1.0).otherwise(0.0) for c in classes])


def label_index(label: Column, classes: list[str]) -> Column:
    """Index in the sorted classes; null for an unknown label."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in classes]), label), F.lit(0)) - 1


def index_label(index: Column, classes: list[str]) -> Column:
    """The class of an index; null outside."""
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def sequence_ids(docs: DataFrame, doc: str, tokens: Column, model: Vocabulary, length: int = 150) -> DataFrame:
    """``(doc, ids)``: the first ``length`` tokens as ids (idx + 2, 1 for unknown ones), padded with 0.

    Only the tokens that are kept are looked up.  A document without tokens is all padding.
    """
    cut = docs.select(F.col(doc).alias("doc"), F.slice(F.coalesce(tokens, F.array().cast("array<string>")), 1, length).alias("t"))
    at = cut.select("doc", F.posexplode("t").alias("pos", "term")).join(_sent(model.table.select("term", "idx"), model.rows), "term", "left")
    ids = at.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col("idx") + 2, F.lit(1)).alias("id")))), lambda x: x["id"]).alias("ids"))
    full = cut.select("doc").join(ids, "doc", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return full.select("doc", F.concat("ids", F.array_repeat(F.lit(0), F.lit(length) - F.size("ids"))).alias("ids"))


@dataclass
class FeatureModel:
    """Everything ``features_of`` needs: word and character vocabularies and the style scaler."""

    words: Vocabulary
    chars: Vocabulary
    scaler: DataFrame


def _blocks(docs: DataFrame, text: str):
    from ..functions.text import clean_text

    clean = docs.withColumn("_clean", clean_text(F.coalesce(F.col(text), F.lit(""))))
    return clean.withColumn("_tokens", T.word_tokens(F.col("_clean")))


def fit_features(train: DataFrame, doc: str, text: str, word_features: int = 3000, char_features: int = 2000) -> FeatureModel:
    """Fits word TF-IDF (1-2 grams, at most 95 % of documents), character TF-IDF (2-4, 98 %) and the style scaler on the training rows."""
    from ..functions.style import COLUMNS, style_features

    clean = _blocks(train, text)
    words = fit_words(clean, doc, T.word_ngrams(F.col("_tokens"), 1, 2), word_features, 2, 0.95)
    chars = fit_chars(clean, doc, "_clean", 2, 4, char_features, 2, 0.98)
    return FeatureModel(words, chars, fit_scaler(style_features(train, text), COLUMNS))


def features_of(docs: DataFrame, doc: str, text: str, model: FeatureModel) -> DataFrame:
    """``(doc, idx, value)`` with the blocks [words | characters | style] at fixed offsets."""
    from ..functions.style import COLUMNS, style_features

    clean = _blocks(docs, text)
    words = token_tf_idf(clean, doc, T.word_ngrams(F.col("_tokens"), 1, 2), model.words)
    chars = char_tf_idf(clean, doc, "_clean", 2, 4, model.chars)
    style = scale(style_features(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))).select("doc", *[F.col(c).cast("double").alias(c) for c in COLUMNS]), COLUMNS, model.scaler)
    long = style.select("doc", F.posexplode(F.array(*COLUMNS)).alias("idx", "value"))
    start = model.words.size
    return words.unionByName(chars.withColumn("idx", F.col("idx") + start)).unionByName(long.withColumn("idx", F.col("idx") + start + model.chars.size))
