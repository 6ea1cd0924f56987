"""Thirteen stylistic measures of a raw text, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import count_of, sentences, words

COLUMNS = ["n_chars", "n_words", "word_len_mean", "word_len_std", "type_token", "n_sentences", "sent_len_mean", "sent_len_std", "punct_share", "digit_share", "upper_share", "commas_per_word", "stops_per_sentence"]


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def _std(a: Column, mean: Column) -> Column:
    square = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(F.size(a) > 1, F.sqrt(square / F.size(a))).otherwise(0.0)


def style_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of ``COLUMNS``; a null text counts as empty.

    Words are runs of non-space characters, sentences the non-empty parts between ``. ! ?``; characters, words
    and sentences count at least 1 where they divide.  Deviations are those of the population.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = df.withColumn("_w", words(t)).withColumn("_s", sentences(t))
    a = a.withColumn("_wl", F.transform("_w", lambda w: F.length(w).cast("double"))).withColumn("_sl", F.transform("_s", lambda s: F.size(words(s)).cast("double")))
    a = a.withColumn("n_chars", F.greatest(F.length(t), F.lit(1))).withColumn("n_words", F.greatest(F.size("_w"), F.lit(1))).withColumn("n_sentences", F.greatest(F.size("_s"), F.lit(1)))
    a = a.withColumn("word_len_mean", _mean(F.col("_wl"))).withColumn("sent_len_mean", _mean(F.col("_sl")))
    a = a.withColumns({
        "word_len_std": _std(F.col("_wl"), F.col("word_len_mean")),
        "type_token": F.size(F.array_distinct("_w")) / F.col("n_words"),
        "sent_len_std": _std(F.col("_sl"), F.col("sent_len_mean")),
        "punct_share": F.regexp_count(t, F.lit("[.,;:!?-]")) / F.col("n_chars"),
        "digit_share": F.regexp_count(t, F.lit(r"\p{Nd}")) / F.col("n_chars"),
        "upper_share": F.regexp_count(t, F.lit(r"\p{Lu}")) / F.col("n_chars"),
        "commas_per_word": count_of(t, ",") / F.col("n_words"),
        "stops_per_sentence": count_of(t, ".") / F.col("n_sentences"),
    })
    return a.select(*df.columns, *COLUMNS)
