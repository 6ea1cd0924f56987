"""Tokenisers and n-grams as column expressions over a text column; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import STOP_WORDS
from .text import WS, sentences_kept, words


def _plain_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def word_tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case ``[a-z0-9]`` words of two letters on without stop words (default list; ``[]`` for none)."""
    stop = STOP_WORDS if stop_words is None else list(stop_words)
    kept = F.filter(_plain_words(c), lambda w: F.length(w) > 1)
    return F.filter(kept, lambda w: ~w.isin(*stop)) if stop else kept


def sequence_tokens(c: Column) -> Column:
    """As ``word_tokens`` without stop words."""
    return word_tokens(c, [])


def letter_tokens(c: Column) -> Column:
    """Lower-case words made of ``a-z`` alone that stand between non-word characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]+$"))


raw_tokens = words

# The public rules of treebank tokenising, in order; ``\\1`` and ``\\2`` are groups.
TREEBANK = [
    (r'^"', "``"), (r"(``)", r" \1 "), (r"""([ (\[{<])("|'')""", r"\1 `` "),
    (r"([:,])([^0-9])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", r" \1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", r"\1 \2\3 "), (r"([?!])", r" \1 "), (r"([^'])' ", r"\1 ' "),
    (r"([\]\[(){}<>])", r" \1 "), (r"--", " -- "), (r"''", " '' "), (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"(?i)\b(can)(not)\b", r" \1 \2 "), (r"(?i)\b(d)('ye)\b", r" \1 \2 "), (r"(?i)\b(gim)(me)\b", r" \1 \2 "), (r"(?i)\b(gon)(na)\b", r" \1 \2 "), (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(lem)(me)\b", r" \1 \2 "), (r"(?i)\b(more)('n)\b", r" \1 \2 "), (r"(?i) ('t)(is)\b", r" \1 \2 "), (r"(?i) ('t)(was)\b", r" \1 \2 "), (r"(?i)\b(wan)(na)\b", r" \1 \2 "),
]


def treebank_tokens(c: Column) -> Column:
    """Treebank tokens of one sentence, as they stand; ends are padded, so that a mark at the end is one at a space."""
    for pattern, by in TREEBANK:
        if pattern in ("''",):
            c = F.concat(F.lit(" "), c, F.lit(" "))
        c = F.regexp_replace(c, pattern, by.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def alphabetic_tokens(c: Column) -> Column:
    """Lower-case treebank tokens made of letters only, sentence by sentence (cut at white space after ``. ! ?``)."""
    tokens = F.flatten(F.transform(sentences_kept(c), treebank_tokens))
    return F.filter(F.transform(tokens, F.lower), lambda w: w.rlike(r"^\p{L}+$"))


def default_word_tokens(c: Column) -> Column:
    """Lower-case runs of two word characters on (the public default of TF-IDF vectorizers)."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """n-grams of ``low`` to ``high`` tokens joined by spaces, by n, then position.

    ``tokens`` should be a column of the input (not an expression, which would be evaluated for every n-gram).
    """
    def grams(n):
        if n == 1:
            return tokens
        last = F.size(tokens) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.concat(*[grams(n) for n in range(low, high + 1)])


def char_ngrams_of_word(word: Column, low: int, high: int) -> Column:
    """n-grams of ``low`` to ``high`` characters of a word with a space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def grams(n):
        last = F.length(padded) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(padded, i, F.lit(n)))
    return F.concat(*[grams(n) for n in range(low, high + 1)])


def char_words(c: Column) -> Column:
    """The words whose characters make the n-grams: lower-case ``[a-z0-9]`` words of any length."""
    return _plain_words(c)


__all__ = ["WS", "word_tokens", "sequence_tokens", "letter_tokens", "raw_tokens", "treebank_tokens", "alphabetic_tokens", "default_word_tokens", "word_ngrams", "char_ngrams_of_word", "char_words"]
