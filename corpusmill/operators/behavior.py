"""Twenty-four behavioural measures of a text, as joins and aggregates over its tokens.

``tokens(docs, doc, array)`` gives ``(doc, pos, w)``; the measures of one text need no other text, except the
rank shares, which look word pairs up in a rank table fitted on a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BUZZWORDS, FUNCTION_WORDS, STOP_WORDS
from ..functions.text import count_of, sentences_kept, words


def tokens(docs: DataFrame, doc: str, array: Column) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(array).alias("pos", "w"))


def _entropy(p: Column) -> Column:
    return -F.sum(p * F.log2(p))


def word_measures(docs: DataFrame, doc: str, array: Column, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Entropy, type/token ratio, word length, buzzword, stop-word, function-word and hapax shares by document.

    Documents without tokens give no row.
    """
    c = tokens(docs, doc, array).groupBy("doc", "w").agg(F.count("*").alias("n"))
    isf = F.col("w").isin(*FUNCTION_WORDS)
    whole = Window.partitionBy("doc")
    c = c.withColumn("total", F.sum("n").over(whole)).withColumn("fw", F.sum(F.when(isf, F.col("n")).otherwise(0)).over(whole))
    p, q = F.col("n") / F.col("total"), F.try_divide(F.col("n"), F.col("fw"))
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.first("total")
    return c.groupBy("doc").agg(
        F.first("total").alias("n_tokens"), _entropy(p).alias("entropy"), (F.count("*") / F.first("total")).alias("type_token"),
        (F.sum(F.length("w") * F.col("n")) / F.first("total")).alias("word_length"), share(F.col("w").isin(*BUZZWORDS)).alias("buzz_share"),
        share(F.col("w").isin(*stop_words)).alias("stop_share"), share(F.col("n") == 1).alias("hapax_share"), share(isf).alias("function_share"),
        F.coalesce(-F.sum(F.when(isf, q * F.log2(q))), F.lit(0.0)).alias("function_entropy"))


def bigrams(docs: DataFrame, doc: str, array: Column) -> DataFrame:
    """``(doc, pos, w1, w2)`` of neighbouring tokens, made inside the row."""
    held = docs.select(F.col(doc).alias("doc"), array.alias("a")).where("size(a) > 1")
    n = F.size("a") - 1
    pairs = F.arrays_zip(F.slice("a", 1, n).alias("w1"), F.slice("a", 2, n).alias("w2"))
    return held.select("doc", F.posexplode(pairs).alias("pos", "p")).select("doc", "pos", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))


def bigram_measures(docs: DataFrame, doc: str, array: Column) -> DataFrame:
    """``(doc, bigram_ratio, perplexity)``: distinct over all pairs; add-one bigram perplexity inside the document."""
    b = docs.select(F.col(doc).alias("doc"), array.alias("a")).where(F.size("a") > 1)
    pairs = bigrams(b, "doc", F.col("a")).groupBy("doc", "w1", "w2").agg(F.count("*").alias("n"))
    first = pairs.groupBy("doc", "w1").agg(F.sum("n").alias("as_first"))
    last = b.select("doc", F.element_at("a", -1).alias("w1"), F.lit(1).alias("more"))
    size = b.select("doc", F.size(F.array_distinct("a")).alias("v"))
    full = pairs.join(first, ["doc", "w1"]).join(last, ["doc", "w1"], "left").join(size, "doc")
    p = (F.col("n") + 1) / (F.col("as_first") + F.coalesce("more", F.lit(0)) + F.col("v"))
    return full.groupBy("doc").agg((F.count("*") / F.sum("n")).alias("bigram_ratio"), F.pow(F.lit(2.0), -F.sum(F.col("n") * F.log2(p)) / F.sum("n")).alias("perplexity"))


def trigram_density(docs: DataFrame, text: str, name: str = "trigram_density") -> DataFrame:
    """Adds the share of distinct among all character trigrams, spaces as ``_``; 0 for texts under three characters."""
    held = docs.withColumn("_c", F.split(F.replace(F.col(text), F.lit(" "), F.lit("_")), ""))
    n = F.size("_c") - 2
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.get("_c", i), F.get("_c", i + 1), F.get("_c", i + 2)))
    return held.withColumn(name, F.when(n >= 1, F.size(F.array_distinct(grams)) / n).otherwise(0.0)).drop("_c")


def exclamation_share(text: Column) -> Column:
    """``!``, ``?`` and ``...`` per character; 0 for an empty text."""
    return F.when(F.length(text) > 0, (count_of(text, "!") + count_of(text, "?") + count_of(text, "...")) / F.length(text)).otherwise(0.0)


def repetition_distance(docs: DataFrame, doc: str, array: Column) -> DataFrame:
    """``(doc, repetition_distance)``: mean distance to the same word's previous place; 0 if nothing repeats."""
    t = tokens(docs, doc, array)
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("doc", "w").orderBy("pos"))
    return t.withColumn("gap", gap).groupBy("doc").agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("repetition_distance"))


def rhythm(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, n_sent, burstiness, rhythm_variance, words_per_sentence, length_entropy)`` from sentence lengths in words."""
    s = docs.select(F.col(doc).alias("doc"), F.explode(sentences_kept(F.col(text))).alias("s")).select("doc", F.size(words(F.col("s"))).alias("n"))
    by = s.groupBy("doc", "n").agg(F.count("*").alias("k"))
    whole = Window.partitionBy("doc")
    by = by.withColumn("all", F.sum("k").over(whole)).withColumn("mean", F.sum(F.col("n") * F.col("k")).over(whole) / F.col("all"))
    p = F.col("k") / F.col("all")
    var = F.sum(F.col("k") * (F.col("n") - F.col("mean")) * (F.col("n") - F.col("mean"))) / F.first("all")
    return by.groupBy("doc").agg(F.first("all").alias("n_sent"), F.sqrt(var).alias("burstiness"), var.alias("rhythm_variance"), (F.sum(F.col("n") * F.col("k")) / F.first("all")).alias("words_per_sentence"), _entropy(p).alias("length_entropy"))


def unknown_share(docs: DataFrame, doc: str, array: Column, dictionary: DataFrame) -> DataFrame:
    """``(doc, unknown_share)``: distinct words missing from ``dictionary(w)``, over all words."""
    sized = docs.select(F.col(doc).alias("doc"), F.size(array).alias("n"), F.array_distinct(array).alias("d")).where("n > 0")
    missing = sized.select("doc", F.explode("d").alias("w")).join(dictionary, "w", "left_anti").groupBy("doc").agg(F.count("*").alias("k"))
    return sized.select("doc", "n").join(missing, "doc", "left").select("doc", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("unknown_share"))


def bigram_ranks(docs: DataFrame, doc: str, array: Column) -> DataFrame:
    """``(w1, w2, n, rank)``: followers of each word by frequency, ties by the follower."""
    n = bigrams(docs, doc, array).groupBy("w1", "w2").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("n"), "w2")))


def rank_shares(docs: DataFrame, doc: str, array: Column, ranks: DataFrame) -> DataFrame:
    """``(doc, top10, top100, top1000, rest)``: shares of a text's word pairs by rank; unknown pairs are rest.

    Pairs are counted per document before the lookup, so a pair is looked up once a document.
    """
    pairs = bigrams(docs, doc, array).groupBy("doc", "w1", "w2").agg(F.count("*").alias("n"))
    # ranks beyond the last class need not be made: tasks pass on the first thousand followers of a word
    r = pairs.join(ranks.where("rank <= 1000").select("w1", "w2", "rank"), ["w1", "w2"], "left")
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    k = F.col("rank")
    return r.groupBy("doc").agg(share(k <= 10).alias("top10"), share((k > 10) & (k <= 100)).alias("top100"), share((k > 100) & (k <= 1000)).alias("top1000"), share(k.isNull() | (k > 1000)).alias("rest"))


def tag_by_suffix(w: Column) -> Column:
    """A small stand-in for a part-of-speech tagger: a tag from a word's ending."""
    return (F.when(w.rlike("(ous|ful|ive|able|ible|ic|al|less)$"), "JJ").when(w.rlike("ly$"), "RB").when(w.rlike("(ing|ed|ize|izes|ise)$"), "VB")
            .when(w.isin(*FUNCTION_WORDS), "FW").otherwise("NN"))


def tag_measures(docs: DataFrame, doc: str, array: Column, tagger=tag_by_suffix) -> DataFrame:
    """``(doc, adjective_share, tag_entropy)`` by any tagger given as a column function."""
    c = tokens(docs, doc, array).groupBy("doc", tagger(F.col("w")).alias("tag")).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("doc")))
    p = F.col("n") / F.col("all")
    return c.groupBy("doc").agg((F.sum(F.when(F.col("tag") == "JJ", F.col("n")).otherwise(0)) / F.first("all")).alias("adjective_share"), _entropy(p).alias("tag_entropy"))
