"""Queries that fit and apply vocabularies, TF-IDF, scalers and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X, tokens as T
from ..operators import vectorize as V
from . import base as S
from .base import query

#: The operators' own sizes: words and n-grams of words, character n-grams, sequence ids (two less for padding and unknown).
N_WORDS, N_CHARS, N_SEQUENCE = 5_000, 2_000, 30_000 - 2


def _words(c="text"):
    return T.word_tokens(F.col(c))


def _corpus(read):
    return read("documents").where("text is not null")


_N = "(SELECT count(*) FROM documents WHERE text IS NOT NULL)"


def _occurrences(tokens: str, table: str = "documents", doc: str = "doc_id") -> str:
    return f"SELECT doc, unnest(a) AS term, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT {doc} AS doc, {tokens} AS a FROM {table} WHERE text IS NOT NULL)"


def _vocab(occ: str, most: int, min_df: int, max_df: float) -> str:
    return f"""SELECT term, row_number() OVER (ORDER BY tf DESC, fd, fp) - 1 AS idx, tf, df, ln((1 + {_N}) / (1 + df)) + 1 AS idf FROM (
      SELECT term, sum(n) AS tf, count(*) AS df, min(doc) AS fd, arg_min(pos, doc) AS fp FROM (SELECT doc, term, count(*) AS n, min(pos) AS pos FROM ({occ}) GROUP BY 1, 2) GROUP BY term)
    WHERE df >= {min_df} AND df <= CAST(floor({max_df} * {_N}) AS BIGINT) ORDER BY tf DESC, fd, fp LIMIT {most}"""


_WORD_OCC = _occurrences(S.word_tokens("text"))
_WORD_VOCAB = _vocab(_WORD_OCC, N_WORDS, 2, 0.95)


@query(f"SELECT term, CAST(idx AS INTEGER) AS idx, CAST(tf AS BIGINT) AS tf, df, round(idf, 6) AS idf FROM ({_WORD_VOCAB})")
def word_vocab(read):
    m = V.fit_words(_corpus(read), "doc_id", _words(), N_WORDS)
    return m.table.select("term", "idx", "tf", "df", F.round("idf", 6).alias("idf"))


_CHAR_COUNT = f"SELECT doc, term, sum(k) AS n FROM (SELECT doc, w, k, n AS len, unnest(range(1, length(w) + 4 - n)) AS i, substring(' ' || w || ' ', unnest(range(1, length(w) + 4 - n)), n) AS term FROM (SELECT doc, w, count(*) AS k FROM (SELECT doc_id AS doc, unnest({S.plain_words('text')}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2) JOIN (VALUES (2), (3), (4)) g(n) ON true) GROUP BY 1, 2"
_CHAR_VOCAB = f"""SELECT term, row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, tf, df, ln((1 + {_N}) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(n) AS tf, count(*) AS df FROM ({_CHAR_COUNT}) GROUP BY term)
  WHERE df >= 2 AND df <= CAST(floor(0.98 * {_N}) AS BIGINT) ORDER BY tf DESC, term LIMIT {N_CHARS}"""


@query(f"SELECT term, CAST(idx AS INTEGER) AS idx, CAST(tf AS BIGINT) AS tf, df, round(idf, 6) AS idf FROM ({_CHAR_VOCAB})")
def char_vocab(read):
    m = V.fit_chars(_corpus(read), "doc_id", "text", 2, 4, N_CHARS)
    return m.table.select("term", "idx", "tf", "df", F.round("idf", 6).alias("idf"))


def _counts(occ: str) -> str:
    return f"SELECT doc, term, count(*) AS n FROM ({occ}) GROUP BY 1, 2"


@query(f"SELECT doc, CAST(idx AS INTEGER) AS idx, n FROM ({_counts(_WORD_OCC)}) JOIN ({_WORD_VOCAB}) USING (term)")
def bow_counts(read):
    d = _corpus(read)
    return V.bag_of_words(V.token_counts(d, "doc_id", _words()), V.fit_words(d, "doc_id", _words(), N_WORDS))


def _tfidf(counts: str, vocab: str) -> str:
    return f"""SELECT doc, CAST(idx AS INTEGER) AS idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc)), 6) AS value FROM (SELECT doc, idx, (1 + ln(n)) * idf AS x FROM ({counts}) JOIN ({vocab}) USING (term))"""


def _value(df):
    return df.select("doc", "idx", F.round("value", 6).alias("value"))


_GRAM_OCC = f"""SELECT doc, unnest(a) AS term, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT doc, list_concat(t, list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || ' ' || x[2])) AS a
  FROM (SELECT doc_id AS doc, {S.word_tokens('text')} AS t FROM documents WHERE text IS NOT NULL))"""


@query(_tfidf(_counts(_GRAM_OCC), _vocab(_GRAM_OCC, N_WORDS, 2, 0.95)))
def tfidf_word(read):
    d, grams = _corpus(read).select("doc_id", _words().alias("t")), T.word_ngrams(F.col("t"), 1, 2)
    return _value(V.token_tf_idf(d, "doc_id", grams, V.fit_words(d, "doc_id", grams, N_WORDS)))


@query(_tfidf(_CHAR_COUNT, _CHAR_VOCAB))
def tfidf_char(read):
    d = _corpus(read)
    m = V.fit_chars(d, "doc_id", "text", 2, 4, N_CHARS)
    return _value(V.char_tf_idf(d, "doc_id", "text", 2, 4, m))


_TEST = "(SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at, collected_at NULLS FIRST, text NULLS FIRST, split_name NULLS FIRST) AS rn FROM dataset_test) WHERE rn = 1)"


def first_tests(read):
    from ..operators.tables import first_per_key

    return first_per_key(read("dataset_test"), ["id"], ["loaded_at", "collected_at", "text", "split_name"])


@query(_tfidf(_counts(_occurrences(S.word_tokens("text"), _TEST, "id")), _WORD_VOCAB))
def tfidf_external(read):
    """Fitted on documents, applied to the evaluation texts."""
    m = V.fit_words(_corpus(read), "doc_id", _words(), N_WORDS)
    return _value(V.token_tf_idf(first_tests(read), "id", _words(), m))


_LETTER_OCC = _occurrences(S.letter_tokens("text"))


@query(f"""
WITH c AS ({_counts(_LETTER_OCC)}), v AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS idx, ln((1 + {_N}) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY df DESC, term LIMIT 1500)),
l AS (SELECT doc, sum(n) AS len FROM c GROUP BY 1) SELECT doc, CAST(idx AS INTEGER) AS idx, round(n / len * idf, 6) AS value FROM c JOIN v USING (term) JOIN l USING (doc)""")
def tfidf_relative(read):
    d, t = _corpus(read), T.letter_tokens(F.col("text"))
    return _value(V.relative_tf_idf(d, "doc_id", t, V.fit_relative(d, "doc_id", t)))


_DEFAULT_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)"
_DEFAULT_OCC = _occurrences(_DEFAULT_TOKENS)


@query(f"""
WITH c AS ({_counts(_DEFAULT_OCC)}), v AS (SELECT term, row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, ln((1 + {_N}) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(n) AS tf, count(*) AS df FROM c GROUP BY 1 ORDER BY tf DESC, term LIMIT 3000))
SELECT doc, CAST(idx AS INTEGER) AS idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc)), 6) AS value FROM (SELECT doc, idx, n * idf AS x FROM c JOIN v USING (term))""")
def tfidf_defaults(read):
    """Raw counts, smoothed idf, unit length: the public defaults of common vectorizers."""
    d, t = _corpus(read), T.default_word_tokens(F.col("text"))
    counts = V.token_counts(d, "doc_id", t)
    stats = counts.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    m = V.vocabulary(stats, d.count(), 3000, 1, 1.0, [F.desc("tf"), F.asc("term")])
    return _value(V.token_tf_idf(d, "doc_id", t, m, sublinear=False))


_DIMS = [f"e{i}" for i in range(8)]


@query(f"""
WITH x AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}' for i in range(8))} FROM embeddings),
s AS (SELECT {', '.join(f'avg({c}) AS {c}m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}s' for c in _DIMS)} FROM x)
SELECT vec_id, {', '.join(f'round(({c} - {c}m) / {c}s, 5) AS {c}' for c in _DIMS)} FROM x, s""")
def scaler(read):
    x = read("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    return V.scale(x, _DIMS, V.fit_scaler(x, _DIMS)).select("vec_id", *[F.round(c, 5).alias(c) for c in _DIMS])


_CLASSES = "['Anthropic', 'Google', 'Human', 'Meta', 'OpenAI']"


@query(f"""
WITH l AS (SELECT row_id, {S.canonical_label('label')} AS class FROM dataset)
SELECT row_id, array_to_string(list_transform({_CLASSES}, lambda c: CASE WHEN class = c THEN '1' ELSE '0' END), ',') AS onehot, CAST(nullif(list_position({_CLASSES}, class), 0) - 1 AS BIGINT) AS class_index FROM l""")
def label_codes(read):
    l = read("dataset").select("row_id", X.canonical_label(F.col("label")).alias("class"))
    classes = V.fit_classes(l, "class")
    hot = F.array_join(F.transform(V.one_hot(F.col("class"), classes), lambda x: x.cast("int").cast("string")), ",")
    return l.select("row_id", hot.alias("onehot"), V.label_index(F.col("class"), classes).cast("bigint").alias("class_index"))


_SEQ = S.word_tokens("text", stop=False)
_SEQ_OCC = _occurrences(_SEQ)


@query(f"""
WITH v AS ({_vocab(_SEQ_OCC, N_SEQUENCE, 1, 1.0)}), t AS (SELECT id, coalesce({_SEQ}, []) AS a FROM {_TEST}),
o AS (SELECT id, unnest(a[:150]) AS term, unnest(range(1, least(len(a), 150) + 1)) AS i FROM t), k AS (SELECT id, string_agg(CAST(coalesce(idx + 2, 1) AS VARCHAR), ',' ORDER BY i) AS s FROM o LEFT JOIN v USING (term) GROUP BY id)
SELECT t.id AS doc, concat(coalesce(s, ''), CASE WHEN len(a) > 0 AND len(a) < 150 THEN ',' ELSE '' END, array_to_string(list_transform(range(greatest(150 - len(a), 0)), lambda x: '0'), ',')) AS ids FROM t LEFT JOIN k USING (id)""")
def seq_ids(read):
    d, t = _corpus(read), T.sequence_tokens(F.col("text"))
    m = V.fit_words(d, "doc_id", t, N_SEQUENCE, 1, 1.0)
    ids = V.sequence_ids(first_tests(read), "id", t, m)
    return ids.select("doc", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""
WITH v AS ({_vocab(_SEQ_OCC, N_SEQUENCE, 1, 1.0)}), n AS (SELECT count(*) AS n FROM embeddings), t AS ({_counts(_occurrences(_SEQ, _TEST, 'id'))}),
k AS (SELECT doc, n.n, v.idx, t.n AS c FROM t JOIN v USING (term), n), x AS (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT doc, dim, round(sum(c * CAST(e AS DOUBLE)) / sum(c), 4) + 0.0 AS value FROM k JOIN x ON x.vec_id = k.idx % k.n GROUP BY 1, 2""")
def pooled_vectors(read):
    """Mean of the pretrained vectors of a text's known tokens; each token is looked up once per text."""
    d, t = _corpus(read), T.sequence_tokens(F.col("text"))
    m = V.fit_words(d, "doc_id", t, N_SEQUENCE, 1, 1.0)
    e = read("embeddings")
    n = e.count()
    counts = m.joined(V.token_counts(first_tests(read), "id", t)).select("doc", (F.col("idx") % n).alias("vec_id"), "n")
    long = counts.join(e.select("vec_id", "embedding"), "vec_id").select("doc", "n", F.posexplode("embedding").alias("dim", "e"))
    return long.groupBy("doc", F.col("dim").cast("bigint").alias("dim")).agg((F.round(F.sum(F.col("n") * F.col("e").cast("double")) / F.sum("n"), 4) + 0.0).alias("value"))


@query(f"""
WITH l AS (SELECT {S.canonical_label('label')} AS class, unnest({S.word_tokens('text')}) AS term, doc_id FROM documents WHERE text IS NOT NULL AND {S.canonical_label('label')} IS NOT NULL),
c AS (SELECT class, term, count(*) AS n FROM l GROUP BY 1, 2), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM l GROUP BY 1),
s AS (SELECT class, term, round((1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL AND {S.canonical_label('label')} IS NOT NULL)) / (1 + df)) + 1), 6) AS score FROM c JOIN d USING (term))
SELECT class, term, score, CAST(row_number() OVER (PARTITION BY class ORDER BY score DESC, term) AS INTEGER) AS place FROM s QUALIFY place <= 20""")
def top_terms_by_label(read):
    """The 20 terms of each class with the highest TF-IDF of the class's texts taken together."""
    from pyspark.sql import Window

    l = _corpus(read).withColumn("class", X.canonical_label(F.col("label"))).where("class is not null")
    n_docs = l.count()
    per_doc = l.select("doc_id", "class", F.explode(_words()).alias("term")).groupBy("doc_id", "class", "term").agg(F.count("*").alias("k"))
    per_class = per_doc.groupBy("class", "term").agg(F.sum("k").alias("n"), F.count("*").alias("d"))
    df = per_class.groupBy("term").agg(F.sum("d").alias("df"))
    s = per_class.join(df, "term").select("class", "term", F.round((1 + F.log("n")) * V.smooth_idf(F.col("df"), n_docs), 6).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "term"))).where("place <= 20")


def feature_rows(read):
    """[word | character | style] features fitted on the training part of the stratified split, for the test part."""
    from ..operators.sampling import stratified_split

    d = read("dataset").where("text is not null").select("row_id", "text", X.canonical_label(F.col("label")).alias("class"))
    s = stratified_split(d, "row_id", "class")
    m = V.fit_features(s.where("part = 'train'"), "row_id", "text")
    return _value(V.features_of(s.where("part = 'test'"), "row_id", "text", m))


query()(feature_rows)
