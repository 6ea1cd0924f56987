"""Queries over single texts: cleaning, sentences, tokens, style and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style, text as X, tokens as T
from ..functions.fixed import BUZZWORDS, FUNCTION_WORDS, STOP_WORDS
from ..operators import behavior as B
from . import base as S
from .base import query


@query(f"SELECT doc_id, {S.clean('text')} AS clean FROM documents")
def clean_text(read):
    return read("documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {S.passage('text', S.PASSAGE)} AS passage FROM documents")
def clean_passage(read):
    return read("documents").select("doc_id", X.clean_passage(F.col("text")).alias("passage"))


@query(f"SELECT row_id, {S.passage('text', S.GENERATED)} AS passage FROM dataset")
def clean_generated(read):
    return read("dataset").select("row_id", X.clean_generated(F.col("text")).alias("passage"))


_SAFE = S.sub("translate(" + S.strip(S.sub("text", S.UUID)) + ", ';', ',')", f"{S.WS}+", " ")


@query(f"SELECT row_id, {_SAFE} AS safe FROM dataset")
def sink_safe(read):
    return read("dataset").select("row_id", X.sink_safe(F.col("text")).alias("safe"))


_SENT = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {S.strip('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({_SENT}) AS BIGINT) AS n, array_to_string({_SENT}, '|') AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_split(read):
    s = X.sentences(F.col("text"))
    return read("documents").where("text is not null").select("doc_id", F.size(s).cast("bigint").alias("n"), F.array_join(s, "|").alias("sentences"))


_KEPT = f"list_filter(string_split({S.sub(S.strip('text'), f'([.!?]){S.WS}+', chr(92) + '1' + chr(1))}, chr(1)), lambda s: s <> '')"


@query(f"""
WITH d AS (SELECT doc_id, {_KEPT} AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, s, len({S.words('s')}) AS n FROM (SELECT doc_id, unnest(a) AS s, unnest(range(1, len(a) + 1)) AS i FROM d)),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM s)
SELECT d.doc_id, coalesce(string_agg(r.s, ' ' ORDER BY r.i), '') AS passage FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r.total <= 120 GROUP BY d.doc_id""")
def truncate_sentences(read):
    return read("documents").where("text is not null").select("doc_id", X.truncate_sentences(F.col("text")).alias("passage"))


@query(f"SELECT id, model, submitted_at, label, {S.answer_label('label')} AS answer FROM submissions")
def answer_labels(read):
    return read("submissions").select("id", "model", "submitted_at", "label", X.answer_label(F.col("label")).alias("answer"))


@query(f"""SELECT row_id, {S.canonical_label('label')} AS label FROM dataset""")
def canonical_labels(read):
    return read("dataset").select("row_id", X.canonical_label(F.col("label")).alias("label"))


_TRACE = "concat('is it ', lower(model), chr(10), 'Answer: ', label, chr(10), 'so I stop')"


@query(f"""
WITH t AS (SELECT id, model, submitted_at, label, {_TRACE} AS trace FROM submissions WHERE label IS NOT NULL),
l AS (SELECT id, model, submitted_at, label, i, lower({S.strip('line')}) AS line FROM (SELECT *, unnest(string_split(trace, chr(10))) AS line, unnest(range(1, len(string_split(trace, chr(10))) + 1)) AS i FROM t)),
m AS (SELECT l.*, v.k, v.v FROM l JOIN (VALUES (1, 'Anthropic'), (2, 'Google'), (3, 'Human'), (4, 'Meta'), (5, 'OpenAI')) v(k, v)
  ON line = lower(v) OR contains(line, 'category: ' || lower(v)) OR contains(line, 'answer: ' || lower(v)) OR contains(line, 'is ' || lower(v)))
SELECT t.id, t.model, t.submitted_at, t.label, max_by(m.v, 10 * m.i + m.k) AS last_named FROM t LEFT JOIN m USING (id, model, submitted_at, label) GROUP BY ALL""")
def trace_labels(read):
    t = read("submissions").where("label is not null").withColumn("trace", F.concat(F.lit("is it "), F.lower("model"), F.lit("\nAnswer: "), "label", F.lit("\nso I stop")))
    return t.select("id", "model", "submitted_at", "label", X.trace_label(F.col("trace")).alias("last_named")).distinct()


@query("""
WITH f AS (SELECT id, model, submitted_at, 0 AS k, '' AS content FROM submissions WHERE label IS NULL UNION ALL
           SELECT id, model, submitted_at, 1, label FROM submissions WHERE label IS NOT NULL)
SELECT id, string_agg(content, '' ORDER BY submitted_at, model, content) AS answer FROM f WHERE trim(content) <> '' GROUP BY id""")
def stream_assembly(read):
    """Streamed JSON lines (control lines, nested and flat contents) put together to one answer per id."""
    s = read("submissions").select("id", "model", "submitted_at", "label")
    flat = F.to_json(F.struct(F.lit("delta").alias("type"), F.col("label").alias("content")))
    nested = F.to_json(F.struct(F.lit("delta").alias("type"), F.struct(F.col("label").alias("text")).alias("content")))
    start = F.to_json(F.struct(F.lit("start").alias("type"), F.lit("ignored").alias("content")))
    lines = s.withColumn("line", F.explode(F.array(start, F.when(F.col("model").endswith("a"), flat).otherwise(nested))))
    said = lines.withColumn("content", X.fragment_text(F.col("line"))).where("trim(content) <> ''")
    return said.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("submitted_at", "model", "content"))), lambda x: x["content"]), "").alias("answer"))


@query("SELECT id, model, submitted_at, coalesce(contains(label, '429') OR contains(lower(label), 'rate'), false) AS limited FROM submissions")
def rate_limits(read):
    return read("submissions").select("id", "model", "submitted_at", X.rate_limited(F.col("label")).alias("limited"))


_W, _SL = S.words("t"), f"list_transform(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda s: {S.strip('s')}), lambda s: s <> ''), lambda s: len({S.words('s')}))"
STYLE_SQL = f"""
WITH a AS (SELECT doc_id, label, t, w, list_transform(w, lambda x: length(x)) AS wl, sl FROM (SELECT doc_id, label, t, {_W} AS w, {_SL} AS sl FROM (SELECT doc_id, label, coalesce(text, '') AS t FROM documents))),
b AS (SELECT *, greatest(length(t), 1) AS nc, greatest(len(w), 1) AS nw, greatest(len(sl), 1) AS ns FROM a)
SELECT doc_id, label, nc AS n_chars, nw AS n_words, round(coalesce(list_avg(wl), 0), 6) AS word_len_mean, round(coalesce(list_stddev_pop(wl), 0), 6) AS word_len_std,
  round(len(list_distinct(w)) / nw, 6) AS type_token, ns AS n_sentences, round(coalesce(list_avg(sl), 0), 6) AS sent_len_mean, round(coalesce(list_stddev_pop(sl), 0), 6) AS sent_len_std,
  round(len(regexp_extract_all(t, '[.,;:!?-]')) / nc, 6) AS punct_share, round(len(regexp_extract_all(t, '\\p{{Nd}}')) / nc, 6) AS digit_share, round(len(regexp_extract_all(t, '\\p{{Lu}}')) / nc, 6) AS upper_share,
  round((length(t) - length(replace(t, ',', ''))) / nw, 6) AS commas_per_word, round((length(t) - length(replace(t, '.', ''))) / ns, 6) AS stops_per_sentence FROM b"""
STYLE_SQL = STYLE_SQL.replace("list_stddev_pop(", "list_aggregate(").replace("list_aggregate(wl)", "list_aggregate(wl, 'stddev_pop')").replace("list_aggregate(sl)", "list_aggregate(sl, 'stddev_pop')")


def rounded_style(df):
    s = style.style_features(df)
    return s.select(*[c if c in ("n_chars", "n_words", "n_sentences") or c not in style.COLUMNS else F.round(c, 6).alias(c) for c in s.columns])


_STYLE_CASTS = STYLE_SQL.replace("nc AS n_chars", "CAST(nc AS INTEGER) AS n_chars").replace("nw AS n_words", "CAST(nw AS INTEGER) AS n_words").replace("ns AS n_sentences", "CAST(ns AS INTEGER) AS n_sentences")


@query(f"SELECT * EXCLUDE (label) FROM ({_STYLE_CASTS})")
def style_features(read):
    return rounded_style(read("documents").select("doc_id", "text")).drop("text")


@query(f"""
WITH s AS ({_STYLE_CASTS}), g AS (SELECT {S.canonical_label('label')} AS class, {', '.join(f'avg({c}) AS {c}' for c in style.COLUMNS)} FROM s GROUP BY 1)
SELECT class, {', '.join(f'round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 4) AS {c}' for c in style.COLUMNS)} FROM g""")
def class_fingerprint(read):
    """Mean style of each class, scaled to 0..1 over the classes."""
    from ..operators.tables import min_max

    s = rounded_style(read("documents").select("doc_id", "label", "text"))
    g = s.groupBy(X.canonical_label(F.col("label")).alias("class")).agg(*[F.avg(c).alias(c) for c in style.COLUMNS])
    return min_max(g, style.COLUMNS).select("class", *[F.round(c, 4).alias(c) for c in style.COLUMNS])


_TOKENS = f"SELECT doc_id AS doc, unnest(a) AS w, unnest(range(len(a))) AS pos, len(a) AS total FROM (SELECT doc_id, {S.letter_tokens('text')} AS a FROM documents WHERE text IS NOT NULL)"


def _letters():
    return T.letter_tokens(F.col("text"))


def _share(cond: str) -> str:
    return f"round(sum(CASE WHEN {cond} THEN n ELSE 0 END) / first(total), 6)"


_IN = lambda words: f"w IN ({S.quoted(words)})"


@query(f"""
WITH t AS ({_TOKENS}), c AS (SELECT doc, w, count(*) AS n, first(total) AS total FROM t GROUP BY 1, 2),
f AS (SELECT doc, sum(n) AS fw FROM c WHERE {_IN(FUNCTION_WORDS)} GROUP BY 1)
SELECT c.doc, CAST(first(total) AS BIGINT) AS n_tokens, abs(round(-sum(n / total * log2(n / total)), 6)) AS entropy, round(count(*) / first(total), 6) AS type_token,
  round(sum(length(w) * n) / first(total), 6) AS word_length, {_share(_IN(BUZZWORDS))} AS buzz_share, {_share(_IN(STOP_WORDS))} AS stop_share,
  {_share('n = 1')} AS hapax_share, {_share(_IN(FUNCTION_WORDS))} AS function_share,
  abs(round(coalesce(-sum(CASE WHEN {_IN(FUNCTION_WORDS)} THEN n / fw * log2(n / fw) END), 0), 6)) AS function_entropy
FROM c LEFT JOIN f USING (doc) GROUP BY c.doc""")
def word_measures(read):
    m = B.word_measures(read("documents"), "doc_id", _letters())
    return m.select("doc", "n_tokens", *[F.abs(F.round(c, 6)).alias(c) for c in m.columns[2:]])


_BIGRAMS = f"SELECT doc, pos, w AS w1, lead(w) OVER (PARTITION BY doc ORDER BY pos) AS w2 FROM ({_TOKENS})"


@query(f"""
WITH b AS (SELECT * FROM ({_BIGRAMS}) WHERE w2 IS NOT NULL), u AS (SELECT doc, w AS w1, count(*) AS c1 FROM ({_TOKENS}) GROUP BY 1, 2),
v AS (SELECT doc, count(*) AS v FROM u GROUP BY 1), c AS (SELECT doc, w1, w2, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT doc, round(count(*) / sum(n), 6) AS bigram_ratio, round(pow(2, -sum(n * log2((n + 1) / (c1 + v))) / sum(n)), 4) AS perplexity FROM c JOIN u USING (doc, w1) JOIN v USING (doc) GROUP BY doc""")
def bigram_measures(read):
    m = B.bigram_measures(read("documents"), "doc_id", _letters())
    return m.select("doc", F.round("bigram_ratio", 6).alias("bigram_ratio"), F.round("perplexity", 4).alias("perplexity"))


@query("""
WITH d AS (SELECT doc_id, string_split(replace(text, ' ', '_'), '') AS c, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(c) AS c0, unnest(range(len(c))) AS i FROM d),
g AS (SELECT doc_id, c0, lead(c0, 1) OVER w AS c1, lead(c0, 2) OVER w AS c2 FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, count(DISTINCT c0 || c1 || c2) / count(*) AS density FROM g WHERE c2 IS NOT NULL GROUP BY doc_id)
SELECT doc_id, round(coalesce(density, 0), 6) AS trigram_density,
  round(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, '!', '')) + length(text) - length(replace(text, '?', '')) + (length(text) - length(replace(text, '...', ''))) / 3) / length(text) ELSE 0 END, 6) AS exclamation_share FROM d LEFT JOIN k USING (doc_id)""")
def character_measures(read):
    d = B.trigram_density(read("documents").where("text is not null").select("doc_id", "text"), "text")
    return d.select("doc_id", F.round("trigram_density", 6).alias("trigram_density"), F.round(B.exclamation_share(F.col("text")), 6).alias("exclamation_share"))


@query(f"""
WITH g AS (SELECT doc, pos - lag(pos) OVER (PARTITION BY doc, w ORDER BY pos) AS gap FROM ({_TOKENS}))
SELECT doc, round(coalesce(avg(gap), 0), 6) AS repetition_distance FROM g GROUP BY doc""")
def repetition_distance(read):
    return B.repetition_distance(read("documents"), "doc_id", _letters()).select("doc", F.round("repetition_distance", 6).alias("repetition_distance"))


@query(f"""
WITH d AS (SELECT doc_id AS doc, unnest({_KEPT}) AS s FROM documents WHERE text IS NOT NULL), n AS (SELECT doc, len({S.words('s')}) AS n FROM d),
c AS (SELECT doc, n, count(*) AS k FROM n GROUP BY 1, 2), t AS (SELECT doc, sum(k) AS total FROM c GROUP BY 1),
m AS (SELECT doc, count(*) AS n_sent, stddev_pop(n) AS sd, var_pop(n) AS va, avg(n) AS me FROM n GROUP BY 1)
SELECT m.doc, CAST(first(n_sent) AS BIGINT) AS n_sent, round(first(sd), 8) AS burstiness, round(first(va), 8) AS rhythm_variance, round(first(me), 8) AS words_per_sentence, abs(round(-sum(k / total * log2(k / total)), 8)) AS length_entropy
FROM m JOIN c USING (doc) JOIN t USING (doc) GROUP BY m.doc""")
def sentence_rhythm(read):
    m = B.rhythm(read("documents"), "doc_id", "text")
    return m.select("doc", "n_sent", *[F.abs(F.round(c, 8)).alias(c) for c in m.columns[2:]])


@query(f"""
WITH dict AS (SELECT DISTINCT unnest({S.letter_tokens('text')}) AS w FROM dataset WHERE text IS NOT NULL),
d AS (SELECT doc_id AS doc, {S.letter_tokens('text')} AS a FROM documents WHERE text IS NOT NULL), u AS (SELECT doc, len(a) AS n, unnest(list_distinct(a)) AS w FROM d)
SELECT doc, round(count(*) FILTER (WHERE dict.w IS NULL) / first(n), 6) AS unknown_share FROM u LEFT JOIN dict USING (w) GROUP BY doc""")
def unknown_words(read):
    dictionary = read("dataset").select(F.explode(_letters()).alias("w")).distinct()
    return B.unknown_share(read("documents"), "doc_id", _letters(), dictionary).select("doc", F.round("unknown_share", 6).alias("unknown_share"))


_RANKS = f"SELECT w1, w2, count(*) AS n, row_number() OVER (PARTITION BY w1 ORDER BY count(*) DESC, w2) AS rank FROM ({_BIGRAMS}) WHERE w2 IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT w1, w2, n, CAST(rank AS INTEGER) AS rank FROM ({_RANKS})")
def bigram_ranks(read):
    return B.bigram_ranks(read("documents"), "doc_id", _letters())


@query(f"""
WITH r AS ({_RANKS}), b AS (SELECT * FROM ({_BIGRAMS}) WHERE w2 IS NOT NULL)
SELECT doc, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS top10, round(avg(CASE WHEN rank > 10 AND rank <= 100 THEN 1 ELSE 0 END), 6) AS top100,
  round(avg(CASE WHEN rank > 100 AND rank <= 1000 THEN 1 ELSE 0 END), 6) AS top1000, round(avg(CASE WHEN rank IS NULL OR rank > 1000 THEN 1 ELSE 0 END), 6) AS rest FROM b LEFT JOIN r USING (w1, w2) GROUP BY doc""")
def rank_shares(read):
    d = read("documents")
    m = B.rank_shares(d, "doc_id", _letters(), B.bigram_ranks(d, "doc_id", _letters()))
    return m.select("doc", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


_TAG = f"""CASE WHEN regexp_matches(w, '(ous|ful|ive|able|ible|ic|al|less)$') THEN 'JJ' WHEN regexp_matches(w, 'ly$') THEN 'RB' WHEN regexp_matches(w, '(ing|ed|ize|izes|ise)$') THEN 'VB' WHEN {_IN(FUNCTION_WORDS)} THEN 'FW' ELSE 'NN' END"""


@query(f"""
WITH c AS (SELECT doc, {_TAG} AS tag, count(*) AS n, first(total) AS total FROM ({_TOKENS}) GROUP BY 1, 2)
SELECT doc, round(sum(CASE WHEN tag = 'JJ' THEN n ELSE 0 END) / first(total), 6) AS adjective_share, abs(round(-sum(n / total * log2(n / total)), 6)) AS tag_entropy FROM c GROUP BY doc""")
def tag_measures(read):
    m = B.tag_measures(read("documents"), "doc_id", _letters())
    return m.select("doc", *[F.abs(F.round(c, 6)).alias(c) for c in m.columns[1:]])
