"""Queries of corpus assembly: scans, filters, joins, splits, sampling, counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed import MAX_WORDS, MIN_WORDS
from ..operators import sampling as P
from ..operators import tables as R
from . import base as S
from .base import query
from .features import _TEST, first_tests

_NW = f"len({S.words('text')})"
_LAB = S.canonical_label("label")


def _labelled(read):
    return read("dataset").select("row_id", "source", "termo", "text", X.canonical_label(F.col("label")).alias("class"))


@query(f"SELECT doc_id, CAST({_NW} AS INTEGER) AS n_words FROM documents WHERE {_NW} BETWEEN 80 AND 120")
def word_count_window(read):
    return read("documents").select("doc_id", X.word_count(F.col("text")).alias("n_words")).where(F.col("n_words").between(MIN_WORDS, MAX_WORDS))


@query(f"SELECT {_LAB} AS class, count(*) AS n FROM dataset GROUP BY 1")
def class_distribution(read):
    return _labelled(read).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, min_by(label, row_id) AS first_label FROM dataset WHERE source IS NOT NULL AND label IS NOT NULL GROUP BY source")
def source_inventory(read):
    return read("dataset").where("source is not null and label is not null").groupBy("source").agg(F.count("*").alias("n"), F.min_by("label", "row_id").alias("first_label"))


@query("SELECT row_id, source FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) AS rn FROM dataset) WHERE rn <= 500")
def head_per_source(read):
    w = Window.partitionBy("source").orderBy("row_id")
    return read("dataset").select("row_id", "source", F.row_number().over(w).alias("rn")).where("rn <= 500").drop("rn")


@query("SELECT count(*) AS n, count(text) AS with_text, count(DISTINCT source) AS sources FROM dataset")
def row_counts(read):
    return read("dataset").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.countDistinct("source").alias("sources"))


@query("SELECT row_id FROM dataset WHERE id IS NOT NULL AND termo IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL AND source IS NOT NULL AND collected_at IS NOT NULL AND loaded_at IS NOT NULL")
def complete_rows(read):
    return read("dataset").na.drop().select("row_id")


@query(f"SELECT row_id, {_LAB} AS class FROM dataset WHERE {_LAB} <> 'Human'")
def generated_rows(read):
    return _labelled(read).where("class <> 'Human'").select("row_id", "class")


@query(f"SELECT id, model, submitted_at, coalesce({S.answer_label('label')}, 'Human') AS answer FROM submissions")
def default_answers(read):
    return read("submissions").select("id", "model", "submitted_at", F.coalesce(X.answer_label(F.col("label")), F.lit("Human")).alias("answer"))


@query("SELECT doc_id, substring(text, 1, 400) AS preview, length(text) AS n FROM documents")
def previews(read):
    return read("documents").select("doc_id", F.substring("text", 1, 400).alias("preview"), F.length("text").cast("bigint").alias("n"))


@query(f"SELECT row_id, concat('D1-', row_number() OVER (ORDER BY {S.seeded('row_id')}, row_id)) AS new_id FROM dataset")
def sequential_ids(read):
    return R.with_sequential_ids(read("dataset").select("row_id"), "row_id", "D1").select("row_id", "new_id")


@query("SELECT source, split_part(source, '_', -1) AS base, CAST(len(string_split(source, '_')) AS INTEGER) AS parts FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def source_names(read):
    s = read("documents").where("source is not null").select("source").distinct()
    return s.select("source", F.element_at(F.split("source", "_"), -1).alias("base"), F.size(F.split("source", "_")).alias("parts"))


@query("SELECT id, split_name, loaded_at FROM dataset_test t WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.id = t.id)")
def pending_ids(read):
    return R.pending(read("dataset_test").select("id", "split_name", "loaded_at"), read("submissions"), "id")


@query("SELECT DISTINCT id FROM dataset_test t WHERE EXISTS (SELECT 1 FROM submissions s WHERE s.id = t.id)")
def answered_tests(read):
    return read("dataset_test").join(read("submissions").select("id"), "id", "left_semi").select("id").distinct()


_TERM = S.strip("term")


@query(f"""
WITH l AS (SELECT {_TERM} AS term, min(line_no) AS ord FROM term_list WHERE list_name = 'list' AND {_TERM} <> '' GROUP BY 1), f AS (SELECT DISTINCT {_TERM} AS term FROM term_list WHERE list_name = 'fail' AND {_TERM} <> '')
SELECT term, ord FROM l WHERE term NOT IN (SELECT term FROM f)""")
def term_maintenance(read):
    """Listed terms, each once in its first place, without those on the failure list."""
    t = read("term_list").select("line_no", "list_name", X.strip(F.col("term")).alias("term")).where("term <> ''")
    listed = t.where("list_name = 'list'").groupBy("term").agg(F.min("line_no").alias("ord"))
    return R.pending(listed, t.where("list_name = 'fail'"), "term").select("term", "ord")


@query(f"""
WITH l AS (SELECT {_TERM} AS term, min(line_no) AS ord FROM term_list WHERE list_name = 'list' AND {_TERM} <> '' GROUP BY 1)
SELECT term, ord FROM l WHERE NOT EXISTS (SELECT 1 FROM dataset d WHERE {S.strip('d.termo')} = l.term) ORDER BY ord LIMIT 200""")
def next_terms(read):
    """The first 200 listed terms that no record uses yet (the size of one work order)."""
    t = read("term_list").where("list_name = 'list'").select("line_no", X.strip(F.col("term")).alias("term")).where("term <> ''").groupBy("term").agg(F.min("line_no").alias("ord"))
    used = read("dataset").select(X.strip(F.col("termo")).alias("term"))
    return R.pending(t, used, "term").orderBy("ord").limit(200).select("term", "ord")


@query(f"""
WITH l AS (SELECT {_TERM} AS term, min(line_no) AS ord FROM term_list WHERE {_TERM} <> '' GROUP BY 1)
SELECT row_id, coalesce(ord, 999999999) AS ord FROM dataset d LEFT JOIN l ON {S.strip('d.termo')} = l.term""")
def term_order(read):
    """Rows with the place of their term in another table's order; unlisted terms go last."""
    t = read("term_list").select("line_no", X.strip(F.col("term")).alias("term")).where("term <> ''").groupBy("term").agg(F.min("line_no").alias("ord"))
    return read("dataset").select("row_id", X.strip(F.col("termo")).alias("term")).join(t, "term", "left").select("row_id", F.coalesce("ord", F.lit(999999999)).alias("ord"))


@query("""
WITH s AS (SELECT DISTINCT source, CASE WHEN starts_with(source, 'human') THEN 'human' ELSE split_part(source, '_', 1) END AS maker FROM dataset WHERE source IS NOT NULL)
SELECT h.source AS human, o.source AS opn, g.source AS ggl, a.source AS ant, m.source AS mta, concat_ws(' + ', h.source, o.source, g.source, a.source, m.source) AS combo
FROM s h, s o, s g, s a, s m WHERE h.maker = 'human' AND o.maker = 'opn' AND g.maker = 'ggl' AND a.maker = 'ant' AND m.maker = 'mta'""")
def source_combinations(read):
    maker = F.when(F.col("source").startswith("human"), "human").otherwise(F.split("source", "_")[0])
    s = read("dataset").where("source is not null").select("source", maker.alias("maker")).distinct()
    return R.combinations(s, "maker", "source", ["human", "opn", "ggl", "ant", "mta"])


@query("""
WITH s AS (SELECT DISTINCT source, CASE WHEN starts_with(source, 'human') THEN 'human' ELSE split_part(source, '_', 1) END AS maker FROM dataset WHERE source IS NOT NULL),
n AS (SELECT source, count(*) AS n FROM dataset GROUP BY 1),
c AS (SELECT concat_ws(' + ', h.source, o.source, g.source, a.source, m.source) AS combo, hn.n + n1.n + n2.n + n3.n + n4.n AS n FROM s h, s o, s g, s a, s m, n hn, n n1, n n2, n n3, n n4
 WHERE h.maker = 'human' AND o.maker = 'opn' AND g.maker = 'ggl' AND a.maker = 'ant' AND m.maker = 'mta' AND hn.source = h.source AND n1.source = o.source AND n2.source = g.source AND n3.source = a.source AND n4.source = m.source),
t AS (SELECT combo FROM c ORDER BY n DESC, combo LIMIT 10)
SELECT source, count(*) AS n FROM (SELECT unnest(string_split(combo, ' + ')) AS source FROM t) GROUP BY source""")
def sources_in_top(read):
    """In how many of the ten largest source combinations each source stands."""
    n = read("dataset").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    c = source_combinations(read)
    parts = c.select("combo", F.explode(F.split("combo", r"\s*\+\s*")).alias("source")).join(n, "source").groupBy("combo").agg(F.sum("n").alias("n"))
    top = parts.orderBy(F.desc("n"), "combo").limit(10)
    return top.select(F.explode(F.split("combo", r"\s*\+\s*")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o, lr, d FROM (VALUES ('adam'), ('adamw'), ('sgd')) a(o), (VALUES (CAST(0.1 AS DOUBLE)), (0.01), (0.001)) b(lr), (VALUES (CAST(0.1 AS DOUBLE)), (0.3), (0.5)) c(d)")
def parameter_grid(read):
    spark = read("region").sparkSession
    return R.grid(spark, o=["adam", "adamw", "sgd"], lr=[0.1, 0.01, 0.001], d=[0.1, 0.3, 0.5])


_HIST = f"SELECT {_LAB} AS class, CAST({_NW} AS DOUBLE) AS v FROM dataset WHERE text IS NOT NULL"


@query(f"SELECT class, CAST(least(floor((v - 60) * 24 / 80), 23) AS INTEGER) AS bin, count(*) AS n FROM ({_HIST}) WHERE v >= 60 AND v <= 140 GROUP BY 1, 2")
def word_histogram(read):
    d = _labelled(read).where("text is not null")
    return R.histogram(d, X.word_count(F.col("text")), 60, 140, 24, "class")


@query(f"SELECT class, quantile_cont(v, 0) AS q0, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 1) AS q4 FROM ({_HIST}) GROUP BY class")
def word_quantiles(read):
    d = _labelled(read).where("text is not null").select("class", X.word_count(F.col("text")).cast("double").alias("v"))
    q = d.groupBy("class").agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    return q.select("class", *[F.col("q")[i].alias(f"q{i}") for i in range(5)])


@query(f"SELECT min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v < 80) AS short, count(*) FILTER (WHERE v > 120) AS long FROM ({_HIST})")
def word_stats(read):
    d = read("dataset").where("text is not null").select(X.word_count(F.col("text")).cast("double").alias("v"))
    return d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.count_if(F.col("v") < 80).alias("short"), F.count_if(F.col("v") > 120).alias("long"))


@query("SELECT DISTINCT label FROM dataset")
def distinct_labels(read):
    return read("dataset").select("label").distinct()


@query("SELECT id, text, label, split_name, collected_at, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at, collected_at NULLS FIRST, text NULLS FIRST, split_name NULLS FIRST) AS rn FROM dataset_test) WHERE rn = 1")
def test_assembly(read):
    """Evaluation splits as one table, the first delivery of each id."""
    return first_tests(read)


@query("SELECT count(*) AS n, count(DISTINCT id) AS kept, count(*) - count(DISTINCT id) AS removed FROM dataset_test")
def dedup_counts(read):
    return read("dataset_test").agg(F.count("*").alias("n"), F.countDistinct("id").alias("kept")).withColumn("removed", F.col("n") - F.col("kept"))


@query("""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM dataset WHERE id IS NOT NULL) WHERE rn = 1)
SELECT row_id, id, loaded_at FROM f""")
def latest_delivery(read):
    """The last delivery of each record id."""
    d = read("dataset").where("id is not null").select("row_id", "id", "loaded_at")
    return d.groupBy("id").agg(F.max_by(F.struct("row_id", "loaded_at"), F.struct("loaded_at", "row_id")).alias("r")).select("r.row_id", "id", "r.loaded_at")


@query(f"""
WITH a AS (SELECT termo, text, row_id, {_NW} AS n FROM dataset WHERE termo IS NOT NULL AND text IS NOT NULL)
SELECT termo, row_id, CAST(n AS INTEGER) AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY termo ORDER BY n BETWEEN 80 AND 120 DESC, CASE WHEN n BETWEEN 80 AND 120 THEN 0 ELSE -n END, row_id) AS rn FROM a) WHERE rn = 1""")
def best_attempt(read):
    """Per term the first passage of wanted length, else the longest."""
    a = read("dataset").where("termo is not null and text is not null").select("termo", "row_id", X.word_count(F.col("text")).alias("n_words"))
    ok = F.col("n_words").between(MIN_WORDS, MAX_WORDS)
    key = F.struct((~ok).alias("a"), F.when(ok, 0).otherwise(-F.col("n_words")).alias("b"), F.col("row_id"))
    return a.groupBy("termo").agg(F.min_by(F.struct("row_id", "n_words"), key).alias("r")).select("termo", "r.row_id", "r.n_words")


@query("""
SELECT id, text, label, 'train' AS part FROM dataset UNION ALL SELECT id, text, label, 'test' AS part FROM dataset_test""")
def union_all(read):
    c = ["id", "text", "label"]
    return read("dataset").select(*c, F.lit("train").alias("part")).unionByName(read("dataset_test").select(*c, F.lit("test").alias("part")))


_L = f"(SELECT row_id, {_LAB} AS class FROM dataset WHERE {_LAB} IS NOT NULL)"
_RANKED = f"SELECT row_id, class, row_number() OVER (PARTITION BY class ORDER BY {S.seeded('row_id')}, row_id) AS rank, count(*) OVER (PARTITION BY class) AS n FROM {_L}"


def _known(read):
    return _labelled(read).where("class is not null").select("row_id", "class")


@query(f"SELECT row_id, class, CASE WHEN rank <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM ({_RANKED})")
def stratified_split(read):
    return P.stratified_split(_known(read), "row_id", "class")


@query(f"SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {S.seeded('row_id')}, row_id) <= floor((SELECT count(*) FROM dataset) * 0.2) THEN 'test' ELSE 'train' END AS part FROM dataset")
def plain_split(read):
    return P.plain_split(read("dataset").select("row_id"), "row_id")


_FOLDS = f"SELECT row_id, class, CAST(ntile(3) OVER (PARTITION BY class ORDER BY {S.seeded('row_id')}, row_id) - 1 AS INTEGER) AS fold FROM {_L}"


@query(_FOLDS)
def stratified_folds(read):
    return P.stratified_folds(_known(read), "row_id", "class")


@query(f"SELECT run, role, class, count(*) AS n FROM (SELECT class, CAST(run AS INTEGER) AS run, CASE WHEN run = fold THEN 'val' ELSE 'train' END AS role FROM ({_FOLDS}), range(3) r(run)) GROUP BY ALL")
def fold_roles(read):
    return P.fold_roles(P.stratified_folds(_known(read), "row_id", "class")).groupBy("run", "role", "class").agg(F.count("*").alias("n"))


_SUPPORT = f"SELECT row_id, class FROM ({_RANKED}) WHERE rank <= 10"


@query(_SUPPORT)
def support_set(read):
    return P.per_class(_known(read), "row_id", "class", 10)


@query(f"SELECT row_id, class FROM {_L} WHERE row_id NOT IN (SELECT row_id FROM ({_SUPPORT})) ORDER BY {S.seeded('row_id', 7)}, row_id LIMIT 150")
def validation_cut(read):
    d = _known(read)
    rest = P.complement(d, P.per_class(d, "row_id", "class", 10), "row_id")
    return P.first_in_order(rest, "row_id", 150, 7).select("row_id", "class")


@query(f"""
WITH l AS {_L}, k AS (SELECT least(CAST(floor(0.29 * count(*) FILTER (WHERE class <> 'Human') / (1 - 0.29)) AS BIGINT), count(*) FILTER (WHERE class = 'Human')) AS k FROM l)
SELECT row_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {S.seeded('row_id')}, row_id) AS rn FROM l), k WHERE class <> 'Human' OR rn <= k""")
def cap_class_share(read):
    return P.cap_class_share(_known(read), "row_id", "class", "Human", 0.29)


@query(f"SELECT row_id, class FROM ({_RANKED}) WHERE class <> 'Human' OR rank <= floor(n * 0.7)")
def keep_class_part(read):
    return P.keep_class_part(_known(read), "row_id", "class", "Human", 0.7)


@query(f"SELECT row_id, CAST(floor((row_number() OVER (ORDER BY {S.seeded('row_id')}, row_id) - 1) / 128) AS BIGINT) AS batch FROM dataset")
def mini_batches(read):
    return P.mini_batches(read("dataset").select("row_id"), "row_id", 128)


@query("SELECT line_no, (row_number() OVER (ORDER BY line_no) - 1) % 3 AS worker FROM term_list")
def round_robin(read):
    return P.round_robin(read("term_list").select("line_no"), [F.col("line_no")], 3)


@query(f"""
WITH s AS (SELECT class, row_id, text FROM ({_RANKED}) JOIN dataset USING (row_id) WHERE rank <= 2),
b AS (SELECT string_agg(concat('Text: ', coalesce(substring(text, 1, 400), ''), chr(10), 'Category: ', class), chr(10) || chr(10) ORDER BY class, row_id) AS block FROM s)
SELECT id, concat(block, chr(10), chr(10), 'Text: ', text, chr(10), 'Category:') AS prompt FROM {_TEST}, b WHERE text IS NOT NULL""")
def prompts(read):
    """Few-shot classification prompts: two examples of each class, then the text."""
    from ..sources.remote import few_shot_prompts

    d = _labelled(read).where("class is not null")
    return few_shot_prompts(first_tests(read), P.per_class(d, "row_id", "class", 2), "row_id", "class")
