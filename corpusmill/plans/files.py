"""Queries that go through readers, writers and clients, and come back: what is read must be what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..functions.fixed import LABELS, MAX_WORDS, MIN_WORDS
from ..operators import vectorize as V
from ..operators.scratch import shared_folder
from ..operators.tables import first_per_key
from ..sources import io, remote
from . import base as S
from .base import query
from .evaluation import P, predictions
from .features import _TEST, _WORD_OCC, _vocab, first_tests


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/corpusmill-files-{uuid.uuid4().hex}"


@query("SELECT row_id, nullif(id, 'NA') AS id, nullif(nullif(termo, ''), 'NA') AS termo, nullif(nullif(label, ''), 'NA') AS label, nullif(nullif(text, ''), 'NA') AS text FROM dataset")
def csv_round_trip(read):
    """All training rows through a ``;``-separated file and back: quotes, separators and line ends kept, empty fields and ``NA`` as null."""
    d = read("dataset").select("row_id", "id", "termo", "label", "text")
    path = _folder(d.sparkSession)
    io.write_csv(d, path)
    back = io.read_csv(d.sparkSession, path)
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), *[F.nullif(c, F.lit("")).alias(c) for c in ("id", "termo", "label", "text")])


_SAFE = S.sub(f"replace({S.strip(S.sub('text', S.UUID))}, ';', ',')", f"{S.WS}+", " ")


@query(f"SELECT doc_id, nullif(nullif({_SAFE}, ''), 'NA') AS text FROM documents")
def csv_appended(read):
    """Texts made safe for the file and appended in two runs."""
    d = read("documents").select("doc_id", "text")
    path = _folder(d.sparkSession)
    half = F.col("doc_id") % 2 == 0
    io.write_csv(d.where(half), path, safe="text")
    io.write_csv(d.where(~half), path, "append", "text")
    return io.read_csv(d.sparkSession, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.nullif("text", F.lit("")).alias("text"))


@query("SELECT source, count(*) AS n, nullif(nullif(arg_min(coalesce(label, ''), row_id), ''), 'NA') AS first_label FROM dataset WHERE source IS NOT NULL GROUP BY 1")
def file_inventory(read):
    """One folder of files a source; rows and first label of each file as the directory shows them."""
    d = read("dataset").where("source is not null").select("source", "row_id", "label")
    path = _folder(d.sparkSession)
    d.repartition("source").sortWithinPartitions("source", "row_id").write.partitionBy("source").option("sep", ";").option("header", True).csv(path)
    return io.inventory(d.sparkSession, path, by="source").select("source", "n", F.nullif("first_label", F.lit("")).alias("first_label"))


@query(f"SELECT {S.strip('term')} AS term, count(*) AS n FROM term_list WHERE {S.strip('term')} <> '' GROUP BY 1")
def listed_terms(read):
    """The term list through a text file, a line a term."""
    t = read("term_list")
    path = _folder(t.sparkSession)
    io.write_lines(t, "term", path)
    return io.read_lines(t.sparkSession, path).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT id, model, pred AS label FROM p")
def checkpointed_predictions(read):
    """A run that stops half way, and one that goes on: only ids that the checkpoint lacks are added."""
    p = predictions(read).select("id", "model", F.col("pred").alias("label"))
    path = _folder(p.sparkSession)
    io.write_checkpoint(p.where(F.pmod(F.crc32("id"), F.lit(2)) == 0), path)
    io.write_checkpoint(p.join(io.read_parts(p.sparkSession, path).select("id", "model"), ["id", "model"], "left_anti"), path)
    return io.read_parts(p.sparkSession, path)


@query("SELECT CAST(to_json({'id': id, 'label': label, 'split_name': split_name}) AS VARCHAR) AS document FROM dataset_test")
def json_documents(read):
    """Rows as JSON documents through a file, nulls written out."""
    t = read("dataset_test").select("id", "label", "split_name")
    path = _folder(t.sparkSession)
    io.write_json(t, path)
    return t.sparkSession.read.text(path).select(F.col("value").alias("document"))


@query(f"SELECT doc, CAST(idx AS INTEGER) AS idx, n FROM ({f'SELECT doc, term, count(*) AS n FROM ({_WORD_OCC}) GROUP BY 1, 2'}) JOIN ({_vocab(_WORD_OCC, 300, 2, 0.95)}) USING (term)")
def stored_model(read):
    """A vocabulary saved as a model folder, loaded again and applied."""
    d, t = read("documents").where("text is not null"), T.word_tokens(F.col("text"))
    path = _folder(d.sparkSession)
    m = V.fit_words(d, "doc_id", t, 300)
    io.save_model(path, vocabulary=m.table)
    again = V.Vocabulary(io.load_model(d.sparkSession, path, "vocabulary")["vocabulary"], m.size, m.n_docs, m.rows)
    return V.bag_of_words(V.token_counts(d, "doc_id", t), again)


@query(f"SELECT doc, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY i) AS counts FROM (SELECT DISTINCT doc FROM c) JOIN range(64) r(i) ON true LEFT JOIN c ON c.doc = _D AND c.idx = i GROUP BY doc".replace("(SELECT DISTINCT doc FROM c)", "(SELECT DISTINCT doc AS d0 FROM c)").replace("SELECT doc,", f"WITH c AS (SELECT doc, idx, n FROM (SELECT doc, term, count(*) AS n FROM ({_WORD_OCC}) GROUP BY 1, 2) JOIN ({_vocab(_WORD_OCC, 64, 2, 0.95)}) USING (term)) SELECT d0 AS doc,", 1).replace("c.doc = _D", "c.doc = d0").replace("GROUP BY doc", "GROUP BY d0"))
def dense_features(read):
    """Sparse counts of the 64 commonest words as dense rows."""
    from ..operators.train import dense_rows

    d, t = read("documents").where("text is not null"), T.word_tokens(F.col("text"))
    m = V.fit_words(d, "doc_id", t, 64)
    counts = V.bag_of_words(V.token_counts(d, "doc_id", t), m).select("doc", "idx", F.col("n").alias("value"))
    return dense_rows(counts, 64).select("doc", F.array_join(F.transform("features", lambda x: x.cast("bigint").cast("string")), ",").alias("counts"))


@query(f"WITH {P} SELECT t.id AS ID, t.text AS Text, coalesce(p.pred, 'Human') AS Labels FROM {_TEST} t LEFT JOIN p ON p.id = t.id AND p.model = (SELECT min(model) FROM m)")
def submission_rows(read):
    """The submission of one model: every item, missing answers as the default class."""
    p = predictions(read)
    base = p.agg(F.min("model")).first()[0]
    ids = first_tests(read).select("id", "text").withColumn("ord", F.col("id"))
    return io.submission(p.where(F.col("model") == base).select("id", F.col("pred").alias("label")), ids, with_text=True)


@query(f"SELECT row_id, {S.canonical_label('label')} AS class FROM dataset")
def label_round_trip(read):
    """Classes as numbers and back; what has none stays null."""
    return read("dataset").select("row_id", V.index_label(V.label_index(X.canonical_label(F.col("label")), LABELS), LABELS).alias("class"))


_TERMS = f"(SELECT min(line_no) AS line_no, {S.strip('term')} AS term FROM term_list WHERE {S.strip('term')} <> '' GROUP BY 2)"


def _terms(read):
    t = read("term_list").select("line_no", X.strip(F.col("term")).alias("term")).where("term <> ''")
    return t.groupBy("term").agg(F.min("line_no").alias("line_no"))


@query(f"""SELECT line_no, concat('Example 1:', chr(10), 'Calm and clear.', chr(10), chr(10), 'Example 2:', chr(10), 'Short facts.', chr(10), chr(10), 'In the style of these examples: ',
 'Write an encyclopaedic passage of {MIN_WORDS} to {MAX_WORDS} words about ', chr(39), term, chr(39), '. Plain sentences only.') AS prompt FROM {_TERMS}""")
def generation_prompts(read):
    """Few-shot prompts for a passage about each listed term."""
    shown = F.array(F.lit("Calm and clear."), F.lit("Short facts."))
    return _terms(read).select("line_no", remote.generation_prompt(F.col("term"), shown).alias("prompt"))


def _revisions(term: str):
    return [(f"2020-01-{d:02d}", f"<p>{term} {d}</p>") for d in range(9, 9 - len(term) % 9, -1)]


@query(f"SELECT term, '2020-01-05' AS revised_at, concat('<p>', term, ' 5</p>') AS html FROM {_TERMS} WHERE length(term) % 9 > 4")
def page_revisions(read):
    """The last revision of each term's page before a day, of a client with a few revisions a page."""
    return remote.pages_before(_terms(read), _revisions, "2020-01-06")


@query(f"SELECT line_no AS id, term AS raw FROM {_TERMS} WHERE line_no % 3 <> 0 ORDER BY line_no LIMIT 40")
def collected_answers(read):
    """Generation with a target: terms in order are asked until 40 answers are accepted."""
    t = _terms(read)
    prompts = t.select(F.col("line_no").alias("id"), F.col("line_no").alias("ord"), F.col("term").alias("prompt"))
    return remote.collect_until(prompts, str, 40, F.col("id") % 3 != 0, _folder(t.sparkSession)).select("id", "raw")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0.0 AS total FROM embeddings")
def stored_vectors(read):
    """Word vectors through a text file, a word and its numbers a line."""
    e = read("embeddings")
    path = _folder(e.sparkSession)
    line = F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    e.select(line.alias("value")).write.text(path)
    v = io.read_vectors(e.sparkSession, path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select(F.col("word").cast("bigint").alias("vec_id"), F.size("vector").alias("n"), (F.round(total, 3) + 0.0).alias("total"))


def _treebank(x: str) -> str:
    for pattern, by in T.TREEBANK:
        if pattern == "''":
            x = f"(' ' || {x} || ' ')"
        x = S.sub(x, pattern, by.replace("'", "''"))
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split({S.sub(S.strip('text'), f'([.!?]){S.WS}+', chr(92) + '1' + chr(1))}, chr(1))) AS s FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, lower(unnest({_treebank('s')})) AS w FROM s WHERE s <> '') SELECT doc_id, w, count(*) AS n FROM t WHERE regexp_full_match(w, '\\p{{L}}+') GROUP BY 1, 2""")
def treebank_words(read):
    """Counts of alphabetic treebank tokens by document."""
    return V.token_counts(read("documents").where("text is not null"), "doc_id", T.alphabetic_tokens(F.col("text"))).select(F.col("doc").alias("doc_id"), F.col("term").alias("w"), "n")
