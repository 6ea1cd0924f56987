"""Queries over predictions: metrics, votes, meta-features, experts, scoring, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ensemble as E
from ..operators import score as M
from ..operators import tables as R
from . import base as S
from .base import query
from .features import _TEST, first_tests

_L5 = "(VALUES ('Anthropic'), ('Google'), ('Human'), ('Meta'), ('OpenAI'))"


def predictions(read):
    """``(id, model, ord, pred, gold)``: each model's latest answer to each item with a revealed label."""
    gold = read("dataset_test").groupBy("id").agg(F.max(X.canonical_label(F.col("label"))).alias("gold")).where("gold is not null")
    s = read("submissions").select("id", "model", "submitted_at", X.answer_label(F.col("label")).alias("pred"))
    last = s.groupBy("id", "model").agg(F.max_by("pred", F.struct("submitted_at", "pred")).alias("pred"))
    models = s.select("model").distinct()
    order = models.withColumn("ord", F.expr("cast(rank() over (order by model) as int)"))  # a few models
    return gold.crossJoin(F.broadcast(order)).join(last, ["id", "model"], "left").select("id", "model", "ord", "pred", "gold")


P = f"""gold AS (SELECT id, max({S.canonical_label('label')}) AS gold FROM dataset_test GROUP BY id HAVING max({S.canonical_label('label')}) IS NOT NULL),
s AS (SELECT id, model, submitted_at, {S.answer_label('label')} AS pred FROM submissions),
r AS (SELECT id, model, pred, row_number() OVER (PARTITION BY id, model ORDER BY submitted_at DESC, pred DESC NULLS LAST) AS rn FROM s),
m AS (SELECT model, CAST(rank() OVER (ORDER BY model) AS INTEGER) AS ord FROM (SELECT DISTINCT model FROM s)),
p AS (SELECT gold.id, m.model, m.ord, r.pred, gold FROM gold CROSS JOIN m LEFT JOIN r ON r.id = gold.id AND r.model = m.model AND r.rn = 1),
f AS (SELECT *, coalesce(pred, 'Human') AS fp FROM p),
acc AS (SELECT model, ord, count(*) AS n, count(pred) AS valid, avg(CASE WHEN fp = gold THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN pred IS NULL THEN NULL WHEN pred = gold THEN 1.0 ELSE 0.0 END) AS valid_accuracy FROM f GROUP BY 1, 2),
cm AS (SELECT m.model, g.c AS gold, q.c AS pred, (SELECT count(*) FROM f WHERE f.model = m.model AND f.gold = g.c AND f.fp = q.c) AS n FROM m, {_L5} g(c), {_L5} q(c)),
rep AS (SELECT model, class, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support FROM (
  SELECT model, c.class, sum(CASE WHEN gold = class AND pred = class THEN n ELSE 0 END) AS tp, sum(CASE WHEN pred = class THEN n ELSE 0 END) AS said, sum(CASE WHEN gold = class THEN n ELSE 0 END) AS support FROM cm, {_L5} c(class) GROUP BY 1, 2)),
ew AS (SELECT id, coalesce(max(v), 'Human') AS vote FROM (SELECT id, NULL AS v FROM gold UNION ALL SELECT id, pred FROM (SELECT id, pred, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(ord)) AS k FROM p WHERE pred IS NOT NULL GROUP BY 1, 2) WHERE k = 1) GROUP BY id)"""


@query(f"WITH {P} SELECT id, model, ord, pred, gold FROM p")
def prediction_table(read):
    return predictions(read)


@query(f"WITH {P} SELECT model, n, valid, round(accuracy, 6) AS accuracy, round(valid_accuracy, 6) AS valid_accuracy FROM acc")
def model_accuracy(read):
    return E.accuracy(predictions(read)).select("model", "n", "valid", F.round("accuracy", 6).alias("accuracy"), F.round("valid_accuracy", 6).alias("valid_accuracy"))


@query(f"WITH {P} SELECT model, gold, pred, n FROM cm")
def confusion_matrix(read):
    return E.confusion(predictions(read))


@query(f"""WITH {P}, a AS (SELECT model, class, precision, recall, f1, support FROM rep UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rep GROUP BY 1
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rep GROUP BY 1)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a""")
def class_report(read):
    r = E.report(predictions(read))
    return r.select("model", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT model, label, count(*) AS n FROM submissions GROUP BY 1, 2")
def prediction_distribution(read):
    return read("submissions").groupBy("model", "label").agg(F.count("*").alias("n"))


@query(f"SELECT model, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (WHERE label IS NULL) AS missing, count(*) FILTER (WHERE {S.canonical_label('label')} IS NULL AND label IS NOT NULL) AS outside FROM submissions GROUP BY model")
def output_checks(read):
    c = X.canonical_label(F.col("label"))
    return read("submissions").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("label").isNull()).alias("missing"), F.count_if(c.isNull() & F.col("label").isNotNull()).alias("outside"))


@query(f"WITH {P} SELECT model, round(accuracy / sum(accuracy) OVER (), 6) AS linear, round(accuracy * accuracy / sum(accuracy * accuracy) OVER (), 6) AS quadratic FROM acc")
def model_weights(read):
    a = E.accuracy(predictions(read))
    return E.weights(a, 1).select("model", F.round("weight", 6).alias("linear")).join(E.weights(a, 2).select("model", F.round("weight", 6).alias("quadratic")), "model")


@query(f"WITH {P} SELECT id, vote FROM ew")
def equal_vote(read):
    return E.vote(predictions(read))


def _weighted(power: int) -> str:
    return f"""w AS (SELECT model, power(accuracy, {power}) / sum(power(accuracy, {power})) OVER () AS weight FROM acc),
v AS (SELECT id, pred, row_number() OVER (PARTITION BY id ORDER BY round(sum(weight), 9) DESC, min(ord)) AS k FROM p JOIN w USING (model) WHERE pred IS NOT NULL GROUP BY 1, 2),
wv AS (SELECT gold.id, coalesce(v.pred, 'Human') AS vote FROM gold LEFT JOIN v ON v.id = gold.id AND k = 1)"""


@query(f"WITH {P}, {_weighted(1)} SELECT id, vote FROM wv")
def weighted_vote(read):
    p = predictions(read)
    return E.vote(p, E.weights(E.accuracy(p), 1))


@query(f"WITH {P}, {_weighted(2)} SELECT id, vote FROM wv")
def squared_vote(read):
    p = predictions(read)
    return E.vote(p, E.weights(E.accuracy(p), 2))


_EXPERTS = "x AS (SELECT class, model AS expert, f1 FROM (SELECT rep.*, row_number() OVER (PARTITION BY class ORDER BY round(f1, 9) DESC, ord) AS k FROM rep JOIN m USING (model)) WHERE k = 1)"


@query(f"WITH {P}, {_EXPERTS} SELECT class, expert, round(f1, 6) AS f1 FROM x")
def class_experts(read):
    return E.class_experts(predictions(read)).select("class", "expert", F.round("f1", 6).alias("f1"))


@query(f"WITH {P}, {_EXPERTS} SELECT ew.id, coalesce(p.pred, 'Human') AS vote FROM ew LEFT JOIN x ON x.class = ew.vote LEFT JOIN p ON p.id = ew.id AND p.model = x.expert")
def expert_vote(read):
    return E.expert_vote(predictions(read))


@query(f"""WITH {P}, {_weighted(1)}, {_EXPERTS}, ev AS (SELECT ew.id, coalesce(p.pred, 'Human') AS vote FROM ew LEFT JOIN x ON x.class = ew.vote LEFT JOIN p ON p.id = ew.id AND p.model = x.expert),
a AS (SELECT 'equal' AS scheme, 1 AS o, * FROM ew UNION ALL SELECT 'weighted', 2, * FROM wv UNION ALL SELECT 'expert', 3, * FROM ev),
b AS (SELECT scheme, o, avg(CASE WHEN vote = gold THEN 1.0 ELSE 0.0 END) AS accuracy FROM a JOIN gold USING (id) GROUP BY 1, 2)
SELECT scheme, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY round(accuracy, 9) DESC, o) AS INTEGER) AS place FROM b""")
def scheme_ranking(read):
    """Vote schemes by accuracy; the first declared wins a tie."""
    from pyspark.sql import Window

    p = predictions(read)
    gold = p.select("id", "gold").distinct()
    votes = [("equal", E.vote(p)), ("weighted", E.vote(p, E.weights(E.accuracy(p)))), ("expert", E.expert_vote(p))]
    rows = None
    for k, (name, v) in enumerate(votes):
        part = v.select("id", "vote", F.lit(name).alias("scheme"), F.lit(k).alias("o"))
        rows = part if rows is None else rows.unionByName(part)
    a = rows.join(gold, "id").groupBy("scheme", "o").agg(F.avg((F.col("vote") == F.col("gold")).cast("double")).alias("accuracy"))
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("accuracy", 9)), "o"))).select("scheme", F.round("accuracy", 6).alias("accuracy"), "place")


@query(f"""WITH {P}, c AS (SELECT id, fp, count(*) / sum(count(*)) OVER (PARTITION BY id) AS share FROM f GROUP BY 1, 2),
h AS (SELECT id, string_agg(concat_ws(',', CAST(fp = 'Anthropic' AS INT), CAST(fp = 'Google' AS INT), CAST(fp = 'Human' AS INT), CAST(fp = 'Meta' AS INT), CAST(fp = 'OpenAI' AS INT)), ',' ORDER BY ord) AS one_hot FROM f GROUP BY 1)
SELECT id, first(one_hot) AS one_hot, round(max(share), 6) AS agreement, round(abs(-sum(share * log2(share))), 6) AS vote_entropy FROM c JOIN h USING (id) GROUP BY id""")
def meta_features(read):
    m = E.meta_features(predictions(read))
    return m.select("id", F.array_join(F.transform("one_hot", lambda x: x.cast("string")), ",").alias("one_hot"), F.round("agreement", 6).alias("agreement"), F.round(F.abs("vote_entropy"), 6).alias("vote_entropy"))


@query(f"WITH {P}, b AS (SELECT id, max(CASE WHEN fp = gold THEN 1 ELSE 0 END) AS r FROM f GROUP BY 1) SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS \"right\", round(avg(r), 6) AS bound FROM b")
def oracle_bound(read):
    return E.any_right(predictions(read)).select("n", "right", F.round("bound", 6).alias("bound"))


_BASE = "(SELECT min(model) FROM m)"


@query(f"""WITH {P}, wrong AS (SELECT id FROM f WHERE model = {_BASE} AND fp <> gold), o AS (SELECT f.* FROM f JOIN wrong USING (id) WHERE model <> {_BASE})
SELECT model, count(*) FILTER (WHERE fp = gold) AS n FROM o GROUP BY 1 UNION ALL SELECT 'nobody', count(*) FILTER (WHERE NOT a) FROM (SELECT id, bool_or(fp = gold) AS a FROM o GROUP BY 1)""")
def rescue_counts(read):
    p = predictions(read)
    base = p.agg(F.min("model")).first()[0]
    return E.rescues(p, base)


@query(f"WITH {P} SELECT id, model, CASE WHEN pred IS NULL THEN 'none' ELSE pred END AS said, gold, substring(t.text, 1, 100) AS preview FROM p JOIN {_TEST} t USING (id) WHERE pred IS DISTINCT FROM gold")
def error_listing(read):
    p = predictions(read).where(~F.col("pred").eqNullSafe(F.col("gold")))
    return p.join(first_tests(read).select("id", "text"), "id").select("id", "model", F.coalesce("pred", F.lit("none")).alias("said"), "gold", F.substring("text", 1, 100).alias("preview"))


@query(f"""WITH {P}, {_EXPERTS} SELECT concat('{{"labels":["Anthropic","Google","Human","Meta","OpenAI"],"experts":{{', (SELECT string_agg(concat('"', class, '":"', expert, '"'), ',' ORDER BY class) FROM x), '}}}}') AS config""")
def config_document(read):
    """The ensemble's configuration as one nested JSON document."""
    from ..functions.fixed import LABELS

    e = E.class_experts(predictions(read)).groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "expert")))).alias("experts"))
    return e.select(F.to_json(F.struct(F.array(*[F.lit(x) for x in LABELS]).alias("labels"), "experts")).alias("config"))


# ---- scoring with weights given by a formula -------------------------------------------------------------------

_CLASS, _DIM, _HID = 10, 64, 16
_WEIGHT = "CAST((((i * 7 + j * 13) % 11) - 5) AS DOUBLE) / 10"


def _weights(spark, n_in, n_out):
    w = spark.range(n_in).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(spark.range(n_out).select(F.col("id").cast("int").alias("j"))))
    return w.select(F.col("i").alias("idx"), "j", F.expr(_WEIGHT).alias("w")), spark.range(n_out).select(F.col("id").cast("int").alias("j"), (F.col("id") / 100).alias("b"))


def _vectors(read):
    return read("embeddings").select(F.col("vec_id").alias("doc"), F.posexplode("embedding").alias("idx", "value")).withColumn("value", F.col("value").cast("double"))


_X = "x AS (SELECT vec_id AS doc, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_AFF = f"z AS (SELECT doc, j, sum(v * {_WEIGHT}) + j / 100 AS z FROM x, range({_CLASS}) r(j) GROUP BY doc, j)"
_SM = "sm AS (SELECT doc, j, z, exp(z - max(z) OVER (PARTITION BY doc)) / sum(exp(z)) OVER (PARTITION BY doc) * exp(max(z) OVER (PARTITION BY doc)) AS p FROM z)"


@query(f"WITH {_X}, {_AFF}, {_SM} SELECT doc, CAST(j AS INTEGER) AS idx, round(p, 6) AS p FROM sm")
def affine_softmax(read):
    s = M.network(_vectors(read), [_weights(read("region").sparkSession, _DIM, _CLASS)])
    return s.select("doc", "idx", F.round("p", 6).alias("p"))


@query(f"WITH {_X}, {_AFF}, {_SM} SELECT round(avg(-ln(greatest(least(p, 1 - 1e-15), 1e-15))), 5) AS loss FROM sm JOIN embeddings e ON e.vec_id = sm.doc AND e.label = sm.j")
def softmax_loss(read):
    s = M.network(_vectors(read), [_weights(read("region").sparkSession, _DIM, _CLASS)])
    return M.cross_entropy(s, read("embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("gold"))).select(F.round("loss", 5).alias("loss"))


@query(f"""WITH {_X}, h AS (SELECT doc, j AS i, greatest(sum(v * {_WEIGHT}) + j / 100, 0) AS v FROM x, range({_HID}) r(j) GROUP BY doc, j), z AS (SELECT doc, j, sum(v * {_WEIGHT}) + j / 100 AS z FROM h, range({_CLASS}) r(j) GROUP BY doc, j),
b AS (SELECT doc, arg_max(j, round(z, 6) - j * 1e-9) AS pred FROM z GROUP BY doc)
SELECT pred, count(*) AS n, count(*) FILTER (WHERE label = pred) AS hits FROM b JOIN embeddings ON vec_id = doc GROUP BY pred""")
def network_score(read):
    """A two-layer network rebuilt from stored weights, applied to vectors; predictions and hits by class."""
    spark = read("region").sparkSession
    s = M.network(_vectors(read), [_weights(spark, _DIM, _HID), _weights(spark, _HID, _CLASS)])
    b = M.argmax(s.withColumn("z", F.round("value", 6)), "z")
    return b.join(read("embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc").groupBy(F.col("pred").cast("bigint").alias("pred")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("hits"))


def _formula(n_in, n_out):
    import numpy as np

    i, j = np.arange(n_in)[:, None], np.arange(n_out)[None, :]
    return (((i * 7 + j * 13) % 11) - 5) / 10, np.arange(n_out) / 100


def _stack(sizes, normalised):
    """Weights by formula, with normalisation of the hidden layers' outputs."""
    import numpy as np

    out = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out[f"{k}.w"], out[f"{k}.b"] = _formula(a, b)
        if normalised and k < len(sizes) - 2:
            j = np.arange(b)
            out |= {f"{k}.gamma": 1 + (j % 3) / 10, f"{k}.beta": (j % 5) / 10, f"{k}.mean": (j % 7) / 10, f"{k}.var": 10.0 + j % 4}
    return out


def _layer(source, n_out, normalised, activation):
    z = f"SELECT doc, j, sum(v * {_WEIGHT}) + j / 100 AS z FROM {source}, range({n_out}) r(j) GROUP BY doc, j"
    y = "(z - (j % 7) / 10) / sqrt(10 + j % 4 + 1e-5) * (1 + (j % 3) / 10) + (j % 5) / 10" if normalised else "z"
    on = {"relu": "greatest(y, 0)", "leaky": "CASE WHEN y > 0 THEN y ELSE 0.1 * y END", "elu": "CASE WHEN y > 0 THEN y ELSE exp(y) - 1 END"}[activation]
    return f"(SELECT doc, j AS i, {on} AS v FROM (SELECT doc, j, {y} AS y FROM ({z})))"


def _tabular_sql(name):
    from ..operators.neural import TABULAR

    spec, source = TABULAR[name], "x"
    for h in spec.hidden:
        source = _layer(source, h, spec.normalised, spec.activation)
    return f"SELECT '{name}' AS model, doc, j, z FROM (SELECT doc, j, sum(v * {_WEIGHT}) + j / 100 AS z FROM {source}, range({_CLASS}) r(j) GROUP BY doc, j)"


_SCORED = ("DNNSimple", "DNNNarrow", "DNNLeakyReLU", "DNNELU", "DNNDeep", "DNNVeryDeep")


@query(f"""WITH x AS (SELECT vec_id AS doc, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), z AS ({' UNION ALL '.join(_tabular_sql(n) for n in _SCORED)}),
p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY model, doc)) AS e FROM z) SELECT model, CAST(j AS INTEGER) AS class, round(avg(e / s), 6) AS mean_p FROM (SELECT *, sum(e) OVER (PARTITION BY model, doc) AS s FROM p) GROUP BY 1, 2""")
def tabular_scores(read):
    """Six named tabular networks rebuilt from stored weights by class name; mean probability of each class over all vectors."""
    from ..operators import neural

    e, out = read("embeddings"), None
    for name in _SCORED:
        spec = neural.TABULAR[name]
        p = neural.predict(e, "vec_id", "embedding", _DIM, name, _stack((_DIM, *spec.hidden, _CLASS), spec.normalised))
        part = p.select(F.lit(name).alias("model"), F.posexplode("p").alias("class", "p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("model", "class").agg(F.round(F.avg("p"), 6).alias("mean_p"))


_H = "h AS (SELECT c.c AS config, e.e AS epoch, round(1.0 / (1 + e.e) + ((e.e * 7 + c.c * 3) % 5) * 0.05, 6) AS val_loss FROM range(27) c(c), range(12) e(e))"


def _history(read):
    spark = read("region").sparkSession
    g = spark.range(27).select(F.col("id").alias("config")).crossJoin(F.broadcast(spark.range(12).select(F.col("id").alias("epoch"))))
    return g.withColumn("val_loss", F.round(1.0 / (1 + F.col("epoch")) + ((F.col("epoch") * 7 + F.col("config") * 3) % 5) * 0.05, 6))


@query(f"""WITH {_H}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY config ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM h), i AS (SELECT *, best_before IS NULL OR val_loss < best_before AS improved FROM b)
SELECT config, epoch, val_loss, best_before, improved, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY config ORDER BY epoch) AS waited FROM i""")
def early_stopping(read):
    return R.running_best(_history(read), ["config"], "epoch", "val_loss")


@query(f"WITH {_H} SELECT config, round(avg(val_loss), 6) AS mean, round(stddev_pop(val_loss), 6) AS std, min(val_loss) AS lo, max(val_loss) AS hi, CAST(row_number() OVER (ORDER BY round(avg(val_loss), 9), config) AS INTEGER) AS place FROM h GROUP BY config")
def run_summary(read):
    from pyspark.sql import Window

    s = _history(read).groupBy("config").agg(F.avg("val_loss").alias("m"), F.stddev_pop("val_loss").alias("s"), F.min("val_loss").alias("lo"), F.max("val_loss").alias("hi"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.round("m", 9), "config"))).select("config", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), "lo", "hi", "place")


def grid_configs():
    """3 optimizers x 3 rates x 3 dropouts in the order of ``parameter_grid``; weight decay 0.001."""
    import itertools

    from ..operators import train

    return [train.Config((32,), lr, o, dropout=d, l2=1e-3, epochs=8) for o, lr, d in itertools.product(("adam", "adamw", "sgd"), (0.1, 0.01, 0.001), (0.1, 0.3, 0.5))]


@query()
def grid_search(read):
    """The 27 network configurations of ``parameter_grid`` cross-validated on the embeddings, ranked."""
    from ..operators import sampling, train

    e = read("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").alias("y"))
    rows = sampling.fold_roles(sampling.stratified_folds(e, "vec_id", "y", 3), 3).select("run", "role", "features", "y")
    configs = grid_configs()
    return train.ranking(train.cross_validate(rows, configs, 64, 10)).select("config", F.round("mean_acc", 4).alias("mean_acc"), F.round("std_acc", 4).alias("std_acc"), "place")


@query()
def softmax_regression(read):
    """Multinomial logistic regression on the embeddings (spark.ml): accuracy on the training rows by class."""
    from pyspark.ml.functions import array_to_vector

    from ..operators import train

    rows = read("embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("y"))
    m = train.softmax_regression(rows, iterations=30, l2=1e-3)
    return m.transform(rows).groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("hits"))


def _ranked(read):
    from ..functions import tokens as T
    from ..functions.fixed import LABELS
    from ..operators import corpora
    from .tables import source_combinations

    found = source_combinations(read).limit(corpora.MOST_COMBINATIONS + 1).collect()  # one more is an error there
    combos = [(r["combo"], [r[m] for m in ("human", "opn", "ggl", "ant", "mta")]) for r in found]
    label = X.canonical_label(F.col("label")).alias("class")
    rows = read("dataset").where("source is not null").select("source", label, "text", "row_id")
    tests = first_tests(read).where("text is not null").select(label, "text")
    return corpora.rank_combinations(rows, tests, combos, T.default_word_tokens(F.col("text")), LABELS, order="row_id")


@query()
def corpus_ranking(read):
    """Combinations of one source a maker, each fitted on the first 500 rows of its sources, ranked by five-class accuracy on all evaluation texts."""
    return _ranked(read).withColumn("accuracy", F.round("accuracy", 4))


@query()
def sources_in_best(read):
    """In how many of the ten most accurate source combinations each source stands."""
    best = _ranked(read).where("place <= 10")
    return best.select(F.explode(F.split("combo", r"\s*\+\s*")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def _stacking(read):
    """``(rows(id, features, y), width)``: the meta-features and class of every item with a revealed label."""
    from ..functions.fixed import LABELS
    from ..operators.vectorize import label_index

    p = predictions(read)
    m = E.meta_features(p).join(p.select("id", "gold").distinct(), "id")
    # rounded, so that equal votes are equal features in whatever order their shares were added
    features = F.concat(F.transform("one_hot", lambda x: x.cast("double")), F.array(F.round("agreement", 9), F.round(F.abs("vote_entropy"), 9)))
    return m.select("id", features.alias("features"), label_index(F.col("gold"), LABELS).cast("int").alias("y")), 5 * p.select("model").distinct().count() + 2


@query()
def stacked_vote(read):
    """A small network over the meta-features, judged by leave-one-out over all items with a revealed label."""
    from ..operators import train

    rows, width = _stacking(read)
    return train.leave_one_out(rows, train.Config((16,), 0.01, epochs=12), width, 5)


@query()
def stacked_regression(read):
    """Logistic regression (C = 1) over the meta-features, judged by leave-one-out over all items with a revealed label."""
    from ..operators import train

    rows, width = _stacking(read)
    return train.leave_one_out_regression(rows, width, 5)


def _models(p):
    from ..operators.vectorize import fit_classes

    return fit_classes(p, "model")  # too many are an error


@query(f"WITH {P} SELECT model, n, accuracy FROM (SELECT model, n, round(accuracy, 6) AS accuracy FROM acc)")
def resumed_run(read):
    """A run that asks a stub model only for what a checkpoint does not hold yet gives the same table as one run."""
    from ..sources.remote import classify

    p = predictions(read)
    half = F.pmod(F.crc32("id"), F.lit(2)) == 0
    answers = p.select("id", "model", "ord", "gold", "pred")
    parts = None
    for name in _models(p):
        mine = answers.where(F.col("model") == name)
        prompts = mine.select("id", F.coalesce("pred", F.lit("")).alias("prompt"))
        first = classify(prompts.where(half), str, name)
        rest = classify(prompts, str, name, first.select("id", "model"))
        run = first.unionByName(rest)
        parts = run if parts is None else parts.unionByName(run)
    done = parts.join(answers.drop("pred"), ["id", "model"]).withColumnRenamed("label", "pred")
    return E.accuracy(done).select("model", "n", F.round("accuracy", 6).alias("accuracy"))


_FIRST = f"SELECT *, {S.canonical_label('label')} AS class FROM dataset WHERE text IS NOT NULL"


@query(f"""WITH c AS (SELECT termo, {S.canonical_label('label')} AS class, source, {S.passage('text', S.PASSAGE)} AS passage FROM dataset WHERE text IS NOT NULL AND termo IS NOT NULL AND {S.canonical_label('label')} IS NOT NULL AND source IS NOT NULL)
SELECT source, class, count(*) AS n, round(avg(len({S.words('passage')})), 6) AS words FROM c WHERE len({S.words('passage')}) BETWEEN 80 AND 120 GROUP BY 1, 2""")
def corpus_assembly(read):
    """All corpora together: required columns, cleaned passages of wanted length, by source and class."""
    d = read("dataset").select("termo", "text", "source", X.canonical_label(F.col("label")).alias("class")).na.drop()
    # exploded, so that the cleaned passage is made once and not again in every predicate
    w = d.select("source", "class", F.explode(F.array(X.word_count(X.clean_passage(F.col("text"))))).alias("w"))
    return w.where(F.col("w").between(80, 120)).groupBy("source", "class").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("words"))


_HTML_KEPT = f"""WITH q AS (SELECT doc_id, {S.strip('text')} AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, {S.passage("CASE WHEN length(t) > 30 THEN t ELSE '' END", S.PASSAGE)} AS c FROM q),
k AS (SELECT doc_id, list_filter(string_split({S.sub(S.strip('c'), f'([.!?]){S.WS}+', chr(92) + '1' + chr(1))}, chr(1)), lambda s: s <> '') AS a FROM d),
s AS (SELECT doc_id, i, s, len({S.words('s')}) AS n FROM (SELECT doc_id, unnest(a) AS s, unnest(range(1, len(a) + 1)) AS i FROM k)), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM s)
SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS passage FROM r WHERE total <= 120 GROUP BY 1 HAVING max(total) >= 80"""


@query(_HTML_KEPT)
def page_passages(read):
    """Texts wrapped as encyclopaedia pages with a table, a contents box and a style sheet, taken apart again."""
    from ..sources.remote import page_passages as run

    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit('<html><style>p {}</style><div class="toc big"><p>a box with contents that is long enough to stay</p></div><table><tr><td><p>a table cell that is long enough to be kept</p></td></tr></table><p>'), esc, F.lit("<sup>[1]</sup></p><p>short</p></html>"))
    return run(read("documents").where("text is not null").select("doc_id", html.alias("html")), "doc_id", "html")
