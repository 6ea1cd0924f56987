"""Core functions and operators on literals, against values worked out by hand or row by row."""


import math
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions import tokens as T
from corpusmill.functions.style import COLUMNS, style_features
from corpusmill.operators import behavior as B
from corpusmill.operators import ensemble as E
from corpusmill.operators import sampling as P
from corpusmill.operators import score as M
from corpusmill.operators import tables as R
from corpusmill.operators import vectorize as V
from corpusmill.operators.graph import connected_components
from corpusmill.operators.scratch import Scratch
from corpusmill.operators.skew import salted_join


def run(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select(F.col("i"), f(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


EDGES = ["", " ", "word", "No stop here", "...", " lead\xa0space ", "Ação é boa. Já?", None]


def test_clean_text(spark):
    got = run(spark, X.clean_text, ["See HTTPS://x.y/z?q now", "mail a@b.c, OK!", "É-2 [x]\n\ty", "www.a.b c", "", None])
    assert got == ["see now", "mail ok!", "-2 x y", "c", "", None]


def test_clean_passage(spark):
    got = run(spark, X.clean_passage, ["A [1] b (x) , c {y} d", "Say /ˈab/ it ⓘ\r\nnow ;ok", "a/b/c", "[a\x85b] z", None])
    assert got == ["A b, c  d", "Say it now;ok", "a/b/c", "z", None]
    assert run(spark, X.clean_generated, ["x 12345678-1234-ABCD-1234-1234567890ab /ˈa/ y"]) == ["x /ˈa/ y"]
    assert run(spark, X.sink_safe, ["a;b\n c 12345678-1234-abcd-1234-1234567890ab"]) == ["a,b c"]


def test_sentences(spark):
    assert run(spark, X.sentences, EDGES) == [[], [], ["word"], ["No stop here"], [], ["lead\xa0space"], ["Ação é boa", "Já"], None]
    long = " ".join(["w"] * 119) + ". Two more. X."
    assert run(spark, X.truncate_sentences, [long, " ".join(["w"] * 121) + ". Short.", "A b. C d!  E", "", None]) == [long.split(" Two")[0], "", "A b. C d! E", "", ""]


def test_answers(spark):
    assert run(spark, X.answer_label, ["OpenAI", "I think it is meta or google", "Error: Human", "", None, "none"]) == ["OpenAI", "Google", None, None, None, None]
    assert run(spark, X.trace_label, ["hm\ncategory: Meta\nAnswer: google", "human", "it is OpenAI.\nmaybe", "no", None]) == ["Google", "Human", "OpenAI", None, None]
    assert run(spark, X.canonical_label, [" GOOGLE\t", "openai", "x", None]) == ["Google", "OpenAI", None, None]


def test_fragments(spark):
    lines = ['{"type":"delta","content":"Hi "}', '{"type":"start","content":"x"}', '{"type":"delta","content":{"text":"you"}}', '{"type":"d","content":"12345678-1234-abcd-1234-1234567890ab"}', '{"type":"d","content":" Processing"}', "broken", None]
    assert run(spark, X.fragment_text, lines) == ["Hi ", None, "you", None, None, None, None]
    assert run(spark, X.rate_limited, ["HTTP 429", "Rate limit", "ok", None]) == [True, True, False, False]


def test_tokens(spark):
    assert run(spark, T.word_tokens, ["The cat, a CAT's 2nd x-ray é", "", None]) == [["cat", "cat", "2nd", "ray"], [], None]
    assert run(spark, T.sequence_tokens, ["The cat a"]) == [["the", "cat"]]
    assert run(spark, T.letter_tokens, ["It's a b2 naïve test_x Done."]) == [["it", "s", "a", "done"]]
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.word_ngrams(F.col("t"), 1, 2)).collect()] == [["a", "b", "c", "a b", "b c"], ["a"], []]
    assert run(spark, lambda c: T.char_ngrams_of_word(c, 2, 4), ["ab", "a"]) == [[" a", "ab", "b ", " ab", "ab ", " ab "], [" a", "a ", " a "]]


def naive_style(t):
    w, s = t.split(), [x.strip() for x in re.split(r"[.!?]+", t) if x.strip()]
    nw, nc, ns = max(len(w), 1), max(len(t), 1), max(len(s), 1)
    wl, sl = [len(x) for x in w] or [0], [len(x.split()) for x in s] or [0]
    mean = lambda a: sum(a) / len(a)
    std = lambda a: math.sqrt(mean([(x - mean(a)) ** 2 for x in a]))
    return [nc, nw, mean(wl), std(wl), len(set(w)) / nw, ns, mean(sl), std(sl), sum(c in ".,;:!?-" for c in t) / nc, sum(c.isdigit() for c in t) / nc, sum(c.isupper() for c in t) / nc, t.count(",") / nw, t.count(".") / ns]


def test_style(spark):
    texts = [x or "" for x in EDGES] + ["One, two. THREE four-5! É 77?", "a\tb\nc  d"]
    got = style_features(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert [r[c] for c in COLUMNS] == pytest.approx(naive_style(t)), t


def test_behaviour(spark):
    df = spark.createDataFrame([(1, "the cat saw the cat run"), (2, "one"), (3, ""), (4, None)], "d int, t string")
    a = T.letter_tokens(F.col("t"))
    w = {r.doc: r for r in B.word_measures(df, "d", a).collect()}
    assert set(w) == {1, 2} and w[1].n_tokens == 6 and w[1].hapax_share == pytest.approx(2 / 6)
    assert w[1].entropy == pytest.approx(-2 * (2 / 6) * math.log2(2 / 6) - 2 * (1 / 6) * math.log2(1 / 6))
    b = {r.doc: r for r in B.bigram_measures(df, "d", a).collect()}
    assert set(b) == {1} and b[1].bigram_ratio == pytest.approx(4 / 5)
    p = [(2 + 1) / (2 + 4)] * 2 + [(1 + 1) / (2 + 4), (1 + 1) / (1 + 4), (1 + 1) / (2 + 4)]
    assert b[1].perplexity == pytest.approx(2 ** (-sum(math.log2(x) for x in p) / 5))
    rep = {r.doc: r.repetition_distance for r in B.repetition_distance(df, "d", a).collect()}
    assert rep == {1: 3.0, 2: 0.0}
    s = B.rank_shares(df, "d", a, B.bigram_ranks(df, "d", a)).collect()
    assert [tuple(r)[1:] for r in s] == [(1.0, 0.0, 0.0, 0.0)]
    t = B.trigram_density(spark.createDataFrame([("aaaa",), ("ab",), ("a b a b",)], "t string"), "t")
    assert [r.trigram_density for r in t.collect()] == [0.5, 0.0, pytest.approx(4 / 5)]


def test_vocabulary_order_and_transform(spark):
    df = spark.createDataFrame([(1, "bb aa cc"), (2, "aa bb dd"), (3, "dd")], "d int, t string")
    t = T.sequence_tokens(F.col("t"))
    m = V.fit_words(df, "d", t, 10, 1, 1.0)
    assert [r.term for r in m.table.orderBy("idx").collect()] == ["bb", "aa", "dd", "cc"]
    x = V.tf_idf(V.token_counts(df, "d", t), m)
    norms = x.groupBy("doc").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    ids = V.sequence_ids(spark.createDataFrame([(1, "dd zz bb"), (2, ""), (3, None)], "d int, t string"), "d", t, m, 5)
    assert {r.doc: list(r.ids) for r in ids.collect()} == {1: [4, 1, 2, 0, 0], 2: [0] * 5, 3: [0] * 5}
    s = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "d int, a double, b double")
    assert [tuple(r) for r in V.scale(s, ["a", "b"], V.fit_scaler(s, ["a", "b"])).orderBy("d").collect()] == [(1, -1.0, 0.0), (2, 1.0, 0.0)]


def test_features_do_not_depend_on_the_scored_rows(spark):
    rows = [(i, f"Word{i % 5} same text, number {i}.") for i in range(20)]
    df = spark.createDataFrame(rows, "d int, t string")
    m = V.fit_features(df, "d", "t", 20, 30)
    one = V.features_of(df.where("d = 3"), "d", "t", m).select("idx", F.round("value", 9).alias("v")).collect()
    all_ = V.features_of(df, "d", "t", m).where("doc = 3").select("idx", F.round("value", 9).alias("v")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, all_)) and len({r[0] for r in all_}) == len(all_)


def test_splits_and_folds(spark):
    rows = [(i, c) for i, c in enumerate(["a"] * 11 + ["b"] * 2 + ["c"] + [None] * 12)]
    df = spark.createDataFrame(rows, "i int, c string").repartition(5)
    s = P.stratified_split(df, "i", "c", 0.2).groupBy("c").agg(F.count_if(F.col("part") == "test").alias("n")).collect()
    assert dict(map(tuple, s)) == {"a": 2, "b": 1, "c": 1, None: 2}
    f = P.stratified_folds(df, "i", "c", 3).groupBy("c", "fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in f if r["c"] == "a") == [(0, 4), (1, 4), (2, 3)]
    assert P.stratified_folds(df, "i", "c", 3).count() == len(rows)
    ranks = [r.rank for r in P.global_rank(df, [F.col("i")]).orderBy("i").collect()]
    assert ranks == list(range(1, len(rows) + 1))
    b = P.mini_batches(df, "i", 10).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [6, 10, 10]
    cut = {r.i for r in P.first_in_order(df, "i", 5).collect()}
    assert cut < {r.i for r in P.first_in_order(df, "i", 9).collect()}
    assert P.cap_class_share(df, "i", "c", "a", 0.29).where("c = 'a'").count() == int(0.29 * 15 / 0.71)


def test_relational(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, None), (None, 3, "y"), (None, 3, "z")], "k string, o int, v string")
    assert sorted(map(str, R.first_per_key(df, ["k"], ["o", "v"]).collect())) == sorted(map(str, [("k", 1, None), (None, 3, "y")])) or {tuple(r) for r in R.first_per_key(df, ["k"], ["o", "v"]).collect()} == {("k", 1, None), (None, 3, "y")}
    h = R.histogram(spark.createDataFrame([(60.0,), (140.0,), (141.0,), (None,), (63.4,)], "v double"), F.col("v"), 60, 140, 24)
    assert {tuple(r) for r in h.collect()} == {(0, 1), (23, 1), (1, 1)}
    hist = spark.createDataFrame([(1, e, v) for e, v in enumerate([5.0, 4.0, 4.5, 3.0, 3.0])], "m int, e int, v double")
    assert [r.waited for r in R.running_best(hist, ["m"], "e", "v").orderBy("e").collect()] == [0, 0, 1, 0, 1]
    many = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(None, 99)], "k int, i int")
    one = spark.createDataFrame([(0, 10, "a"), (1, 10, "b")], "k int, n int, v string")
    assert salted_join(many, one, "k", "n", "i", key_rows=3).count() == 20


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 1), (None, 4), (7, 8), (8, 9), (9, 20), (20, 21)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 5: 5, 7: 7, 8: 7, 9: 7, 20: 7, 21: 7}
    for one_task in (1000, 0):
        got = connected_components(df, Scratch(spark, "t"), one_task)
        assert {r.id: r.component for r in got.collect()} == want
    chain = spark.range(0, 300).selectExpr("id as u", "id + 1 as v").repartition(4)
    assert connected_components(chain, Scratch(spark, "t"), 0).where("component <> 0").count() == 0
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def predictions(spark):
    rows = []
    gold = ["Human", "Meta", "OpenAI", "Google"]
    said = {"m1": ["Human", "Meta", None, "Meta"], "m2": ["Meta", "Meta", "", "Google"], "m3": [None, "Human", None, "Google"]}
    for k, m in enumerate(said):
        rows += [(str(i), m, k, p, g) for i, (p, g) in enumerate(zip(said[m], gold))]
    return spark.createDataFrame(rows, "id string, model string, ord int, pred string, gold string")


def test_votes(spark):
    p = predictions(spark).withColumn("pred", F.nullif("pred", F.lit("")))
    assert {r.id: r.vote for r in E.vote(p).collect()} == {"0": "Human", "1": "Meta", "2": "Human", "3": "Google"}
    acc = {r.model: (r.accuracy, r.valid_accuracy) for r in E.accuracy(p).collect()}
    assert acc["m1"] == (0.5, pytest.approx(2 / 3)) and acc["m3"] == (0.5, 0.5)
    assert sum(r.n for r in E.confusion(p).collect()) == 12 and E.confusion(p).count() == 75
    w = E.weights(E.accuracy(p), 2).collect()
    assert sum(r.weight for r in w) == pytest.approx(1)
    b = E.any_right(p).first()
    assert (b.n, b.right) == (4, 3)
    m = {r.id: r for r in E.meta_features(p).collect()}
    assert len(m["0"].one_hot) == 15 and m["2"].agreement == 1.0 and m["2"].vote_entropy == 0.0
    assert {r.model: r.n for r in E.rescues(p, "m1").collect()} == {"m2": 1, "m3": 1, "nobody": 1}
    assert {r["class"] for r in E.report(p).collect()} >= {"macro avg", "weighted avg", "Anthropic"}


def test_network(spark):
    x = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, -1.0)], "doc int, idx int, value double")
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 0, 0.5), (1, 1, 1.0)], "idx int, j int, w double")
    b = spark.createDataFrame([(0, 0.0), (1, 0.5)], "j int, b double")
    got = {(r.doc, r.idx): r.p for r in M.network(x, [(w, b)]).collect()}
    z = [2.0, 1.5]
    assert got[(1, 0)] == pytest.approx(math.exp(z[0]) / sum(map(math.exp, z)))
    assert got[(2, 0)] + got[(2, 1)] == pytest.approx(1)


def test_trainer_learns():
    import numpy as np

    from corpusmill.operators.train import Config, Network

    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    for c in (Config((16,), 0.01, epochs=30), Config((16,), 0.05, "sgd", epochs=30), Config((16,), 0.01, dropout=0.2, epochs=40)):
        n = Network(4, 2, c).fit(x[:200], y[:200], x[200:], y[200:])
        assert (n.probabilities(x[200:]).argmax(1) == y[200:]).mean() > 0.9
    n = Network(3, 2, Config((5,)))
    xs, ys = r.normal(size=(6, 3)), np.array([0, 1, 0, 1, 1, 0])
    g = n._gradients(xs, ys)
    for i in range(len(n.params)):
        at = tuple(0 for _ in n.params[i].shape)
        n.params[i][at] += 1e-6
        up = n.loss(n.probabilities(xs), ys)
        n.params[i][at] -= 2e-6
        down = n.loss(n.probabilities(xs), ys)
        n.params[i][at] += 1e-6
        assert g[i][at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_sources(spark, tmp_path):
    from corpusmill.sources import io

    p = tmp_path / "a.csv"
    p.write_text('﻿ID;Text;Labels\n1;"a ""q"" ;\nb";NA\n2;;Meta\n', encoding="utf-8")
    df = io.read_csv(spark, str(p))
    assert df.columns == ["id", "text", "label"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "q" ;\nb', None), ("2", None, "Meta")]
    with pytest.warns(UserWarning):
        both = io.read_all(spark, [str(p), str(tmp_path / "no.csv")], ["id", "label"])
    assert both.count() == 2
    io.write_csv(df, str(tmp_path / "out"), safe="text")
    assert io.read_csv(spark, str(tmp_path / "out")).where("id = 1").first().text == 'a "q" , b'
    (tmp_path / "l.txt").write_text(" x \n\n y\n", encoding="utf-8")
    assert {r.term for r in io.read_lines(spark, str(tmp_path / "l.txt")).collect()} == {"x", "y"}
    assert io.known_keys(spark, str(tmp_path / "none.csv"), "id").count() == 0
    (tmp_path / "v.txt").write_text("cat 0.5 1\nbad\n", encoding="utf-8")
    assert [tuple(r) for r in io.read_vectors(spark, str(tmp_path / "v.txt")).collect()] == [("cat", [0.5, 1.0])]
    (tmp_path / "c.json").write_text('{"D1": "Meta", "D2": null}', encoding="utf-8")
    assert {tuple(r) for r in io.read_checkpoint(spark, str(tmp_path / "c.json")).collect()} == {("D1", "Meta"), ("D2", None)}


def test_remote(spark):
    from corpusmill.sources import remote

    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise ValueError("no")
        return "Meta"

    assert remote.with_retries(flaky, sleep=waits.append)("x") == "Meta" and waits == [5.0, 10.0]
    assert remote.with_retries(lambda p: 1 / 0, 2, sleep=waits.append)("x").startswith("Error")

    def limited(p):
        raise remote.RateLimited()

    assert remote.Rotation([limited, lambda p: "ok"], sleep=waits.append)("x") == "ok"
    with pytest.raises(remote.RateLimited):
        remote.Rotation([limited], sleep=lambda s: None)("x")
    prompts = spark.createDataFrame([("1", "google"), ("2", "none"), ("3", "HUMAN")], "id string, prompt string")
    done = spark.createDataFrame([("3", "m")], "id string, model string")
    assert {tuple(r) for r in remote.classify(prompts, str, "m", done).collect()} == {("1", "m", "Google"), ("2", "m", None)}
    page = '<div class="toc x"><p>a contents box that is long enough</p></div><p>First &amp; long enough paragraph <b>of text<sup>[1]</sup> here.<p>tiny<table><p>in a table, and long enough to count</table><p>Second paragraph, long enough to be kept'
    assert remote.page_paragraphs(page) == "First & long enough paragraph of text here. Second paragraph, long enough to be kept"


def test_stream(spark, tmp_path):
    from corpusmill.streaming.incremental import score_stream

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([("1", "meta"), ("2", None), ("1", "meta")], "id string, raw string").coalesce(1).write.parquet(src)
    score = lambda b: b.select("id", X.answer_label(F.col("raw")).alias("label"))
    for more in (None, [("2", "google"), ("3", "human")]):
        if more:
            spark.createDataFrame(more, "id string, raw string").coalesce(1).write.mode("append").parquet(src)
        score_stream(spark, src, "id string, raw string", score, out, ck).awaitTermination()
    assert {(r.id, r.label) for r in spark.read.parquet(out).collect()} == {("1", "Meta"), ("2", None), ("3", "Human")}


def test_registry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

