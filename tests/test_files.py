"""Clients with a target, revisions, treebank tokens, dense rows, bounds that are errors, and shared folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import tokens as T
from corpusmill.operators import sampling, score, train
from corpusmill.sources import io, remote


def test_collect_until(spark, tmp_path):
    prompts = spark.createDataFrame([(f"i{k}", k, f"p{k}") for k in range(30)], "id string, ord int, prompt string").repartition(3)
    ok = F.col("ord") % 4 == 1
    got = remote.collect_until(prompts, str.upper, 5, ok, str(tmp_path / "a"))
    assert sorted((r.ord, r.raw) for r in got.collect()) == [(k, f"P{k}") for k in (1, 5, 9, 13, 17)]
    assert remote.collect_until(prompts, str, 50, ok, str(tmp_path / "b")).count() == 8  # prompts run out
    assert remote.collect_until(prompts.limit(0), str, 5, ok, str(tmp_path / "c")).count() == 0


def test_pages_before(spark):
    def client(term):
        if term == "broken":
            raise OSError("no answer")
        return [("2021-03-01", "new"), ("2020-01-01", "old"), ("2020-06-01", "last")] if term == "a" else [("2022-01-01", "late")]

    terms = spark.createDataFrame([("a",), ("b",), ("broken",), (None,)], "term string")
    assert [tuple(r) for r in remote.pages_before(terms, client, "2021-01-01").collect()] == [("a", "2020-06-01", "last")]


def test_treebank(spark):
    rows = {"They'll say \"no\" -- can't we?": ["They", "'ll", "say", "``", "no", "''", "--", "ca", "n't", "we", "?"],
            "I cannot, it's 3,000 (or so).": ["I", "can", "not", ",", "it", "'s", "3,000", "(", "or", "so", ")", "."]}
    df = spark.createDataFrame([(k,) for k in rows] + [("",), (None,)], "s string").select("s", T.treebank_tokens(F.col("s")).alias("t"), T.alphabetic_tokens(F.col("s")).alias("a"))
    got = {r.s: r for r in df.collect()}
    assert all(got[k].t == v for k, v in rows.items())
    assert got["I cannot, it's 3,000 (or so)."].a == ["i", "can", "not", "it", "or", "so"] and got[""].t == [] and got[None].t is None


def test_dense_rows(spark):
    f = spark.createDataFrame([(1, 2, 0.5), (1, 0, 2.0), (7, 3, 1.0)], "doc bigint, idx int, value double")
    assert {r.doc: r.features for r in train.dense_rows(f, 4).collect()} == {1: [2, 0, 0.5, 0], 7: [0, 0, 0, 1]}
    assert train.dense_rows(f.limit(0), 4).count() == 0


def test_bounds_are_errors(spark, monkeypatch):
    monkeypatch.setattr(train, "MOST_ROWS", 3)
    monkeypatch.setattr(train, "MOST_DISTINCT", 2)
    rows = spark.createDataFrame([(i, 0, "train", [float(i)], i % 2) for i in range(4)], "id int, run int, role string, features array<double>, y int")
    with pytest.raises(ValueError):
        train.cross_validate(rows, [train.Config()], 1, 2)
    with pytest.raises(ValueError):
        train.leave_one_out(rows, train.Config(), 1, 2)
    monkeypatch.setattr(score, "SENT_WEIGHTS", 1)  # the same sums by a shuffle
    x = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0)], "doc int, idx int, value double")
    w = spark.createDataFrame([(0, 0, 1.0), (1, 0, 10.0), (0, 1, -1.0)], "idx int, j int, w double")
    b = spark.createDataFrame([(0, 0.5), (1, 0.0)], "j int, b double")
    assert {(r.idx, r.value) for r in score.affine(x, w, b).collect()} == {(0, 32.5), (1, -2.0)}


def test_rank_over_many_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"), "id")
    got = sampling.global_rank(df, [F.desc("v")]).collect()
    assert sorted(r.rank for r in got) == list(range(1, 1001)) and all(r.rank == 1000 - r.v for r in got)
    part = sampling.keep_class_part(df.withColumn("c", (F.col("id") % 2).cast("string")), "id", "c", "1", 0.5)
    assert part.groupBy("c").count().orderBy("c").collect()[1]["count"] == 250


def test_a_shared_folder_is_asked_for(monkeypatch):
    from corpusmill.operators import scratch

    class Session:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        scratch.shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert scratch.shared_folder(Session)


def test_files_keep_white_space(spark, tmp_path):
    rows = [(1, "  led by spaces "), (2, "a\r\nb"), (3, 'q "x"; y'), (4, None)]
    io.write_csv(spark.createDataFrame(rows, "id int, text string"), str(tmp_path / "o"))
    assert {(int(r.id), r.text) for r in io.read_csv(spark, str(tmp_path / "o")).collect()} == set(rows)


def test_np_is_deterministic():
    a, b = (train.Network(2, 2, train.Config((3,), seed=4)).params for _ in range(2))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))
