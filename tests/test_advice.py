"""Whole jobs where a cut was made before: every row, class or configuration, on small literals."""

import numpy as np
import pytest


def _votes(spark, n):
    """More items than the former cap of 120, with few distinct rows and one class of a single row."""
    rows = [(f"i{k:03d}", [float(k % 2), float(k % 3)], k % 2 if k else 2) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id string, features array<double>, y int")


def test_leave_one_out_of_every_row(spark):
    from corpusmill.operators import train

    rows, df = _votes(spark, 130)
    c = train.Config((3,), 0.05, epochs=2)
    got = {r.id: r for r in train.leave_one_out(df, c, 2, 3, 4).collect()}
    assert set(got) == {i for i, _, _ in rows}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    x, y = np.array([r[1] for r in order]), np.array([r[2] for r in order])
    for i in range(0, 130, 13):  # row by row, each with its own fit
        rest = np.arange(130) != i
        assert got[order[i][0]].pred == train.Network(2, 3, c).fit(x[rest], y[rest]).probabilities(x[i:i + 1]).argmax()


def test_leave_one_out_regression(spark):
    from corpusmill.operators import train

    rows, df = _votes(spark, 130)
    got = {r.id: r for r in train.leave_one_out_regression(df, 2, 3, groups=4).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert got["i000"].pred != 2  # its class has no other row
    assert all(got[i].pred == y for i, _, y in rows[1:])
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = train._newton(x, y, np.ones(len(x)), 3, 1.0)
    p = np.exp(np.hstack((x, np.ones((len(x), 1)))) @ w)
    p /= p.sum(axis=1, keepdims=True)
    assert x.T @ (p - np.eye(3)[y]) + w[:-1] == pytest.approx(0, abs=1e-4)  # the penalised optimum
    assert (p - np.eye(3)[y]).sum(axis=0) == pytest.approx(0, abs=1e-4)


def test_every_combination_is_ranked(spark):
    from collections import Counter

    from corpusmill.operators import corpora, train

    r = np.random.default_rng(5)
    own = {"A": ["ab", "cd"], "B": ["ef", "gh"], "C": ["ij", "kl"]}
    sources = {"h1": "A", "h2": "A", "o1": "B", "o2": "B", "g1": "C"}
    say = lambda k: " ".join(r.choice([*own[k], "so", "on", "up", *own["ABC"[r.integers(3)]]], 5))
    rows = [(s, k, say(k)) for s, k in sources.items() for _ in range(12)] + [("other", "A", "ab")]
    tests = [(k, say(k)) for k in "ABC" for _ in range(15)]
    combos = [(f"{h} + {o} + g1", [h, o, "g1"]) for h in ("h1", "h2") for o in ("o1", "o2")]
    from pyspark.sql import functions as F

    got = corpora.rank_combinations(spark.createDataFrame(rows, "source string, class string, text string"), spark.createDataFrame(tests, "class string, text string"), combos, F.split("text", " "), ["A", "B", "C", "D"], max_features=7, tolerance=1e-5)
    got = {x.combo: x for x in got.collect()}
    assert set(got) == {c for c, _ in combos} and all(x.converged and x.n == 45 for x in got.values())
    for combo, parts in combos:  # one by one, solved by Newton steps
        mine = [x for x in rows if x[0] in parts]
        tf = Counter(w for _, _, t in mine for w in t.split(" "))
        df = Counter(w for _, _, t in mine for w in set(t.split(" ")))
        terms = sorted(tf, key=lambda w: (-tf[w], w))[:7]
        def tfidf(texts):
            x = np.array([[t.split(" ").count(w) * (np.log((1 + len(mine)) / (1 + df[w])) + 1) for w in terms] for t in texts])
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        w = train._newton(tfidf([t for _, _, t in mine]), np.array(["ABC".index(k) for _, k, _ in mine]), np.ones(len(mine)), 3, 1.0)
        said = (tfidf([t for _, t in tests]) @ w[:-1] + w[-1]).argmax(axis=1)
        assert got[combo].hits == sum("ABC"[p] == k for p, (k, _) in zip(said, tests))


def test_adamw_and_the_whole_grid():
    from corpusmill.operators import train
    from corpusmill.plans.evaluation import grid_configs

    assert len({(c.optimizer, c.lr, c.dropout) for c in grid_configs()}) == 27
    with pytest.raises(ValueError):
        train.Network(2, 2, train.Config(optimizer="adagrad"))
    n = train.Network(2, 2, train.Config((), 0.1, "adamw", l2=0.5))
    w = n.params[0].copy()
    n._step([np.ones_like(p) for p in n.params])  # the first Adam step is lr; weights have decayed before it, biases not
    assert n.params[0] == pytest.approx(w * (1 - 0.1 * 0.5) - 0.1, abs=1e-6)
    assert n.params[1] == pytest.approx(-0.1, abs=1e-6)


def test_feature_rows_of_production_size(monkeypatch):
    import inspect

    from corpusmill.operators import vectorize
    from corpusmill.plans import features

    seen = {}

    def fit(*a, **k):
        b = inspect.signature(real).bind(*a, **k)
        b.apply_defaults()
        seen.update(b.arguments)
        raise StopIteration

    real = vectorize.fit_features
    monkeypatch.setattr(vectorize, "fit_features", fit)
    from unittest.mock import MagicMock

    monkeypatch.setattr("corpusmill.operators.sampling.stratified_split", MagicMock())
    monkeypatch.setattr(features, "F", MagicMock())
    monkeypatch.setattr(features.X, "canonical_label", MagicMock())
    with pytest.raises(StopIteration):
        features.feature_rows(MagicMock())
    assert (seen["word_features"], seen["char_features"]) == (3000, 2000)


def test_more_than_a_hundred_models_are_kept(spark):
    from corpusmill.plans.evaluation import _models

    assert len(_models(spark.range(101).selectExpr("concat('m', id) AS model"))) == 101
