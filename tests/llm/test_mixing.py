"""Token mixing: rates, caps, unreachable sources, the classifier's use, and the sketches' estimates."""

import re

import numpy as np

from corpusmill.llm import mixing, sketch
from corpusmill.llm.textcodes import word_sets

from .plain import sentence_maker

TOK = re.compile(r"\w+|[^\w\s]+")


def corpus(spark):
    r, make = sentence_maker(11, 200)
    own = {"a": make(40), "b": make(40), "c": make(40)}
    rows = []
    for i in range(300):
        s = r.choice(["a", "a", "a", "b", "c", "other", None])
        words = own.get(s or r.choice("ab"), make(40))
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 80))) + " é_1 ½...", s))
    rows += [(900, None, "a"), (901, "", "b"), (902, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


def test_mix(spark):
    rows, docs = corpus(spark)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.35, 4), ("c", 0.34, 1), ("none", 0.01, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    counts = {s: sum(len(TOK.findall(t or "")) for _, t, x in rows if x == s) for s in "abc"}
    total = sum(counts.values())
    want = {s for s, share, cap in (("a", 0.3, 1), ("b", 0.35, 4), ("c", 0.34, 1)) if counts[s] * cap < share * total} | {"none"}
    mix = mixing.fit_mix(docs, targets, sample_rows=150)
    rep = {r.source: r for r in mix.report().collect()}
    assert {s: rep[s].tokens for s in "abc"} == counts
    assert {s for s, r in rep.items() if not r.reachable} == want
    for s in "abc":
        if s not in want:
            assert abs(rep[s].reached_tokens - rep[s].wanted_tokens) < 0.02 * total
    drawn = {r.doc_id: r for r in mix.draw().collect()}
    assert set(drawn) == {i for i, _, _ in rows}
    caps = {"a": 1, "b": 4, "c": 1, "other": 0}
    assert all(0 <= r.repeats <= caps.get(r.source, 4) for r in drawn.values())


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    assert mixing.fit_mix(docs, targets).report().count() == 1
    assert mixing.unreachable_sources(docs, targets).count() == 0


def test_classifier_learns(spark):
    rows, docs = corpus(spark)
    w = mixing.fit_classifier(docs, ["a", "b", "c"], 250, 200)
    held = [(t, s) for i, t, s in rows if s in ("a", "b", "c") and t and len(t) > 60]
    p = mixing._softmax(mixing._features([t for t, _ in held]) @ w[:-1] + w[-1])
    assert np.mean([("a", "b", "c")[k] == s for k, (_, s) in zip(p.argmax(axis=1), held)]) > 0.9


def test_joint_estimate_is_near_the_likeness():
    r, make = sentence_maker(12, 5000)
    a = set(make(300))
    errors = []
    for share in (0.2, 0.5, 0.7, 0.9):
        keep = set(list(a)[: int(len(a) * share)])
        b = keep | set(make(len(a) - len(keep)))
        v, d, w = word_sets([" ".join(a), " ".join(b)])
        table = sketch.register_values(v, 384)
        k1, k2 = (table[w[d == i]].max(axis=0).astype(int) for i in (0, 1))
        j = sketch.joint_estimate(np.array([(d == 0).sum()]), np.array([(d == 1).sum()]), np.array([(k1 > k2).sum()]), np.array([(k1 < k2).sum()]), np.array([(k1 == k2).sum()]))[0]
        true = len(set(w[d == 0]) & set(w[d == 1])) / len(set(w))
        errors.append(abs(j - true))
    assert max(errors) < 0.09


def test_sketches_merge():
    v, d, w = word_sets(["a b c d", "c d e f g", "a b c d e f g"])
    t = sketch.register_values(v, 64)
    k = [t[w[d == i]].max(axis=0) for i in range(3)]
    assert (np.maximum(k[0], k[1]) == k[2]).all()
