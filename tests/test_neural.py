"""Named networks: forward passes against step-by-step versions, gradients against differences, batches, vectors, subwords."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import neural, train


def _weights(r, *shapes):
    return {k: r.normal(0, 0.5, s) for k, s in shapes}


@pytest.mark.parametrize("name", list(neural.TABULAR))
def test_tabular_training_and_rebuilding(name):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (90, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    c = train.Config(lr=0.01, epochs=12, batch=30, patience=30, plateau=2, l2=1e-3)
    net = neural.TabularNetwork(name, 6, 3, c).fit(x, y, x, y)
    assert min(h["val_loss"] for h in net.history) < net.history[0]["val_loss"]
    p = neural.rebuild(name, net.weights())(x)
    assert p == pytest.approx(net.probabilities(x), abs=1e-9)  # the restored best epoch, normalisation folded in
    assert net.loss(p, y) == pytest.approx(min(h["val_loss"] for h in net.history), abs=1e-9)


def test_tabular_gradients(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setitem(neural.TABULAR, "Small", neural.Tabular((5, 4), (0.0, 0.0), "elu"))
    net = neural.TabularNetwork("Small", 3, 2, train.Config())
    x, y = r.normal(0, 1, (7, 3)), r.integers(0, 2, 7)
    g = net._gradients(x, y)
    for k, p in enumerate(net.params):
        at = tuple(r.integers(0, s) for s in p.shape)
        old = p[at]
        losses = []
        for e in (1e-5, -1e-5):
            p[at] = old + e
            losses.append(net.loss(net._forward(x, True)[0], y))
        p[at] = old
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-5)


def _steps(x, w, p, kind):
    """One row, one step, one unit at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    units = w[p + "wh"].shape[0]
    h, c = np.zeros(units), np.zeros(units)
    for v in x:
        a, b = v @ w[p + "wi"] + w[p + "bi"], h @ w[p + "wh"] + w[p + "bh"]
        new = np.zeros(units)
        for k in range(units):
            if kind == "lstm":
                i, f, g, o = (a[k + q * units] + b[k + q * units] for q in range(4))
                c[k] = sig(f) * c[k] + sig(i) * np.tanh(g)
                new[k] = sig(o) * np.tanh(c[k])
            else:
                rr, z = sig(a[k] + b[k]), sig(a[k + units] + b[k + units])
                new[k] = (1 - z) * np.tanh(a[k + 2 * units] + rr * b[k + 2 * units]) + z * h[k]
        h = new
        yield h


@pytest.mark.parametrize("name,kind,gates", [("BiLSTM", "lstm", 4), ("BiGRU", "gru", 3), ("BiLSTMVectors", "lstm", 4)])
def test_recurrent(name, kind, gates):
    r, units = np.random.default_rng(3), 3
    w = {"embedding": r.normal(0, 1, (9, 5))}
    for k in range(2):
        for d in ("", "back."):
            n = 5 if k == 0 else 2 * units
            w |= _weights(r, (f"layer{k}.{d}wi", (n, gates * units)), (f"layer{k}.{d}wh", (units, gates * units)), (f"layer{k}.{d}bi", gates * units), (f"layer{k}.{d}bh", gates * units))
    w |= _weights(r, ("head.0.w", (2 * units, 4)), ("head.0.b", 4))
    ids = np.array([[3, 1, 8, 0, 0], [2, 2, 2, 2, 2]])
    table = w["embedding"].copy()
    table[0] = 0
    for row, p in zip(ids, neural.rebuild(name, w)(ids.astype(float))):
        x = table[row]
        for k in range(2):
            there, back = list(_steps(x, w, f"layer{k}.", kind)), list(_steps(x[::-1], w, f"layer{k}.back.", kind))
            x = np.array([np.concatenate((a, b)) for a, b in zip(there, back[::-1])])
        z = np.concatenate((there[-1], back[-1])) @ w["head.0.w"] + w["head.0.b"]
        assert p == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-12)


def test_encoder_ignores_padding_and_pooling_does():
    r, width = np.random.default_rng(4), 8
    w = _weights(r, ("embedding", (12, width)), ("position", (6, width)), ("embedding.gamma", width), ("embedding.beta", width), ("head.0.w", (width, 4)), ("head.0.b", 4), ("head.1.w", (4, 3)), ("head.1.b", 3))
    p = "layer0."
    w |= _weights(r, *[(p + c + "w", (width, width)) for c in "qkvo"], *[(p + c + "b", width) for c in "qkvo"], (p + "upw", (width, 16)), (p + "upb", 16), (p + "downw", (16, width)), (p + "downb", width), *[(p + n + g, width) for n in ("attended.", "fed.") for g in ("gamma", "beta")])
    net = neural.rebuild("Encoder", w, layers=1, heads=2)
    short, long = np.array([[5, 7, 2]]), np.array([[5, 7, 2, 0, 0]])
    assert net(short) == pytest.approx(net(long), abs=1e-9) and net(short).sum() == pytest.approx(1)
    x = w["embedding"][short[0]] + w["position"][:3]  # attention of the first token, head by head
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True) * w["embedding.gamma"] + w["embedding.beta"]
    q, k, v = (x @ w[p + c + "w"] + w[p + c + "b"] for c in "qkv")
    a = []
    for h in (slice(0, 4), slice(4, 8)):
        s = np.exp([q[0, h] @ k[j, h] / 2 for j in range(3)])
        a.append(sum(s[j] / s.sum() * v[j, h] for j in range(3)))
    ln = lambda u, n: (u - u.mean()) / u.std() * w[p + n + "gamma"] + w[p + n + "beta"]
    y = ln(x[0] + np.concatenate(a) @ w[p + "ow"] + w[p + "ob"], "attended.")
    y = ln(y + neural.activate(y @ w[p + "upw"] + w[p + "upb"], "gelu") @ w[p + "downw"] + w[p + "downb"], "fed.")
    z = np.maximum(y @ w["head.0.w"] + w["head.0.b"], 0) @ w["head.1.w"] + w["head.1.b"]
    assert net(short)[0] == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-9)

    e = _weights(r, ("embedding", (12, width)), ("head.0.w", (width, 3)), ("head.0.b", 3))
    pooled = neural.rebuild("EmbeddingDNN", e)
    assert pooled(short) == pytest.approx(pooled(long))
    z = e["embedding"][[5, 7, 2]].mean(axis=0) @ e["head.0.w"] + e["head.0.b"]
    assert pooled(short)[0] == pytest.approx(np.exp(z) / np.exp(z).sum())
    z = e["head.0.b"]
    assert pooled(np.zeros((1, 4)))[0] == pytest.approx(np.exp(z) / np.exp(z).sum())
    with pytest.raises(ValueError):
        neural.rebuild("DNNHuge", e)


def test_batched_inference(spark):
    r = np.random.default_rng(5)
    net = neural.TabularNetwork("DNNSimple", 4, 3, train.Config())
    x = r.normal(0, 1, (300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id bigint, f array<double>").repartition(3)
    got = {row.id: row for row in neural.predict(df, "id", "f", 4, "DNNSimple", net.weights(), batch=64).collect()}
    p = net.probabilities(x)
    assert set(got) == set(range(300))
    assert all(got[i].p == pytest.approx(p[i]) and got[i].pred == p[i].argmax() for i in range(300))


def test_embedding_rows(spark):
    voc = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "term string, idx int")
    known = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("c", [1.0])], "word string, vector array<double>")
    got = {r.idx: r.vector for r in neural.vectors_of(voc, known, 3).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0] == [0, 0, 0] and got[2] == [1, 2, 3]
    wide = neural.vectors_of(spark.range(2, 202).select(F.concat(F.lit("w"), "id").alias("term"), F.col("id").cast("int").alias("idx")), known, 50).where("idx > 0")
    v = np.array([r.vector for r in wide.collect()])
    assert abs(v.mean()) < 0.03 and abs(v.std() - 0.6) < 0.03 and len(np.unique(v)) == v.size


def test_schedules():
    r = np.random.default_rng(6)
    x, y = r.normal(0, 1, (40, 2)), r.integers(0, 2, 40)
    net = train.Network(2, 2, train.Config((3,), 0.1, "sgd", momentum=0.0, epochs=5, batch=10, warmup=0.1, clip=1e-3, best="acc"))
    rates = []
    step = net._step
    net._step = lambda g: (rates.append(net.rate), step(g))[1]
    before = [p.copy() for p in net.params]
    net.fit(x, y)
    assert rates[0] == pytest.approx(0.5) and rates[1] == pytest.approx(1) and rates[-1] == pytest.approx(1 / 18) and len(rates) == 20
    assert sum(((a - b) ** 2).sum() for a, b in zip(before, net.params)) ** 0.5 <= 0.1 * 1e-3 * sum(rates) + 1e-9
    flat = train.Network(2, 2, train.Config((3,), 0.0, "sgd", epochs=9, batch=40, plateau=2, patience=99)).fit(x, y, x, y)
    assert flat.rate == pytest.approx(0.25)  # halved after every third epoch without a lower loss


def test_retraining_is_compared(spark):
    r = np.random.default_rng(7)
    rows = [(role, v.tolist(), int(v[0] > 0)) for role, n in (("train", 60), ("val", 20), ("test", 20)) for v in r.normal(0, 1, (n, 2))]
    df = spark.createDataFrame(rows, "role string, features array<double>, y int")
    cv = df.where("role = 'train'").selectExpr("explode(array(0, 1)) AS run", "if(pmod(xxhash64(features), 2) = run, 'val', 'train') AS role", "features", "y")
    configs = [train.Config((4,), 0.05, epochs=15), train.Config((4,), 1e-6, epochs=2)]
    history = train.cross_validate(cv, configs, 2, 2)
    got = {x.config: x for x in train.retrain_all(df, configs, 2, 2, history).collect()}
    assert got[0].test_acc > 0.8 and got[0].cv_acc > 0.8 and set(got) == {0, 1}
    curve = train.learning_curve(history).where("config = 0").orderBy("epoch").collect()
    assert [x.epoch for x in curve] == list(range(len(curve))) and curve[-1].val_loss < curve[0].val_loss


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no public tokenizer files")
def test_subword_ids(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = [(1, "The cell grows <|endoftext|> ç"), (2, None), (3, "word " * 300), (4, "")]
    got = {r.id: r for r in neural.subword_ids(spark.createDataFrame(texts, "id bigint, text string"), "id", "text", path, 16, 7, 8, 9).collect()}
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for i, x in texts:
        ids = [7, *t.encode(x or "", add_special_tokens=False).ids[:14], 8]
        assert got[i].ids == ids + [9] * (16 - len(ids)) and got[i].mask == [1] * len(ids) + [0] * (16 - len(ids))
