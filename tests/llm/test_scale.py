"""What is to hold at any size: band plans, packed entries, bounded chance meetings, hot keys spread."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import leaks, neardup, overlap, packed

from .plain import likeness, sentence_maker, words
from .test_found import frame, naive_leaks, near_rows, pairs


def test_packed_entries_come_back():
    r = np.random.default_rng(1)
    key = r.integers(0, 2**63, 3000).astype(np.uint64)
    for ref in (np.repeat(np.arange(-5, 295), 10), r.integers(-2**62, 2**62, 3000), np.repeat([3, 2**40], 1500), np.repeat(r.integers(-2**62, 2**62, 10), 300), np.tile(np.array([-2**63, 0, 2**63 - 1]), 1000)):
        b = packed.pack(key, ref.astype(np.int64), 16, 1)
        got = []
        for part in range(16):
            rem, row, kind = packed.unpack(pa.Table.from_batches([b]).filter(pa.compute.field("part") == part))
            assert (kind == 1).all()
            got += zip(rem.tolist(), [part] * len(rem), row.tolist())
        assert sorted(got) == sorted(zip((key >> np.uint64(32)).tolist(), (key & np.uint64(15)).tolist(), ref.tolist()))
    assert packed.pack(key[:0], np.zeros(0, np.int64), 16).num_rows == 0


def test_met_in_slices():
    r = np.random.default_rng(2)
    left, right = (r.integers(0, 30, 200).astype(np.uint32), r.integers(0, 50, 200)), (r.integers(0, 40, 100).astype(np.uint32), r.integers(0, 50, 100))
    want = sorted({(int(a), int(b)) for k, a in zip(*left) for m, b in zip(*right) if k == m})
    for most in (1, 7, 10_000):
        assert sorted(zip(*(x.tolist() for x in packed.met(left, right, most)))) == want


def test_bands_keep_the_recall():
    """Pairs at exactly the threshold, by simulated agreement of codes, for every width in use."""
    r = np.random.default_rng(3)
    for codes in (4, 6, 8, 10):
        columns = packed.band_columns(codes, packed.bands_for(codes))
        agree = r.random((4000, packed.WIDTH)) < 0.7
        missed = np.ones(len(agree), dtype=bool)
        for c in columns:
            missed &= ~agree[:, c].all(axis=1)
        assert missed.mean() <= 0.004
    assert [packed.codes_for(n) for n in (0, 175_000, 175_001, 60_000_000)] == [4, 6, 7, 9]


def test_chance_meetings_do_not_grow(spark):
    """Unrelated texts over one small vocabulary: candidates a row stay bounded as the rows grow fourfold and again."""
    r, make = sentence_maker(21, 700)
    texts = [" ".join(make(60)) for _ in range(16_000)]
    a_row = []
    for n in (1_000, 4_000, 16_000):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "row_id bigint, text string").repartition(4)
        table = rows.mapInArrow(neardup.sketches(20), neardup._SKETCHES).cache()
        codes = packed.codes_for(n)
        a_row.append(neardup.candidates(table, codes, packed.bands_for(codes)).where("b is not null").distinct().count() / n)
        table.unpersist()
    assert max(a_row) < 7


@pytest.mark.parametrize("codes", [4, 9])
def test_overlap_with_any_width(spark, codes):
    """Few and many blocks a text find the same pairs."""
    rows = near_rows(25, 25)
    tests = [(f"T{i}", t) for i, t in enumerate(rows[::4])]
    want = {(i, k) for i, t in enumerate(rows) for k, u in tests if t and u and len(set(words(t))) >= 20 and len(set(words(u))) >= 20 and likeness(words(t), words(u)) >= 0.7}
    train, test = frame(spark, [(i, t, None, None) for i, t in enumerate(rows)]), spark.createDataFrame(tests, "id string, text string")
    assert pairs(overlap.overlapping_pairs(train, test, codes=codes), "row_id", "test_id") == want


def test_overlap_of_crowded_blocks(spark):
    """A third of the rows share their blocks; the crowded ones come through the lists."""
    rows = near_rows(23, 20)
    hot = rows[0] if rows[0] and len(set(words(rows[0]))) >= 20 else next(t for t in rows if t and len(set(words(t))) >= 20)
    rows += [f"{hot} extra{i}" for i in range(40)]
    tests = [(f"T{i}", t) for i, t in enumerate(rows[::3])]
    want = {(i, k) for i, t in enumerate(rows) for k, u in tests if t and u and len(set(words(t))) >= 20 and len(set(words(u))) >= 20 and likeness(words(t), words(u)) >= 0.7}
    train = frame(spark, [(i, t, None, None) for i, t in enumerate(rows)])
    test = spark.createDataFrame(tests, "id string, text string")
    assert pairs(overlap.overlapping_pairs(train, test, local=3), "row_id", "test_id") == want


@pytest.mark.parametrize("n,local", [(1, 64), (5, 2), (16, 0), (40, 64)])
def test_leaks_of_any_length(spark, monkeypatch, n, local):
    monkeypatch.setattr(leaks, "LOCAL", local)
    monkeypatch.setattr(leaks, "SHARD_ROWS", 50)
    r, make = sentence_maker(24, 300 if n > 5 else 4000)
    tests = [(f"T{i}", " ".join(make(60))) for i in range(8)] + [("T0", "a b c"), ("E", "")]
    docs = []
    for i in range(40):
        w, t = make(r.randint(0, 80)), words(tests[i % 8][1])
        k = r.randint(0, 60)
        docs.append((i, " ".join(w[:20] + (t[:k] if i % 2 else t[-k:]) * (i % 4 > 0) + w[20:])))
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(tests, "id string, text string")
    want = naive_leaks(docs, tests, n)
    assert pairs(leaks.leaked_pairs(d, t, n), "doc_id", "test_id") == want
    text, items = dict(docs), {}
    for k, u in tests:
        items.setdefault(k, []).append(words(u))
    long = leaks.longest_matches(d, t, n).collect()
    assert {(x.doc_id, x.test_id) for x in long} == want
    for x in long:  # no longer run exists, and the places hold it
        w = words(text[x.doc_id])
        run = w[x.doc_word:x.doc_word + x.match_words]
        assert any(u[x.test_word:x.test_word + x.match_words] == run for u in items[x.test_id])
        longer = {tuple(u[i:i + x.match_words + 1]) for u in items[x.test_id] for i in range(len(u) - x.match_words)}
        assert not any(tuple(w[i:i + x.match_words + 1]) in longer for i in range(len(w) - x.match_words))


def test_copies_behind_a_long_prefix(spark):
    """Records that share thousands of bytes are split on until they end."""
    from corpusmill.llm import copies

    rows = [(i, None, "á" * 5000 + f" end{i % 9}" + "z" * (i % 3)) for i in range(54)] + [(100 + i, None, "b" * 700) for i in range(20)]
    by = {}
    for i, _, t in rows:
        by.setdefault(t, []).append(i)
    want = {(min(v), i) for v in by.values() for i in v}
    df = spark.createDataFrame(rows, "row_id bigint, termo string, text string").repartition(4)
    assert pairs(copies.copy_sets(df, bucket_rows=2), "first_row_id", "row_id") == want


def test_hot_code_is_spread(spark):
    """One key on a third of the rows: no task of the salted join gets more than a few times the bound."""
    from corpusmill.operators.skew import salted_join

    many = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        got = salted_join(many, one, "k", "n", "id", key_rows=100)
        most = got.where("k = -1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert got.count() == 9000 and got.where("v <> 2 * k").isEmpty()
        assert most <= 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
