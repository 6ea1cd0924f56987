"""The operators against row-by-row versions on small tables with nulls, ties, copies and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import copies, leaks, neardup, overlap, pieces, splits
from corpusmill.llm.textcodes import plain_letters, word_spans

from .plain import bare, groups, likeness, plain, sentence_maker, words

SCHEMA = "row_id bigint, text string, a string, id string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def pairs(df, *names):
    got = [tuple(r) for r in df.select(*names).collect()]
    assert len(got) == len(set(got)), "repeated rows"
    return set(got)


def near_rows(seed=1, n=60):
    """Texts with near copies at likeness about 0.6 to 1, exact copies, a hot text, nulls, blanks and a long text."""
    r, make = sentence_maker(seed)
    rows = []
    base = [make(r.randint(22, 60)) for _ in range(n)]
    for b in base:
        rows.append(" ".join(b))
        for _ in range(r.randint(0, 3)):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 5))):
                c[r.randrange(len(c))] = make(1)[0]
            r.shuffle(c)
            rows.append(" ".join(c).upper() if r.random() < 0.3 else ", ".join(c))
    rows += [rows[3]] * 40 + ["é é É", "", "   ", None, "a b c", " ".join(make(5000)), "𝔘𝔫 😀 ok"]
    r.shuffle(rows)
    return rows


def test_plain_form():
    texts = ["Ação É é ok_1 x²", "", "  ", "ÅNGSTRÖM—½ ño", "😀 Ⅷ 𝔘x", "a" * 3000 + " b"]
    doc, code = word_spans(texts)
    assert [sum(doc == i) for i in range(len(texts))] == [len(words(t)) for t in texts]
    assert plain_letters(texts) == [bare(t) for t in texts]
    same, _ = word_spans(["Ação", "acao"]), None
    assert same[1][0] == same[1][1]


@pytest.mark.parametrize("bucket,local", [(256, 64), (4, 100), (3, 2)])
def test_near_duplicate_groups(spark, bucket, local):
    """The same groups whether buckets are compared whole, as stars, or as stars before the shuffle."""
    rows = list(enumerate(near_rows(2)))
    sets = [(i, set(words(t))) for i, t in rows if t]
    sets = [(i, s) for i, s in sets if len(s) >= 20]
    want = groups([(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1:] if likeness(a, b) >= 0.7])
    df = frame(spark, [(i, t, "x", None) for i, t in rows])
    got = neardup.near_duplicate_groups(df, bucket=bucket, local=local)
    assert pairs(got, "group_row_id", "row_id") == want


def test_hot_cluster_of_different_texts(spark):
    """A third of all rows are variants of one text, all different; with small buckets they are closed by stars and blocks."""
    r, make = sentence_maker(5)
    base, rows = make(60), []
    for _ in range(120):
        c = list(base)
        for _ in range(6):
            c[r.randrange(60)] = make(1)[0]
        rows.append(" ".join(c))
    rows += [" ".join(make(50)) for _ in range(200)]
    sets = list(enumerate(set(words(t)) for t in rows))
    want = groups([(i, j) for i, a in sets for j, b in sets[i + 1:] if likeness(a, b) >= 0.7])
    got = neardup.near_duplicate_groups(frame(spark, [(i, t, None, None) for i, t in enumerate(rows)]), bucket=8, local=5)
    assert pairs(got, "group_row_id", "row_id") == want


def test_overlapping_pairs(spark):
    rows = near_rows(3)
    tests = [(f"T{i % 37}", t) for i, t in enumerate(near_rows(3)[::2])] + [(None, rows[0]), ("N", None), ("E", "")]
    want = {(i, k) for i, t in enumerate(rows) for k, u in tests if k and t and u and len(set(words(t))) >= 20 and len(set(words(u))) >= 20 and likeness(words(t), words(u)) >= 0.7}
    train = frame(spark, [(i, t, None, None) for i, t in enumerate(rows)])
    test = spark.createDataFrame(tests, "id string, text string").withColumn("row_id", F.lit(7))
    assert pairs(overlap.overlapping_pairs(train, test), "row_id", "test_id") == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA + ", doc_id bigint, termo string, label string, source string, split_name string")
    assert neardup.near_duplicate_groups(none).count() == 0
    assert overlap.overlapping_pairs(none, none).count() == 0
    assert leaks.leaked_pairs(none, none).count() == 0
    assert copies.copy_sets(none).count() == 0
    assert splits.linked_units(none).count() == 0
    assert pieces.pieces(none).count() == 0
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, share double")
    assert splits.split_assignment(none, targets).count() == 0


@pytest.mark.parametrize("bucket_rows", [20_000, 3, 1])
def test_copy_sets(spark, bucket_rows):
    r = random.Random(4)
    base = [("Blue moss", "The cell grows, always."), ("Moss", "The cell grows always x"), (None, "Solo text."), ("", "solo TEXT"), ("a b", "c"), ("c", "A-B"), ("z", "..."), ("orvane", "orvane one"), ("orvane", "orvane two"), ("orvane", "orvane two three")]
    rows = []
    for i in range(400):
        t, x = r.choice(base)
        if r.random() < 0.5:
            x = x.upper() if r.random() < 0.5 else f"  {x} ;"
        if t and r.random() < 0.2:
            t, x = x, t
        rows.append((i, t, x))
    rows += [(1000, "x", None), (1001, "x", "   "), (1002, None, "\n")] + [(2000 + i, "hot", "hot text") for i in range(300)]
    by = {}
    for i, t, x in rows:
        if x is not None and x.strip():
            by.setdefault(tuple(sorted((bare(t or ""), bare(x)))), []).append(i)
    want = {(min(v), i) for v in by.values() if len(v) > 1 for i in v}
    df = spark.createDataFrame(rows, "row_id bigint, termo string, text string").repartition(4).withColumn("first", F.lit(1))
    assert pairs(copies.copy_sets(df, bucket_rows=bucket_rows), "first_row_id", "row_id") == want
    one = {tuple(x) for x in copies.one_of_each(df, bucket_rows=bucket_rows).collect()}
    assert one == {(min(v), len(v)) for v in by.values()}


def test_trie_splits_edges():
    t = copies.Trie()
    for i, k in enumerate(["abc", "abd", "ab", "abc", "", "b", "abcd"]):
        t.add(k, i, 1)
    assert sorted((n, low, sorted(m)) for n, low, m in t.terminals()) == [(1, 1, [1]), (1, 2, [2]), (1, 4, [4]), (1, 5, [5]), (1, 6, [6]), (2, 0, [0, 3])]


def naive_leaks(docs, tests, n=16):
    at = {}
    for k, t in tests:
        w = words(t)
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i:i + n]), set()).add(k)
    out = set()
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            out |= {(d, k) for k in at.get(tuple(w[i:i + n]), ()) if k}
    return out


@pytest.mark.parametrize("shard_rows", [200_000, 7])
def test_leaked_pairs(spark, monkeypatch, shard_rows):
    """Runs of 15, 16 and more words, repeated passages, a passage in a third of all documents, small shards."""
    monkeypatch.setattr(leaks, "SHARD_ROWS", shard_rows)
    r, make = sentence_maker(6)
    tests = [(f"T{i}", " ".join(make(r.choice([10, 16, 17, 40, 90])))) for i in range(30)] + [("T1", "twice with other text " * 9), ("X", None), ("Y", ""), (None, " ".join(make(30))), ("A", "same " * 40)]
    docs = []
    for i in range(120):
        w = make(r.randint(0, 200))
        if i % 3 == 0:
            w += words(tests[5][1])
        if i % 4 == 0:
            t = words(r.choice(tests)[1] or "")
            k = r.choice([15, 16, 18, 90])
            w[len(w) // 2:len(w) // 2] = t[:k] if r.random() < 0.5 else t[-k:]
        docs.append((i, " ".join(w).title() if i % 2 else "; ".join(w)))
    docs += [(500, None), (501, ""), (502, "same " * 60), (503, " ".join(make(30000)) + " " + (tests[7][1] or ""))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    t = spark.createDataFrame(tests, "id string, text string").withColumn("doc_id", F.lit(1))
    want = naive_leaks(docs, tests)
    assert pairs(leaks.leaked_pairs(d, t), "doc_id", "test_id") == want
    long = leaks.longest_matches(d, t).collect()
    assert {(x.doc_id, x.test_id) for x in long} == want
    text = dict(docs)
    for x in long:
        run = words(text[x.doc_id])[x.doc_word:x.doc_word + x.match_words]
        assert any(words(u)[x.test_word:x.test_word + x.match_words] == run for k, u in tests if k == x.test_id and u)
    assert leaks.without_leaks(d, t).count() == len(docs) - len({p[0] for p in want})


def test_linked_units_and_splits(spark):
    r = random.Random(8)
    names = [f"Term {i}" for i in range(60)]
    rows = []
    for i in range(900):
        t = "Hot term" if i % 3 == 0 else r.choice(names)
        if r.random() < 0.1:
            t = t.upper() + " ;" + r.choice(names)
        rows.append((i, None if r.random() < 0.03 else t, r.choice(["Human", "openai", None, "Meta"])))
    rows += [(2000, ";;", "Human"), (2001, "x" * 121, "Human"), (2002, "", None), (2003, "!", None)]
    parsed = {t: [b for b in (bare(p) for p in t.split(";")) if b] if len(t) <= 120 else [] for _, t, _ in rows if t is not None}
    named = {t: ns for t, ns in parsed.items() if ns}
    root = {n: k for k, n in groups([(ns[0], n) for ns in named.values() for n in ns] + [(n, n + "~") for ns in named.values() for n in ns])}
    variants = {}
    for t, ns in named.items():
        variants.setdefault(root[ns[0]], set()).add(t)
    want = {(i, root[named[t][0]]) for i, t, _ in rows if t in named and len(variants[root[named[t][0]]]) > 1}
    df = spark.createDataFrame(rows, "row_id bigint, termo string, label string").repartition(3)
    assert pairs(splits.linked_units(df), "row_id", "unit") == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    for chunk in (20_000, 20):
        got = dict(map(tuple, splits.split_assignment(df, targets, bins=16, chunk=chunk).collect()))
        assert set(got) == {i for i, _, _ in rows}
        by_unit = {}
        for i, t, _ in rows:
            if t in named:
                by_unit.setdefault(root[named[t][0]], set()).add(got[i])
        assert all(len(s) == 1 for s in by_unit.values())


def test_largest_differencing():
    dealt = splits.largest_differencing([[(w, i)] for i, w in enumerate([8, 7, 6, 5, 4, 3, 2, 1])], 3)
    sums = sorted(sum([8, 7, 6, 5, 4, 3, 2, 1][i] for i in d) for d in dealt)
    assert sum(map(len, dealt)) == 8 and sums[-1] - sums[0] <= 1
    assert splits.largest_differencing([], 2) == [[], []]


def naive_cuts(n, cuts, limit, overlap):
    out, c = [], 0
    while c < n:
        reach = max(0, c - overlap) + limit
        nxt = max([x for x in [*cuts, n] if c < x <= reach], default=reach)
        out.append(nxt)
        c = nxt
    return out


def test_greedy_cuts():
    import numpy as np

    r = random.Random(9)
    for limit, overlap in ((10, 3), (10, 0), (7, 6), (512, 64)):
        texts = []
        for _ in range(200):
            n = r.randint(0, 8 * limit)
            texts.append((n, sorted({r.randint(1, n - 1) for _ in range(r.randint(0, n // r.choice([2, limit]) + 1))}) if n > 1 else []))
        count = np.array([n for n, _ in texts])
        doc = np.array([i for i, (_, c) in enumerate(texts) for _ in c], dtype=np.int64)
        cut = np.array([x for _, c in texts for x in c], dtype=np.int64)
        d, at, _, longest = pieces.greedy_cuts(count, doc, cut, limit, overlap)
        for i, (n, c) in enumerate(texts):
            assert at[d == i].tolist() == naive_cuts(n, c, limit, overlap), (limit, overlap, n, c)
            assert longest[i] == (max(b - a for a, b in zip([0, *c], [*c, n])) if n else 0)


def test_pieces_cover_the_text(spark):
    import re

    tok = re.compile(r"\w+|[^\w\s]+")
    r, make = sentence_maker(10)
    docs = [(i, " ".join(w + r.choice(["", "", "", ".", '."', "\n", "!)", " —"]) for w in make(r.choice([0, 3, 40, 900])))) for i in range(40)] + [(90, None), (91, ""), (92, "   "), (93, "x" * 50_000 + " y"), (94, " ".join(["w"] * 1500)), (95, "😀 " * 700)]
    got = pieces.pieces(spark.createDataFrame(docs, "doc_id bigint, text string"), 50, 8).orderBy("doc_id", "piece").collect()
    for i, t in docs:
        own = [p for p in got if p.doc_id == i]
        n = len(tok.findall(t or ""))
        assert bool(own) == (n > 0)
        end = 0
        for k, p in enumerate(own):
            assert p.piece == k + 1 and p.tokens <= 50 and p.tokens == len(tok.findall(p.text)) and p.doc_tokens == n
            assert p.first_token == (max(0, end - 8) if k else 0)
            assert tok.findall(p.text) == tok.findall(t)[p.first_token:p.first_token + p.tokens]
            end = p.first_token + p.tokens
        assert end == n


def test_plain_helper_agrees():
    assert plain("ÉÇ") == "ec"
