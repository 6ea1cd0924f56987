"""Evaluation passages standing verbatim inside a training corpus (problem 5).

Method: suffix arrays over the training text in shards; every test suffix is searched by bisection in the shards that can
hold its matches.

* Anchors.  A run of ``min_words`` words holds a fixed number of neighbouring word grams of half that length; the gram with the
  smallest hash is the run's anchor, the same wherever the run stands, and about one position in five is the anchor of
  any run.  Corpus and tests are first met on their anchors alone, as packed entries of six bytes (``packed``): what
  has no anchor in common with the other side is left out.  Nothing is broadcast, and no anchor is dropped for another reason.
* Passages.  The runs around a shared anchor go, with their words, to the anchor's shard.  An anchor with more
  than ``SHARD_ROWS`` passages on a side is spread by document, or by test, over a grid of shards.
* Suffix arrays.  A shard sorts all suffixes of its passages by their words (prefix doubling), and bisects each test suffix
  for the range of corpus suffixes that begin with the same ``min_words`` words.  Longer matches are read off as neighbouring
  ranges of one diagonal, inside a passage in the shard and across passages after it.

Copies of a test text are searched once.  Null or short texts match nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from . import packed
from .textcodes import blocks, mix64, word_spans

MIN_WORDS = 16
SHARD_ROWS = 200_000
LOCAL, SALTS = 64, 32


def _doubled(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each position on, by doubling; the last n - 1 positions have none."""
    g, step = mix64(codes, 3), 1
    while 2 * step <= n:
        g = mix64(g[:-step] * np.uint64(0x9E3779B97F4A7C15) + g[step:], 10 + step) if len(g) > step else g[:0]
        step *= 2
    rest = n - step
    return mix64(g[:-rest] * np.uint64(0x9E3779B97F4A7C15) + g[rest:], 90) if rest and len(g) > rest else (g[:0] if rest else g)


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` neighbours from each position on."""
    step = 1
    while 2 * step <= n:
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        step *= 2
    rest = n - step
    return np.minimum(g[:-rest], g[rest:]) if rest and len(g) > rest else (g[:0] if rest else g)


def run_anchors(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number by word, word codes, starts of the runs inside one text, their anchors)."""
    doc, codes = word_spans(texts)
    gram = (min_words + 1) // 2
    anchor = _least(_doubled(codes, gram), min_words - gram + 1)
    start = np.flatnonzero(doc[:len(anchor)] == doc[min_words - 1:min_words - 1 + len(anchor)])
    return doc, codes, start, mix64(anchor[start], 77)


def _code_of_text(doc: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit code for the word sequence of each text."""
    first = np.searchsorted(doc, np.arange(n))
    at = (np.arange(len(doc)) - first[doc]).astype(np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    if len(doc):
        x = mix64(words + mix64(at, 29), 31)
        used, starts = np.unique(doc, return_index=True)
        out[used] = np.add.reduceat(x, starts)
    return mix64(out, 37)


def _test_codes(min_words: int):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for first, part in blocks(b.column(1).to_pylist()):
                doc, words = word_spans(part)
                size = np.bincount(doc, minlength=len(part))
                code = _code_of_text(doc, words, len(part))
                keep = np.flatnonzero(size >= min_words)
                yield pa.record_batch([ids.take(pa.array(keep + first)), pa.array(code[keep].view(np.int64)), pa.array([part[i] for i in keep], pa.string())], names=["test_id", "code", "text"])
    return run


def _entries(min_words: int, parts: int, local: int | None, apart: bool = False):
    """(ref, text) -> the distinct anchors of each text as packed entries, without the crowded ones of a batch, or, ``apart``, those as (key, refs)."""
    def run(batches):
        for b in batches:
            ids, keys, refs = b.column(0).to_numpy(zero_copy_only=False), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, part in blocks(b.column(1).to_pylist()):
                doc, _, start, anchor = run_anchors(part, min_words)
                a, k = packed.unique_pairs(doc[start], anchor)
                keys.append(k)
                refs.append(ids[first + a])
            key, ref = np.concatenate(keys), np.concatenate(refs)
            hot = packed.crowded(key, local) if local is not None else np.zeros(len(key), dtype=bool)
            if not apart:
                yield packed.pack(key[~hot], ref[~hot], parts)
            elif hot.any():
                yield packed.lists(key[hot], ref[hot])
    return run


def _shared(left: pa.Table, right: pa.Table) -> pa.Table:
    """The entries of both sides whose keys occur on both: (side, ref, anchor), the anchor without its middle bits."""
    out = []
    sides = [packed.unpack(t)[:2] for t in (left, right)]
    for k in (0, 1):
        keys, refs = sides[k]
        live = np.isin(keys, sides[1 - k][0])
        out.append((np.full(live.sum(), k, np.int32), refs[live], keys[live]))
    part = (left if left.num_rows else right).column("part")[0].as_py()
    side, ref, key = (np.concatenate([o[i] for o in out]) for i in range(3))
    return pa.table({"side": side, "ref": pa.array(ref, pa.int64()), "anchor": pa.array((key.astype(np.uint64) << np.uint64(32) | np.uint64(part)).view(np.int64))})


def _passages(min_words: int, parts: int):
    """(ref, text, anchors) -> (anchor, ref, pos, words) of the runs around the given anchors."""
    def run(batches):
        for b in batches:
            refs, lists = b.column(0), b.column(2)
            for first, part in blocks(b.column(1).to_pylist()):
                doc, codes, start, anchor = run_anchors(part, min_words)
                mine = lists.slice(first, len(part))
                of = np.repeat(np.arange(len(part)), np.diff(mine.offsets.to_numpy()))
                wanted = mix64(mine.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix64(of.astype(np.uint64), 7), 8)
                short = packed.short(anchor, parts)
                live = np.flatnonzero(np.isin(mix64(short ^ mix64(doc[start].astype(np.uint64), 7), 8), wanted))
                if not len(live):
                    continue
                at, key, d = start[live], short[live], doc[start[live]]
                new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(d) != 0) | (key[1:] != key[:-1])))
                low, high = at[new], at[np.append(new[1:], len(at)) - 1] + min_words
                place = low - np.searchsorted(doc, d[new])
                words = codes[packed.ranges(low, high - low)].view(np.int64)
                ends = np.concatenate(([0], np.cumsum(high - low))).astype(np.int32)
                yield pa.record_batch([pa.array(key[new].view(np.int64)), refs.take(pa.array(first + d[new])), pa.array(place, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(words))], names=["anchor", "ref", "pos", "words"])
    return run


def suffix_ranks(words: np.ndarray, passage: np.ndarray, depth: int, until: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the passages by their words: by the first ``depth`` (-1 where there are fewer), and by ``until`` or more.

    Prefix doubling; a passage's end comes before every word.
    """
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    n, step, at_depth = len(words), 1, None

    def joined(first, ahead):
        second = np.zeros(n, dtype=np.int64)
        if n > ahead:
            same = passage[:-ahead] == passage[ahead:] if ahead else np.ones(n, dtype=bool)
            second[:n - ahead] = np.where(same, first[ahead:], 0)
        return np.unique(first * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1

    while True:
        if at_depth is None and 2 * step > depth:
            at_depth = joined(rank, depth - step) if depth > step else rank.copy()
            whole = np.zeros(n, dtype=bool)
            if n >= depth:
                whole[:n - depth + 1] = passage[:n - depth + 1] == passage[depth - 1:]
            at_depth[~whole] = -1
        if step >= until and at_depth is not None:
            return at_depth, rank
        rank = joined(rank, step)
        step *= 2


def search_shard(corpus: list[np.ndarray], test: list[np.ndarray], min_words: int):
    """Sorts the passages' suffixes to an array and bisects every test suffix.

    Yields the matches as (corpus suffixes, test suffixes), places in the joined passages of each side; a range that is
    equal for many test suffixes is found once.
    """
    both = corpus + test
    words, sizes = np.concatenate(both), np.array([len(w) for w in both])
    passage = np.repeat(np.arange(len(both)), sizes)
    first, whole = suffix_ranks(words, passage, min_words, int(sizes.max()))
    n = int(sizes[:len(corpus)].sum())
    array = np.argsort(whole[:n], kind="stable")  # the suffix array of the corpus side
    array = array[first[array] >= 0]
    ranks = first[array]  # ascending, as the array's order is by all words
    t = np.flatnonzero(first[n:] >= 0)
    low, high = np.searchsorted(ranks, first[n + t], "left"), np.searchsorted(ranks, first[n + t], "right")
    live = high > low
    return array, t[live], low[live], high[live]


def _search(min_words: int, positions: bool):
    names = ["doc_id", "code", "doc_pos", "test_pos", "words"] if positions else ["doc_id", "code"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], pa.int64()) for c in names})
        if not left.num_rows or not right.num_rows:
            return none
        sides = []
        for t in (left, right):
            lists = t.column("words").combine_chunks()
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            size = np.diff(ends)
            ref, pos = (t.column(c).to_numpy() for c in ("ref", "pos"))
            sides.append(([flat[a:z] for a, z in zip(ends, ends[1:])], np.repeat(ref, size), np.repeat(pos, size) + packed.ranges(np.zeros(len(size), np.int64), size), np.repeat(np.arange(len(size)), size)))
        (c_words, c_ref, c_pos, c_passage), (t_words, t_ref, t_pos, t_passage) = sides
        array, t, low, high = search_shard(c_words, t_words, min_words)
        out = []
        if not positions:
            # a range once for each text it stands in, a test once for each range
            a, b = packed.unique_pairs(low, t_ref[t])
            starts, where = np.unique(low, return_index=True)
            size = high[where] - starts
            rank, docs = packed.unique_pairs(np.repeat(np.arange(len(starts)), size), c_ref[array[packed.ranges(starts, size)]])
            number = np.searchsorted(starts, a)
            first, last = np.searchsorted(rank, number, "left"), np.searchsorted(rank, number, "right")
            for s, e in packed.slices(last - first):
                x, y = packed.unique_pairs(docs[packed.ranges(first[s:e], (last - first)[s:e])], np.repeat(b[s:e], (last - first)[s:e]))
                out.append([x, y])
            x, y = packed.unique_pairs(*(np.concatenate([o[i] for o in out]) for i in (0, 1))) if out else (array[:0], array[:0])
            return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=names)
        for s, e in packed.slices(high - low):
            c, q = array[packed.ranges(low[s:e], (high - low)[s:e])], np.repeat(t[s:e], (high - low)[s:e])
            order = np.lexsort((c, c - q, t_passage[q], c_passage[c]))
            c, q = c[order], q[order]
            new = np.append(True, (np.diff(c) != 1) | (np.diff(q) != 1) | (np.diff(c_passage[c]) != 0) | (np.diff(t_passage[q]) != 0))
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(c))) + min_words - 1
            out.append([c_ref[c[at]], t_ref[q[at]], c_pos[c[at]], t_pos[q[at]], length])
        return pa.table([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(5)], names=names) if out else none
    return run


def _near_anchors(texts: DataFrame, shared: DataFrame, side: int, scratch: Scratch, min_words: int, parts: int, label: str) -> DataFrame:
    anchors = shared.where(F.col("side") == side).groupBy("ref").agg(F.collect_set("anchor").alias("anchors"))  # as many as a text has
    return scratch.keep(texts.join(anchors, "ref").select("ref", "text", "anchors").mapInArrow(_passages(min_words, parts), "anchor bigint, ref bigint, pos bigint, words array<bigint>"), label)


def _ways(passages: DataFrame, name: str) -> DataFrame:
    return passages.groupBy("anchor").count().where(F.col("count") > SHARD_ROWS).select("anchor", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias(name))


def _matches(documents: DataFrame, tests: DataFrame, scratch: Scratch, min_words: int, positions: bool) -> tuple[DataFrame, DataFrame]:
    """(matching runs, or distinct pairs; test items with the code of their text)."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    items = scratch.keep(tests.select(F.col("id").cast("string").alias("id"), "text").where("text is not null and id is not null").mapInArrow(_test_codes(min_words), "test_id string, code bigint, text string"), "tests")
    asked = items.dropDuplicates(["code"]).select(F.col("code").alias("ref"), "text")
    corpus = documents.select(F.col("doc_id").cast("bigint").alias("ref"), "text").where("text is not null and doc_id is not null")

    # about one word of six characters in five is an anchor
    size = corpus.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = packed.parts_for(size // 30)
    hot = scratch.keep(corpus.mapInArrow(_entries(min_words, parts, LOCAL, True), "key bigint, rows array<bigint>"), "crowded")
    x, y = corpus.mapInArrow(_entries(min_words, parts, LOCAL), packed.SCHEMA), asked.mapInArrow(_entries(min_words, parts, None), packed.SCHEMA)
    schema = "side int, ref bigint, anchor bigint"
    met = x.groupBy("part").cogroup(y.groupBy("part")).applyInArrow(_shared, schema)
    if not hot.isEmpty():
        own = asked.mapInArrow(_entries(min_words, parts, 0, True), "key bigint, rows array<bigint>")
        met_keys = scratch.keep(own.select("key", F.explode("rows").alias("ref")).join(hot.select("key").distinct(), "key", "left_semi"), "crowded-tests")
        salted = met_keys.select("key").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lists = hot.withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi")
        short = F.col("key").bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.col("key").bitwiseAND(F.lit(parts - 1)))
        met = met.unionByName(lists.select(F.lit(0).alias("side"), F.explode("rows").alias("ref"), short.alias("anchor"))).unionByName(met_keys.select(F.lit(1).alias("side"), "ref", short.alias("anchor")))
    shared = scratch.keep(met, "shared")

    c = _near_anchors(corpus, shared, 0, scratch, min_words, parts, "corpus-passages")
    t = _near_anchors(asked, shared, 1, scratch, min_words, parts, "test-passages")
    n = max(c.count(), t.count())
    shards = max(1, -(-n // SHARD_ROWS), documents.sparkSession.sparkContext.defaultParallelism if n > 10_000 else 1)
    grid = scratch.keep(_ways(c, "down").join(_ways(t, "across"), "anchor", "full").select("anchor", F.coalesce("down", F.lit(1)).alias("down"), F.coalesce("across", F.lit(1)).alias("across")), "grid")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each passage to one row or column of its anchor's grid, and to all shards of it."""
        own_way, all_ways = F.pmod(F.xxhash64("ref"), F.coalesce(own, F.lit(1))), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        placed = side.join(grid, "anchor", "left").withColumn("i", own_way.cast("int")).withColumn("j", all_ways)
        first, second = ("i", "j") if own == "down" else ("j", "i")
        return placed.select(F.pmod(F.xxhash64("anchor", first, second), F.lit(shards)).cast("int").alias("shard"), "ref", "pos", "words")

    schema = "doc_id bigint, code bigint" + ", doc_pos bigint, test_pos bigint, words bigint" * positions
    found = dealt(c, "down", "across").groupBy("shard").cogroup(dealt(t, "across", "down").groupBy("shard")).applyInArrow(_search(min_words, positions), schema)
    return found, items.select("test_id", "code").distinct()


def leaked_pairs(documents: DataFrame, tests: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id BIGINT, test_id STRING)``: documents holding ``min_words`` consecutive words of a test item.

    ``documents`` needs ``doc_id, text``, ``tests`` needs ``id, text``; other columns are ignored.  An
    id that comes with several texts matches if any of them does; null ids or texts, and texts under
    ``min_words`` words, match nothing.  Each pair comes out once; empty tables give an empty result.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    found, items = _matches(documents, tests, scratch, min_words, False)
    return found.distinct().join(items, "code").select("doc_id", "test_id").distinct()


def longest_matches(documents: DataFrame, tests: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The longest verbatim run of each document and test item, with its places.

    ``(doc_id, test_id, match_words, doc_word, test_word)``; places are word numbers from 0.  Of
    equally long runs the one that comes first in the document, then in the item, is given.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    found, items = _matches(documents, tests, scratch, min_words, True)
    # runs of one diagonal that touch are one run: each begins where the one before may still go on
    line = Window.partitionBy("doc_id", "code", "diagonal").orderBy("doc_pos", "words")
    last = F.col("doc_pos") + F.col("words") - min_words
    runs = (found.distinct().withColumn("diagonal", F.col("doc_pos") - F.col("test_pos")).withColumn("last", last)
            .withColumn("before", F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("run", F.sum(F.when(F.col("doc_pos") <= F.col("before") + 1, 0).otherwise(1)).over(line))
            .groupBy("doc_id", "code", "diagonal", "run").agg((F.max("last") - F.min("doc_pos") + min_words).alias("match_words"), F.min("doc_pos").alias("doc_word"), F.min("test_pos").alias("test_word")))
    best = runs.groupBy("doc_id", "code").agg(F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("test_word")).alias("t"))).alias("b"))
    best = best.join(items, "code")
    best = best.groupBy("doc_id", "test_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "test_id", F.col("b.match_words").alias("match_words"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.t")).alias("test_word"))


def without_leaks(documents: DataFrame, tests: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that hold no test passage, with all their columns."""
    bad = leaked_pairs(documents, tests, min_words).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")
