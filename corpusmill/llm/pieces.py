"""Cutting oversized texts at natural boundaries, with overlap (problem 7).

Method: pointer doubling.  Every possible cut points to its farthest legal successor: the last natural
boundary that keeps the next piece, overlap included, within the limit, or the limit itself where no
boundary is in reach.  Squaring the table of successors while collecting what the starts reach gives all
greedy cuts of all texts of a batch in a logarithmic number of steps.  No row leaves its task: the plan has
no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcodes import blocks
from .tokens import Tokens

MAX_TOKENS, OVERLAP = 512, 64


def greedy_cuts(count: np.ndarray, cut_doc: np.ndarray, cut: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of many texts at once, by pointer doubling.

    ``count``: tokens of each text; ``cut_doc, cut``: natural boundaries, sorted.  Returns the text, the tokens
    before the cut and whether it is natural, for every cut (a text's end included), and each text's
    longest stretch between neighbouring boundaries.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    docs = np.arange(len(count))
    some = docs[count > 0]
    # natural nodes: start, boundaries and end of each text, in order
    doc = np.concatenate((some, cut_doc, some))
    at = np.concatenate((np.zeros(len(some), dtype=np.int64), cut, count[some]))
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    stride = int(count.max(initial=0)) + limit + 1
    key = doc * stride + at
    nxt = np.append(at[1:], 0)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, dtype=bool)
    stretch = np.where(last, 0, nxt - at)
    longest = np.zeros(len(count), dtype=np.int64)
    np.maximum.at(longest, doc, stretch)
    # hard cuts: from a node whose next boundary is out of reach, one at each limit
    reach = np.maximum(at - overlap, 0) + limit
    out = np.flatnonzero(~last & (nxt > reach))
    step = limit - overlap
    first = reach[out]
    # as cuts below the overlap keep the piece's start at 0, the first hard cut may lie less than a step on
    follow = np.maximum(first - overlap, 0) + limit - first
    n = 1 + np.where(nxt[out] > first + follow, 1 + np.maximum(0, -(-(nxt[out] - first - follow) // step) - 1), 0)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hard = np.repeat(first, n) + np.where(j > 0, np.repeat(follow, n) + (j - 1) * step, 0)
    hard_doc = np.repeat(doc[out], n)
    inside = hard < np.repeat(nxt[out], n)
    hard, hard_doc = hard[inside], hard_doc[inside]
    all_doc, all_at = np.concatenate((doc, hard_doc)), np.concatenate((at, hard))
    natural = np.concatenate((np.ones(len(doc), dtype=bool), np.zeros(len(hard), dtype=bool)))
    order = np.lexsort((all_at, all_doc))
    all_doc, all_at, natural = all_doc[order], all_at[order], natural[order]
    all_key = all_doc * stride + all_at
    # farthest legal successor
    reach = np.maximum(all_at - overlap, 0) + limit
    to = np.searchsorted(key, all_doc * stride + np.minimum(reach, stride - 1), side="right") - 1
    end = count[all_doc] == all_at
    target = np.where(key[to] > all_key, key[to], all_doc * stride + reach) if len(key) else key
    succ = np.where(end, np.arange(len(all_key)), np.searchsorted(all_key, target))
    used = all_at == 0
    while True:
        hit = used.copy()
        hit[succ[used]] = True
        if (hit == used).all() and (succ[succ] == succ).all():
            break
        used, succ = hit, succ[succ]
    keep = used & (all_at > 0)
    return all_doc[keep], all_at[keep], natural[keep], longest


def _cut(limit: int, overlap: int, with_text: bool):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for first, part in blocks(b.column(1).to_pylist()):
                t = Tokens(part)
                doc, stop, natural, longest = greedy_cuts(t.count, t.cut_doc, t.cut, limit, overlap)
                if not len(doc):
                    continue
                new = np.append(True, doc[1:] != doc[:-1])
                number = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
                start = np.where(new, 0, np.maximum(np.append(0, stop[:-1]) - overlap, 0))
                columns = [ids.take(pa.array(first + doc)), pa.array(number + 1, pa.int64()), pa.array(start, pa.int64()), pa.array(stop - start, pa.int64()), pa.array(natural), pa.array(t.count[doc], pa.int64()), pa.array(longest[doc], pa.int64())]
                names = ["doc_id", "piece", "first_token", "tokens", "natural", "doc_tokens", "longest_stretch"]
                if with_text:
                    a, z = t.start[t.first[doc] + start].tolist(), t.end[t.first[doc] + stop - 1].tolist()
                    columns.append(pa.array([part[d][x:y] for d, x, y in zip(doc.tolist(), a, z)], pa.string()))
                    names.append("text")
                yield pa.record_batch(columns, names=names)
    return run


def pieces(documents: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """``(doc_id, piece, first_token, tokens, natural, doc_tokens, longest_stretch[, text])``.

    ``documents`` needs ``doc_id, text``; other columns are ignored.  Pieces are numbered from 1 and hold at most
    ``limit`` tokens, each but the first starting with the last ``overlap`` tokens of the one before (with all
    of it if that is shorter).  ``natural`` tells whether the piece ends at a boundary or the text's end.  White
    space around a piece is not part of its text.  A text within the limit is one piece; a null text,
    or one without tokens, gives no row.  Row ids may repeat: each row is cut on its own.
    """
    schema = "doc_id bigint, piece bigint, first_token bigint, tokens bigint, natural boolean, doc_tokens bigint, longest_stretch bigint" + ", text string" * with_text
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(_cut(limit, overlap, with_text), schema)


def not_naturally_divisible(documents: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id)`` of the texts over the limit in which two neighbouring boundaries lie more than it apart."""
    cut = pieces(documents, limit, overlap, with_text=False)
    return cut.where((F.col("piece") == 1) & (F.col("doc_tokens") > limit) & (F.col("longest_stretch") > limit)).select("doc_id")


def size_limit(limits: DataFrame, kind: str = "documents") -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of an item kind; the defaults where the table has none."""
    row = limits.where(F.col("item_kind") == kind).select("max_tokens", "overlap_tokens").limit(1).first()
    return (int(row[0]), int(row[1] or 0)) if row and row[0] else (MAX_TOKENS, OVERLAP)
