"""Remote models and pages behind a small protocol: prompts, retries, rotation, resumable runs.

A client is any picklable callable ``prompt -> str`` that raises on failure.  No network code lives here; tests
and queries use deterministic stubs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DROPPED_CLASSES, DROPPED_ELEMENTS, MAX_WORDS, MIN_WORDS
from ..functions.text import answer_label, clean_passage, truncate_sentences, word_count

Client = Callable[[str], str]


class RateLimited(Exception):
    """Raised by a client whose account is used up for now."""


def examples_block(examples: DataFrame, key: str, label: str, chars: int = 400) -> DataFrame:
    """One row ``block``: ``Text: ... / Category: ...`` of every example, by class, then key.

    ``examples`` is a support set, a few rows of each class.
    """
    item = F.concat(F.lit("Text: "), F.coalesce(F.substring("text", 1, chars), F.lit("")), F.lit("\nCategory: "), F.col(label))
    rows = examples.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(key).alias("k"), item.alias("t")))).alias("a"))
    return rows.select(F.array_join(F.transform("a", lambda x: x["t"]), "\n\n").alias("block"))


def few_shot_prompts(texts: DataFrame, examples: DataFrame, key: str, label: str) -> DataFrame:
    """``(id, prompt)``: the examples, then the text to classify; null texts are left out."""
    block = F.broadcast(examples_block(examples, key, label))  # one row
    prompt = F.concat("block", F.lit("\n\nText: "), "text", F.lit("\nCategory:"))
    return texts.where("text is not null").crossJoin(block).select("id", prompt.alias("prompt"))


def generation_prompt(term: Column, examples: Column | None = None) -> Column:
    """A prompt for a passage about a term, after examples of the wanted style if there are any."""
    ask = F.format_string(f"Write an encyclopaedic passage of {MIN_WORDS} to {MAX_WORDS} words about '%s'. Plain sentences only.", term)
    if examples is None:
        return ask
    shown = F.array_join(F.transform(examples, lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), F.substring(x, 1, 500))), "\n\n")
    return F.concat(shown, F.lit("\n\nIn the style of these examples: "), ask)


def with_retries(client: Client, tries: int = 5, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Client:
    """Retries a failing client, waiting ``wait``, ``2 wait``, ... between; after the last try the answer is ``Error: ...``."""
    def call(prompt: str) -> str:
        for k in range(tries):
            try:
                return client(prompt)
            except Exception as e:
                if k == tries - 1:
                    return f"Error: {e}"
                sleep(wait * (k + 1))
        return "Error: no try"
    return call


class Rotation:
    """Accounts in turn: a limited one passes the call on; when all are limited it pauses and starts again, ``rounds`` times."""

    def __init__(self, clients: list[Client], pause: float = 30.0, rounds: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.clients, self.pause, self.rounds, self.sleep, self.at = clients, pause, rounds, sleep, 0

    def __call__(self, prompt: str) -> str:
        for _ in range(self.rounds):
            for _ in range(len(self.clients)):
                client = self.clients[self.at]
                self.at = (self.at + 1) % len(self.clients)
                try:
                    return client(prompt)
                except RateLimited:
                    continue
            self.sleep(self.pause)
        raise RateLimited("all accounts are limited")


def ask(prompts: DataFrame, client: Client, pace: float = 0.0) -> DataFrame:
    """``(id, raw)`` answers, one call a row, ``pace`` seconds between calls of a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = []
            for p in b["prompt"]:
                raw.append(client(p))
                if pace:
                    time.sleep(pace)
            yield pd.DataFrame({"id": b["id"], "raw": pd.Series(raw, dtype=object)})
    return prompts.select("id", "prompt").mapInPandas(run, "id string, raw string")


def classify(prompts: DataFrame, client: Client, model: str, done: DataFrame | None = None) -> DataFrame:
    """``(id, model, label)`` of the prompts that ``done(id, model)`` does not hold yet: a resumed run asks for the rest only."""
    todo = prompts if done is None else prompts.join(done.where(F.col("model") == model).select("id").distinct(), "id", "left_anti")
    return ask(todo, client).select("id", F.lit(model).alias("model"), answer_label(F.col("raw")).alias("label"))


def collect_until(prompts: DataFrame, client: Client, target: int, accept: Column, sink: str, pace: float = 0.0) -> DataFrame:
    """``(id, ord, raw)``: accepted answers to the first of ``prompts(id, ord, prompt)`` by ``ord``, until there are ``target``.

    Each round asks as many prompts as are missing, side by side, and appends what ``accept`` (over ``id, ord, raw``) lets through to
    ``sink``, a new folder; so no more than ``target`` are accepted, and rounds end when they are or when prompts run out.
    """
    from ..operators.sampling import global_rank

    spark = prompts.sparkSession
    ordered = global_rank(prompts.select("id", "ord", "prompt"), [F.col("ord"), F.col("id")], "place").persist()
    asked, got, left = 0, 0, ordered.count()
    schema = ordered.select("id", "ord").schema.add("raw", "string")
    while got < target and asked < left:
        block = ordered.where((F.col("place") > asked) & (F.col("place") <= asked + target - got))
        answers = ask(block.select(F.col("id").cast("string").alias("id"), "prompt"), client, pace)
        done = block.select("id", "ord").join(answers, block["id"].cast("string") == answers["id"]).select(block["id"], "ord", "raw")
        done.where(accept).write.mode("append").parquet(sink)
        asked, got = asked + target - got, spark.read.schema(schema).parquet(sink).count()
    ordered.unpersist()
    return spark.read.schema(schema).parquet(sink) if asked else spark.createDataFrame([], schema)


def pages_before(terms: DataFrame, client: Callable[[str], list[tuple[str, str]]], cutoff: str) -> DataFrame:
    """``(term, revised_at, html)``: the last revision of each term's page before ``cutoff``; terms without one are left out.

    ``client(term)`` gives ``(time, html)`` of the page's revisions in any order, times as text that sorts by time; a client that fails
    leaves its term out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for term in b["term"]:
                try:
                    before = [r for r in client(term) if r[0] < cutoff]
                except Exception:
                    continue
                if before:
                    rows.append((term, *max(before, key=lambda r: r[0])))
            yield pd.DataFrame(rows, columns=["term", "revised_at", "html"])
    return terms.select("term").where("term is not null").mapInPandas(run, "term string, revised_at string, html string")


class _Paragraphs(HTMLParser):
    """Text of ``<p>`` elements outside dropped elements and classes."""

    SCOPES = {"table", "td", "th", "caption", "button", "object", "template"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.dropped = 0
        self.open: list[list[str]] = []
        self.done: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        drop = tag in DROPPED_ELEMENTS or any(c in DROPPED_CLASSES for c in classes)
        if tag == "p" and self._open_paragraph():
            self.handle_endtag("p")
        self.stack.append((tag, drop))
        self.dropped += drop
        if tag == "p" and not self.dropped:
            self.open.append([])

    def _open_paragraph(self) -> bool:
        """Whether a new ``<p>`` ends an open one: an unclosed one, unless a table cell or the like stands between."""
        for t, _ in reversed(self.stack):
            if t == "p":
                return True
            if t in self.SCOPES:
                return False
        return False

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, drop = self.stack.pop()
            if t == "p" and not self.dropped and self.open:
                self.done.append("".join(self.open.pop()).strip())
            self.dropped -= drop
            if t == tag:
                break

    def handle_data(self, data):
        if not self.dropped and self.open:
            self.open[-1].append(data)


def page_paragraphs(html: str | None, longer_than: int = 30, most_words: int = MAX_WORDS) -> str | None:
    """Paragraphs over ``longer_than`` characters, joined until their words exceed ``most_words`` (the crossing one is kept)."""
    if html is None:
        return None
    p = _Paragraphs()
    p.feed(html)
    p.close()
    while p.stack:
        p.handle_endtag(p.stack[-1][0])
    out, n = [], 0
    for t in p.done:
        if len(t) > longer_than:
            out.append(t)
            n += len(t.split())
            if n > most_words:
                break
    return " ".join(out)


def page_passages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, passage)`` of pages whose cleaned, truncated paragraphs hold at least the minimum of words."""
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(page_paragraphs, na_action="ignore")

    done = pages.select(key, truncate_sentences(clean_passage(text(F.col(html)))).alias("passage"))
    return done.where(word_count(F.col("passage")) >= MIN_WORDS)
