"""Text cleaning and normalising as column expressions (no Python in the execution).

All functions take and return columns; a null text gives null unless stated otherwise.  White space is
the set that Python's ``str.split`` knows, which is wider than Java's ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import LABELS, MAX_WORDS, PHONETIC

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
_UUID = r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def _sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return _sub(c, f"^{WS}+|{WS}+$")


def squeeze(c: Column) -> Column:
    """Each run of white space as one space."""
    return _sub(c, f"{WS}+", " ")


def words(c: Column) -> Column:
    """The maximal runs of non-space characters, case kept; no words for a blank text."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words; 0 for null."""
    return F.when(c.isNull(), 0).otherwise(F.size(words(c)))


def clean_text(c: Column) -> Column:
    """Lower case; web and mail addresses and all but ``a-z 0-9 . , ! ? ; : ' -`` become spaces; squeezed, stripped."""
    c = _sub(F.lower(c), rf"https?://{NOT_WS}+|www\.{NOT_WS}+", " ")
    c = _sub(c, f"{NOT_WS}+@{NOT_WS}+", " ")
    c = _sub(c, r"[^a-z0-9.,!?;:'\-]+", " ")
    return F.trim(c)


def _without_marks(c: Column, first: list[str]) -> Column:
    c = strip(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))
    c = F.replace(c, F.lit("ⓘ"), F.lit(""))
    for pattern in first:
        c = _sub(c, pattern)
    c = squeeze(_sub(c, r"(?d)\(.*?\)"))
    c = _sub(c, rf"{WS}+([,;.])", "$1")
    return strip(_sub(c, r"(?d)\{.*?\}"))


def clean_passage(c: Column) -> Column:
    """Corpus cleaner: line ends, info marks, ``[...]``, phonetic ``/.../``, ``(...)``, spaces before ``, ; .``, then ``{...}``."""
    return _without_marks(c, [r"(?d)\[.*?\]", f"/[^/]*?[{PHONETIC}][^/]*?/"])


def clean_generated(c: Column) -> Column:
    """The cleaner for generated passages: identifiers in UUID form go, phonetic transcriptions stay."""
    return _without_marks(c, [_UUID, r"(?d)\[.*?\]"])


def sink_safe(c: Column) -> Column:
    """For a ``;``-separated file: no UUIDs, stripped, ``;`` as ``,``, squeezed."""
    return squeeze(F.translate(strip(_sub(c, _UUID)), ";", ","))


def sentences(c: Column) -> Column:
    """Sentences as the stripped, non-empty parts between runs of ``. ! ?``."""
    return F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda s: s != "")


def sentences_kept(c: Column) -> Column:
    """Sentences with their end marks: cut at white space after ``. ! ?``."""
    return F.filter(F.split(strip(c), rf"(?<=[.!?]){WS}+"), lambda s: s != "")


def truncate_sentences(c: Column, most: int = MAX_WORDS) -> Column:
    """The leading whole sentences that hold at most ``most`` words together; '' for null."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc, s):
        n = F.size(words(s))
        over = acc["full"] | (acc["n"] + n > most)
        return F.struct(F.when(over, acc["text"]).when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(" "), s)).alias("text"), F.when(over, acc["n"]).otherwise(acc["n"] + n).alias("n"), over.alias("full"))

    return strip(F.aggregate(sentences_kept(F.coalesce(c, F.lit(""))), start, step, lambda acc: acc["text"]))


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of ``part``."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def answer_label(c: Column, labels: list[str] = LABELS) -> Column:
    """The first listed label that an answer contains in any case; null for a missing, failed or other answer."""
    low = F.lower(c)
    found = F.lit(None).cast("string")
    for label in reversed(labels):
        found = F.when(low.contains(label.lower()), F.lit(label)).otherwise(found)
    return F.when(c.isNull() | (c == "") | c.startswith("Error"), F.lit(None)).otherwise(found)


def trace_label(c: Column, labels: list[str] = LABELS) -> Column:
    """The label a reasoning trace names last: a line that is a label, or says ``category:``, ``answer:`` or ``is`` before it.

    Of several labels in one line the last listed counts.
    """
    lines = F.transform(F.split(strip(c), "\n"), lambda s: F.lower(strip(s)))

    def of_line(s):
        found = F.lit(None).cast("string")
        for label in labels:
            low = label.lower()
            hit = (s == low) | s.contains(f"category: {low}") | s.contains(f"answer: {low}") | s.contains(f"is {low}")
            found = F.when(hit, F.lit(label)).otherwise(found)
        return found

    named = F.filter(F.transform(lines, of_line), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, F.element_at(named, -1))


def canonical_label(c: Column, labels: list[str] = LABELS) -> Column:
    """A label in its listed spelling whatever its case and outer space; other values are null."""
    low = F.lower(strip(c))
    found = F.lit(None).cast("string")
    for label in labels:
        found = F.when(low == label.lower(), F.lit(label)).otherwise(found)
    return found


def rate_limited(c: Column) -> Column:
    """Whether a message tells of a rate limit; false for null."""
    return F.coalesce(c.contains("429") | F.lower(c).contains("rate"), F.lit(False))


def fragment_text(line: Column) -> Column:
    """The text a streamed JSON line adds to an answer; null for control lines, identifiers and broken lines."""
    o = F.from_json(line, "struct<type:string,content:string>")
    content = o["content"]
    inner = F.get_json_object(line, "$.content.text")
    nested = F.coalesce(F.get_json_object(line, "$.content"), F.lit("")).startswith("{")
    control = F.coalesce(o["type"], F.lit("")).isin("start", "end", "close", "error")
    idle = content.rlike(_UUID) | F.lower(strip(content)).isin("", "processing")
    return F.when(control, F.lit(None)).when(nested, inner).when(idle, F.lit(None)).otherwise(content)
