"""How queries and their SQL are registered, and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import LABELS, PHONETIC, STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Tables of texts, whose per-row work is worth a shuffle of small inputs.
_TEXTS = {"documents", "dataset"}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table; texts that come as fewer scan partitions than there are cores are spread over the cores."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in _TEXTS and df.rdd.getNumPartitions() < cores else df


def query(sql: str | None = None):
    """Registers a function ``(read) -> DataFrame`` under its name; ``read(table)`` loads a table."""
    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(lambda table: load(spark, folder, table))
        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


# DuckDB fragments (RE2 syntax); the Spark side has the same rules in corpusmill.functions.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NW = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def sub(x: str, pattern: str, by: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', '{by}', 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def clean(x: str) -> str:
    c = sub(f"lower({x})", rf"https?://{NW}+|www\.{NW}+", " ")
    c = sub(c, f"{NW}+@{NW}+", " ")
    return "trim(" + sub(c, r"[^a-z0-9.,!?;:'\-]+", " ") + ")"


UUID = r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def passage(x: str, first: list[str]) -> str:
    c = strip(f"replace(replace({x}, chr(10), ' '), chr(13), '')")
    c = f"replace({c}, 'ⓘ', '')"
    for p in first:
        c = sub(c, p)
    c = sub(sub(c, r"\(.*?\)"), f"{WS}+", " ")
    c = sub(c, rf"{WS}+([,;.])", r"\1")
    return strip(sub(c, r"\{.*?\}"))


PASSAGE = [r"\[.*?\]", f"/[^/]*?[{PHONETIC}][^/]*?/"]
GENERATED = [UUID, r"\[.*?\]"]


def plain_words(x: str) -> str:
    return f"list_filter(string_split({sub(f'lower({x})', '[^a-z0-9]+', ' ')}, ' '), lambda w: w <> '')"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def word_tokens(x: str, stop: bool = True) -> str:
    cut = f" AND w NOT IN ({quoted(STOP_WORDS)})" if stop else ""
    return f"list_filter({plain_words(x)}, lambda w: length(w) > 1{cut})"


def letter_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"


def canonical_label(x: str) -> str:
    cases = " ".join(f"WHEN '{v.lower()}' THEN '{v}'" for v in LABELS)
    return f"CASE lower({strip(x)}) {cases} END"


def answer_label(x: str) -> str:
    cases = " ".join(f"WHEN contains(lower({x}), '{v.lower()}') THEN '{v}'" for v in LABELS)
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR starts_with({x}, 'Error') THEN NULL {cases} END"


def seeded(key: str, seed: int = 42) -> str:
    return f"md5(concat('{seed}:', CAST({key} AS VARCHAR)))"
