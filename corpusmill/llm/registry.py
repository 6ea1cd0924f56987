"""Queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES  # noqa: F401
from . import copies, leaks, mixing, neardup, overlap, pieces, splits


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlapping_pairs(_read(spark, folder, "dataset"), _read(spark, folder, "dataset_test"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_read(spark, folder, "dataset"), _read(spark, folder, "dataset_test"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_read(spark, folder, "dataset"))


def p2_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.group_report(_read(spark, folder, "dataset"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_sets(_read(spark, folder, "dataset"))


def p3_one_of_each(spark: SparkSession, folder: str) -> DataFrame:
    return copies.one_of_each(_read(spark, folder, "dataset"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.linked_units(_read(spark, folder, "dataset"))


def p4_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_assignment(_read(spark, folder, "dataset"), _read(spark, folder, "split_targets"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_report(_read(spark, folder, "dataset"), _read(spark, folder, "split_targets"))


def p4_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the assignment: units whole, every row once, splits within a bin's weight of their share."""
    return splits.assignment_faults(_read(spark, folder, "dataset"), _read(spark, folder, "split_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_pairs(_read(spark, folder, "documents"), _read(spark, folder, "dataset_test"))


def p5_longest_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.longest_matches(_read(spark, folder, "documents"), _read(spark, folder, "dataset_test"))


def p5_clean_sources(spark: SparkSession, folder: str) -> DataFrame:
    kept = leaks.without_leaks(_read(spark, folder, "documents"), _read(spark, folder, "dataset_test"))
    return kept.groupBy("source").agg(F.count("*").alias("documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.unreachable_sources(_read(spark, folder, "documents"), _read(spark, folder, "source_targets"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.fit_mix(_read(spark, folder, "documents"), _read(spark, folder, "source_targets")).report()


def p6_wanted(spark: SparkSession, folder: str) -> DataFrame:
    """The exact part of the report: tokens there are and tokens wanted of each source."""
    report = mixing.fit_mix(_read(spark, folder, "documents"), _read(spark, folder, "source_targets")).report()
    return report.select("source", "tokens", F.round("wanted_tokens").cast("bigint").alias("wanted_tokens"), "reachable")


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the fit and the draw: repeats kept, the fit settled, its tokens within 1 % of what is wanted where there is room."""
    return mixing.fit_mix(_read(spark, folder, "documents"), _read(spark, folder, "source_targets")).faults()


def p6_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.drawn_shares(_read(spark, folder, "documents"), _read(spark, folder, "source_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = pieces.size_limit(_read(spark, folder, "size_limits"))
    return pieces.not_naturally_divisible(_read(spark, folder, "documents"), limit, overlap)


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = pieces.size_limit(_read(spark, folder, "size_limits"))
    return pieces.pieces(_read(spark, folder, "documents"), limit, overlap).select("doc_id", "piece", "first_token", "tokens", "natural", "text")


def p7_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces without their texts."""
    limit, overlap = pieces.size_limit(_read(spark, folder, "size_limits"))
    return pieces.pieces(_read(spark, folder, "documents"), limit, overlap, with_text=False).select("doc_id", "piece", "first_token", "tokens", "natural")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_group_sizes": p2_group_sizes,
    "p3_found": p3_found,
    "p3_one_of_each": p3_one_of_each,
    "p4_found": p4_found,
    "p4_assignment": p4_assignment,
    "p4_report": p4_report,
    "p4_checked": p4_checked,
    "p5_found": p5_found,
    "p5_longest_matches": p5_longest_matches,
    "p5_clean_sources": p5_clean_sources,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_wanted": p6_wanted,
    "p6_checked": p6_checked,
    "p6_drawn": p6_drawn,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_cuts": p7_cuts,
}
