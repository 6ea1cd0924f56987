"""Readers and writers: ``;``-separated files, term lists, word vectors, JSON documents, model tables."""

from __future__ import annotations

import json
import warnings

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sink_safe, strip

ALIASES = {"labels": "label", "id": "id", "termo": "termo", "text": "text"}


def normalize_columns(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Column names without outer space and byte-order mark, in lower case, aliases resolved.

    Of columns that come to the same name the first keeps it, the others get a suffix ``_2``, ``_3`` and so on.
    """
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = c.lstrip("﻿").strip().lower()
        n = aliases.get(n, n)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def read_csv(spark: SparkSession, path, schema: str | T.StructType | None = None, na: bool = True) -> DataFrame:
    """A ``;``-separated file with header; doubled quotes, line ends and separators inside quotes are read as text.

    Without a schema all columns are strings.  With ``na`` the text ``NA`` counts as null, as an empty field does.
    """
    r = spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = (r.schema(schema) if schema else r).csv(path)
    df = normalize_columns(df)
    return df.withColumns({f.name: F.nullif(F.col(f.name), F.lit("NA")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}) if na else df


def read_all(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame | None:
    """The required columns of every readable file that has them, with ``source_file``; others are skipped with a warning.

    None if no file is left.
    """
    out = None
    for p in paths:
        try:
            df = read_csv(spark, p)
        except PySparkException as e:  # a missing or broken file is skipped
            warnings.warn(f"skipped {p}: {str(e)[:100]}", stacklevel=2)
            continue
        if not set(required) <= set(df.columns):
            warnings.warn(f"skipped {p}: it lacks {sorted(set(required) - set(df.columns))}", stacklevel=2)
            continue
        part = df.select(*required, F.lit(p).alias("source_file"))
        out = part if out is None else out.unionByName(part)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", safe: str | None = None) -> None:
    """``;``-separated with header; ``mode='append'`` adds rows; ``safe`` names a text column to sanitise first."""
    df = df.withColumn(safe, sink_safe(F.col(safe))) if safe else df
    df.write.mode(mode).option("sep", ";").option("header", True).option("quoteAll", False).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(term)``: a text file's lines, stripped, without blank ones."""
    return spark.read.text(path).select(strip(F.col("value")).alias("term")).where("term <> ''")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def known_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct keys of a file; empty where the file is missing, broken or lacks the column."""
    try:
        df = read_csv(spark, path)
        if key in df.columns:
            return df.select(key).where(F.col(key).isNotNull()).distinct()
    except PySparkException:  # no such file, or none that can be read
        pass
    return spark.createDataFrame([], f"`{key}` string")


def inventory(spark: SparkSession, path, by: str | None = None) -> DataFrame:
    """``(file, n, first_label)`` of the CSV files below a path, or of its folders ``<by>=...`` as ``(by, n, first_label)``."""
    df = read_csv(spark, path).withColumn("file", F.element_at(F.split(F.input_file_name(), r"[\\/]"), -1)).withColumn("_ord", F.monotonically_increasing_id())
    return df.groupBy(by or "file").agg(F.count("*").alias("n"), F.min_by("label", "_ord").alias("first_label"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector ARRAY<FLOAT>)`` from lines ``word f1 f2 ...``; lines without numbers are left out."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("vector")).where("size(vector) > 0")


def read_checkpoint(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """``(id, label)`` of a JSON checkpoint: an object id -> label, or, with ``ids(id, ord)``, a list in their order."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()) or "{}"
    data = json.loads(text)
    if isinstance(data, dict):
        return spark.createDataFrame([(k, v) for k, v in data.items()], "id string, label string")
    listed = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "ord bigint, label string")
    return ids.join(listed, "ord").select("id", "label")


def write_checkpoint(df: DataFrame, path: str) -> None:
    """Predictions as parquet parts that a resumed run can append to."""
    df.select("id", "model", "label").write.mode("append").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_checkpoint`` has written so far."""
    return spark.read.schema("id string, model string, label string").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, nulls written out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def submission(predictions: DataFrame, ids: DataFrame, with_text: bool = False) -> DataFrame:
    """``ID;Label`` rows in the order of ``ids(id, ord[, text])``, a missing prediction as ``Human``; ``ID;Text;Labels`` with text."""
    j = ids.join(predictions.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit("Human"))).orderBy("ord")
    return j.select(F.col("id").alias("ID"), F.col("text").alias("Text"), F.col("label").alias("Labels")) if with_text else j.select(F.col("id").alias("ID"), F.col("label").alias("Label"))


def save_model(path: str, **tables: DataFrame) -> None:
    """A fitted model as a folder of parquet tables, one for each part."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
