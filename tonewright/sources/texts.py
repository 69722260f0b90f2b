"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Any table as texts: text_id, text and its other columns as attributes."""
    others = [c for c in rows.columns if c not in (id_col, text_col, "text_id", "text")]
    return rows.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).cast("string").alias("text"), *others)


def read_texts(spark: SparkSession, path: str, id_col: str = "text_id", text_col: str = "text", fmt: str = "parquet") -> DataFrame:
    """A corpus: parquet or json with an id and a text column, or a folder of text files, one text each.

    Text files have the hash of their path as id.
    """
    if fmt == "text":
        files = spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("text_id"), F.col("value").alias("text"))
        return files
    return as_texts(spark.read.format(fmt).load(path), id_col, text_col)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Turns of conversations as texts; conversation and turn make the id and stay as attributes."""
    rows = spark.read.parquet(path)
    return rows.select((F.shiftleft(F.col("conv_id").cast("long"), 20) + F.col("turn")).alias("text_id"), "text", "conv_id", "turn", "role")


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recorded raw outputs: text_id, raw_output."""
    return spark.read.format(fmt).load(path).select(F.col("text_id").cast("long").alias("text_id"), F.col("raw_output").cast("string").alias("raw_output"))


def results_json(results: DataFrame) -> DataFrame:
    """Each result as a JSON text with all fields, nulls too."""
    fields = ["binary_label", "severity", "bias_found", "biased_segments", "unbiased_text", "original_text"]
    return results.select("text_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results as parquet, or as JSON lines."""
    if fmt == "json":
        results_json(results).select("json").write.text(path)
    else:
        results.write.format(fmt).save(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Rejects, one folder a stage."""
    rejects.write.partitionBy("stage").parquet(path)
