"""Results and rejects side by side: what has an outcome, what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_outcomes(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of a judged table; write it first, or both read the responder's output anew.

    A reject's detail is the responder's error, or the names of all fields that break the schema.
    """
    drop = ("data", "raw_output", "error", "reject_reason", "reject_field", "stage")
    results = judged.where("reject_reason IS NULL").drop(*drop)
    detail = [F.col(c) for c in ("error", "reject_field") if c in judged.columns]
    rejects = judged.where("reject_reason IS NOT NULL").select("text_id", "raw_output", "stage", F.col("reject_reason").alias("reason"), F.coalesce(*detail, F.lit(None).cast("string")).alias("detail"))
    return results, rejects


def attach_source(results: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Results with the text that they are about (as original_text) and its attributes."""
    return results.drop("original_text").join(texts.withColumnRenamed(text_col, "original_text"), "text_id")


def pending_texts(texts: DataFrame, *done: DataFrame) -> DataFrame:
    """Texts with neither result nor reject."""
    known = done[0].select("text_id")
    for other in done[1:]:
        known = known.unionByName(other.select("text_id"))
    return texts.join(known, "text_id", "left_anti")


def outcomes(results: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row a text that has an outcome: result, or the stage and reason of its reject."""
    none = F.lit(None).cast("string")
    return results.select("text_id", F.lit("result").alias("status"), none.alias("stage"), none.alias("reason")).unionByName(rejects.select("text_id", F.lit("reject").alias("status"), "stage", "reason"))
