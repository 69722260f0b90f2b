"""Spans of located segments: valid, selected, marked, replaced, reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans


def valid_spans(results: DataFrame) -> DataFrame:
    return results.withColumn("biased_segments", spans.valid(F.col("biased_segments")))


def select_spans(results: DataFrame) -> DataFrame:
    return results.withColumn("biased_segments", spans.selected(F.col("biased_segments")))


def mark_original(results: DataFrame) -> DataFrame:
    return results.select("text_id", spans.marked(F.col("original_text"), F.col("biased_segments")).alias("html"))


def mark_rewrite(results: DataFrame) -> DataFrame:
    return results.select("text_id", spans.marked_rewrite(F.col("unbiased_text"), F.col("biased_segments")).alias("html"))


def review_report(results: DataFrame) -> DataFrame:
    return results.select("text_id", spans.report(F.col("bias_found"), F.col("biased_segments"), F.col("unbiased_text")).alias("report"))


def apply_replacements(results: DataFrame) -> DataFrame:
    """The rewrite that the listed phrases alone would give, and whether the responder gave the same."""
    made = spans.replaced(F.col("original_text"), F.col("biased_segments"))
    return results.select("text_id", made.alias("rebuilt"), (made == F.col("unbiased_text")).alias("faithful"))
