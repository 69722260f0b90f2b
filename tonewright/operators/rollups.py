"""Counts and rates over results. All group on short columns; texts are pruned before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import SEGMENT_SEVERITIES


def _of(severity: str) -> Column:
    return F.size(F.filter("biased_segments", lambda s: s["severity"] == severity)).cast("long")


def severity_counts(results: DataFrame, *by: str) -> DataFrame:
    """Segments by severity in each group; nothing is exploded."""
    return results.groupBy(*by).agg(*[F.sum(_of(s)).alias(s) for s in reversed(SEGMENT_SEVERITIES)], F.count("*").alias("n_texts"))


def segment_counts(results: DataFrame) -> DataFrame:
    return results.select("text_id", F.size("biased_segments").cast("long").alias("n_segments"))


def bias_type_counts(results: DataFrame, k: int | None = None) -> DataFrame:
    """How often each bias type occurs (merged ones count apart); the k most frequent, where k is given."""
    types = results.select(F.explode("biased_segments.bias_type").alias("t")).select(F.explode(F.split("t", "/")).alias("t")).select(stripped(F.col("t")).alias("bias_type"))
    counts = types.where("bias_type != ''").groupBy("bias_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "bias_type").limit(k) if k else counts


def label_rates(results: DataFrame, *by: str) -> DataFrame:
    """Share of biased texts, mean severity and share of repaired outputs, with all totals."""
    mean = lambda c: F.round(F.avg(c), 6)
    return results.cube(*by).agg(
        F.grouping_id().cast("long").alias("level"),
        F.count("*").alias("n_texts"),
        mean((F.col("binary_label") == "biased").cast("double")).alias("biased_share"),
        mean(F.col("severity").cast("double")).alias("mean_severity"),
        mean((F.col("repair_strategy") != "direct").cast("double")).alias("repaired_share"),
    )


#: Rules of the prompt's contract that no schema enforces.
RULES = {
    "unbiased_with_severity": "binary_label = 'unbiased' AND severity != 0",
    "unbiased_with_flag": "binary_label = 'unbiased' AND bias_found",
    "unbiased_with_segments": "binary_label = 'unbiased' AND size(biased_segments) > 0",
    "unbiased_but_changed": "binary_label = 'unbiased' AND unbiased_text != original_text",
    "flag_without_segments": "bias_found AND size(biased_segments) = 0",
    "biased_without_flag": "binary_label = 'biased' AND NOT bias_found",
}


def consistency_audit(results: DataFrame) -> DataFrame:
    """Number of results that break each rule; one row."""
    return results.agg(*[F.coalesce(F.sum(F.expr(rule).cast("long")), F.lit(0)).cast("long").alias(name) for name, rule in RULES.items()], F.count("*").alias("n_results"))


def top_texts(results: DataFrame, k: int) -> DataFrame:
    """The k worst texts: by severity, then segments of high severity, then id."""
    return results.select("text_id", "severity", _of("high").alias("n_high")).orderBy(F.desc("severity"), F.desc("n_high"), "text_id").limit(k)
