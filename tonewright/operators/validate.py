"""Untyped data to typed results or rejects: exactly one outcome a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity
from ..functions.text import stripped
from ..schema import LABELS
from . import segments

# Texts that count as a flag, whatever their case.
_TRUE, _FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def flag(value: Column) -> Column:
    """A flag from a JSON boolean, 1 or 0, or one of the fixed texts (not trimmed); else null."""
    kind, text, number = F.schema_of_variant(value), F.lower(F.try_variant_get(value, "$", "string")), F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.when(text.isin(*_TRUE), True).when(text.isin(*_FALSE), False))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(number == 1, True).when(number == 0, False))
    )


def validate_results(parsed: DataFrame) -> DataFrame:
    """Adds binary_label, severity, bias_found, biased_segments, unbiased_text, reject_reason and reject_field.

    Segments with one phrase are merged before they are judged. Where reject_reason (not_json, bad_segment or
    schema_mismatch) is set, the result's columns are null; reject_field names all fields that break the schema.
    """
    field = lambda n: F.try_variant_get("data", f"$.{n}", "variant")
    kind = lambda n: F.schema_of_variant(field(n))
    text = lambda n: F.when(kind(n) == "STRING", F.try_variant_get("data", f"$.{n}", "string"))
    rows = parsed.withColumns(
        {
            "_label": stripped(F.lower(text("binary_label"))),
            "_severity": severity.from_variant(field("severity")),
            "_found": flag(field("bias_found")),
            "_merged": segments.merged(F.try_variant_get("data", "$.biased_segments", "array<variant>")),
            "_rewrite": text("unbiased_text"),
        }
    )
    items = F.col("_merged.items")
    checks = [
        ("binary_label", F.col("_label").isin(*LABELS)),
        ("severity", F.col("_severity").isNotNull()),
        ("bias_found", F.col("_found").isNotNull()),
        ("biased_segments", F.col("_merged").isNotNull() & ~segments.invalid(items)),
        ("unbiased_text", F.col("_rewrite").isNotNull()),
    ]
    broken = F.nullif(F.concat_ws(",", *[F.when(~F.coalesce(fine, F.lit(False)), F.lit(name)) for name, fine in checks]), F.lit(""))
    reason = F.when(F.col("data").isNull(), "not_json").when(F.coalesce(F.col("_merged.bad"), F.lit(False)), "bad_segment").when(F.col("_broken").isNotNull(), "schema_mismatch")
    judged = rows.withColumn("_broken", broken).withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    return judged.select(
        *parsed.columns,
        F.when(good, F.col("_label")).alias("binary_label"),
        F.when(good, F.col("_severity")).alias("severity"),
        F.when(good, F.col("_found")).alias("bias_found"),
        F.when(good, segments.typed(items)).alias("biased_segments"),
        F.when(good, F.col("_rewrite")).alias("unbiased_text"),
        "reject_reason",
        F.when(F.col("reject_reason") == "schema_mismatch", F.col("_broken")).alias("reject_field"),
    )
