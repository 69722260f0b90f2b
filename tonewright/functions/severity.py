"""Coercion of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GLOBAL_SEVERITIES, SEGMENT_SEVERITIES
from .text import stripped

_WHOLE = r"(?U)\A[+-]?\d+(?:_\d+)*\z"


def _clamped(number: Column) -> Column:
    """0 for none and below, 2 to 4 as they are, 1 as 2, all else as 4 (fractions above 0 too)."""
    return F.when(number <= 0, 0).when(number.isin(2, 3, 4), number.cast("int")).when(number == 1, 2).otherwise(4)


def from_text(text: Column) -> Column:
    """A global severity that came as text: a word of the scale, a whole number, else 2."""
    word = stripped(F.lower(text))
    known = F.lit(None).cast("int")
    for name, value in GLOBAL_SEVERITIES.items():
        known = F.when(word == name, F.lit(value)).otherwise(known)
    digits = F.replace(word, F.lit("_"), F.lit(""))
    whole = F.when(word.rlike(_WHOLE), F.coalesce(digits.try_cast("decimal(38,0)"), F.when(digits.startswith("-"), -1).otherwise(9).cast("decimal(38,0)")))
    return F.coalesce(known, F.when(whole.isNotNull(), _clamped(whole)), F.lit(2))


def from_variant(value: Column) -> Column:
    """A global severity of any JSON type; null where the type allows none."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "STRING", from_text(F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), 2).otherwise(0))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _clamped(number))
    )


def of_segment(text: Column) -> Column:
    """A segment's severity: a word of its scale, else medium."""
    word = stripped(F.lower(text))
    return F.when(word.isin(*SEGMENT_SEVERITIES), word).otherwise("medium")


def rank(text: Column) -> Column:
    """Order of segment severities; what isn't one ranks lowest."""
    return F.when(F.lower(text) == "high", 3).when(F.lower(text) == "medium", 2).otherwise(1)
