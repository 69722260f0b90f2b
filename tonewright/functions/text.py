"""Columns on plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Goes to the end at once and back to the last character that isn't white space.
_INNER = r"(?sU)\A[\s\x1c-\x1f]*+(.*[^\s\x1c-\x1f])?"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_extract(text, _INNER, 1)


def quoted(text: Column) -> Column:
    """Text as a JSON string, with its quotes."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)\A\[(.*)\]\z", 1)


def escaped(text: Column, breaks: bool) -> Column:
    """Text as HTML; line breaks too, where wanted."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.replace(out, F.lit("\n"), F.lit("<br/>")) if breaks else out
