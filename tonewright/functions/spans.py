"""Columns on located segments of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEGMENT
from .text import escaped


def valid(segments: Column) -> Column:
    """Segments with both offsets."""
    return F.filter(segments, lambda s: s["start"].isNotNull() & s["end"].isNotNull())


def selected(segments: Column) -> Column:
    """Of the valid ones, by start: those that begin at or after the end of the last one taken."""
    ordered = F.transform(F.array_sort(F.transform(valid(segments), lambda s, i: F.struct(s["start"].alias("by"), i.alias("pos"), s.alias("s")))), lambda x: x["s"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SEGMENT}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out")))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def _woven(text: Column, chosen: Column, between, within) -> Column:
    """A text built of what stands between chosen spans and of the spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    part = lambda a, b: F.substring(text, a + 1, b - a)

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], between(part(acc["at"], s["start"])), within(s, part(s["start"], s["end"]))).alias("out"))

    return F.aggregate(chosen, start, step, lambda acc: F.concat(acc["out"], between(F.substring(text, acc["at"] + 1, F.length(text)))))


def marked(text: Column, segments: Column) -> Column:
    """The text as HTML with the selected spans marked by severity."""
    safe = lambda t: escaped(t, breaks=True)
    return _woven(text, selected(segments), safe, lambda s, t: F.concat(F.lit('<mark class="severity-'), s["severity"], F.lit('">'), safe(t), F.lit("</mark>")))


def replaced(text: Column, segments: Column) -> Column:
    """The text with the selected spans' replacements in their places."""
    return _woven(text, selected(segments), lambda t: t, lambda s, _: s["replacement"])


def marked_rewrite(rewrite: Column, segments: Column) -> Column:
    """The rewrite as HTML; the first occurrence of each replacement is marked, one after the other."""

    def step(out: Column, s: Column) -> Column:
        word = escaped(s["replacement"], breaks=False)
        at = F.call_function("locate", word, out)
        mark = F.concat(F.substring(out, F.lit(1), at - 1), F.lit('<mark class="replaced">'), word, F.lit("</mark>"), F.substring(out, at + F.length(word), F.length(out)))
        return F.when((word != "") & (at > 0), mark).otherwise(out)

    return F.aggregate(segments, escaped(rewrite, breaks=False), step)


def report(found: Column, segments: Column, rewrite: Column) -> Column:
    """A block of plain text for review: number of segments, each with its fields, and the rewrite."""
    each = F.transform(
        segments,
        lambda s, i: F.concat(
            *[F.lit("["), (i + 1).cast("string"), F.lit("] "), F.upper(s["severity"]), F.lit("\nOriginal: "), s["original"]],
            *[F.lit("\nReplacement: "), s["replacement"], F.lit("\nBias type: "), s["bias_type"], F.lit("\nReasoning: "), s["reasoning"]],
        ),
    )
    count = F.when(found, F.concat(F.lit("Segments found: "), F.size(segments).cast("string")))
    none = F.when(F.size(segments) == 0, "No biased segments.")
    return F.concat_ws("\n", count, none, F.array_join(each, "\n"), F.lit("Neutral rewrite:"), rewrite)
