"""Segments with one phrase merged over a table of segments, as `segments.merged` does within one answer.

Merging is an ordered fold. What a stretch of a group's rows adds to it can be written in short: the types and reasonings
that no earlier row of the stretch makes redundant. So rows are folded by (text, phrase, stretch of BLOCK positions) first,
and a group's stretches then; neither a text nor a phrase with a third of all rows is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity
from ..functions.text import once, stripped

#: Positions of a text that are folded at a time.
BLOCK = 1024
_VALUES = "array<struct<pos:bigint,value:string>>"


def _parts(value: Column) -> Column:
    return F.transform(F.split(value, "/"), lambda t: stripped(t))


def _no_types() -> Column:
    return F.array().cast(_VALUES)


def _needed_types(values: Column) -> Column:
    """Types that may be added: not one without a slash that an earlier value has as a part (one with a slash always is)."""
    start = F.struct(_no_types().alias("out"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        known = F.array_contains(s["parts"], x["value"])
        return F.when(known, s).otherwise(F.struct(F.concat(s["out"], F.array(x)).alias("out"), F.array_union(s["parts"], _parts(x["value"])).alias("parts")))

    return F.aggregate(values, start, step, lambda s: s["out"])


def _needed_reasons(values: Column) -> Column:
    """Reasonings that may be added: not those that stand within an earlier one."""
    return F.aggregate(values, _no_types(), lambda out, x: F.when(F.exists(out, lambda y: F.contains(y["value"], x["value"])), out).otherwise(F.concat(out, F.array(x))))


def _with_types(first: Column, later: Column) -> Column:
    """Types added in order: one with a slash always, another where neither the first nor an earlier one has it as a part.

    Sorting finds the first place of each part, so the work is about linear in the group, as is the text that it gives.
    """
    place = lambda x, i: F.transform(_parts(x["value"]), lambda p: F.struct(p.alias("part"), i.alias("at"), F.contains(x["value"], F.lit("/")).alias("several")))
    parts = F.array_sort(F.flatten(F.transform(later, place)))
    entry = lambda at, value: F.struct(at.alias("at"), value.alias("value"))
    leads = once(parts, lambda every: F.filter(every, lambda x, i: ~F.coalesce(F.get(every, i - 1)["part"] == x["part"], F.lit(False))))
    known = _parts(F.coalesce(first, F.lit("")))
    single = F.transform(F.filter(leads, lambda x: ~x["several"] & ~F.array_contains(known, x["part"])), lambda x: entry(x["at"], x["part"]))
    several = F.filter(F.transform(later, lambda x, i: entry(i, x["value"])), lambda x: F.contains(x["value"], F.lit("/")))

    def joined(added: Column) -> Column:
        text = F.concat(stripped(first), F.lit(" / "), F.array_join(F.transform(added, lambda x: x["value"]), " / "))
        return F.when(F.size(added) == 0, first).when(F.size(added) == 1, text).otherwise(stripped(text))

    return once(F.array_sort(F.concat(single, several)), joined)


def _with_reasons(first: Column, later: Column) -> Column:
    return F.aggregate(later, first, lambda text, x: F.when(F.contains(F.coalesce(text, F.lit("")), x["value"]), text).otherwise(F.concat(stripped(F.coalesce(text, F.lit(""))), F.lit(" "), x["value"])))


def merge_segment_rows(rows: DataFrame) -> DataFrame:
    """Segments (text_id, pos, original, replacement, severity, bias_type, reasoning) with one phrase in a text as one row.

    pos orders a text's segments and is that of the first one in the result; the first one's original and replacement stay,
    new types and reasonings are added, the highest severity is taken. clash says that the first one has no type (null) and
    a later one does, which an answer is rejected for. Null and blank originals are dropped; null ids are a text of their own.
    """
    keyed = rows.withColumns({"key": stripped(F.col("original")), "block": F.floor(F.col("pos") / BLOCK), "pos": F.col("pos").cast("long")}).where("key != ''")
    rank = severity.rank(F.coalesce("severity", F.lit("low")))
    noted = lambda c: F.sort_array(F.collect_list(F.when(stripped(F.coalesce(c, F.lit(""))) != "", F.struct("pos", stripped(F.col(c)).alias("value"))))).cast(_VALUES)
    folded = keyed.groupBy("text_id", "key", "block").agg(
        F.min(F.struct("pos", "original", "replacement", "bias_type", "reasoning")).alias("first"),
        F.min(F.struct((-rank).alias("rank"), "pos", "severity")).alias("highest"),
        noted("bias_type").alias("types"),
        noted("reasoning").alias("reasons"),
    )
    short = folded.select("text_id", "key", "block", "first", "highest", _needed_types(F.col("types")).alias("types"), _needed_reasons(F.col("reasons")).alias("reasons"))
    in_order = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", c))), lambda x: x[c]))
    met = short.groupBy("text_id", "key").agg(F.min("first").alias("first"), F.min("highest").alias("highest"), in_order("types").alias("types"), in_order("reasons").alias("reasons"))
    later = lambda c: F.filter(c, lambda x: x["pos"] != F.col("first.pos"))
    return met.select(
        "text_id",
        "first.pos",
        "first.original",
        "first.replacement",
        "highest.severity",
        _with_types(F.col("first.bias_type"), later("types")).alias("bias_type"),
        _with_reasons(F.col("first.reasoning"), later("reasons")).alias("reasoning"),
        (F.col("first.bias_type").isNull() & (F.size(later("types")) > 0)).alias("clash"),
    )
