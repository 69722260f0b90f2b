"""Segments: merging raw duplicates, validating, locating in the text, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity
from ..functions.text import stripped
from ..schema import SEGMENT

_TEXTS = ("replacement", "severity", "bias_type", "reasoning")
_RAW = "struct<key:string,original:string," + ",".join(f"{n}:string,{n}_kind:string" for n in (*_TEXTS, "start", "end")) + ">"


def _raw(item: Column) -> Column:
    """A segment as it came: each field's text and its JSON type (null where it is missing)."""
    get = lambda n: F.try_variant_get(item, f"$.{n}", "variant")
    original = F.try_variant_get(item, "$.original", "string")
    fields = [stripped(original).alias("key"), original.alias("original")]
    for n in (*_TEXTS, "start", "end"):
        fields += [F.try_variant_get(item, f"$.{n}", "string").alias(n), F.schema_of_variant(get(n)).alias(f"{n}_kind")]
    return F.struct(*fields).cast(_RAW)


def _ok_text(kind: Column) -> Column:
    return kind.isNull() | (kind == "STRING")


def _met(old: Column, new: Column) -> Column:
    """What stays of two segments with one phrase: the first, with the other's type and reasoning where they are new."""
    types = F.transform(F.split(F.coalesce(old["bias_type"], F.lit("")), "/"), lambda t: stripped(t))
    added = stripped(F.coalesce(new["bias_type"], F.lit("")))
    kind = F.when((added != "") & ~F.array_contains(types, added), F.concat(stripped(old["bias_type"]), F.lit(" / "), added)).otherwise(old["bias_type"])
    before, more = F.coalesce(old["reasoning"], F.lit("")), stripped(F.coalesce(new["reasoning"], F.lit("")))
    joins = (more != "") & ~F.contains(before, more)
    why = F.when(joins, F.concat(stripped(before), F.lit(" "), more)).otherwise(old["reasoning"])
    higher = severity.rank(F.coalesce(new["severity"], F.lit("low"))) > severity.rank(F.coalesce(old["severity"], F.lit("low")))
    values = {"bias_type": kind, "reasoning": why, "severity": F.when(higher, new["severity"]).otherwise(old["severity"])}
    kinds = {"reasoning_kind": F.when(joins, F.lit("STRING")).otherwise(old["reasoning_kind"]), "severity_kind": F.when(higher, new["severity_kind"]).otherwise(old["severity_kind"])}
    names = ["key", "original", *[x for n in (*_TEXTS, "start", "end") for x in (n, f"{n}_kind")]]
    return F.struct(*[(values | kinds).get(n, old[n]).alias(n) for n in names]).cast(_RAW)


def _clash(old: Column, new: Column) -> Column:
    """Whether two segments with one phrase can't be merged: fields that aren't text, or a type where the first has none."""
    bad = F.lit(False)
    for n in ("bias_type", "reasoning", "severity"):
        bad = bad | ~_ok_text(old[f"{n}_kind"]) | ~_ok_text(new[f"{n}_kind"])
    return bad | (old["bias_type_kind"].isNull() & (stripped(F.coalesce(new["bias_type"], F.lit(""))) != ""))


def merged(items: Column) -> Column:
    """(bad, items) of an array of variants: segments with one phrase as one, in the order of their first."""
    start = F.struct(F.lit(False).alias("bad"), F.array().cast(f"array<{_RAW}>").alias("items"))

    def read(item: Column) -> Column:
        wrong = ~F.schema_of_variant(item).startswith("OBJECT") | ~_ok_text(F.schema_of_variant(F.try_variant_get(item, "$.original", "variant")))
        return F.struct(_raw(item).alias("new"), F.coalesce(wrong, F.lit(True)).alias("wrong"))

    def step(s: Column, item: Column) -> Column:
        new, wrong = item["new"], item["wrong"]
        same = F.filter(s["items"], lambda x: x["key"] == new["key"])
        fresh = F.concat(s["items"], F.array(new))
        joined = F.transform(s["items"], lambda x: F.when(x["key"] == new["key"], _met(x, new)).otherwise(x))
        blank = F.coalesce(new["key"], F.lit("")) == ""
        clash = (F.size(same) > 0) & F.coalesce(_clash(same[0], new), F.lit(False))
        return F.struct(
            (s["bad"] | wrong | (~blank & clash)).alias("bad"),
            F.when(s["bad"] | wrong | blank | clash, s["items"]).when(F.size(same) == 0, fresh).otherwise(joined).alias("items"),
        )

    return F.aggregate(F.transform(items, read), start, step)


def _whole(text: Column, kind: Column) -> Column:
    """Offsets: whole numbers, also as text; (value, fine)."""
    fine = kind.isNull() | (kind == "VOID") | (kind == "BOOLEAN") | text.rlike(r"^\s*[+-]?\d{1,9}(\.0*)?\s*$")
    value = F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).otherwise(F.regexp_extract(text, r"^\s*([+-]?\d{1,9})", 1).try_cast("int"))
    return F.struct(value.alias("value"), fine.alias("fine"))


def invalid(items: Column) -> Column:
    """Whether a merged segment breaks the schema."""

    def fine(x: Column) -> Column:
        good = _whole(x["start"], x["start_kind"])["fine"] & _whole(x["end"], x["end_kind"])["fine"]
        for name in _TEXTS:
            good = good & _ok_text(x[f"{name}_kind"])
        return good

    return F.exists(items, lambda x: ~fine(x))


def typed(items: Column) -> Column:
    """Merged segments with defaults and the severity of their scale."""
    empty = F.lit("")
    return F.transform(
        items,
        lambda x: F.struct(
            x["original"].alias("original"),
            F.coalesce(x["replacement"], empty).alias("replacement"),
            F.when(x["severity"].isNull(), "medium").otherwise(severity.of_segment(x["severity"])).alias("severity"),
            F.coalesce(x["bias_type"], empty).alias("bias_type"),
            F.coalesce(x["reasoning"], empty).alias("reasoning"),
            _whole(x["start"], x["start_kind"])["value"].alias("start"),
            _whole(x["end"], x["end_kind"])["value"].alias("end"),
        ).cast(SEGMENT),
    )


def located(text: Column, segments: Column) -> Column:
    """Segments with offsets in code points: each from where the one before ended, else from the start; in order of start.

    What isn't found keeps its offsets; a missing start counts as 0 in the order, and equals keep their order.
    """
    # The lowered text goes along with the fold, so it is lowered once.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SEGMENT}>").alias("out"), F.lower(text).alias("low"))

    def step(s: Column, x: Column) -> Column:
        phrase = F.lower(x["original"])
        ahead = F.call_function("locate", phrase, s["low"], s["at"] + 1)
        found = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", phrase, s["low"])) - 1
        end = found + F.length(x["original"])
        offsets = [F.when(found >= 0, found).otherwise(x["start"]).alias("start"), F.when(found >= 0, end).otherwise(x["end"]).alias("end")]
        here = F.struct(*[x[n] for n in ("original", *_TEXTS)], *offsets).cast(SEGMENT)
        return F.struct(F.when(found >= 0, end).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.array(here)).alias("out"), s["low"].alias("low"))

    out = F.aggregate(segments, start, step, lambda s: s["out"])
    keyed = F.transform(out, lambda x, i: F.struct(F.coalesce(x["start"], F.lit(0)).alias("by"), i.alias("pos"), x.alias("segment")))
    return F.transform(F.array_sort(keyed), lambda x: x["segment"])


def explode_segments(results: DataFrame) -> DataFrame:
    """One row a segment: text_id, pos and the segment's fields."""
    return results.select("text_id", F.posexplode("biased_segments").alias("pos", "s")).select("text_id", "pos", "s.*")


def number_segments(segments: DataFrame) -> DataFrame:
    """Adds ordinal, from 1, in the order of display."""
    order = Window.partitionBy("text_id").orderBy(F.coalesce("start", F.lit(0)), "pos")
    return segments.withColumn("ordinal", F.row_number().over(order))


def match_quality(results: DataFrame) -> DataFrame:
    """Adds quality to each segment: exact, case (only without regard to case) or none."""
    rows = results.select("text_id", "original_text", F.posexplode("biased_segments").alias("pos", "s"))
    exact, case = F.contains(F.col("original_text"), F.col("s.original")), F.contains(F.lower("original_text"), F.lower("s.original"))
    return rows.select("text_id", "pos", F.col("s.original").alias("original"), F.when(exact, "exact").when(case, "case").otherwise("none").alias("quality"))
