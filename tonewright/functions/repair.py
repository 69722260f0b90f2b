"""Getting a JSON object out of a model's raw output: steps as columns.

The folds run over tokens (a closed bracket with all that it holds, a string, a bracket, or what lies between), so they
are linear in the output's length, and interpreted steps are few: one at most for each token outside closed brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, quoted, stripped

# The JSON keys and the shapes (fences, missing commas, single fields) that the patterns of this module know.
#: Possessive throughout: outputs of any length match without backtracking.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'
_BESIDE = r'[^"{}\[\]]++'


def _shut(levels: int) -> str:
    """A pattern of a bracket that closes, with brackets in it down to the given number of levels."""
    within = rf'(?:{_BESIDE}|{_STRING}"' + (f"|{_shut(levels - 1)}" if levels > 1 else "") + ")*+"
    return rf"\{{{within}\}}|\[{within}\]"


#: Brackets nested more deeply are tokens of their own: slower, with the same outcome.
_TOKEN = rf'(?s){_shut(4)}|{_STRING}(?:"|\\?+)|[{{}}\[\]]|{_BESIDE}'
_CLOSED = r'(?s)\A"[^"\\]*+(?:\\.[^"\\]*+)*+"\z'
_FENCE = r"(?s)```(?:json)?(?U:\s*)(\{.*\})(?U:\s*)```"
_NO_COMMA = r'(?U)(["\d\]}\w])\s*\n(\s*")'


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def extracted(raw: Column) -> Column:
    """The first object of an output: of a fenced block as a whole, else from the first brace to where it closes.

    An object that never closes ends after its last character outside strings.
    """
    body = F.substring(raw, F.locate("{", raw), F.length(raw))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"), F.lit(False).alias("done"))

    def step(s: Column, token: Column) -> Column:
        text, after = token.startswith('"'), s["at"] + F.length(token)
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        moved = F.struct(after.alias("at"), depth.alias("depth"), F.when(text, s["end"]).otherwise(after).alias("end"), (~text & token.endswith("}") & (depth == 0)).alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    cut = F.aggregate(_tokens(body), start, step, lambda s: s["end"])
    bare = F.when(F.locate("{", raw) == 0, stripped(raw)).otherwise(stripped(F.substring(body, F.lit(1), cut)))
    return once(F.regexp_extract(raw, _FENCE, 1), lambda fence: F.when(fence != "", stripped(fence)).otherwise(bare))


def without_thoughts(text: Column) -> Column:
    """What follows the first closing tag of a think block; nothing, if one only opens."""
    tag = "</think>"

    def rest(t: Column) -> Column:
        after = F.substring(t, F.locate(tag, t) + len(tag), F.length(t))
        return F.when(t.contains(tag), stripped(after)).when(t.contains("<think>"), F.lit("")).otherwise(t)

    return once(text, rest)


def closed(text: Column) -> Column:
    """Text with the quote and brackets that are missing at its end."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("text"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        now = F.when(opens, F.concat(s["open"], token)).when(closes, F.substring(s["open"], F.lit(1), F.greatest(F.length(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        return F.struct(now.alias("open"), (token.startswith('"') & ~token.rlike(_CLOSED)).alias("text"))

    def tail(s: Column) -> Column:
        return F.concat(F.when(s["text"], '"').otherwise(""), F.translate(F.reverse(s["open"]), "{[", "}]"))

    return once(text, lambda t: F.concat(t, F.aggregate(_tokens(t), start, step, tail)))


def with_commas(text: Column) -> Column:
    """Commas put where a line ends a value and the next one starts with a quote."""
    return F.regexp_replace(text, _NO_COMMA, "$1,\n$2")


def _alone(text: Column) -> Column:
    """The one JSON value that a text holds, as a variant, else null. Two readings rule out what follows the value."""
    beside = F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit("}")))
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return once(values, lambda v: F.when((F.size(v) == 1) & beside.isNotNull(), v[0]))


def parsed(text: Column) -> Column:
    """A JSON object as a variant; null for anything else."""
    return once(text, lambda t: F.when(t.rlike(r"\A[ \t\r\n]*+\{"), _alone(t)))


def parsed_list(text: Column) -> Column:
    """As parsed, for an array; its text."""
    return once(text, lambda t: F.when(t.rlike(r"\A[ \t\r\n]*+\["), F.to_json(_alone(t))))


def salvaged(text: Column) -> Column:
    """An object of the fields that patterns find; null unless label, severity and flag are there."""
    label = F.regexp_extract(text, r'"binary_label"(?U:\s*):(?U:\s*)"([^"]+)"', 1)
    number = F.regexp_extract(text, r'"severity"(?U:\s*):(?U:\s*)([0-9]+)', 1)
    flag = F.lower(F.regexp_extract(text, r'(?i)"bias_found"(?U:\s*):(?U:\s*)(true|false)', 1))
    has_text = text.rlike(r'"unbiased_text"(?U:\s*):(?U:\s*)"')
    rewrite = stripped(F.replace(F.regexp_extract(text, r'(?sd)"unbiased_text"(?U:\s*):(?U:\s*)"(.*?)(?:"|$)', 1), F.lit('\\"'), F.lit('"')))
    segments = F.coalesce(parsed_list(F.regexp_extract(text, r'(?s)"biased_segments"(?U:\s*):(?U:\s*)(\[.*?\])(?U:\s*)[,}]', 1)), F.lit("[]"))
    digits = F.regexp_replace(number, "^0+(?=.)", "")
    object_ = F.concat(
        F.lit('{"binary_label":'), quoted(label), F.lit(',"severity":'), F.when(F.length(digits) > 18, "999").otherwise(digits), F.lit(',"bias_found":'), flag,
        F.when(has_text, F.concat(F.lit(',"unbiased_text":'), quoted(rewrite))).otherwise(""), F.lit(',"biased_segments":'), segments, F.lit("}"),
    )
    return F.when((label != "") & (number != "") & (flag != ""), F.try_parse_json(object_))
