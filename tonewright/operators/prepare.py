"""Texts on their way to a responder: gate and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import MAX_CHARS

INSTRUCTIONS = """You review texts for biased wording. Answer with one JSON object and nothing else:
{"binary_label": "biased" or "unbiased", "severity": 0, 2, 3 or 4, "bias_found": true or false,
 "biased_segments": [{"original": "...", "replacement": "...", "severity": "low", "medium" or "high", "bias_type": "...", "reasoning": "..."}],
 "unbiased_text": "..."}
severity says how strong the bias of the whole text is: 0 none, 2 low, 3 medium, 4 high. original is copied from the text
letter by letter. unbiased_text is the whole text with only the listed phrases changed. For an unbiased text severity is
0, bias_found is false, biased_segments is empty and unbiased_text equals the text."""
QUESTION = "Which words of this text are biased?\n\n"


def gate_texts(texts: DataFrame, max_chars: int | None = MAX_CHARS, allow_empty: bool = False) -> DataFrame:
    """Texts trimmed, with a reject_reason where they are empty (null ones too) or longer than max_chars code points.

    With allow_empty, empty ones pass; with max_chars None as well, all do.
    """
    trimmed = texts.withColumn("text", stripped(F.coalesce("text", F.lit(""))))
    long_ = F.length("text") > max_chars if max_chars is not None else F.lit(False)
    none = F.lit(False) if allow_empty else F.col("text") == ""
    return trimmed.withColumn("reject_reason", F.when(none, "empty").when(long_, "too_long"))


def messages(text: Column) -> Column:
    """The two chat messages for a text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(INSTRUCTIONS)), message("user", F.concat(F.lit(QUESTION), text)))


def build_prompts(texts: DataFrame) -> DataFrame:
    """text_id and the two chat messages. Build them next to the responder: instructions aren't to be shuffled."""
    return texts.select("text_id", messages(F.col("text")).alias("messages"))
