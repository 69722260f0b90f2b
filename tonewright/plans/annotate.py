"""The whole way from texts to results and rejects."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parse import parse_responses
from ..operators.prepare import gate_texts
from ..operators.segments import located
from ..operators.validate import validate_results
from ..schema import MAX_CHARS
from ..storage import Keep, materialise, scratch


def judge(answered: DataFrame, keep: Keep = materialise) -> DataFrame:
    """Answered texts (text_id, text, raw_output, attributes, maybe the responder's error) parsed, merged, validated and
    located; one row each.

    All of it is columns of one row: no shuffle. Answers and outcomes are each written once: a responder runs once whatever
    reads its output, and no filter is pushed into (and copied through) the steps below it. The answers are removed at the
    end; `keep` writes the outcomes.
    """
    with scratch(answered.sparkSession, "judge") as step:
        return keep(_placed(validate_results(parse_responses(step(answered, "answers")))), "outcomes")


def _placed(parsed: DataFrame) -> DataFrame:
    placed = F.when(F.col("reject_reason").isNull(), located(F.col("text"), F.col("biased_segments")))
    unanswered = F.col("raw_output").isNull()
    reason = F.when(unanswered, "no_answer").otherwise(F.col("reject_reason"))
    stage = F.when(F.col("reject_reason").isNotNull(), F.when(unanswered, "respond").when(F.col("reject_reason") == "not_json", "parse").otherwise("validate"))
    return parsed.withColumns({"biased_segments": placed, "stage": stage, "reject_reason": F.when(F.col("reject_reason").isNotNull(), reason)}).withColumnRenamed("text", "original_text").drop("data")


def annotate(texts: DataFrame, respond: Callable[..., DataFrame], max_chars: int | None = MAX_CHARS, keep: Keep = materialise, allow_empty: bool = False) -> DataFrame:
    """One outcome for each text. respond adds raw_output (and error, where it fails) to a table of texts.

    Texts that the gate refuses never reach the responder; with allow_empty it doesn't refuse empty ones. A responder with a parameter `keep` gets one for the tables
    that it needs; they are removed when the outcomes are written.
    """
    gated = gate_texts(texts, max_chars, allow_empty)
    asked = gated.where("reject_reason IS NULL").drop("reject_reason")
    with scratch(texts.sparkSession, "responder") as own:
        good = judge(respond(asked, keep=own) if "keep" in inspect.signature(respond).parameters else respond(asked), keep)
    refused = gated.where("reject_reason IS NOT NULL").withColumnRenamed("text", "original_text").withColumn("stage", F.lit("gate"))
    return good.unionByName(refused, allowMissingColumns=True)


def one_answer(responses: DataFrame) -> DataFrame:
    """recorded_id, raw_output and error: one row a text. An answer that is recorded twice is one; of different ones none counts.

    A null output beside another one is no answer of its own.
    """
    each = responses.groupBy(F.col("text_id").alias("recorded_id")).agg(F.min("raw_output").alias("least"), F.max("raw_output").alias("most"))
    same = F.col("least") == F.col("most")
    return each.select("recorded_id", F.when(same, F.col("least")).alias("raw_output"), F.when(~same, "different answers are recorded").alias("error"))


def annotate_recorded(texts: DataFrame, responses: DataFrame, max_chars: int | None = MAX_CHARS, keep: Keep = materialise) -> DataFrame:
    """One outcome for each text, from recorded answers (text_id, raw_output).

    A text without one has no answer, and neither has one with several that differ: its reject's detail says so.
    """
    recorded = one_answer(responses)
    return annotate(texts, lambda rows: rows.join(recorded, F.col("text_id") == F.col("recorded_id"), "left").drop("recorded_id"), max_chars, keep)
