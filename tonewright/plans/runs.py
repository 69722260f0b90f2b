"""Runs over a corpus that go on where a killed one ended: outcomes are published a part at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcomes import split_outcomes
from ..schema import MAX_CHARS
from ..storage import finished, scratch
from .annotate import annotate

PARTS = 64


def part_of(parts: int) -> Column:
    """The part of a text: it depends on its id alone, on the text where that is null."""
    return F.pmod(F.when(F.col("text_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("text_id")), F.lit(parts)).cast("int")


def published(spark: SparkSession, path: str) -> list[int]:
    """Parts whose outcomes are whole: their entry in the log was written after both sinks."""
    return sorted(int(p.rsplit("=", 1)[1].split("-")[0]) for p in finished(spark, f"{path}/log"))


def _check(spark: SparkSession, path: str, parts: int) -> None:
    for entry in finished(spark, f"{path}/log"):
        if int(entry.rsplit("-", 1)[1]) != parts:
            raise ValueError(f"{path} holds a run in {entry.rsplit('-', 1)[1]} parts")


def pending(texts: DataFrame, path: str, parts: int = PARTS) -> DataFrame:
    """Texts of parts that aren't published."""
    done = published(texts.sparkSession, path)
    return texts.where(~part_of(parts).isin(done)) if done else texts


def annotate_parts(texts: DataFrame, respond: Callable[..., DataFrame], path: str, parts: int = PARTS, max_chars: int | None = MAX_CHARS) -> None:
    """Results and rejects of a corpus in `path`, part by part.

    A part's sinks replace what a killed run left of them, then the log gets its entry. A run with the same path takes the
    parts that have none, so a text is asked for again only if its part wasn't published. All runs have the same `parts`.
    """
    spark = texts.sparkSession
    _check(spark, path, parts)
    done = set(published(spark, path))
    for part in range(parts):
        if part in done:
            continue
        with scratch(spark, f"part{part}") as keep:
            judged = annotate(texts.where(part_of(parts) == part), respond, max_chars, keep)
            for rows, kind in zip(split_outcomes(judged), ("results", "rejects")):
                rows.write.mode("overwrite").parquet(f"{path}/{kind}/part={part}")
            judged.groupBy("stage").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/part={part}-{parts}")


def outcomes_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Published results or rejects."""
    found = [f"{path}/{kind}/part={p}" for p in published(spark, path)]
    return spark.read.parquet(*found)
