"""Annotation of a stream of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.outcomes import split_outcomes
from ..plans.annotate import annotate
from ..schema import MAX_CHARS
from ..storage import scratch


def annotate_stream(texts: DataFrame, respond: Callable[..., DataFrame], results_path: str, rejects_path: str, checkpoint: str, max_chars: int | None = MAX_CHARS, **trigger) -> StreamingQuery:
    """Results and rejects of a stream, written by micro-batch; no state is kept.

    A batch's outcomes are written once, so the responder runs once for both sinks, and are removed when both are done. A
    batch that is run again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession, f"batch{number}") as keep:
            judged = annotate(batch, respond, max_chars, keep)
            for rows, path in zip(split_outcomes(judged), (results_path, rejects_path)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
