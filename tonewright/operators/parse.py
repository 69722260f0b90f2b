"""Raw outputs to untyped data: fast path, repair ladder, and the few outputs that only a lenient reader accepts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repair

STRATEGIES = ("direct", "truncated", "commas", "combined", "salvage")
_HUGE = "1e300"


def _lenient(texts: pd.Series) -> pd.Series:
    """Objects that standard readers refuse but a lenient one takes (a key twice, NaN), written plainly; else null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            read = json.loads(text, parse_constant=lambda c: float("-" + _HUGE if c.startswith("-") else _HUGE))
        except (ValueError, RecursionError):
            return None
        return json.dumps(read, ensure_ascii=False) if isinstance(read, dict) else None

    return texts.map(one)


def _fast(raw: Column) -> Column:
    """Data of an output whose first object is well-formed, where neither fences nor think tags can matter."""
    body = F.substring(raw, F.locate("{", raw), F.length(raw))
    plain = (F.locate("{", raw) > 0) & ~raw.contains("```") & ~raw.contains("think>")
    return F.when(plain, F.try_parse_json(body))


def parse_responses(responses: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """Adds data (variant) and repair_strategy; both null where nothing can be read.

    Outputs that the reader takes at once pass no fold. Python sees only texts that no step of the ladder could read
    though they look like a whole object.
    """
    quick = responses.withColumn("_fast", _fast(F.col(raw_col)))
    slow = F.when(F.col("_fast").isNull(), F.col(raw_col))
    texts = quick.withColumn("_text", F.when(slow.isNotNull(), repair.without_thoughts(repair.extracted(slow))))
    text = F.col("_text")
    shut = texts.withColumn("_direct", F.when(text.isNotNull(), repair.parsed(text)))
    lenient = F.when(F.col("_direct").isNull() & text.startswith("{") & text.endswith("}"), text)
    # A repeated key or a NaN makes both readers of a bare value fail; what is broken otherwise is read in vain, but is rare.
    read = shut.withColumn("_lenient", F.try_parse_json(F.pandas_udf(_lenient, "string")(lenient)))
    open_ = F.when(F.coalesce("_fast", "_direct", "_lenient").isNull(), text)
    ladder = read.withColumn("_open", open_).withColumn("_shut", repair.closed(F.col("_open")))
    cut = F.col("_shut") != F.col("_open")
    ladder = ladder.withColumn("_truncated", F.when(cut, repair.parsed(F.col("_shut"))))
    ladder = ladder.withColumn("_commas", F.when(F.col("_truncated").isNull(), repair.parsed(repair.with_commas(F.col("_open")))))
    still = F.col("_truncated").isNull() & F.col("_commas").isNull()
    ladder = ladder.withColumn("_combined", F.when(still & cut, repair.parsed(repair.with_commas(F.col("_shut")))))
    ladder = ladder.withColumn("_salvage", F.when(still & F.col("_combined").isNull(), repair.salvaged(F.col("_open"))))
    steps = {"direct": F.coalesce("_fast", "_direct", "_lenient"), **{s: F.col(f"_{s}") for s in STRATEGIES[1:]}}
    strategy = F.coalesce(*[F.when(c.isNotNull(), F.lit(s)) for s, c in steps.items()])
    return ladder.withColumns({"data": F.coalesce(*steps.values()), "repair_strategy": strategy}).select(*responses.columns, "data", "repair_strategy")
