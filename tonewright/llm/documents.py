"""Documents met by id and text, so that rows that meet nothing aren't shuffled.

A filter of fixed size (filters.FILTER_BITS) is broadcast. It lets every wanted row through, and others at times; the joins decide.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..filters import filter_of, passes
from .storage import materialise

def may_be_in(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """Whether an id may be one of these, as a column; only ids pass through Python."""
    hashed = ids.select(F.xxhash64(F.col(column).cast("long")).alias("at"))
    bits = ids.sparkSession.sparkContext.broadcast(filter_of(hashed, "at"))  # 8 MB

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, at.to_numpy()))

    return lambda id_: may(F.xxhash64(id_.cast("long")))


def digest_of(text: Column) -> Column:
    """16 bytes for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def met(docs: DataFrame, id_: str, text: str, fate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that surely meet nothing, the others with fate's columns, null where they meet nothing).

    fate has own_id, own_digest, copies (how often docs hold that id and text) and more, one row for each id and text.
    The second table also says which row `leads` those equal in id and text: the first written one. docs' columns mustn't
    have such names (see storage.neutral).
    """
    marked = docs.withColumn("may_meet", may_be_in(fate, "own_id")(F.col(id_)))
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    some = marked.where("may_meet").drop("may_meet").withColumns({"id": F.col(id_).cast("long"), "digest": digest_of(F.col(text))})
    some = some.join(fate, same, "left").drop("own_id", "own_digest").withColumn("row", F.monotonically_increasing_id())
    some = materialise(some, "met")
    repeated = F.coalesce(F.col("copies") > 1, F.lit(False))
    leads = some.where(repeated).groupBy("id", "digest").agg(F.min("row").alias("lead")).select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "lead")
    led = some.where(repeated).join(leads, same).withColumn("leads", F.col("row") == F.col("lead")).drop("own_id", "own_digest", "lead")
    return marked.where(~F.col("may_meet")).drop("may_meet"), some.where(~repeated).withColumn("leads", F.lit(True)).unionByName(led)
