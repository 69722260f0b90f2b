"""Filters of fixed size over hash values: every value put in passes, others at times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26


def filter_of(values: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash value of a column: FILTER_BITS bits whatever the input, built by bitmap aggregates."""
    at = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    made = values.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in made.toLocalIterator():
        raw = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["bucket"] - 1) * len(raw) : row["bucket"] * len(raw)] = raw
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) & (FILTER_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
