"""All pairs of a group without a list of pairs and without a large task: classes on a line, cut into bounded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Keep

_BLOCK = "struct<a:bigint,b:int>"
_PAIRS = f"array<struct<first:{_BLOCK},second:{_BLOCK}>>"


def dealt(rows: DataFrame, keep: Keep, group: str, position: Column, id_col: str, most: int, weight: str | None = None, most_weight: int = 1, within: Column | None = None) -> DataFrame:
    """rows once for each pair of blocks that may hold partners: with columns block (the row's own), first and second (the pair).

    Partners share `group`, and their `position` (an integer) differs by one at most. What shares group and position is
    cut by a hash of the id into blocks of about `most` rows (and `most_weight` of `weight`); two rows that may be
    partners meet in exactly one pair of blocks. Where `within` is given and false (for whole positions), rows of the same
    position aren't partners.
    """
    classed = rows.withColumn("_class", position.cast("long"))
    size = F.ceil(F.count("*") / most)
    size = F.greatest(size, F.ceil(F.sum(weight) / most_weight)) if weight else size
    # Written apart from the joins: small ones shuffle nothing, and in large ones Spark splits what shares a position.
    counts = keep(classed.groupBy(group, "_class").agg(size.cast("int").alias("_blocks")), "blocks")
    beside = {n: counts.select(group, (F.col("_class") - shift).alias("_class"), F.col("_blocks").alias(n)) for n, shift in (("_above", 1), ("_below", -1))}
    met = classed.join(counts, [group, "_class"])
    for one in beside.values():
        met = met.join(one, [group, "_class"], "left")

    def block(shift: int, nth: Column) -> Column:
        return F.struct((F.col("_class") + shift).cast("long"), nth.cast("int")).cast(_BLOCK)

    mine = block(0, F.pmod(F.xxhash64(id_col), F.col("_blocks")))

    def pairs(shift: int, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(mine, block(shift, j)).alias("first"), F.greatest(mine, block(shift, j)).alias("second"))).cast(_PAIRS)

    none = F.array().cast(_PAIRS)
    inner = pairs(0, F.col("_blocks")) if within is None else F.when(within, pairs(0, F.col("_blocks"))).otherwise(none)
    every = F.concat(inner, *[F.when(F.col(n).isNotNull(), pairs(shift, F.col(n))).otherwise(none) for shift, n in ((1, "_above"), (-1, "_below"))])
    return met.withColumn("_pair", F.explode(every)).select(*rows.columns, F.to_json(mine).alias("block"), F.to_json("_pair.first").alias("first"), F.to_json("_pair.second").alias("second"))
