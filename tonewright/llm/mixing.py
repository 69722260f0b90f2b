"""Mixing sources to target weights by systematic sampling.

A source's weight gives its share of all words; its target stops at ``cap`` times its own words, and the excess is
shared again by weight. Every document of a source expects target / source_size copies. Expected copies are
prefix-summed within the source, one random offset is added, and a document is emitted once for each integer boundary
that its step crosses. Documents are taken by falling size, so whatever the offset, the words taken differ from the
target by little more than one long document. Of DRAWS offsets that hashes of seed and source give, a source takes the one
whose mix comes nearest to its target, the first of equals: reruns agree. What each would take is known from how many
documents of each size a source has.

The rank within a source is a sum of three counts (larger sizes; lower lanes of the same size; place in the lane), so
that neither a hot source nor thousands of documents of one size meet in one task.

Edge cases: a null text has size 0; null is a source of its own, the last; sources without words have target 0;
repeated rows are documents of their own; an empty table gives an empty result; further columns, whatever their names,
are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, neutral

WORD = r"[^\x20\x09-\x0D]+"
LANES = 256
SEED = "mix-1"
DRAWS = 16
_UPTO = (Window.unboundedPreceding, -1)


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) -> target. One row a source; water-filling as prefix sums over the sources by cap / weight.

    In rising order of cap / weight, counting a further source as capped raises the level of the others as long as it has
    to be capped, and lowers it from there on: the greatest level is the right one.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    known = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size").cast("double") * cap)
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    known = known.withColumns(
        {
            "capped_before": F.coalesce(F.sum("most").over(rising.rowsBetween(*_UPTO)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(every).cast("double"),
        }
    ).withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    return known.select("source", "source_size", F.least("most", F.max("level").over(every) * F.col("weight")).alias("target"))


def offset_of(source: Column, seed: str, draw: int) -> Column:
    """A number from 0 to 1 for each source and draw."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{draw}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("none"))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def _crossed(start: Column, step: Column, after: Column, upto: Column) -> Column:
    """Integer boundaries that the documents of the ranks above `after`, up to `upto`, cross."""
    return F.floor(start + step * upto) - F.floor(start + step * after)


def _offsets(levels: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """targets with step and start: the offset whose words come nearest to the target. levels: (source, size, above, n)."""
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.withColumn("step", step)
    starts = [offset_of(F.when(F.col("known"), F.col("source_key")), seed, draw) for draw in range(DRAWS)]
    met = levels.join(known, ["known", "source_key"])
    taken = [F.sum(_crossed(start, F.col("step"), F.col("above"), F.col("above") + F.col("n")) * F.col("size")).alias(f"taken{draw}") for draw, start in enumerate(starts)]
    drawn = met.groupBy("known", "source_key", "source_size", "target", "step").agg(*taken)
    each = [F.struct(F.abs(F.col(f"taken{draw}") - F.col("target")).alias("off"), F.lit(draw).alias("draw"), start.alias("start")) for draw, start in enumerate(starts)]
    return drawn.select("known", "source_key", "source_size", "target", "step", F.array_min(F.array(*each))["start"].alias("start"))


def planned(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, source, size, source_size, target, copies (0 to cap)."""
    lane = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.crc32(F.col(text_col).cast("binary")), F.lit(0)), F.lit(LANES)).cast("int")
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), lane.alias("lane")), "sizes")
    return planned_sizes(rows, weights, cap, seed)


def planned_sizes(rows: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """As planned, of a table (id, source, size, lane) with any further columns."""
    key = rows.withColumn("known", F.col("source").isNotNull()).withColumn("source_key", F.coalesce("source", F.lit("")))
    parts = key.groupBy("known", "source_key", "size", "lane").agg(F.count("*").alias("n"))
    same_size = Window.partitionBy("known", "source_key", "size")
    parts = parts.withColumns({"below": F.coalesce(F.sum("n").over(same_size.orderBy("lane").rowsBetween(*_UPTO)), F.lit(0))})
    levels = parts.groupBy("known", "source_key", "size").agg(F.sum("n").alias("n"))
    sizes = levels.groupBy("known", "source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes.select(F.when(F.col("known"), F.col("source_key")).alias("source"), "source_size"), weights, cap)
    targets = targets.select(F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("source_key"), "source_size", "target")
    by_size = Window.partitionBy("known", "source_key").orderBy(F.desc("size"))
    levels = levels.select("known", "source_key", "size", F.coalesce(F.sum("n").over(by_size.rowsBetween(*_UPTO)), F.lit(0)).alias("above"), "n")
    # A source's sizes meet its offset, one narrow row a size; its documents meet those by source and size.
    started = levels.drop("n").join(_offsets(levels, targets, seed), ["known", "source_key"])
    bases = parts.join(started, ["known", "source_key", "size"]).drop("n")
    nth = F.row_number().over(Window.partitionBy("known", "source_key", "size", "lane").orderBy("id"))
    ranked = key.withColumn("nth", nth).join(bases, ["known", "source_key", "size", "lane"]).withColumn("rank", F.col("above") + F.col("below") + F.col("nth"))
    crossed = _crossed(F.col("start"), F.col("step"), F.col("rank") - 1, F.col("rank"))
    return ranked.withColumn("copies", F.least(crossed, F.lit(cap)).cast("int")).drop("known", "source_key", "lane", "nth", "above", "below", "rank", "step", "start")


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with docs' columns.

    The rows are numbered in one written table; they are planned on their sizes alone and meet their texts again by number.
    """
    plain, id_, text, source = neutral(docs, id_col, text_col, source_col)
    numbered = materialise(plain.withColumns({"row": F.monotonically_increasing_id(), "words": n_words(text)}), "numbered")
    lane = F.pmod(F.xxhash64("row"), F.lit(LANES)).cast("int")
    rows = numbered.select(F.col(id_).alias("id"), "row", F.col(source).alias("source"), F.col("words").alias("size"), lane.alias("lane"))
    plan = planned_sizes(rows, weights, cap, seed).where("copies > 0").select("row", "copies")
    return numbered.join(plan, "row").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*plain.columns).toDF(*docs.columns)
