"""Sharding by fixed virtual slots.

A record belongs to one of ``n_slots`` virtual slots for good, by a hash of its id. Which shard holds a slot is said
by a small versioned map (version, slot, shard), whose size depends on ``n_slots`` alone. Version 1 deals the slots in
turn; a later version edits its predecessor: `rebalanced` moves as few slots as level the bytes, `grown` moves slots
into new shards only.

Law of the finished layout: ``bytes``. The sizes of the shards are as near to equal as whole slots allow.

Edge cases: a null text has no bytes (size 8, crc 0); a record with a null id is dealt by the hash of its text;
repeated rows keep a row each; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import exists, materialise

N_SLOTS = 4096
#: Parts of a slot that are numbered apart, so that an id that repeats a great many times isn't one task's work.
LANES = 32


def slot_of(id_col: str, text_col: str, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record; it never changes."""
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    return F.pmod(key, F.lit(n_slots)).cast("int")


def record_size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + F.lit(8)


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map: slots dealt to the shards in turn."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes by slot of a table with slot and size; summed before the shuffle, at most one row a slot after it."""
    return records.groupBy("slot").agg(F.sum("size").alias("bytes"))


def _placed(loads: str, moving: str) -> str:
    """SQL for the moving slots, largest first, each in the shard that is emptiest then."""
    return f"""aggregate({moving},
        struct({loads} AS loads, cast(array() AS array<struct<slot:int, shard:int>>) AS placed),
        (a, x) -> transform(array(cast(array_position(a.loads, array_min(a.loads)) AS int) - 1), i -> struct(
            transform(a.loads, (b, j) -> if(j = i, b + x.bytes, b)) AS loads,
            concat(a.placed, array(struct(x.slot AS slot, i AS shard))) AS placed))[0],
        a -> a.placed)"""


def _edited(marked: DataFrame, loads: DataFrame, version: Column) -> DataFrame:
    """Slots marked stays keep their shard; the others go to loads' shards. One row of n_slots entries does it."""
    moving = marked.where(~F.col("stays")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "slot")))).alias("moving"))
    placed = moving.crossJoin(F.broadcast(loads)).select(F.expr(f"inline({_placed('loads', 'moving')})"))
    kept = marked.where("stays").select("slot", "shard")
    return kept.unionByName(placed).select(version.alias("version"), "slot", "shard")


def rebalanced(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The next version: each shard keeps its largest slots as far as the mean goes; the rest, largest first, go to the emptiest."""
    sized = slot_map.join(stats, "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = sized.agg((F.sum("bytes") / n_shards).alias("mean"), (F.max("version") + 1).alias("next"))
    marked = sized.withColumn("upto", F.sum("bytes").over(own)).crossJoin(F.broadcast(mean)).withColumn("stays", F.col("upto") <= F.col("mean"))
    by_shard = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    every = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(by_shard, "shard", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")))), lambda x: x["load"]).alias("loads"))
    return _edited(marked, loads, F.lit(None).cast("int")).drop("version").crossJoin(F.broadcast(mean.select(F.col("next").alias("version")))).select("version", "slot", "shard")


def grown(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard n_shards beside 0 to n_shards - 1: its share of the bytes moves into it, nothing moves between the others."""
    sized = slot_map.join(stats, "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    own = Window.partitionBy("shard").orderBy("bytes", "slot")
    upto = F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))
    goal = sized.agg((F.sum("bytes") / (n_shards + 1)).alias("goal"))
    held = F.sum("bytes").over(Window.partitionBy("shard"))
    moved = sized.withColumn("upto", upto).withColumn("held", held).crossJoin(F.broadcast(goal)).withColumn("moves", F.col("upto") <= F.col("held") - F.col("goal"))
    shard = F.when(F.col("moves"), F.lit(n_shards)).otherwise(F.col("shard")).cast("int")
    return moved.select((F.col("version") + 1).alias("version"), "slot", shard.alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest if none is named."""
    stored = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else stored.agg(F.max("version").alias("v")).first()["v"]
    return stored.where(F.col("version") == wanted).select("version", "slot", "shard")


def edited_map(spark: SparkSession, path: str, stats: DataFrame, n_shards: int, n_slots: int = N_SLOTS, rebalance: bool = False) -> DataFrame:
    """The latest version (version, slot, shard) of the stored map, edited where it has to be.

    Without a stored map, versions 1 (dealt in turn) and 2 (levelled by stats' bytes) are stored. A stored map is taken as
    it is; `rebalance` levels it anew, and each further shard asked for takes its share out of the others.
    """
    if not exists(spark, path):
        first = first_map(spark, n_shards, n_slots)
        save_map(first, path)
        save_map(rebalanced(first, stats, n_shards), path)
        return load_map(spark, path)
    latest = load_map(spark, path)
    held = latest.agg((F.max("shard") + 1).alias("shards"), F.count("*").alias("slots")).first()  # one row
    if held["slots"] != n_slots or held["shards"] > n_shards:
        raise ValueError(f"the stored map has {held['slots']} slots and {held['shards']} shards")
    for shards in range(held["shards"], n_shards):
        save_map(grown(latest, stats, shards), path)
        latest = load_map(spark, path)
    if rebalance:
        save_map(rebalanced(latest, stats, n_shards), path)
    return load_map(spark, path)


def assigned(docs: DataFrame, n_shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, rebalance: bool = False) -> DataFrame:
    """One row a record: id, size, crc32 of the text, virtual slot, shard and place (0, 1, ... without gaps within its shard).

    The map is the one stored under map_path, see `edited_map`: a second call gives the same shards. The texts are read
    once; what is shuffled is four numbers a record.
    """
    spark = docs.sparkSession
    records = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            record_size(text_col).alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("crc"),
            slot_of(id_col, text_col, n_slots).alias("slot"),
            (F.spark_partition_id() % LANES).alias("lane"),
        ),
        "records",
    )
    slot_map = edited_map(spark, map_path, slot_bytes(records), n_shards, n_slots, rebalance)
    slot_map = slot_map.select("slot", "shard")  # n_slots rows, whatever the input
    counts = records.groupBy("slot", "lane").agg(F.count("*").alias("n")).join(F.broadcast(slot_map), "slot")
    before = Window.partitionBy("shard").orderBy("slot", "lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("slot", "lane", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("slot", "lane").orderBy("id", "crc", "size")
    numbered = records.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(bases, ["slot", "lane"]).select("id", "size", "crc", "slot", "shard", (F.col("base") + F.col("nth")).cast("long").alias("place"))
