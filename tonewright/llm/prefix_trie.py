"""Trie of conversation prefixes, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is known by its depth and the exclusive or of a 128-bit hash of each of its
turns with the turn's place; that sum can be taken in blocks, so a conversation of any length is no single task's work.
Grouping by it, pre-aggregated, gives each node its smallest conversation, its members and a bound of its subtree's nodes
(the members' remaining turns).

Subtree totals: where the bound is SHARD_NODES or less and the parent's is not, a node is the root of a shard, which holds
its whole subtree. A task has its shards' nodes sorted by reverse level order (the sort spills) and reads each once: a
priority queue (it spills too) brings what the node's children have sent, the node's totals are final, and it sends them on
to its parent. What shard roots send is summed by parent, and the nodes above all shards go the same way, in bands of levels
of TOP_NODES nodes, from the deepest on; so no task holds more than a band or sorts more than its shards.

Edge cases: rows without a conversation's id belong to none; a null turn comes first, null roles and texts are empty, turns
equal in number come in the order of their hashes; a conversation without turns is a member of the root alone; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Keep, materialise, scratch

#: Bound of a shard's nodes; nodes of a band of the tree above the shards.
SHARD_NODES, TOP_NODES = 100_000, 1_000_000
#: Turns of a conversation that are summed at a time; numbers of conversations that are joined at a time.
BLOCK, PIECE = 512, 65_536
#: Messages that a queue holds in memory.
QUEUED = 500_000
KEY = ("depth", "k1", "k2")


def numbered(conversations: DataFrame, keep: Keep, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, nth (from 1), t1, t2 (hashes of role and text) and n_bytes of the text: one narrow row a turn.

    Rows are sorted over all tasks, so a conversation that holds many of them is dealt like any others.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hashes = [F.xxhash64(F.lit(i), filled(role_col), filled(text_col)).alias(f"t{i}") for i in (1, 2)]
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *hashes, F.octet_length(filled(text_col)).cast("long").alias("n_bytes"))
    order = ["conv", "turn", "t1", "t2"]
    laid = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "t1", "t2", "n_bytes", F.monotonically_increasing_id().alias("at")), "turns")
    laid = laid.withColumn("stretch", F.shiftright("at", 33))
    stretches = laid.groupBy("conv", "stretch").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = stretches.select("conv", "stretch", (before - F.col("first") + 1).alias("shift"))
    return laid.join(places, ["conv", "stretch"]).select("conv", (F.col("at") + F.col("shift")).alias("nth"), "t1", "t2", "n_bytes")


def member_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and each of its prefixes: conv, n_turns, the node's key and its parent's, n_bytes of its last turn.

    turns: conv, nth, t1, t2, n_bytes; convs: conv, n_turns, also of conversations without turns.
    """
    each = turns.select("conv", F.col("nth").cast("long").alias("depth"), "n_bytes", *[F.xxhash64(F.lit(10 + i), "nth", "t1", "t2").alias(f"e{i}") for i in (1, 2)])
    each = each.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    blocks = each.groupBy("conv", "block").agg(*[F.bit_xor(f"e{i}").alias(f"e{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"e{i}").over(upto), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)])
    within = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.select("conv", "block", "depth", "n_bytes", "e1", "e2", *[F.bit_xor(f"e{i}").over(within).alias(f"s{i}") for i in (1, 2)]).join(blocks, ["conv", "block"])
    key = lambda i: F.col(f"s{i}").bitwiseXOR(F.col(f"b{i}"))
    below = summed.select("conv", "depth", "n_bytes", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("e1")).alias("p1"), key(2).bitwiseXOR(F.col("e2")).alias("p2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("n_bytes"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "n_turns")
    return below.join(convs, "conv").unionByName(roots)


def nodes_of(members: DataFrame) -> DataFrame:
    """One row a node: its key and its parent's, conv_id (the smallest member), n_convs, n_bytes, and a bound of its subtree's nodes."""
    same = [F.max(c).alias(c) for c in ("p1", "p2", "n_bytes")]  # all of a group have the same
    return members.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *same, F.sum(F.col("n_turns") - F.col("depth") + 1).alias("bound"))


class SpillingQueue:
    """A priority queue of tuples; beyond `most`, all but the least are written to unnamed files as sorted runs."""

    def __init__(self, most: int | None = None):
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # the least of each run, and how to go on
        self.most, self.n_runs = most or QUEUED, 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        kept = len(self.heap) // 4
        rest, self.heap = self.heap[kept:], self.heap[:kept]
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # where Spark's own sorts spill
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for at in range(0, len(rest), 4096):
            pickle.dump(rest[at : at + 4096], file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self.n_runs += 1
        self._next(self.n_runs, self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, number: int, run: Iterator[tuple]) -> None:
        item = next(run, None)
        if item is not None:
            heapq.heappush(self.runs, (item, number, run))

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = heapq.heappop(self.runs)
            self._next(number, run)
            return item
        return heapq.heappop(self.heap)


_TOTALS = ("n_children", "n_leaves", "saved_tokens")
_FIELDS = [*KEY, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_bytes", "sends"]


def forwarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in reverse level order with their subtrees' totals; those that `sends` is true for pass theirs to their parent.

    n_children, n_leaves and saved_tokens come with what a node has got from elsewhere (zeros, if nothing).
    """
    queue = SpillingQueue()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "p1", "p2", "n_convs", "n_bytes", "sends", *_TOTALS)]
        made = []
        for depth, k1, k2, p1, p2, n_convs, n_bytes, sends, children, leaves, saved in zip(*columns):
            key = (-depth, k1, k2)
            while (first := queue.least()) is not None and first[:3] <= key:
                got = queue.pop()
                children, leaves, saved = children + 1, leaves + got[3], saved + got[4]
            leaves, saved = leaves if children else 1, saved + (n_convs - 1) * n_bytes
            if sends:
                queue.push((1 - depth, p1, p2, leaves, saved))
            made.append((children, leaves, saved))
        arrays = [batch.column(c) for c in _FIELDS]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, pa.int64()) for c in zip(*made)]] if made else [*arrays, *[pa.array([], pa.int64())] * 3], names=[*_FIELDS, *_TOTALS])


_SCHEMA = ", ".join(f"{c} {'boolean' if c == 'sends' else 'long'}" for c in (*_FIELDS, *_TOTALS))


def _passed(nodes: DataFrame) -> DataFrame:
    """Totals of nodes whose senders' parents are in the same task, dealt so already."""
    return nodes.select(*_FIELDS, *_TOTALS).sortWithinPartitions(F.desc("depth"), "k1", "k2").mapInArrow(forwarded, _SCHEMA)


def _sent(rows: DataFrame) -> DataFrame:
    """What nodes send out of their shard or band, by parent."""
    return rows.where(~F.col("sends") & F.col("p1").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))


def _received(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    met = nodes.join(sent, list(KEY), "left")
    more = dict(zip(_TOTALS, ("more_children", "more_leaves", "more_saved")))
    return met.withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in more.items()}).select(*nodes.columns)


def _bands(nodes: DataFrame) -> list[tuple[int, int, int]]:
    """(first level, last level, nodes) of bands of about TOP_NODES nodes, the deepest first."""
    levels = nodes.groupBy("depth").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("depth")))
    banded = levels.withColumn("band", F.floor((upto - 1) / TOP_NODES)).groupBy("band").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.sum("n").alias("n"))
    return [(r["lo"], r["hi"], r["n"]) for r in banded.orderBy(F.desc("lo")).collect()]


def with_totals(nodes: DataFrame, members: DataFrame, keep: Keep) -> DataFrame:
    """nodes with parent_conv_id, n_children, n_leaves and saved_tokens (over the subtree, (n_convs - 1) * n_bytes of each node)."""
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("bound").alias("parent_bound"))
    zeros = {c: F.lit(0).cast("long") for c in _TOTALS}
    placed = keep(nodes.join(parents, ["depth", "p1", "p2"], "left").withColumns(zeros), "placed")
    light, under = F.col("bound") <= SHARD_NODES, F.coalesce(F.col("parent_bound") <= SHARD_NODES, F.lit(False))
    # Each conversation passes one shard root at most: the first light node of its path.
    roots = placed.where(light & ~under)
    shard_of = members.select("conv", *KEY).join(roots.select(*KEY), list(KEY)).select("conv", F.xxhash64(*KEY).alias("shard"))
    inner = placed.where(light & under).join(shard_of, F.col("conv_id") == F.col("conv")).withColumn("sends", F.lit(True))
    shards = roots.withColumn("sends", F.lit(False)).withColumn("shard", F.xxhash64(*KEY)).select(*_FIELDS, *_TOTALS, "shard").unionByName(inner.select(*_FIELDS, *_TOTALS, "shard"))
    done = [keep(_passed(shards.repartition("shard")), "shards")]
    top = keep(_received(placed.where(~light).withColumn("sends", F.lit(True)).select(*_FIELDS, *_TOTALS), _sent(done[0])), "top")
    for lo, hi, _ in _bands(top):
        band = top.where(F.col("depth").between(lo, hi)).withColumn("sends", F.col("depth") > lo)
        if len(done) > 1:
            band = _received(band, _sent(done[-1]))
        # A single level has no parents in it, so it may be any number of tasks.
        done.append(keep(_passed(band.repartition(1) if lo < hi else band.repartition(*KEY)), "band"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select(*KEY, "conv_id", "parent_conv_id", "n_convs", *_TOTALS)


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows with one key as texts of up to PIECE numbers, numbered over all tasks."""
    first, at, key, held = TaskContext.get().partitionId() << 32, 0, None, []
    made: list[tuple] = []

    def close() -> None:
        nonlocal at
        if held:
            made.append((*key, first + at, ",".join(map(str, held))))
            at += 1
            held.clear()

    for batch in batches:
        for *new, conv in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv")]):
            if new != key or len(held) >= PIECE:
                close()
            key = new
            held.append(conv)
        if made:
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*made))[:4]], pa.array([m[4] for m in made])], names=[*KEY, "piece", "ids"])
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*made))[:4]], pa.array([m[4] for m in made])], names=[*KEY, "piece", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's pieces, which come in order."""
    key, state = None, None
    names = [*KEY, "ends_sha256"]
    row = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([state.hexdigest()])], names=names)
    for batch in batches:
        made = []
        for *new, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
            if new != key:
                if key is not None:
                    made.append((*key, state.hexdigest()))
                key, state = new, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if made:
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*made))[:3]], pa.array([m[3] for m in made])], names=names)
    if key is not None:
        yield row()


def ends(members: DataFrame) -> DataFrame:
    """For nodes at which conversations end: the SHA-256 of their numbers, ascending and joined by commas.

    A node's numbers are dealt over tasks by range and joined in pieces there; one task hashes a node's few pieces.
    """
    rows = members.where("depth = n_turns").select(*KEY, "conv")
    order = [*KEY, "conv"]
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_pieces, "depth long, k1 long, k2 long, piece long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    with scratch(turns.sparkSession, "trie") as keep:
        members = keep(member_rows(turns, convs), "members")
        made = with_totals(keep(nodes_of(members), "nodes"), members, keep)
        whole = made.join(ends(members), list(KEY), "left")
        return materialise(whole.select("conv_id", "depth", "parent_conv_id", "n_convs", *_TOTALS, F.coalesce("ends_sha256", nothing).alias("ends_sha256")), "trie")


def grafted(turns: DataFrame, keep: Keep, every: int = 5, reach: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that begin like others: the first h turns of conversation c - c % every, then c's own after its first h.

    h is the CRC-32 of c's decimal digits modulo `reach`.
    """
    base_of: Column = F.col("conv") - F.pmod("conv", F.lit(every))
    convs = turns.groupBy("conv").agg(F.max("nth").alias("own")).withColumns({"base": base_of, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % reach})
    bases = convs.where("conv = base").select("base", F.col("own").alias("base_own"))
    convs = keep(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0)))), "convs")
    heads = turns.where((F.col("conv") == base_of) & (F.col("nth") < reach)).withColumnRenamed("conv", "base")
    shared = heads.join(convs.select("base", "conv", "h"), "base").where("nth <= h").select("conv", "nth", "t1", "t2", "n_bytes")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where("nth > h").select("conv", (F.col("taken") + F.col("nth") - F.col("h")).alias("nth"), "t1", "t2", "n_bytes")
    lengths = convs.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return shared.unionByName(own), lengths
