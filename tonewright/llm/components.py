"""Connected components of a graph given as edges, by star contraction (large-star and small-star rounds)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import materialise, scratch

ROUNDS = 40
#: Edges that one task holds.
LOCAL_EDGES = 1 << 18


def _pulled(edges: DataFrame) -> DataFrame:
    """Each node's neighbours and itself pulled to the least among them. Minima are taken before the shuffle, and a node
    with very many neighbours is a skewed join that Spark splits."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
    return edges.join(least, "src")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _pulled(both).where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    pulled = _pulled(edges)
    down = pulled.where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return down.unionByName(pulled.select("src", F.col("least").alias("dst"))).distinct()


def labelled(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node (of 0 to n - 1) that each one reaches by the edges (i, j): least labels passed along until nothing changes."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a graph of at most LOCAL_EDGES -> (id, component)."""
    pairs = [np.stack([b.column("src").to_numpy(), b.column("dst").to_numpy()]) for b in batches]
    if pairs:
        nodes, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
        src, dst = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labelled(len(nodes), src, dst)])], names=["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node of an edge with the least node that it reaches. Nodes are 64-bit integers.

    Each round is a written table, so lineage stays short and a lost executor costs one round at most. The number of
    rounds grows with the logarithm of the longest path. What is left of a graph when it has at most LOCAL_EDGES edges, a
    few megabytes, is finished by one task, with the same result.
    """
    made = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()
    before = None
    with scratch(edges.sparkSession, "components") as keep:
        for _ in range(ROUNDS):
            seen = Observation()  # counted while the round is written
            now = keep(made.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("mark")), "round")
            if seen.get["n"] <= LOCAL_EDGES:
                return materialise(now.coalesce(1).mapInArrow(_finished, "id long, component long"), "components")
            if seen.get == before:
                break
            before, made = seen.get, _small_star(_large_star(now))
        else:
            raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
        found = now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component"))).distinct()
        return materialise(found, "components")
