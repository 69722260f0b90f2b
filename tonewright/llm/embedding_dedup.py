"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors of a label are scaled to length 1 and projected on PROJECTIONS random Gaussian directions. In each projection
a query's window holds what lies within `half_width` of the query's own value in sorted order; a pair's count says in
how many windows it meets. For a pair at the threshold the difference in a projection is normal with a known spread, so
the count is binomial: pairs with at least `needed` collisions are verified by their cosine in double precision, and a
true pair is missed in one of 1/MISS cases at most.

Equal vectors of a label are one class that counts as often as it occurs. Classes are laid out on the first projection
in cells as wide as a window of the same miss rate and cut into blocks of bounded size; only blocks of the same or of
neighbouring cells meet. A pair of blocks returns numbers of links and links that connect, never its list of pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
id, link with nothing; vectors of different lengths don't link; rows that repeat an id are vectors of their own, and a
component's id is the least of all its rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt
from .components import components, labelled
from .storage import materialise, scratch

PROJECTIONS = 48
SPREADS = 1.5  # half a window, in standard deviations of a pair at the threshold
MISS = 1e-9
BLOCK_ROWS = 1024
_PAIRS_AT_ONCE = 1 << 15
SEED = 20240607


def spread(least: float) -> float:
    """Standard deviation of the difference of a pair at cosine `least` in a Gaussian projection."""
    return math.sqrt(2 - 2 * least)


def needed_collisions(projections: int = PROJECTIONS, spreads: float = SPREADS, miss: float = MISS) -> int:
    """The greatest count that a pair at the threshold fails to reach with a chance of at most `miss`."""
    hit, below = math.erf(spreads / math.sqrt(2)), 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((n, dim)).T


@functools.lru_cache(maxsize=64)
def _first_direction(dim: int) -> np.ndarray:
    return directions(dim, 1)[:, 0]


def window_counts(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """Collisions of each pair over all projections (columns): places in sorted order within each query's window."""
    counts = np.zeros((len(queries), len(others)), np.uint8)
    for k in range(queries.shape[1]):
        order = np.argsort(others[:, k], kind="stable")
        line = others[order, k]
        place = np.empty(len(others), np.int16 if len(others) < 1 << 15 else np.int32)
        place[order] = np.arange(len(others))
        low = np.searchsorted(line, queries[:, k] - half, "left").astype(place.dtype)
        high = np.searchsorted(line, queries[:, k] + half, "right").astype(place.dtype)
        counts += (place >= low[:, None]) & (place < high[:, None])
    return counts


def linked(left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs that pass the count and whose cosine is at least `least`."""
    dim = left.shape[1]
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right))
    along = directions(dim)
    i, j = np.nonzero(window_counts(a @ along, b @ along, SPREADS * spread(least)) >= needed_collisions())
    norm_a, norm_b = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    good = []
    for at in range(0, len(i), _PAIRS_AT_ONCE):
        x, y = i[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
        good.append(np.einsum("ij,ij->i", left[x], right[y]) >= least * norm_a[x] * norm_b[y])
    good = np.concatenate(good) if good else np.empty(0, bool)
    return i[good], j[good]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, enough to connect what they connect."""
    label = labelled(n, i, j)
    return [(int(label[x]), x) for x in np.flatnonzero(label != np.arange(n))]


def _block_links(least: float):
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids, times = (group.column(c).to_numpy() for c in ("id", "times"))
        vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
        mine = np.array(group.column("block").to_pylist()) == group.column("first")[0].as_py()
        same = group.column("first")[0].as_py() == group.column("second")[0].as_py()
        left = np.flatnonzero(mine)
        right = left if same else np.flatnonzero(~mine)
        rows: list[tuple] = []
        if len(left) and len(right):
            i, j = linked(vectors[left], vectors[right], least)
            i, j = left[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            degree = np.zeros(len(ids), np.int64)
            np.add.at(degree, i, times[j])
            np.add.at(degree, j, times[i])
            rows = [(int(ids[x]), None, int(degree[x])) for x in np.flatnonzero(degree)] + [(int(ids[x]), int(ids[y]), 0) for x, y in _forest(len(ids), i, j)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    return run


def _with_cells(width: float):
    """Adds the cell of each vector, scaled to length 1, on the first direction of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            cells = []
            for begin, end in zip(np.append(0, ends[:-1]), ends):
                x = values[begin:end]
                cells.append(int(np.floor(x @ _first_direction(end - begin) / np.linalg.norm(x) / width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=[*batch.schema.names, "cell"])

    return run


def grouped(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: id, n_links, component (the least id it reaches), kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    own = F.when(usable, F.md5(F.to_json(F.struct("vector")).cast("binary")))
    with scratch(vectors.sparkSession, "vectors") as keep:
        rows = keep(rows.select("id", "label", F.when(usable, F.col("vector")).alias("vector"), own.alias("own")), "vectors")
        classes = rows.where("own IS NOT NULL").groupBy("label", "own").agg(F.min("id").alias("least"), F.count("*").alias("times"), F.first("vector").alias("vector"))
        # Classes have numbers of their own: an id may stand for several vectors.
        classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        placed = classes.select("id", "times", "vector", F.concat_ws(":", F.size("vector"), "label").alias("group"), F.xxhash64("own").alias("deal"))
        placed = placed.mapInArrow(_with_cells(6.2 * spread(least)), "id long, times long, vector array<double>, `group` string, deal long, cell long")
        pairs = dealt(keep(placed, "placed"), keep, "group", F.col("cell"), "deal", BLOCK_ROWS)
        found = keep(pairs.groupBy("group", "first", "second").applyInArrow(_block_links(least), "id long, other long, links long"), "links")
        degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
        joined = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("component", "root")
        named = classes.select("id", "label", "own", "times", "least").join(degrees, "id", "left").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
        named = keep(named, "named")
        named = keep(named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("label", "own", "times", "links", "component"), "components")
        whole = materialise(rows.select("id", "label", "own").join(named, ["label", "own"], "left").select("id", "times", "links", "component"), "links")
    component = F.coalesce("component", "id")
    links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))
    return whole.select("id", links.cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
