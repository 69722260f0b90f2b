"""Near-duplicate documents by HyperMinHash.

1. Each document's shingle set becomes a sketch of compressed registers. Documents with equal sets are one class.
2. Bands of registers bring classes together; in every bucket each class is paired with the bucket's first one. Pairs
   whose collision-corrected similarity estimate can still reach the threshold make candidate clusters. Buckets whose
   classes these leave in several clusters are compared whole, in blocks: all pairs but those within the bucket's
   largest cluster.
3. In a cluster all full sets are compared exactly, in blocks of bounded size and only where their sizes allow a link:
   no list of pairs is made, a block sends back links that connect what it found.
4. The links' components are the result.

With 32 bands of 5 registers a pair at the threshold 0.8 shares no bucket in 3 of a million cases, above it in fewer.

Edge cases: a document without words links with nothing; one with fewer words than a shingle has all its words as one
shingle; a null id links with nothing and has a null component; rows that repeat an id are documents of their own, and a
component's id is the least of all its rows; rows equal in id and text are one document; an empty table gives an empty
result; further columns, whatever their names, are kept or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt
from .components import components
from .hyperminhash import REGISTERS, band_keys, estimate, floor_of, shingle_set, signature, sketch
from .documents import digest_of, may_be_in, met
from .storage import Keep, materialise, neutral, scratch
from .tokens import raw_texts, slices

SHINGLE_WORDS, LEAST = 5, 80  # per cent
#: Documents and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
_COLUMNS_AT_ONCE = 4096


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, digest of the text, n_shingles, signature of the set, registers, band keys (null for an empty set)."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.binary()), ("registers", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = raw_texts(part)
                sets = [shingle_set(t, k) for t in texts]
                made = [sketch(s) if len(s) else None for s in sets]
                full = [m for m in made if m is not None]
                keys = iter(band_keys(np.array(full))) if full else iter(())
                columns = [
                    part.column("id"),
                    pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([m.tobytes() if m is not None else None for m in made], pa.binary()),
                    pa.array([next(keys) if m is not None else None for m in made], schema.field("keys").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, digest binary, n_shingles long, signature binary, registers binary, keys array<long>")


def shared_buckets(classes: DataFrame, keep: Keep) -> DataFrame:
    """Classes in buckets of two or more: id, bucket (a hash of band and key), the bucket's first class and its size."""
    bands = classes.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    # Written apart from the join: a bucket with very many classes is then a skewed join that Spark splits.
    first = keep(bands.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "buckets")
    return bands.join(first, "bucket").select("id", "bucket", "first", "n")


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """Pairs of each class with the first class of each of its buckets, once each."""
    return shared.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()


def similar_pairs(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs whose estimate can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            floor = floor_of(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), least / 100)
            yield batch.select(["a", "b"]).filter(pa.array(estimate(left, right) >= floor))

    side = classes.select(F.col("id"), "n_shingles", "registers")
    met = pairs.join(side.toDF("b", "nb", "rb"), "b").join(side.toDF("a", "na", "ra"), "a")
    return met.mapInArrow(run, "a long, b long")


def _bucket_links(least: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, sizes, own = (np.array(c, np.int64) for c in zip(*(r[:3] for r in rows)))
        registers = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, REGISTERS)
        side = np.array([r[4] for r in rows])
        other = bool((side != side[0]).any())  # two blocks meet; else a block meets itself
        out = []
        for i in np.flatnonzero(side == side[0]) if other else range(len(ids)):
            apart = (own != own[i]) & (100 * np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
            apart &= (side != side[0]) if other else (np.arange(len(ids)) > i)
            at = np.flatnonzero(apart)
            if not len(at):
                continue
            for j in at[estimate(registers[at], registers[i]) >= floor_of(sizes[at], sizes[i], least / 100)]:
                if own[i] != own[j]:  # links that connect are enough
                    out.append((int(ids[i]), int(ids[j])))
                    own[own == own[j]] = own[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found = []
            for own, row in zip(zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "second"))), zip(*(batch.column(c).to_pylist() for c in ("id", "n_shingles", "component", "registers", "block")))):
                if own != key:
                    found += links_of(rows) if len(rows) > 1 else []
                    key, rows = own, []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        if len(rows) > 1 and (found := links_of(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return run


def bucket_links(shared: DataFrame, found: DataFrame, classes: DataFrame, least: int, keep: Keep) -> DataFrame:
    """Further pairs whose estimate can reach the threshold, of buckets whose classes lie in several of the clusters found.

    Every pair of such a bucket is compared but those within its largest cluster and those that already are connected.
    Buckets of the same classes count once.
    """
    many = shared.where("n > 2").join(found, "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("component"))
    parts = many.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"))
    buckets = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.bit_xor("mark").alias("mark")).where("parts > 1")
    once = buckets.groupBy("n", "mark").agg(F.min(F.struct("bucket", "largest")).alias("b")).select("b.*")
    rows = keep(many.join(once, "bucket").select("id", "bucket", "component", (F.col("component") == F.col("largest")).alias("inner")), "open_buckets")
    pairs = dealt(rows, keep, "bucket", F.col("inner").cast("int"), "id", BLOCK_ROWS, within=~F.col("inner"))
    met = pairs.join(classes.select("id", "n_shingles", "registers"), "id").repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    return met.select("bucket", "first", "second", "id", "n_shingles", "component", "registers", "block").mapInArrow(_bucket_links(least), "a long, b long")


def close_pairs(sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Positions of all pairs of sets with 100 * intersection >= least * union, exactly."""
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    if n <= 8:
        found = []
        for i in range(n):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= least * max(sizes[i], sizes[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= least * (sizes[i] + sizes[j] - both):
                        found.append((j, i))
        return found
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, at = np.zeros((n, n), np.float64), 0
    while at < len(column):  # counts of common shingles, a band of the incidence matrix at a time
        first = column[at]
        upto = int(np.searchsorted(column, first + _COLUMNS_AT_ONCE))
        part = np.zeros((n, _COLUMNS_AT_ONCE), np.float32)
        part[row[at:upto], column[at:upto] - first] = 1
        both += part @ part.T
        at = upto
    union = sizes[:, None] + sizes[None, :] - both
    i, j = np.nonzero(np.triu(100 * both >= least * union, 1))
    return list(zip(i.tolist(), j.tolist()))


def _links(k: int, least: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(rows: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        ids = [i for i, _ in rows]
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in close_pairs([shingle_set(t, k) for _, t in rows], least):
            a, b = find(i), find(j)
            if a != b:  # links that connect are enough for the components
                root[b] = a
                out.append((ids[i], ids[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            found = []
            for own, doc_id, text in zip(zip(*(batch.column(c).to_pylist() for c in ("cluster", "first", "second"))), batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if own != key:
                    found += links_of(list(rows.items())) if len(rows) > 1 else []
                    key, rows = own, {}
                rows[doc_id] = text
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        if len(rows) > 1 and (found := links_of(list(rows.items()))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return run


def exact_links(clusters: DataFrame, texts: DataFrame, k: int, least: int, keep: Keep) -> DataFrame:
    """Links within clusters (id, component, n_shingles), compared on the whole texts of the classes (id, text).

    A cluster is cut into classes of set sizes, each a quarter wider than the last, and these into blocks; only blocks
    of the same or of neighbouring classes can hold links, and each pair of such blocks is one group.
    """
    position = F.floor(F.log("n_shingles") / np.log(100 / least) - 1e-9)
    pairs = dealt(clusters.select("id", "n_shingles", F.col("component").alias("cluster")), keep, "cluster", position, "id", BLOCK_ROWS, "n_shingles", BLOCK_SHINGLES)
    rows = pairs.join(texts, "id").repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second", "id")
    return rows.select("cluster", "first", "second", "id", "text").mapInArrow(_links(k, least), "a long, b long")


def _joined(docs: DataFrame, k: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, digest, n_shingles, number of its group (null without one) and the group's least id."""
    with scratch(docs.sparkSession, "near_duplicates") as keep:
        made = keep(sketches(docs, k, id_col, text_col), "sketches")
        sets = made.where("signature IS NOT NULL AND id IS NOT NULL").groupBy("signature")
        sets = sets.agg(F.min(F.struct("id", "digest")).alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "registers", "keys")])
        classes = keep(sets.select("signature", "least.*", "n_shingles", "registers", "keys").withColumnRenamed("id", "least").withColumn("id", F.monotonically_increasing_id()), "classes")
        sketched = classes.select("id", "n_shingles", "registers")
        shared = keep(shared_buckets(classes.select("id", "keys"), keep), "shared_buckets")
        similar = keep(similar_pairs(candidate_pairs(shared), sketched, least), "similar")
        similar = similar.unionByName(bucket_links(shared, components(similar), sketched, least, keep))
        clusters = keep(components(similar).join(classes.select("id", "n_shingles", "least", "digest"), "id"), "clusters")
        texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).cast("string").alias("text"))
        texts = texts.where(may_be_in(clusters, "least")(F.col("least"))).withColumn("digest", digest_of(F.col("text")))
        texts = texts.join(clusters.select("id", "least", "digest"), ["least", "digest"]).select("id", "text")
        groups = components(exact_links(clusters, texts, k, least, keep)).withColumnRenamed("component", "group")
        named = keep(classes.select("signature", "id", "least").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id")), "named")
        ids = keep(named.groupBy("group").agg(F.min("least").alias("component")), "components")
        whole = keep(named.select("signature", "group").join(ids, "group"), "groups")
        linked = made.where("signature IS NOT NULL AND id IS NOT NULL").select("id", "digest", "n_shingles", "signature").join(whole, "signature").drop("signature")
        alone = made.where("signature IS NULL OR id IS NULL").select("id", "digest", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("id").alias("component"))
        return materialise(linked.unionByName(alone), "near_duplicates")


def grouped(docs: DataFrame, k: int = SHINGLE_WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component (the least id it reaches), kept (it is the component's first)."""
    rows = _joined(docs, k, least, id_col, text_col)
    return rows.select("id", "n_shingles", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = SHINGLE_WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each group: that of the least id and, where it repeats, of the least digest.

    Rows with a null id all stay; of rows equal in id and text one does. Only rows that a filter of the ids to be dropped
    lets through are shuffled.
    """
    plain, id_, text = neutral(docs, id_col, text_col)
    rows = _joined(docs, k, least, id_col, text_col).where("id IS NOT NULL")
    each = rows.groupBy("id", "digest", "group", "component").agg(F.count("*").alias("copies"))
    # Written apart from the join: a group with very many documents is then a skewed join that Spark splits.
    first = materialise(each.where("id = component AND group IS NOT NULL").groupBy("group").agg(F.min("digest").alias("main")), "firsts")
    fate = each.join(first, "group", "left").withColumn("stays", F.col("group").isNull() | ((F.col("id") == F.col("component")) & (F.col("digest") == F.col("main"))))
    fate = materialise(fate.where("NOT stays OR copies > 1").select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "copies", "stays"), "fate")
    rest, some = met(plain, id_, text, fate)
    stays = F.coalesce(F.col("stays"), F.lit(True)) & F.col("leads")
    return some.where(stays).select(*plain.columns).unionByName(rest).toDF(*docs.columns)
