"""Token ids of a corpus in wavelet-matrix shards, in ascending order of document id.

`write_shards` ranges the documents over the tasks by id; a task writes one row for each shard of about SHARD_TOKENS
ids: its place in the order, the table of its documents and one compressed wavelet-matrix file. Documents aren't cut,
so a shard with a very long document is larger. `read_documents` gets every document's ids back from these files.

Edge cases: a null or empty text is the end id alone; null ids come first; repeated ids keep a row each, ordered by
their texts' hash; an empty table gives no shards and no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise
from .tokens import TEXT_BYTES, encoder, raw_texts, slices
from .wavelet import WaveletMatrix, build

SHARD_TOKENS = 1 << 19
_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("file", pa.binary())])
SHARDS = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, file binary"


def _encoded(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, part, seq = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        with encoder(path, spaced=False) as encode:
            doc_ids, held, size = [], [], 0

            def shard() -> pa.RecordBatch:
                tokens = np.frombuffer(b"".join(held), "<u4")
                row = [[part], [seq], [len(tokens)], [doc_ids], [[len(x) // 4 for x in held]], [build(tokens)]]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _SHARDS)], schema=_SHARDS)

            for batch in batches:
                for rows in slices(batch, most=TEXT_BYTES):
                    for doc_id, ids in zip(rows.column("id").to_pylist(), encode(raw_texts(rows))):
                        doc_ids.append(doc_id)
                        held.append(ids + end)
                        size += len(ids) // 4 + 1
                        if size >= shard_tokens:
                            yield shard()
                            doc_ids, held, size, seq = [], [], 0, seq + 1
            if doc_ids:
                yield shard()

    return run


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the corpus' shards as a table under path."""
    tied = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = tied.repartitionByRange(F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "row")
    ordered.select("id", "text").mapInArrow(_encoded(vocabulary, end_id, shard_tokens), SHARDS).write.option("compression", "uncompressed").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {k: batch.column(k)[row].as_py() for k in ("first", "doc_ids", "lengths", "file")}
            ids, lengths = WaveletMatrix(one["file"]).tokens().astype("<u4"), np.array(one["lengths"], np.int64)
            ends = np.cumsum(lengths)
            texts = [ids[e - k : e].tobytes() for e, k in zip(ends, lengths)]
            columns = [pa.array(one["doc_ids"], pa.int64()), pa.array(one["first"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # Ids before a shard: those of lower tasks (one number a task) and those of the task's lower shards.
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("first"))
    # One short row a shard is written first: shards meet it before they are decoded, and it is broadcast where it is small.
    begun = shards.join(materialise(starts, "starts"), ["part", "seq"]).select("first", "doc_ids", "lengths", "file")
    return begun.mapInArrow(_decoded, "id long, start long, n_tokens long, ids binary")


def token_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """Tokens at (part, seq, place), read from the files by access alone."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("place", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["file"])
                found = [(row["part"], row["seq"], i, matrix.access(i)) for i in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    asked = places.groupBy("part", "seq").agg(F.collect_set("place").alias("places"))
    return shards.select("part", "seq", "file").join(asked, ["part", "seq"]).mapInArrow(run, "part int, seq int, place long, token long")


def occurrences(shards: DataFrame, token: int, most: int | None = None) -> DataFrame:
    """Count of a token in each shard and the places of its occurrences (the first `most` where given), by rank and select."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["file"])
                n = matrix.count(token)
                places = [matrix.select(token, k) for k in range(n if most is None else min(n, most))]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["part"], row["seq"], n, places), schema)], schema=schema)

    return shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, n long, places array<long>")
