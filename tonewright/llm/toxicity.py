"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

A feature says that a hashed character n-gram (lower case, white space as one space, the ends of the text counting as
space) occurs in the text. Its value is the n-gram's log-count ratio between the classes, learned weights scale it, and
a logistic gives the score. Features whose ratio says little are left out, so a text's score hangs on few n-grams
whatever its length.

Fitting takes at most PER_CLASS labelled rows of each class, those with the least hash of their id; that bound holds
for every corpus, so one task fits. Scoring runs over all rows and whole texts with a table of 2**BITS weights.

Edge cases: a null or empty text has the score of no features; without labelled rows of both classes every score is
the share of label 1 (0 without any); a label that is null or neither 0 nor 1 isn't learned; repeated rows are scored
as often as they come; of a labelled id with several texts the least is learned, of one with both labels label 0; further
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tokens import slices

SIZES = (3, 4, 5, 6)
BITS = 20
PER_CLASS = 4000
#: Features need this many training texts and this much of a log-count ratio, towards either label.
LEAST_TEXTS, LEAST_RATIO = 5, 2.0
#: Steps of the fit, their size, and the weight of a penalty on squared weights.
ROUNDS, RATE, DECAY = 150, 0.02, 1.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are hashed at a time.
PIECE = 1 << 20


def gram_buckets(text: str, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, a size and piece at a time."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE + max(sizes) - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        rolled, n = points, 1
        for size in sorted(sizes):
            while n < size and len(rolled) > 1:
                rolled, n = rolled[:-1] * np.uint64(0x100000001B3) + points[n:], n + 1
            if n == size:
                yield ((rolled ^ np.uint64(size)) * _MULTIPLIER >> np.uint64(64 - bits)).astype(np.int32)


def fitted(texts: list[str], labels: np.ndarray, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from labelled texts."""
    labels = np.asarray(labels, float)
    positives, rows = labels.sum(), len(labels)
    if not 0 < positives < rows:
        share = positives / rows if rows else 0.0
        return np.empty(0, np.int32), np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    present = [np.unique(np.concatenate([np.empty(0, np.int32), *gram_buckets(t or "", sizes, bits)])) for t in texts]
    counts = np.zeros((2, 1 << bits))
    for grams, label in zip(present, labels):
        counts[int(label), grams] += 1
    # Log-count ratio of the share of each class's texts that hold the n-gram.
    ratio = np.log((counts[1] + 1) / (positives + 2)) - np.log((counts[0] + 1) / (rows - positives + 2))
    chosen = (counts.sum(0) >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    number = np.full(1 << bits, -1, np.int32)
    number[chosen] = np.arange(chosen.sum())
    ratio = ratio[chosen]
    own = [x[x >= 0] for x in (number[g] for g in present)]
    del present, counts
    row = np.repeat(np.arange(rows), [len(x) for x in own])
    column = np.concatenate(own) if own else np.empty(0, np.int32)
    value = ratio[column]
    weights, bias = np.zeros(len(ratio)), float(np.log(positives / (rows - positives)))
    # Adam over all rows: few steps, no order of rows, the same result each time.
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        score = np.bincount(row, value * weights[column], rows) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels) / rows
        slope = np.bincount(column, error[row] * value, len(weights)) + DECAY / rows * weights
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        bias -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-10)
    return np.flatnonzero(chosen).astype(np.int32), weights * ratio, float(bias)


def score(text: str | None, table: np.ndarray, bias: float, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> float:
    """Likelihood of label 1; table holds a weight for every bucket."""
    hits = [b[table[b] != 0] for b in gram_buckets(text or "", sizes, bits)]
    total = bias + float(table[np.unique(np.concatenate(hits))].sum(dtype=float)) if hits else bias
    return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    buckets, weights, bias = fitted(texts, np.array(labels))
    yield pa.RecordBatch.from_arrays([pa.array([buckets.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["buckets", "weights", "bias"])


def model(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """(table of weights, bias), learned from labelled rows that aren't held out. Its size doesn't depend on the input."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("label"))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).select(F.col(id_col).alias("id"), "label"))  # at most 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = texts.select("id", "text", "label").repartition(1).sortWithinPartitions("id").mapInArrow(_fit, "buckets binary, weights binary, bias double").first()
    table = np.zeros(1 << BITS, np.float32)
    if found is None:
        return table, -40.0
    table[np.frombuffer(found["buckets"], np.int32)] = np.frombuffer(found["weights"])
    return table, found["bias"]


def scored(docs: DataFrame, table: np.ndarray, bias: float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 4 MB, whatever the input
    plain = docs.drop(score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                scores = pa.array([score(t, weights, bias) for t in part.column(text_col).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, score_col])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField(score_col, DoubleType())]))
