"""Periodic runs of words, found by seeds that are extended along diagonals, and texts with their runs collapsed.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), that is at least
``least`` words and ``times`` periods long, and that no neighbouring word extends.

On the diagonal of lag q a run overlaps itself in at least max(least - q, (times - 1) * q) words. Lags are dealt into
classes, [lo, hi], whose least such overlap k is hi or more; k-grams are the class's index. A k-gram of a run and the same
one a period later have none between them: it would be a shorter period of k >= q words. So a pair of *neighbouring*
occurrences stands on each run's diagonal, and pairs whose lag is in the class are all that is enumerated: one a word at
most. A table of the furthest place that each lag has covered suppresses seeds within what is extended already, so each
stretch is read once. A class is three times (``times`` - 1) as far as the one before: n words take n log n steps.

K-grams are found by 64-bit hashes; whatever they give is extended word by word, on numbers that each stand for one word.

Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows and null ids keep
a row each; an empty table gives an empty result; a text is handled whole, in memory in proportion to its own length;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices
from .words import mixed_bits, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Bytes of text whose words are numbered and indexed at a time; a longer text is alone.
SLICE = 1 << 21
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def overlap(lag: int, least: int, times: int) -> int:
    """Words by which a run of this period overlaps itself at the least."""
    return max(least - lag, (times - 1) * lag)


def classes(longest: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, k): lags from lo to hi, whose runs overlap themselves in k >= hi words; for texts of up to `longest` words."""
    lo = 1
    while times * lo <= longest:
        hi, k = lo, overlap(lo, least, times)
        while (wider := min(k, overlap(hi + 1, least, times))) > hi and hi < longest:
            hi, k = hi + 1, wider
        yield lo, hi, k
        lo = hi + 1


def _reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from `at` on (by `step`, 1 or -1) whose word isn't that of lag words later."""
    width = 32
    while True:
        a, b = (at, min(at + width, len(ids) - lag)) if step > 0 else (max(at - width + 1, 0), at + 1)
        if b <= a:
            return at
        unlike = np.flatnonzero(ids[a:b] != ids[a + lag : b + lag])
        if len(unlike):
            return a + int(unlike[0 if step > 0 else -1])
        at, width = (b, 2 * width) if step > 0 else (a - 1, 2 * width)


def _seeds(ids: np.ndarray, k: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Places of k-grams whose next occurrence is lo to hi words later, and that lag; by place."""
    hashes = window_hashes(mixed_bits(ids.astype(np.uint64)), k)
    order = np.argsort(hashes, kind="stable")
    lags = np.diff(order)
    hit = np.flatnonzero((hashes[order[1:]] == hashes[order[:-1]]) & (lags >= lo) & (lags <= hi))
    at = np.argsort(order[hit], kind="stable")
    return zip(order[hit][at].tolist(), lags[hit][at].tolist())


def runs(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run of each text, by start and period; texts are arrays of word numbers."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    for lo, hi, k in classes(int(sizes.max(initial=0)), least, times):
        long_ = np.flatnonzero(sizes >= max(least, times * lo)).tolist()
        if not long_:
            break
        # One text after the other, with a number between that no word has: what spans two texts is like nothing.
        ids = np.concatenate([x for i in long_ for x in (texts[i], np.array([-1 - i]))])
        firsts = np.cumsum([0, *[len(texts[i]) + 1 for i in long_]])
        covered: dict[int, int] = {}
        for at, lag in _seeds(ids, k, lo, hi):
            if at < covered.get(lag, 0):
                continue
            end = covered[lag] = _reach(ids, at + k, lag, 1)
            start = _reach(ids, at - 1, lag, -1) + 1
            if end - start + lag >= max(least, times * lag):
                nth = int(np.searchsorted(firsts, start, "right")) - 1
                found[long_[nth]].append((start - int(firsts[nth]), end - start + lag, lag))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words but those that stand in a run after its first period, with single spaces."""
    if not found:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def collapsed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row a document: id, n_words, runs (an array of RUN, by start and period) and the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                words = [WORD.findall(t or "") for t in part.column("text").to_pylist()]
                numbers: dict[str, int] = {}
                ids = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in words]
                each = runs(ids, least, times)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in each]
                texts = [collapsed(w, x) for w, x in zip(words, each)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, _ARROW), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id long, n_words long, runs array<{RUN}>, collapsed string")
