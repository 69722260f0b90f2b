"""Bounded-space online packing of token sequences.

Each task keeps at most ``open_windows`` open windows. A document's full windows leave at once; its rest goes into the
open window that it fills best. When none has room and no further window may open, the fullest is emitted. What is
still open at the end of a task is merged in rounds by the same rule: each round deals the windows of ``FAN_IN`` tasks
to one, so no task sees more than FAN_IN * open_windows of them, and a last round has at most open_windows left open.

Edge cases: a null or empty text is the end id alone; a null id stays null; repeated rows are packed as often as they
come; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, scratch
from .tokens import TEXT_BYTES, encoder, raw_texts, slices

WINDOW = 1024
OPEN_WINDOWS = 256
FAN_IN = 16
#: Windows are numbered task * 2**33 + place, and merged ones so again with their round: ids never meet.
_TASK = 1 << 33
_ROUND = 1 << 56
_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
PIECES = "id long, start long, length long, ids binary, doc_tokens long, window long, offset long, open boolean"


class OpenWindows:
    """The open windows of one task, sorted by room."""

    def __init__(self, first_id: int, size: int, most: int):
        self.next_id, self.size, self.most = first_id, size, most
        self.rooms: list[tuple[int, int]] = []  # (room, window)

    def place(self, length: int) -> tuple[int, int, int | None]:
        """Window and offset for a piece; the window emitted to make place, if any. A window without room left is closed."""
        emitted = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                emitted = self.rooms.pop(0)[1]
            room, window, self.next_id = self.size, self.next_id, self.next_id + 1
        if room > length:
            insort(self.rooms, (room - length, window))
        return window, self.size - room, emitted


def _pieces(path: str, end_id: int, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        with encoder(path, spaced=True) as encode:
            windows = OpenWindows(TaskContext.get().partitionId() * _TASK, size, most)
            waiting: dict[int, list] = {}  # pieces of open windows

            def out(rows: list, is_open: bool) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*rows), [is_open] * len(rows)], _PIECES)], schema=_PIECES)

            for batch in batches:
                for part in slices(batch, most=TEXT_BYTES):
                    ready = []
                    for doc_id, ids in zip(part.column("id").to_pylist(), encode(raw_texts(part))):
                        ids += end
                        n, start = len(ids) // 4, 0
                        while n - start >= size:
                            ready.append((doc_id, start, size, ids[4 * start : 4 * (start + size)], n, windows.next_id, 0))
                            windows.next_id += 1
                            start += size
                        if start < n:
                            window, offset, emitted = windows.place(n - start)
                            ready += waiting.pop(emitted, ())
                            waiting.setdefault(window, []).append((doc_id, start, n - start, ids[4 * start :], n, window, offset))
                            if offset + n - start == size:
                                ready += waiting.pop(window)
                    if ready:
                        yield out(ready, False)
            if rest := [row for rows in waiting.values() for row in rows]:
                yield out(rest, True)

    return run


def _merge_round(size: int, most: int, number: int):
    """(bundle, fill) -> (bundle, into, base): windows packed into windows, largest first."""
    schema = pa.schema([("bundle", pa.int64()), ("into", pa.int64()), ("base", pa.int64()), ("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(-number * _ROUND + TaskContext.get().partitionId() * _TASK, size, most)
        rows = []
        for batch in batches:
            for bundle, fill in zip(batch.column("bundle").to_pylist(), batch.column("fill").to_pylist()):
                into, base, _ = windows.place(fill)
                rows.append((bundle, into, base))
        still = {w for _, w in windows.rooms}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*rows), [r[1] in still for r in rows]], schema)], schema=schema)

    return run


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence, offset."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(source.mapInArrow(_pieces(vocabulary, end_id, size, open_windows), PIECES), "pieces")
    loose = pieces.where("open")
    with scratch(docs.sparkSession, "packing") as keep:
        bundles = keep(loose.groupBy("window").agg(F.sum("length").alias("fill")), "round0")
        tasks = pieces.agg(F.max(F.expr(f"window div {_TASK}"))).first()[0]
        places = bundles.select("window", F.col("window").alias("bundle"), F.lit(0).cast("long").alias("base"))
        items, groups, number = bundles.select(F.col("window").alias("bundle"), "fill"), (tasks or 0) + 1, 0
        while True:
            number += 1
            last = groups <= FAN_IN
            # Windows of FAN_IN tasks meet in one; ids of a round hold the task that made them.
            group = F.expr(f"pmod(bundle, {_ROUND}) div {_TASK}") / F.lit(FAN_IN)
            dealt = items.repartition(1) if last else items.repartitionByRange(-(-groups // FAN_IN), F.floor(group))
            most = FAN_IN * open_windows if last else open_windows
            laid = dealt.sortWithinPartitions(F.desc("fill"), "bundle").mapInArrow(_merge_round(size, most, number), "bundle long, into long, base long, open boolean")
            merged = keep(laid, f"round{number}")
            places = places.join(merged.select("bundle", "into", F.col("base").alias("more")), "bundle").select("window", F.col("into").alias("bundle"), (F.col("base") + F.col("more")).alias("base"))
            if last:
                break
            items = merged.join(items, "bundle").groupBy("into").agg(F.sum("fill").alias("fill")).withColumnRenamed("into", "bundle")
            groups = -(-groups // FAN_IN)
        places = materialise(places, "places")
    columns = ["id", "start", "length", "ids", "doc_tokens"]
    placed = loose.join(places, "window").select(*columns, F.col("bundle").alias("sequence"), (F.col("base") + F.col("offset")).alias("offset"))
    return pieces.where(~F.col("open")).select(*columns, F.col("window").alias("sequence"), "offset").unionByName(placed)
