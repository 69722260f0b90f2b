"""Removal of repeated passages with phrase automata.

A window is WINDOW consecutive words of one text. Each word that lies in a window whose words also start earlier (a
smaller id, or the same document before) is removed; windows are judged on the input.

1. One pass over the texts writes a narrow row a document, with its anchors: winnowing picks short word runs that equal
   windows share. An anchor that two texts or two places of one text share recurs. Only windows whose anchor recurs are
   looked at further.
2. Recurring windows are confirmed: each window's first place is its least (document, start), taken before the shuffle.
3. Documents are dealt to shards, very long ones in parts. A shard gets the words of the recurring windows that its
   documents may hold, from the documents where they come first, compiles an Aho-Corasick automaton of them, and streams
   its documents to find every occurrence. That search is on the words themselves: no hash decides a removal.

Exact copies of a text are settled without any of that: all their windows come earlier in the first copy. Filters of a
fixed size are broadcast to keep most rows that join nothing out of shuffles (see documents.py).

Edge cases: a null text has no words; texts with fewer words than a window keep all; of rows with one id and different
texts, the first by digest comes in its place and the others after all other documents, as do null ids; of rows equal
in id and text the first counts as earlier; an empty table gives an empty result; further columns, whatever their names,
are kept or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import filter_of, met, passes
from .storage import materialise, neutral, scratch
from .tokens import raw_texts, slices
from .words import hashed_texts, minimiser_positions, spans, window_hashes

WINDOW = 20
ANCHOR = 10
#: Window occurrences in the documents of a shard, about; an automaton takes some 0.5 kB for each distinct one.
SHARD_WINDOWS = 60_000
#: Windows of a document that are searched together; a longer document is dealt in parts.
PART_WINDOWS = 1 << 16
_LATER = 1 << 62


def _anchors(texts: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, where each text's begin, and of each anchor the text, the place and the hash."""
    words, bounds = hashed_texts(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    whole = np.flatnonzero(own[: len(own) - window + 1] == own[window - 1 :]) if len(own) >= window else own[:0]
    grams = window_hashes(words, k)
    at = minimiser_positions(grams, window - k + 1, whole) if len(whole) else whole
    return words, bounds, own[at], at, grams[at] if len(at) else words[:0]


def _lists(own: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values by their text (ascending) as one list a text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def survey(docs: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """A narrow row a document: id, digest of the text, n_words, sha256 of its words joined by single spaces, its anchors
    once each, and those that it holds twice or more."""
    names = ["id", "digest", "n_words", "plain", "anchors", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = raw_texts(part)
                _, bounds, own, _, grams = _anchors(texts, window, k)
                order = np.lexsort((grams, own))
                own, grams = own[order], grams[order]
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (grams[1:] != grams[:-1]))) if len(own) else own
                twice = first[np.diff(np.append(first, len(own))) > 1]
                digests = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
                plain = pa.array([hashlib.sha256(b" ".join(t.split())).digest() for t in texts], pa.binary())
                columns = [part.column("id"), digests, pa.array(np.diff(bounds), pa.int64()), plain, _lists(own[first], grams[first], len(texts)), _lists(own[twice], grams[twice], len(texts))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, digest binary, n_words long, plain binary, anchors array<long>, twice array<long>")


def keyed(rows: DataFrame, keep) -> DataFrame:
    """(id, digest) -> key that orders documents, whether it is its text's first, and how often the row comes."""
    each = keep(rows.groupBy("id", "digest").agg(F.count("*").alias("copies"), F.min("n_words").alias("n_words"), F.min("plain").alias("plain")), "each")
    primary = each.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("main"))
    late = F.lit(_LATER) + F.shiftrightunsigned(F.xxhash64("id", "digest"), 2)
    key = F.when(F.col("digest") == F.col("main"), F.col("id")).otherwise(late)
    named = keep(each.join(primary, "id", "left").withColumn("key", key).drop("main"), "named")
    # Written apart from the join below: a text with very many copies is then a skewed join that Spark splits.
    first = keep(named.groupBy("digest").agg(F.min("key").alias("first")), "first_copies")
    return named.join(first, "digest").withColumn("is_first", F.col("key") == F.col("first")).drop("first")


def _recurring_anchors(rows: DataFrame) -> DataFrame:
    """Hashes of anchors that two different texts, or two places of one, share."""
    tag = F.conv(F.hex(F.substring("digest", 1, 5)), 16, 10).cast("long")
    each = rows.select(tag.alias("tag"), F.explode("anchors").alias("anchor"))
    again = rows.select(F.lit(-1).cast("long").alias("tag"), F.explode("twice").alias("anchor"))
    return each.unionByName(again).groupBy("anchor").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low < high").select("anchor")


def _occurrences(rows: DataFrame, bits) -> DataFrame:
    """(anchor, id) of the anchors that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("anchors")
            values = lists.flatten().to_numpy()
            held = passes(bits.value, values)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())[held]
            yield pa.RecordBatch.from_arrays([pa.array(values[held]), batch.column("id").take(pa.array(row))], names=["anchor", "id"])

    return rows.select("id", "anchors").mapInArrow(run, "anchor long, id long")


def _candidates(texts: DataFrame, bits) -> DataFrame:
    """Texts that may hold a recurring anchor, compressed; ids that pass the filter or are null."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("id")
            keep = passes(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            for part in slices(batch.filter(pa.array(keep))):
                raw = raw_texts(part)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array([press.compress(r) for r in raw], pa.binary())], schema=schema)

    return texts.mapInArrow(run, "id long, digest binary, packed binary")


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _spots(window: int, k: int):
    """(key, packed, anchors) -> the windows whose minimiser is one of the anchors: (window, key, start)."""
    schema = pa.schema([("window", pa.int64()), ("key", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", 1 << 18):
                texts = [_unpacked(p) for p in part.column("packed").to_pylist()]
                words, bounds, own, at, grams = _anchors(texts, window, k)
                recurring = np.isin(grams.view(np.int64), part.column("anchors").flatten().to_numpy())
                own, at = own[recurring], at[recurring]
                if not len(at):
                    continue
                near = np.zeros(len(words) + 1, np.int32)  # windows that hold one of these anchors, within the text
                np.add.at(near, np.maximum(bounds[own], at + k - window), 1)
                np.add.at(near, np.minimum(bounds[own + 1] - window, at) + 1, -1)
                starts = np.flatnonzero(np.cumsum(near[:-1]))
                text = np.searchsorted(bounds, starts, "right") - 1
                keys = part.column("key").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(window_hashes(words, window)[starts].view(np.int64)), pa.array(keys), pa.array((starts - bounds[text]).astype(np.int32))], schema=schema)

    return run


def _phrases(window: int):
    """(owner, shard, starts, packed) -> runs of the owner's windows with their words."""
    schema = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", 1 << 18):
                rows = []
                for row in part.to_pylist():
                    words = _unpacked(row["packed"]).split()
                    starts = np.array(sorted(row["starts"]))
                    for run_ in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                        rows.append((row["shard"], 0, row["key"], int(run_[0]), b" ".join(words[run_[0] : run_[-1] + window])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _parts(window: int):
    """(key, packed) of long texts -> (key, start, packed): parts of PART_WINDOWS windows each."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for key, packed in zip(batch.column("key").to_pylist(), batch.column("packed")):
                words = _unpacked(packed.as_py()).split()
                for start in range(0, len(words) - window + 1, PART_WINDOWS):
                    cut = press.compress(b" ".join(words[start : start + PART_WINDOWS + window - 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, start, cut), schema)], schema=schema)

    return run


class PhraseAutomaton:
    """Every window of some passages, to be found in texts word by word.

    Words are numbered, and so are all runs of `step` words in the passages. A window is the numbers of window / step runs,
    written in letters of one byte each, so that no state has many branches. A text is read once from each of its first
    `step` words, and only where a window's length of words is known.
    """

    def __init__(self, window: int):
        self.window, self.step = window, max(d for d in range(1, 6) if window % d == 0)
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, int, np.ndarray]] = []
        self.found = None

    def add(self, owner: int, start: int, words: list[bytes]) -> None:
        numbers = self.numbers
        self.passages.append((owner, start, np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.uint32)))

    def _spelt(self, runs: np.ndarray) -> np.ndarray:
        """Letters of each run; of unknown ones (-1) a letter that is nowhere in the automaton."""
        letters = runs[:, None] >> 8 * np.arange(self.letters) & 255
        letters[runs < 0] = 256
        return letters.astype("<u4")

    def compile(self) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        views = [np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(w, self.step)).view(f"V{4 * self.step}").ravel() for _, _, w in self.passages]
        known, which = np.unique(np.concatenate(views), return_inverse=True)
        raw, size = known.tobytes(), 4 * self.step
        self.runs = {raw[i * size : (i + 1) * size]: i for i in range(len(known))}
        self.letters = max(1, (len(known).bit_length() + 7) // 8)
        owners, starts, at, width = [], [], 0, self.letters * self.window // self.step
        for (owner, start, words), view in zip(self.passages, views):
            spelt, n = self._spelt(which[at : at + len(view)].astype(np.int64)), len(words) - self.window + 1
            text = np.concatenate([spelt[i : i + n] for i in range(0, self.window, self.step)], axis=1).tobytes().decode("utf-32-le")
            for i in range(n):
                self.found.add_word(text[i * width : (i + 1) * width], len(owners) + i)
            owners += [owner] * n
            starts += range(start, start + n)
            at += len(view)
        self.owners, self.starts = np.array(owners, np.int64), np.array(starts, np.int64)
        self.passages.clear()
        self.found.make_automaton()

    def _occurrences(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, place) of the windows in a run of known words."""
        raw, size, look, span = numbers.tobytes(), 4 * self.step, self.runs.get, self.window // self.step
        runs = np.array([look(raw[4 * i : 4 * i + size], -1) for i in range(len(numbers) - self.step + 1)], np.int64)
        for phase in range(self.step):
            for end, place in self.found.iter(self._spelt(runs[phase :: self.step]).tobytes().decode("utf-32-le")):
                if not (end + 1) % self.letters:  # where a run ends
                    yield phase + ((end + 1) // self.letters - span) * self.step, place

    def later(self, key: int, words: list[bytes], first: int = 0) -> np.ndarray:
        """Which words lie in windows that come first somewhere else than here; `first` is the place of words[0] in its text."""
        covered = np.zeros(len(words) + 1, np.int64)
        if self.found is None and self.passages:
            self.compile()
        if self.found is not None and len(words) >= self.window:
            get = self.numbers.get
            numbers = np.array([get(w, 0) for w in words], np.uint32)
            steps = np.diff(np.concatenate([[0], (numbers > 0).astype(np.int8), [0]]))
            for begin, end in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
                if end - begin >= self.window and (hits := list(self._occurrences(numbers[begin:end]))):
                    starts, places = np.array(hits).T
                    starts = starts + begin
                    starts = starts[(self.owners[places] != key) | (self.starts[places] != starts + first)]
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + self.window, -1)
        return np.cumsum(covered[:-1]) > 0


def _cut(raw: bytes, gone: np.ndarray) -> str:
    """A text without some of its words; what separates the kept words stays, one separator for a passage cut out."""
    first, last = spans(np.frombuffer(raw, np.uint8))
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return ""
    runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1)
    pieces = []
    for r in runs:
        begin = first[r[0]] if pieces or gone[: r[0]].any() else 0
        end = first[r[-1] + 1] if r[-1] + 1 < len(first) else len(raw)
        pieces.append(raw[begin:end])
    return b"".join(pieces).decode("utf-8", "surrogatepass")


_LEFT = "key long, n_removed long, kept_sha256 string, kept_text string"
_LEFT_SCHEMA = pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _left(key: int, raw: bytes, words: list[bytes], gone: np.ndarray) -> tuple:
    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    return key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), _cut(raw, gone)


def _searched(window: int):
    """Rows of a shard, its passages first -> what is left of its documents; of parts the words' places that go, in pairs."""
    schema = _LEFT_SCHEMA.append(pa.field("gone", pa.list_(pa.int64())))
    columns = ("shard", "kind", "key", "start", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, PhraseAutomaton(window)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                own, kind, key, start, packed = (batch.column(c)[i].as_py() for c in columns)
                if own != shard:
                    shard, automaton = own, PhraseAutomaton(window)
                if kind == 0:
                    automaton.add(key, start, packed.split(b" "))
                    continue
                raw = _unpacked(packed)
                words = raw.split()
                gone = automaton.later(key, words, start)
                if not gone.any():
                    continue
                if kind == 1:
                    rows.append((*_left(key, raw, words, gone), None))
                else:
                    pairs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))) + start
                    rows.append((key, None, None, None, pairs.tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gone, packed) of long texts -> what is left of them."""
    for batch in batches:
        for row in batch.to_pylist():
            raw = _unpacked(row["packed"])
            words = raw.split()
            covered, pairs = np.zeros(len(words) + 1, np.int64), np.array(row["gone"]).reshape(-1, 2)
            np.add.at(covered, pairs[:, 0], 1)
            np.add.at(covered, pairs[:, 1], -1)
            one = _left(row["key"], raw, words, np.cumsum(covered[:-1]) > 0)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, _LEFT_SCHEMA)], schema=_LEFT_SCHEMA)


def _changed(docs: DataFrame, surveyed: DataFrame, keys: DataFrame, window: int, k: int, id_col: str, text_col: str, keep) -> DataFrame:
    """Of first copies that lose words: key, n_removed, kept_sha256, kept_text."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    recurring = keep(_recurring_anchors(surveyed), "anchors")
    known = context.broadcast(filter_of(recurring, "anchor"))  # 8 MB
    held = keep(_occurrences(surveyed, known).join(recurring, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "held")
    wanted = context.broadcast(filter_of(held.where("id IS NOT NULL"), "id"))  # 8 MB
    firsts = keys.where("is_first").select("id", "digest", "key", "n_words")
    named = firsts.join(held, firsts["id"].eqNullSafe(held["id"])).select(firsts["id"].alias("own_id"), F.col("digest").alias("own_digest"), "key", "n_words", "anchors")
    met = _candidates(texts, wanted).join(named, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    packed = keep(met.dropDuplicates(["key"]).select("key", "n_words", "packed", "anchors"), "texts", "uncompressed")
    spots = keep(packed.select("key", "packed", "anchors").mapInArrow(_spots(window, k), "window long, key long, start int"), "windows")
    # Written apart from the join below: a very frequent window is then a skewed join that Spark splits.
    places = spots.groupBy("window").agg(F.min(F.struct("key", "start")).alias("place"), F.count("*").alias("n")).where("n > 1")
    first = keep(places.select("window", F.col("place.key").alias("owner"), F.col("place.start").alias("begin")), "firsts")
    again = spots.join(first, "window").where("key != owner OR start != begin")
    shards = spots.count() // SHARD_WINDOWS + 1
    shard = F.pmod(F.xxhash64("key", F.expr(f"start div {PART_WINDOWS}")), F.lit(shards))
    asked = again.select(shard.alias("shard"), "owner", "begin").groupBy("owner", "shard").agg(F.collect_set("begin").alias("starts"))
    phrases = asked.join(packed.select(F.col("key").alias("owner"), "packed"), "owner").select("shard", F.col("owner").alias("key"), "starts", "packed")
    schema, is_long = "shard long, kind int, key long, start int, packed binary", F.col("n_words") >= PART_WINDOWS + window
    whole = packed.where(~is_long).select("key", F.lit(0).alias("start"), "packed").select(shard.alias("shard"), F.lit(1).alias("kind"), "key", "start", "packed")
    parts = packed.where(is_long).select("key", "packed").mapInArrow(_parts(window), "key long, start int, packed binary").select(shard.alias("shard"), F.lit(2).alias("kind"), "key", "start", "packed")
    rows = phrases.mapInArrow(_phrases(window), schema).unionByName(whole).unionByName(parts)
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind", "key", "start")
    found = keep(dealt.mapInArrow(_searched(window), f"{_LEFT}, gone array<long>"), "found")
    joined = found.where("gone IS NOT NULL").groupBy("key").agg(F.flatten(F.collect_list("gone")).alias("gone")).join(packed.where(is_long).select("key", "packed"), "key")
    return found.where("gone IS NULL").drop("gone").unionByName(joined.select("key", "gone", "packed").mapInArrow(_joined_parts, _LEFT))


def _searched_docs(docs: DataFrame, window: int, k: int, id_col: str, text_col: str, *columns: str) -> DataFrame:
    """One row for each id and text: key, id, digest, n_words, plain, copies, is_first, and these columns of what is left."""
    with scratch(docs.sparkSession, "passages") as keep:
        surveyed = keep(survey(docs, window, k, id_col, text_col), "survey")
        keys = keep(keyed(surveyed, keep), "keys")
        left = _changed(docs, surveyed, keys, window, k, id_col, text_col, keep).select("key", *columns)
        return materialise(keys.join(left, "key", "left"), "passages")


_NOTHING = hashlib.sha256(b"").hexdigest()


def summary(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    keys = _searched_docs(docs, window, k, id_col, text_col, "n_removed", "kept_sha256")
    each = keys.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    first = F.col("is_first") & (F.col("nth") == 1)
    copy, plain = ~first & (F.col("n_words") >= window), F.lower(F.hex("plain"))
    removed = F.when(copy, F.col("n_words")).when(first, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long")
    sha = F.when(copy, F.lit(_NOTHING)).when(first, F.coalesce(F.col("kept_sha256"), plain)).otherwise(plain)
    return each.select("id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def cleaned(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of the texts; other columns and the number of rows stay, n_chars is set anew.

    Later copies of a whole text keep an empty text. Of rows equal in id and text one counts as the first. Only rows that a
    filter of their ids lets through meet what is left of them; the others stay where they are.
    """
    plain, id_, text = neutral(docs, id_col, text_col)
    keys = _searched_docs(docs, window, k, id_col, text_col, "kept_text")
    fate = keys.where("NOT is_first OR copies > 1 OR kept_text IS NOT NULL").select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "n_words", "is_first", "kept_text", "copies")
    rest, some = met(plain, id_, text, fate)
    first = F.coalesce(F.col("is_first"), F.lit(True)) & F.col("leads")
    cut = F.when(first, F.coalesce("kept_text", text)).when(F.col("n_words") >= window, F.lit("")).otherwise(F.col(text))
    out = some.select(*[cut.alias(c) if c == text else F.col(c) for c in plain.columns]).unionByName(rest).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
