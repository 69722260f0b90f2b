"""Phrases of a lexicon found in texts, without regard to case: a text is read once, however many phrases there are.

A small lexicon is one automaton in each worker. Of a large one the workers have two bit filters of fixed size and the
phrases' lengths. A phrase of n characters is known by its first and last 2^k characters, the greatest such stretch that it
has: where the hash of a text's 2^k characters passes the first filter, the stretches of each length from 2^k to twice that
are looked up in the second. What passes both meets the lexicon in a join on the characters themselves.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..filters import filter_of, passes
from ..storage import Keep, materialise

FIELDS = ("phrase", "replacement", "severity", "bias_type", "reasoning")
HIT = "struct<at:int," + ",".join(f"{n}:string" for n in FIELDS) + ",until:int>"
#: Characters of the lexicon's rows that an automaton may hold: some 40 MB, which is broadcast.
SHARD_CHARS = 500_000
#: Rows and characters of texts that are worked on at a time.
ROWS_AT_ONCE = 512
SLICE_CHARS = 1 << 20

_LOADED: dict[str, Finder] = {}


def _as_it_came(text: str, found: dict) -> dict:
    """Places of the lowered text as those of the text itself, some letters of which are longer when lowered."""
    upto = np.cumsum([len(c.lower()) for c in text])
    back = lambda at, side: int(np.searchsorted(upto, at, side))
    return {k: (back(a, "right"), back(b, "left") + 1) for k, (a, b) in found.items()}


class Finder:
    """An automaton over the lowered phrases of some lexicon rows, which may repeat."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        groups: dict[str, list[int]] = {}
        for i, row in enumerate(rows):
            groups.setdefault(row[0].lower(), []).append(i)
        self.always = groups.pop("", [])  # an empty phrase stands at the beginning of every text
        self.members = [np.array(m, np.int64) for m in groups.values()]
        self.sizes = [len(p) for p in groups]
        self.fields = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(FIELDS))]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, phrase in enumerate(groups):
            self.automaton.add_word(phrase, number)
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[int, tuple[int, int]]:
        """First and past-the-last place in the text of each group of phrases that it holds; the first time each comes."""
        low, found = text.lower(), {}
        if not self.members:
            return found
        for end, number in self.automaton.iter(low):
            if number not in found:
                found[number] = (end + 1 - self.sizes[number], end + 1)
        return _as_it_came(text, found) if len(low) != len(text) else found

    def hits(self, texts: pa.Array) -> pa.Array:
        """As ROWS_AT_ONCE rows at a time have them: the Python values of a batch don't all live at once."""
        return pa.concat_arrays([self._hits(texts.slice(at, ROWS_AT_ONCE)) for at in range(0, max(1, len(texts)), ROWS_AT_ONCE)])

    def _hits(self, texts: pa.Array) -> pa.Array:
        sizes, rows, starts, ends = [0], [], [], []
        for text in texts.to_pylist():
            found = self.places(text or "")
            groups = [(np.array(self.always, np.int64), (0, 0))] if self.always else []
            groups += [(self.members[k], place) for k, place in found.items()]
            for members, (start, end) in groups:
                rows.append(members)
                starts.append(np.full(len(members), start + 1, np.int32))
                ends.append(np.full(len(members), end + 1, np.int32))
            sizes.append(sizes[-1] + sum(len(m) for m, _ in groups))
        joined = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        chosen = pa.array(joined(rows, np.int64))
        columns = [pa.array(joined(starts, np.int32)), *[f.take(chosen) for f in self.fields], pa.array(joined(ends, np.int32))]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["at", *FIELDS, "until"]))


def _loaded(name: str, packed: Broadcast) -> Finder:
    """The worker's automaton of that name; it keeps the last one alone, as tasks of a stage share theirs."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(packed.value)
    return _LOADED[name]


def _finder(spark: SparkSession, rows: list[tuple]) -> Callable[[Column], Column]:
    packed, name = spark.sparkContext.broadcast(pickle.dumps(Finder(rows))), uuid.uuid4().hex

    @F.arrow_udf(f"array<{HIT}>")
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _loaded(name, packed)
        for part in parts:
            yield finder.hits(part)

    return find


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    for _ in range(2):
        values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _stretches(codes: np.ndarray, upto: int) -> Iterator[np.ndarray]:
    """Hashes of all stretches of 1, 2, 4 ... 2^upto characters of a text, or of each row of texts, by their first place."""
    made = _mixed(codes + np.uint64(1))
    for power in range(upto + 1):
        yield made
        step = 1 << power
        made = _mixed(made[..., :-step] * _ODD + made[..., step:]) if made.shape[-1] > step else made[..., :0]


def _first_key(stretches: np.ndarray, power: int) -> np.ndarray:
    return _mixed(stretches + np.uint64(power))


def _whole_keys(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of stretches of a length, by those of their first and last 2^k characters."""
    both = _mixed(first * _ODD + _mixed(last + np.uint64(length)))
    return both, both >> np.uint64(32)


_KNOWN = "struct<low:string,length:int,first:bigint,one:bigint,two:bigint>"


def _known_by(phrases: pa.Array) -> pa.Array:
    """A phrase in lower case, its length and hashes; an empty one's say nothing."""
    lows = [p.lower() for p in phrases.to_pylist()]
    sizes = np.array([len(low) for low in lows], np.int32)
    keys = np.zeros((3, len(lows)), np.int64)
    for length in np.unique(sizes[sizes > 0]).tolist():
        power = length.bit_length() - 1
        of_length = np.flatnonzero(sizes == length)
        for at in np.array_split(of_length, 1 + length * len(of_length) // SLICE_CHARS):
            *_, made = _stretches(_codes("".join([lows[i] for i in at])).reshape(-1, length), power)
            for key, values in zip(keys, (_first_key(made[:, 0], power), *_whole_keys(made[:, 0], made[:, -1], length))):
                key[at] = values.astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(lows, pa.string()), pa.array(sizes), *map(pa.array, keys)], ["low", "length", "first", "one", "two"])


def _slices(numbers: list, texts: list) -> Iterator[tuple[list, list]]:
    """Rows in turn, as many as have SLICE_CHARS characters together; one at least."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > SLICE_CHARS:
            yield numbers[at:i], texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield numbers[at:], texts[at:]


def _may_stand(texts: list[str], lengths: list[int], first: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """Stretches of each text that may be phrases: the text's number, the stretch in lower case, its first place and its end."""
    lows = [t.lower() for t in texts]
    joined = "".join(lows)
    ends = np.cumsum([len(low) for low in lows])
    found: dict[int, dict[str, tuple[int, int]]] = {}
    for power, made in enumerate(_stretches(_codes(joined), max(lengths, default=0).bit_length() - 1)):
        own = [n for n in lengths if n.bit_length() - 1 == power]
        if not own:
            continue
        at = np.flatnonzero(passes(first, _first_key(made, power)))
        which = np.searchsorted(ends, at, "right")
        for length in own:
            here = at + length <= ends[which]  # within one text
            start, number = at[here], which[here]
            one, two = _whole_keys(made[start], made[start + length - (1 << power)], length)
            hit = passes(whole, one) & passes(whole, two)
            for p, k in zip(start[hit].tolist(), number[hit].tolist()):
                found.setdefault(k, {}).setdefault(joined[p : p + length], (p, p + length))
    for k, places in found.items():
        began = int(ends[k]) - len(lows[k])
        places = {phrase: (a - began, b - began) for phrase, (a, b) in places.items()}
        for phrase, (a, b) in (_as_it_came(texts[k], places) if len(lows[k]) != len(texts[k]) else places).items():
            yield k, phrase, a, b


def _filtered(lexicon: DataFrame, row: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """From (row, text) to (row, low, at, until): what may be a phrase of the lexicon. It has two broadcasts of 8 MB."""
    lengths = sorted(r[0] for r in lexicon.select("length").distinct().collect())
    empty, lengths = 0 in lengths, [n for n in lengths if n]
    context = lexicon.sparkSession.sparkContext
    first = context.broadcast(filter_of(lexicon.where("length > 0"), "first"))
    whole = context.broadcast(filter_of(lexicon.where("length > 0").select(F.explode(F.array("one", "two")).alias("at")), "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for numbers, texts in _slices(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]):
                    rows = [(k, "", 0, 0) for k in range(len(texts))] if empty else []
                    rows += _may_stand(texts, lengths, first.value, whole.value)
                    if rows:
                        which, low, start, end = zip(*rows)
                        columns = [pa.array([numbers[k] for k in which], pa.int64()), pa.array(low, pa.string()), pa.array([a + 1 for a in start], pa.int32()), pa.array([b + 1 for b in end], pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=[row, "low", "at", "until"])

    return run, f"{row} long, low string, at int, until int"


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, keep: Keep = materialise) -> DataFrame:
    """Adds hits (an array of HIT): the lexicon's phrases in each text, without regard to case, by their first place.

    `at` and `until` are places of the text as it came, from 1, also where lowering changes its length. Repeated lexicon
    rows count as often; a null phrase stands nowhere, an empty one at the beginning of every text; a null text is empty.
    A lexicon of up to SHARD_CHARS characters is one automaton, and nothing is shuffled. Of a larger one what may be its
    phrases is shuffled once to meet it, and once more to meet the texts; lexicon and texts are written once.
    """
    rows = lexicon.select(*FIELDS).where("phrase IS NOT NULL")
    chars = rows.agg(F.sum(F.length(F.concat_ws("", *FIELDS)) + 1)).first()[0] or 0
    if chars <= SHARD_CHARS:
        return texts.withColumn("hits", F.array_sort(_finder(texts.sparkSession, [tuple(r) for r in rows.collect()])(F.col("text"))))
    row = "tonewright_row"
    known = keep(rows.withColumn("known", F.arrow_udf(_known_by, _KNOWN)(F.col("phrase"))).select(*FIELDS, "known.*"), "lexicon")
    kept = keep(texts.withColumn(row, F.monotonically_increasing_id()), "texts")  # rows get numbers that stay
    found = kept.select(row, "text").mapInArrow(*_filtered(known, row)).join(known.select("low", *FIELDS), "low")
    whole = found.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("at", *FIELDS, "until"))).alias("hits"))
    return kept.join(whole, row, "left").withColumn("hits", F.coalesce("hits", F.array().cast(f"array<{HIT}>"))).select(*texts.columns, "hits")
