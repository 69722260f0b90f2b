"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, share of tokens that are single bytes,
and entropy of its tokens in bits; a second one, made for many languages, measures characters per token as well, so that a
language that the first hardly knows is also judged by one that does. For each language, quartiles over all texts that pass the base rules give bands; a
text outside a band of its language is rejected. Tolerances widen for texts with fewer tokens than the language's
median text, as the square root of their ratio, since short texts scatter more, and for languages with few texts, as
the square root of 1 + FEW_TEXTS / their number, whatever other languages are there: the fewer, the less is rejected, and
a single text never is.

Base rules: at least 50 words, at most half of them in 3-word windows that occur more than once.

Edge cases: a null or empty text has no words and fails the base rules; a null language is one of its own; repeated
rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .tokens import slices
from .words import hashed_words, window_hashes

LEAST_WORDS = 50
#: Words whose measures a worker keeps; at about 200 bytes each, a bound on its memory.
CACHE_WORDS = 1_000_000
#: Half-width of a band in interquartile ranges, and the least range that counts as one, by measure.
WIDTH = 4.0
LEAST_RANGE = {"chars_per_token": 0.02, "byte_share": 0.005, "token_entropy": 0.1, "chars_per_token_multi": 0.02}
#: With so many texts that pass the base rules, a language's tolerances are wider by the square root of two.
FEW_TEXTS = 100
_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_token_multi double"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = hashed_words(text.encode("utf-8", "surrogatepass"))
    n, seen, doubled = len(words), set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            doubled += line in seen
            seen.add(line)
    repeated = 0
    if n > 3:
        _, which, times = np.unique(window_hashes(words, 3), return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(times[which] > 1)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + 3, -1)
        repeated = int(np.count_nonzero(np.cumsum(cover)))
    return n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), doubled, repeated


class Fertility:
    """Measures of a text's tokens; a bounded cache holds the ids of words and, negated, their number of tokens in the second vocabulary."""

    def __init__(self, path: str, multi: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.starts = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(n)])
        with open(multi, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.multi = tiktoken.Encoding("multi", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.multi_starts = np.zeros(max(ranks.values()) + 1, bool)
        self.multi_starts[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.known: dict[bytes, bytes] = {}

    def multi_counts(self, texts: list[str]) -> list[int]:
        """Tokens of each plain word in the second vocabulary, from one text: the token that begins with a space begins a word."""
        ids = np.array(self.multi.encode_ordinary("".join([f" {t}" for t in texts])))
        firsts = np.flatnonzero(self.multi_starts[ids])
        if len(firsts) != len(texts):
            return [len(self.multi.encode_ordinary(f" {t}")) for t in texts]
        return np.diff(np.append(firsts, len(ids))).tolist()

    def learn(self, words: list[bytes]) -> None:
        """The tokens of new words. Only plain ones are encoded together: no neighbour may change what a word is made of."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        plain = [(w, t) for w, t in zip(words, texts) if t.isascii() or t.isalpha() and max(t) < "\u0250"]
        for at in range(0, len(plain), 4096):
            part, each = zip(*plain[at : at + 4096])
            ids = np.array(self.model.encode(" ".join(each), num_threads=1), np.int32)
            firsts = np.flatnonzero(self.starts[ids])
            if len(firsts) == len(part) and firsts[0] == 0:
                self._note(part, [x.tobytes() for x in np.split(ids, firsts[1:])], self.multi_counts(each))
            else:
                self._alone(part, each)
        known = {w for w, _ in plain}
        other = [(w, t) for w, t in zip(words, texts) if w not in known]
        self._alone(tuple(w for w, _ in other), tuple(t for _, t in other))

    def _alone(self, words: tuple[bytes, ...], texts: tuple[str, ...]) -> None:
        self._note(words, [np.array(self.model.encode(t, num_threads=1), np.int32).tobytes() for t in texts], [len(self.multi.encode_ordinary(f" {t}")) for t in texts])

    def _note(self, words: tuple[bytes, ...], ids: list[bytes], counts: list[int]) -> None:
        self.known.update((w, x + (-n).to_bytes(4, "little", signed=True)) for w, x, n in zip(words, ids, counts))

    def __call__(self, words: list[bytes], n_chars: int) -> tuple[int, float, float, float, float]:
        """n_tokens, chars_per_token, byte_share, token_entropy, chars_per_token_multi."""
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        counts, ids = ids[ids < 0], ids[ids >= 0]
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0, 0.0
        times = np.unique(ids, return_counts=True)[1]
        return n, n_chars / n, float(self.is_byte[ids].mean()), float(np.log2(n) - (times * np.log2(times)).sum() / n), n_chars / max(1, -int(counts.sum(dtype=np.int64)))


_FERTILITY: dict[tuple, Fertility] = {}


def measured(docs: DataFrame, vocabularies: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """One narrow row a document: id, group, base counts and token measures of the whole text.

    vocabularies are the files of one with byte fallback and of one for many languages, and the latter's splitting pattern.
    """
    names = ["id", "group", *[c.split()[0] for c in _COLUMNS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = _FERTILITY.get(vocabularies) or _FERTILITY.setdefault(vocabularies, Fertility(*vocabularies))
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
                if len(fertility.known) > CACHE_WORDS:
                    fertility.known.clear()
                fertility.learn(list(set().union(*words).difference(fertility.known)))
                rows = [(*(base := base_counts(t)), *fertility(w, base[1])) for t, w in zip(texts, words)]
                kinds = [pa.int64()] * 6 + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("group"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("group"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id long, `group` string, {_COLUMNS}")


def fails_base() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """Quartiles of each measure by group; one row a group.

    Measures are rounded for this, so that a group's summary has few distinct values however many texts it has.
    """
    good = rows.where(~F.col("base_failed"))
    quarters = [F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in LEAST_RANGE]
    return good.select("group", *LEAST_RANGE, "n_tokens").groupBy("group").agg(F.count("*").alias("n"), F.percentile(F.round(F.log2("n_tokens"), 2), F.lit(0.5)).alias("log_tokens"), *quarters)


def judged(docs: DataFrame, vocabularies: tuple[str, str, str], **columns: str) -> DataFrame:
    """One row a document with its counts, measures, base_failed, in_band and kept."""
    rows = materialise(measured(docs, vocabularies, **columns).withColumn("base_failed", fails_base()), "measures")
    own = bands(rows).select(F.col("group").alias("own_group"), F.col("n").alias("own_n"), *[F.col(c).alias(f"own_{c}") for c in ("log_tokens", *LEAST_RANGE)])
    met = rows.join(own, F.col("group").eqNullSafe(F.col("own_group")), "left")
    widened = F.greatest(F.lit(1.0), F.sqrt(F.pow(F.lit(2.0), F.col("own_log_tokens")) / F.greatest("n_tokens", F.lit(1)))) * F.sqrt(1 + FEW_TEXTS / F.col("own_n"))
    inside = F.lit(True)
    for c, least in LEAST_RANGE.items():
        quarters = F.col(f"own_{c}")
        reach = F.greatest(quarters[2] - quarters[0], F.lit(least)) * WIDTH * widened
        low, high = quarters[1] - reach, quarters[1] + reach
        inside = inside & (F.col(c) >= low if c == "token_entropy" else F.col(c) <= high if c == "byte_share" else F.col(c).between(low, high))
    return met.withColumn("in_band", F.coalesce(inside, F.lit(True))).withColumn("kept", ~F.col("base_failed") & F.col("in_band")).select(*rows.columns, "in_band", "kept")
