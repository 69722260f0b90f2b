"""Raw outputs for texts: any responder in batches, each distinct text once, or a lexicon alone."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..schema import GLOBAL_SEVERITIES
from ..storage import Keep, finished, materialise, remove
from .phrases import ROWS_AT_ONCE, lexicon_hits
from .prepare import INSTRUCTIONS, QUESTION, messages

#: A factory, called once a task (load the model there); what it gives answers a batch of conversations.
Responder = Callable[[], Callable[[list], Sequence]]


class TokenLimit(NamedTuple):
    """The most tokens that a prompt may have, its instructions too, in the vocabulary of a file of the tokenizers library."""

    most: int
    path: str


#: Where every byte-level vocabulary begins a word: a space between a character that isn't white space and a plain letter.
_WORD = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")
#: Characters a token that are encoded at first.
_CHARS_A_TOKEN = 6


def _encoded(tokenizer, text: str, most: int, longest: int, by_words: bool):
    """A text's beginning encoded: its first `most` + 1 tokens, or all if it has no more, are those of the text.

    A vocabulary that encodes words by themselves is shown whole words of a short beginning, then of longer ones.
    """
    size, upto = most * _CHARS_A_TOKEN, min(len(text), most * longest + 1)
    while by_words and size < upto:
        ends = [m.start() for m in _WORD.finditer(text, max(1, size - 256), size)]
        if ends:
            encoded = tokenizer.encode(text[: ends[-1]], add_special_tokens=False)
            if len(encoded.ids) > most:
                return encoded
        size *= 2
    return tokenizer.encode(text[:upto], add_special_tokens=False)


def _prefix(tokenizer, text: str, most: int, longest: int, by_words: bool = False) -> str:
    """The longest beginning of a text that ends with one of its tokens and is at most so many tokens itself."""
    if len(text.encode("utf-8", "surrogatepass")) <= most:  # no token is less than a byte
        return text
    encoded = _encoded(tokenizer, text, most, longest, by_words)
    if len(encoded.ids) <= most:
        return text
    offsets = encoded.offsets
    for n in range(most, 0, -1):
        if offsets[n][0] >= offsets[n - 1][1]:  # else a letter is parted
            found = text[: offsets[n - 1][1]]
            if len(tokenizer.encode(found, add_special_tokens=False).ids) <= most:
                return found
    return ""


def _tokenizer(path: str) -> tuple:
    """A vocabulary's tokenizer and the letters of its longest token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, max(map(len, tokenizer.get_vocab()))


def _by_words(tokenizer) -> bool:
    """Whether a vocabulary surely begins a word at _WORD: byte-level, with its usual pattern, no normalizer and no added token with a space."""
    made = json.loads(tokenizer.to_str())
    cut = made["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(plain and made["normalizer"] is None and made["model"].get("type") == "BPE" and not any(set(t["content"]) & set(" \n\t") or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]))


def room_for_text(limit: TokenLimit) -> int:
    """Tokens of a prompt that its text may have."""
    tokenizer, _ = _tokenizer(limit.path)
    room = limit.most - sum(len(tokenizer.encode(x, add_special_tokens=False).ids) for x in (INSTRUCTIONS, QUESTION))
    if room < 1:
        raise ValueError(f"instructions leave no room for a text in {limit.most} tokens")
    return room


def cut_to_tokens(text: Column, path: str, most: int) -> Column:
    """The text up to the end of its last token that fits into so many; a text that fits is as it was, a null one null.

    Texts with as few bytes are not encoded, and of a longer one only as much as the tokens can reach.
    """

    @F.arrow_udf("string")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer, longest = _tokenizer(path)
        by_words = _by_words(tokenizer)
        for part in parts:
            texts = (t for at in range(0, len(part), ROWS_AT_ONCE) for t in part.slice(at, ROWS_AT_ONCE).to_pylist())
            yield pa.array([None if t is None else _prefix(tokenizer, t, most, longest, by_words) for t in texts], pa.string())

    return cut(text)


def _asked(answer: Callable[[list], Sequence], talks: list) -> tuple[list, list]:
    """Answers and errors of a batch; one bad row must not lose its batch."""
    try:
        given = list(answer(talks))
        if len(given) != len(talks):
            raise ValueError(f"{len(given)} answers to {len(talks)} prompts")
        return given, [None] * len(talks)
    except Exception as why:
        if len(talks) == 1:
            return [None], [f"{type(why).__name__}: {why}"]
    outputs, errors = zip(*[_asked(answer, [talk]) for talk in talks])
    return [x for (x,) in outputs], [x for (x,) in errors]


def _shown(max_prompt_chars: int | None, limit: TokenLimit | None) -> Column:
    shown = F.coalesce("text", F.lit(""))
    if max_prompt_chars is not None:
        shown = F.substring(shown, 1, max_prompt_chars)
    return cut_to_tokens(shown, limit.path, room_for_text(limit)) if limit else shown


def respond(texts: DataFrame, responder: Responder, batch: int = 64, max_prompt_chars: int | None = None, limit: TokenLimit | None = None) -> DataFrame:
    """Adds raw_output and error: the responder's answers; a failing row has no output and a reason.

    Limits of new tokens are the responder's own. Of a text longer than max_prompt_chars, or whose prompt is longer than the
    token limit, the responder sees the beginning alone, like a model that cuts its prompt; None cuts nothing.
    """

    @F.pandas_udf("raw_output string, error string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        answer = responder()
        for part in parts:
            outputs: list = []
            errors: list = []
            for at in range(0, len(part), batch):
                given, why = _asked(answer, [[dict(role=m["role"], content=m["content"]) for m in talk] for talk in part.iloc[at : at + batch]])
                outputs += given
                errors += why
            yield pd.DataFrame({"raw_output": pd.Series(outputs, dtype=object), "error": pd.Series(errors, dtype=object)})

    answered = texts.withColumn("tonewright_answer", ask.asNondeterministic()(messages(_shown(max_prompt_chars, limit))))
    kept = [c for c in texts.columns if c not in ("raw_output", "error")]
    return answered.select(*kept, "tonewright_answer.raw_output", "tonewright_answer.error")


def padded_batches(sizes: Sequence[int], most: int, most_rows: int) -> Iterator[slice]:
    """Stretches of rows whose longest size times their number is at most `most`; one row at least."""
    first, longest = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= most_rows or max(longest, n) * (i - first + 1) > most):
            yield slice(first, i)
            first, longest = i, 0
        longest = max(longest, n)
    if first < len(sizes):
        yield slice(first, len(sizes))


def respond_by_length(
    texts: DataFrame, responder: Responder, batch_chars: int = 1 << 18, batch: int = 64, max_prompt_chars: int | None = None, limit: TokenLimit | None = None, profile=None, keep: Keep = materialise
) -> DataFrame:
    """As respond, with texts of like length in a batch, so that a model pads little; adds batch_length, its longest text.

    Texts are dealt and sorted by length, and a batch is as many as fit into batch_chars when all are padded to the longest.
    `profile`, a ResourceProfile, holds for the responder's stage alone: only its tasks take a GPU. Answers are written and
    then meet their rows by a number that these were given before.
    """
    row = "tonewright_row"
    kept = keep(texts.withColumn(row, F.monotonically_increasing_id()), "texts")
    shown = kept.select(row, _shown(max_prompt_chars, limit).alias("shown")).withColumn("length", F.length("shown"))

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = responder()
        for part in parts:
            rows, prompts, sizes = (part.column(c).to_pylist() for c in (row, "shown", "length"))
            for at in padded_batches(sizes, batch_chars, batch):
                outputs, errors = _asked(answer, [[dict(role="system", content=INSTRUCTIONS), dict(role="user", content=QUESTION + t)] for t in prompts[at]])
                columns = [pa.array(rows[at], pa.int64()), pa.array(outputs, pa.string()), pa.array(errors, pa.string()), pa.array([max(sizes[at])] * len(outputs), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[row, "raw_output", "error", "batch_length"])

    dealt = shown.repartitionByRange("length", row).sortWithinPartitions("length")
    answers = keep(dealt.mapInArrow(ask, f"{row} long, raw_output string, error string, batch_length int", profile=profile), "answers")
    return kept.drop("raw_output", "error").join(answers, row).drop(row)


def respond_once(texts: DataFrame, responder: Responder, batch: int = 64, max_prompt_chars: int | None = None, limit: TokenLimit | None = None, keep: Keep = materialise) -> DataFrame:
    """As respond, but each distinct text is answered once; for responders that decode deterministically.

    Answers are written before they meet their texts, so a text that comes very often is a skewed join that Spark splits.
    """
    key = "tonewright_key"
    keyed = texts.withColumn(key, F.coalesce(F.sha2("text", 256), F.lit("")))
    asked = keyed.groupBy(key).agg(F.first("text").alias("text"))
    answers = keep(respond(asked, responder, batch, max_prompt_chars, limit).select(key, "raw_output", "error"), "answers")
    return keyed.drop("raw_output", "error").join(answers, key).drop(key)


_ANSWERS = "tonewright_key string, raw_output string"


def stored_answers(spark: SparkSession, store: str, version: str) -> DataFrame:
    """Published answers by key; of answers to one text that two runs gave at a time, the lesser."""
    batches = finished(spark, f"{store}/{version}")
    if not batches:
        return spark.createDataFrame([], _ANSWERS)
    return spark.read.schema(_ANSWERS).parquet(*batches).groupBy("tonewright_key").agg(F.min("raw_output").alias("raw_output"))


def respond_stored(texts: DataFrame, responder: Responder, store: str, version: str = "1", batch: int = 64, max_prompt_chars: int | None = None, limit: TokenLimit | None = None, keep: Keep = materialise) -> DataFrame:
    """As respond_once, over runs and micro-batches: a text whose answer is in the store is not asked again.

    The store is a folder of batches for each version (name the model and its limits there). A run asks for the keys that
    no published batch has and adds a batch of its own; it is published with its last file, and one that a killed run left
    is nothing. What failed isn't stored, so it is asked again. Null texts have the empty text's key.
    """
    key = "tonewright_key"
    keyed = texts.withColumn(key, F.coalesce(F.sha2("text", 256), F.sha2(F.lit(""), 256)))
    known = keep(stored_answers(texts.sparkSession, store, version).join(keyed.select(key).distinct(), key, "left_semi"), "known")
    asked = keyed.groupBy(key).agg(F.first("text").alias("text")).join(known, key, "left_anti")
    fresh = keep(respond(asked, responder, batch, max_prompt_chars, limit).select(key, "raw_output", "error"), "answers")
    fresh.where("raw_output IS NOT NULL").select(key, "raw_output").write.parquet(f"{store}/{version}/{uuid.uuid4().hex}")
    answers = known.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)
    return keyed.drop("raw_output", "error").join(answers, key).drop(key)


def compact_answers(spark: SparkSession, store: str, version: str = "1") -> None:
    """One batch of all published ones. They go after it is published; till then readers see answers twice, which is no harm."""
    old = finished(spark, f"{store}/{version}")
    if len(old) > 1:
        stored_answers(spark, store, version).write.parquet(f"{store}/{version}/{uuid.uuid4().hex}")
        for path in old:
            remove(spark, path)


def _answer(hits: Column) -> Column:
    """The contract's JSON for a text and its hits, fields in the prompt's order; values are quoted by the JSON writer."""
    level = F.array_max(F.transform(hits, lambda h: F.when(h["severity"] == "high", GLOBAL_SEVERITIES["high"]).when(h["severity"] == "medium", GLOBAL_SEVERITIES["medium"]).otherwise(GLOBAL_SEVERITIES["low"])))
    segments = F.transform(hits, lambda h: F.struct(h["phrase"].alias("original"), *[h[n].alias(n) for n in ("replacement", "severity", "bias_type", "reasoning")]))
    any_ = F.size(hits) > 0
    return F.struct(
        F.when(any_, "biased").otherwise("unbiased").alias("binary_label"),
        F.coalesce(level, F.lit(0)).alias("severity"),
        any_.alias("bias_found"),
        segments.alias("biased_segments"),
        rewritten(F.col("text"), hits).alias("unbiased_text"),
    )


def rewritten(text: Column, hits: Column) -> Column:
    """The text with the first place of each phrase replaced; places are those of the text as it came."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, h: Column) -> Column:
        return F.when(h["at"] < s["at"], s).otherwise(F.struct(h["until"].alias("at"), F.concat(s["out"], F.substring(text, s["at"], h["at"] - s["at"]), h["replacement"]).alias("out")))

    return F.aggregate(hits, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"], F.length(text))))


def lexicon_respond(texts: DataFrame, lexicon: DataFrame, keep: Keep = materialise) -> DataFrame:
    """Adds raw_output: what a responder that knows the lexicon alone would answer."""
    hits = lexicon_hits(texts, lexicon, keep)
    return hits.withColumn("raw_output", F.to_json(_answer(F.col("hits")))).drop("hits")


def json_fields(raw: Column) -> dict[str, Column]:
    """The fields of a well-formed answer as JSON texts, to write them in another order or shape."""
    segment = "struct<original:string,replacement:string,severity:string,bias_type:string,reasoning:string>"
    fields = F.from_json(raw, f"binary_label string, severity int, bias_found boolean, biased_segments array<{segment}>, unbiased_text string")
    return {
        "binary_label": quoted(fields["binary_label"]),
        "severity": fields["severity"].cast("string"),
        "bias_found": fields["bias_found"].cast("string"),
        "biased_segments": F.to_json(fields["biased_segments"]),
        "unbiased_text": quoted(fields["unbiased_text"]),
    }
