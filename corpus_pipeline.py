"""A training corpus from `documents`, in five stages that each use one operator of tonewright.llm.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`.

Edge cases, in all stages: null and empty texts stay (they are one token when packed), and so do null ids; of rows equal in
id and text the near-duplicate stage keeps one; rows with one id and different texts are documents of their own; an empty
table gives an empty result; further columns, whatever their names, are kept until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import minhash_dedup, mixing, packing, phrase_dedup, toxicity
from tonewright.llm.storage import neutral, scratch
from tonewright.session import ship

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below TOXIC.

    A null or empty text has the score of no features and stays, unless most of what was learned is toxic; without labels of
    both classes all stay or, where only toxic ones are known, none.
    """
    ship(spark)
    weights, bias = toxicity.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, text = neutral(docs, "text")
    scored = toxicity.scored(plain, weights, bias, text_col=text, score_col="toxicity")
    return scored.where(F.col("toxicity") < TOXIC).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    That of the least id stays, of several with that id the one of the least digest. Texts without words and null ids have no
    duplicates.
    """
    ship(spark)
    return minhash_dedup.deduplicated(docs, k=5, least=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that come earlier in the corpus.

    Every row stays, if need be with an empty text; a document with a null id counts as later than all others.
    """
    ship(spark)
    return phrase_dedup.cleaned(docs, window=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, or up to three times.

    A null source is one of its own; rows without words are taken where their place in the source's order says so.
    """
    ship(spark)
    return mixing.mixed(docs, weights=(5, 2, 1), cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; equal rows are packed as often as they come."""
    ship(spark)
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests/llm compares their operators with brute-force versions, and the stages on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage hands on goes when the last one has written its pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark, "pipeline") as keep:
        for name, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
