"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its words, weighted by how often they come. For each of N_SAMPLES samples every term draws, by its hash
alone, r and c from Gamma(2, 1) and b from [0, 1); with weight w, t = floor(ln w / r + b) and the term of the least
ln c - r * (t - b + 1) is the sample, together with t. Two texts have the same sample with a probability equal to their
generalised Jaccard similarity: sum of the lesser weights over sum of the greater ones. A fingerprint holds 32 bits of each
sample, so equal texts have equal fingerprints and the share of equal samples estimates that similarity.

Texts are exchanged once, by parts of the order of ids; a part also gets the document after its last one. Counting terms,
drawing and taking least values all group within parts, so nothing else of a document is exchanged. Rows carry a document's
other values through the grouping as terms of kinds of their own.

Edge cases: a null text counts as empty; texts without words have a fingerprint of zeros, like one another and like
nothing else; null ids come after all others; of rows with one id the lesser text comes first, and rows equal in both
follow one another, a row each; an only row is its own next; an empty table gives an empty result; further columns are
ignored, whatever their names. Rows that share one id share a part: its task sorts and spills them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Samples of a fingerprint, and how many a row draws at a time (more make a method that the JVM doesn't compile).
N_SAMPLES, PER_LANE = 32, 4
#: Documents of a part, and parts at the most: the bounds between them are one constant of the plan.
PART_ROWS, MOST_PARTS = 512, 100_000
#: Parts of a task, at the most on average; there are as many tasks as shuffles have, where that is more.
TASK_PARTS = 64
#: Cells of the gamma distribution: this many for each halving of the lower probability, and halvings.
CELLS, HALVINGS = 64, 16
# Kinds of exploded rows: words of the text and of the text beside it, and values that are carried along.
_TEXT, _BESIDE, _VALUES = 0, 1, 2


def gamma_quantiles() -> list[float]:
    """Gamma(2, 1) at the middle of each cell: probability 2**-g * (1/2 + (m + 1/2) / (2 * CELLS)) at g * CELLS + m."""
    found = []
    for at in range((HALVINGS + 1) * CELLS):
        p = 2.0 ** -(at // CELLS) * (0.5 + (at % CELLS + 0.5) / (2 * CELLS))
        x = math.sqrt(2 * p) if p < 0.5 else 2.0
        for _ in range(60):  # Newton's steps; 1 - (1 + x) * exp(-x) is taken apart so that small x keep their digits
            x -= (-math.expm1(-x) - x * math.exp(-x) - p) / (x * math.exp(-x))
        found.append(x)
    return found


def _constant(values: list, kind: str) -> Column:
    """An array as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _cell(bits: Column, at: int, halvings: int) -> Column:
    """The cell that a hash's bits from `at` on choose: trailing zeros of `halvings` bits, then a place among CELLS."""
    field = F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << halvings) - 1).cast("long")).bitwiseOR(F.lit(1 << halvings).cast("long"))
    zeros = F.bit_count(field.bitwiseAND(-field) - 1)
    return zeros * CELLS + F.shiftrightunsigned(bits, at + halvings).bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int")


def _sample(term: Column, seed: Column, logs: list[Column], quantiles: Column, log_quantiles: Column) -> list[Column]:
    """For each weight's logarithm (null: no such term) a number whose least one is the sample: its order, then 32 bits of it."""
    bits = F.xxhash64(term, seed)  # 22 bits for c, 16 for r, 26 for b
    log_c, r = log_quantiles[_cell(bits, 0, HALVINGS)], quantiles[_cell(bits, 22, 10)]
    b = F.shiftrightunsigned(bits, 38).cast("double") / (1 << 26)
    name = term.bitwiseAND(F.lit((1 << 32) - 1))
    made = []
    for log in logs:
        t = F.floor(log / r + b)
        order = F.floor((log_c - r * (t - b + 1) + 64) * (1 << 24))
        made.append(F.shiftleft(order, 32).bitwiseOR((name + t).bitwiseAND(F.lit((1 << 32) - 1))))
    return made


def _part_of(id_: Column, bounds: list[int]) -> Column:
    """How many bounds are below an id, by halving; all for a null."""
    if not bounds:
        return F.lit(0)
    held, halves = _constant(bounds, "bigint"), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    below = lambda at: F.when(at <= len(bounds), F.get(held, at - 1) < id_).otherwise(False)
    found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))
    return F.when(id_.isNull(), len(bounds)).otherwise(found)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and next_text, the text of the next row by id (after the last: of the first), with part and nth.

    Each part ends with a row that only `follows` it: the next part's first one. All rows of a part are in one task, by nth.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_parts = min(MOST_PARTS, -(-rows.select("id").count() // PART_ROWS))
    cuts = [i / n_parts for i in range(1, n_parts)]
    bounds = rows.agg(F.percentile_approx("id", cuts, max(10_000, 4 * n_parts))).first()[0] if cuts else []
    dealt = rows.withColumn("part", _part_of(F.col("id"), bounds or []))
    # A row for each part (MOST_PARTS at most): its least id, and the part before it in the ring.
    ring = Window.orderBy("part")
    firsts = dealt.groupBy("part").agg(F.min("id").alias("first_id"))
    firsts = firsts.select(F.col("part").alias("of"), "first_id", F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy())).alias("before"))
    heads = dealt.join(F.broadcast(firsts), (F.col("part") == F.col("of")) & F.col("id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy(F.col("before").alias("part"), "id").agg(F.min("text").alias("text"))
    # Dealt to a fixed number of tasks: what follows is much more work than its bytes say.
    n_tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_parts // TASK_PARTS))
    both = dealt.withColumn("follows", F.lit(False)).unionByName(heads.withColumn("follows", F.lit(True))).repartition(n_tasks, "part")
    order = Window.partitionBy("part").orderBy("follows", F.col("id").isNull(), "id", "text")
    return both.withColumns({"nth": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def edited(text: Column, next_text: Column) -> Column:
    """A text whose last quarter is replaced by the beginning of the next one."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(next_text, F.lit(1), quarter))


def _words(text: Column, kind: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.lit(kind).alias("kind"), F.xxhash64(w).alias("value")))


def sampled(rows: DataFrame, text: str, beside: str, values: list[Column]) -> DataFrame:
    """part, nth, samples of two texts a row, and value0, value1, ...: whole numbers that belong to the row.

    rows are dealt by part and numbered by nth in it; nothing is exchanged where they already are.
    """
    carried = F.array(*[F.struct(F.lit(_VALUES + i).alias("kind"), v.cast("long").alias("value")) for i, v in enumerate(values)])
    terms = rows.select("part", "nth", F.explode(F.concat(_words(F.col(text), _TEXT), _words(F.coalesce(beside, F.lit("")), _BESIDE), carried)).alias("t"))
    times = lambda kind: F.nullif(F.sum((F.col("t.kind") == kind).cast("int")), F.lit(0))
    counted = terms.groupBy("part", "nth", F.greatest("t.kind", F.lit(_BESIDE)).alias("kind"), F.col("t.value").alias("value")).agg(times(_TEXT).alias("own"), times(_BESIDE).alias("other"))
    is_term, lanes = F.col("kind") == _BESIDE, N_SAMPLES // PER_LANE
    dealt = counted.select("part", "nth", "kind", "value", F.ln("own").alias("own"), F.ln("other").alias("other"), F.explode(F.when(is_term, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.lit(0)))).alias("lane"))
    quantiles = gamma_quantiles()
    tables = [_constant(x, "double") for x in (quantiles, [math.log(x) for x in quantiles])]
    drawn = [_sample(F.col("value"), F.col("lane") * PER_LANE + j, [F.col("own"), F.col("other")], *tables) for j in range(PER_LANE)]
    least = [F.min(x).alias(f"{name}{j}") for j, pair in enumerate(drawn) for name, x in zip(("own", "other"), pair)]
    kept = [F.max(F.when(F.col("kind") == _VALUES + i, F.col("value"))).alias(f"value{i}") for i in range(len(values))]
    by_lane = dealt.groupBy("part", "nth", "lane").agg(*least, *kept)
    # What the grouping keeps of a sample is its name, not its order.
    names = lambda name: F.array(*[F.coalesce(F.col(f"{name}{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)) for j in range(PER_LANE)])
    lined = by_lane.groupBy("part", "nth").agg(F.sort_array(F.collect_list(F.struct("lane", names("own").alias("own"), names("other").alias("other")))).alias("l"), *[F.max(f"value{i}").alias(f"value{i}") for i in range(len(values))])
    whole = lambda name: F.when(F.size("l") == lanes, F.flatten(F.col(f"l.{name}"))).otherwise(F.array_repeat(F.lit(0).cast("long"), N_SAMPLES))
    return lined.select("part", "nth", whole("own").alias("samples"), whole("other").alias("beside"), *[f"value{i}" for i in range(len(values))])


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints: the share of samples that they have in common."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / N_SAMPLES


def written(samples: Column) -> Column:
    """A fingerprint as hexadecimal digits, eight a sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, sha256 of the edited text, samples of both texts and of the next row's: one row a document."""
    rows = in_order(docs, id_col, text_col)
    rows = rows.withColumn("edited", F.when(~F.col("follows"), edited(F.col("text"), F.col("next_text"))))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10) for i in range(4)]
    made = sampled(rows, "text", "edited", [F.col("id"), F.length("text"), F.col("follows").cast("int"), *quarters])
    nexts = made.withColumn("next_samples", F.lead("samples").over(Window.partitionBy("part").orderBy("nth"))).where("value2 = 0")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"value{i}"), 16, "0") for i in range(3, 7)]))
    return nexts.select(F.col("value0").alias("id"), F.col("value1").alias("n_chars"), sha.alias("edited_sha256"), "samples", F.col("beside").alias("edited_samples"), "next_samples")
