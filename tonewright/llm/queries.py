"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, minhash_dedup, mixing, packing, periodic_runs, phrase_dedup, prefix_trie, quality, sharding, token_files, toxicity, weighted_sampling
from .storage import new_path, scratch

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embedding_dedup.grouped(table(spark, sf_dir, "embeddings"), least=0.93)
    return groups.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = sharding.assigned(docs, 24, new_path(spark, "slot_map"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
    )


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabularies = (vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = quality.judged(table(spark, sf_dir, "documents"), vocabularies)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy", "chars_per_token_multi")


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash_dedup.grouped(table(spark, sf_dir, "documents"), k=2, least=80)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = toxicity.model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), weights, bias)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    token_files.write_shards(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_documents(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrase_dedup.summary(table(spark, sf_dir, "documents"), window=20)
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark, "turns") as keep:
        turns = keep(prefix_trie.numbered(table(spark, sf_dir, "conversations"), keep), "numbered")
        return prefix_trie.trie(*prefix_trie.grafted(turns, keep))


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted_sampling.fingerprints(table(spark, sf_dir, "documents"))
    samples, beside = F.col("samples"), F.col("edited_samples")
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        weighted_sampling.written(samples).alias("fingerprint"),
        weighted_sampling.written(beside).alias("edited_fingerprint"),
        weighted_sampling.likeness(samples, beside).alias("near_edited"),
        weighted_sampling.likeness(samples, F.col("next_samples")).alias("near_next"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """documents, of which a tenth gets periodic words from some place on; its hashed id says where and how long a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        first = g % n
        period = 1 + F.floor((n - first) / (3 + g % 8))
        source = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: words[source(i)]), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.collapsed_runs(with_periods(table(spark, sf_dir, "documents")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    length = -F.when(F.size("runs") > 0, longest["less"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") > 0, longest["start"]).alias("start"),
        length.alias("length"),
        F.when(F.size("runs") > 0, longest["period"]).alias("period"),
        F.when(F.size("runs") > 0, F.floor(1000 * length / longest["period"])).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_collision_counting, op3_sharding, op4_packing, op5_fertility, op6_token_files, op7_hyperminhash, op8_toxicity, op9_mixing, op10_phrase_automata, op11_prefix_trie, op12_weighted_sampling, op13_periodic_runs)}

#: crc(id) is CRC-32 of decimal numbers, by the usual table of 256 values made here from the polynomial.
_CRC = """tab AS (
    SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))
), crc AS (
    SELECT id, xor(list_reduce(list_transform(string_split(id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
    FROM (SELECT DISTINCT {id} AS id FROM {table}) CROSS JOIN tab
)"""

ORACLE_SQL = {
    "op11_prefix_trie": "WITH " + _CRC.format(id="conv_id", table="conversations") + r""", o AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:(h % 9)::BIGINT], o.turns[(h % 9 + 1)::BIGINT:]) AS turns FROM o JOIN crc ON id = o.conv_id LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5
), m AS (
    SELECT conv_id, d, len(turns) AS n, md5(turns[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(turns[1:d - 1]::VARCHAR) END AS p, CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)
), nodes AS (
    SELECT d, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM m GROUP BY d, k
), kids AS (
    SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, p
), each AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)
), above AS (
    SELECT m.d, m.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * each.bytes) AS saved FROM each JOIN m ON m.conv_id = each.conv_id AND m.d <= each.d GROUP BY m.d, m.k
)
SELECT e.conv_id, e.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, e.n_convs::BIGINT AS n_convs, e.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM each e JOIN above USING (d, k) LEFT JOIN nodes parent ON parent.d = e.d - 1 AND parent.k = e.p
""",
    "op13_periodic_runs": "WITH " + _CRC.format(id="doc_id", table="documents") + r""", d AS (
    SELECT doc_id, w, len(w)::BIGINT AS n, h, h // 10 AS g FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents) JOIN crc ON id = doc_id
), f AS (
    SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM d
), e AS (
    SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)
), pair AS (
    SELECT a.doc_id, b.i - a.i AS q, a.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), r AS (
    SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
    SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = a.doc_id AND b.period < a.period AND b.start <= a.start AND b.start + b.length >= a.start + a.length)
), s AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS top FROM run GROUP BY doc_id
), k AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.doc_id = e.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period, (1000 * top.length // top.period)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op9_mixing": r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS most FROM d GROUP BY source
), w AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), r AS (
    SELECT *,
        coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped_before,
        sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
        sum(source_size) OVER ()::DOUBLE AS total
    FROM w
), l AS (
    SELECT *, (total - capped_before) / weight_left AS level FROM r
), t AS (
    SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l
), n AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END::DOUBLE AS step,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id % 256, d.doc_id) AS nth
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
    SELECT source, draw, ('0x' || substr(md5('mix-1:' || draw || ':' || coalesce('s' || source, 'none')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
    FROM s CROSS JOIN range(16) AS g(draw)
), p AS (
    SELECT o.source, o.start, row_number() OVER (PARTITION BY o.source ORDER BY abs(sum((floor(start + step * nth) - floor(start + step * (nth - 1)))::BIGINT * size)::DOUBLE - any_value(target)), draw) AS best
    FROM n JOIN o ON n.source IS NOT DISTINCT FROM o.source GROUP BY o.source, o.draw, o.start
), k AS (
    SELECT n.*, p.start FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE p.best = 1
)
SELECT doc_id, size, source_size, target, (least(floor(start + step * nth) - floor(start + step * (nth - 1)), 3) * size)::BIGINT AS taken FROM k
""",
    "op2_collision_counting": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: coalesce(isfinite(x), false)), false) AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.93::DOUBLE * a.norm * b.norm),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
""",
    "op7_hyperminhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
half AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 80 * (p.n + q.n - x)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(least.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
""",
    "op10_phrase_automata": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
edge AS (SELECT doc_id, pos, sum(step) AS step FROM (SELECT doc_id, s AS pos, 1 AS step FROM later UNION ALL SELECT doc_id, s + 20, -1 FROM later) GROUP BY doc_id, pos),
each AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
cover AS (SELECT e.doc_id, e.i, e.word, sum(coalesce(g.step, 0)) OVER (PARTITION BY e.doc_id ORDER BY e.i) > 0 AS gone FROM each e LEFT JOIN edge g ON g.doc_id = e.doc_id AND g.pos = e.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM cover GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)
""",
}
