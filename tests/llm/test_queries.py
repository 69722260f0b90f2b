"""All registered queries of the training-data operators on tables with odd rows, and on empty ones."""

import collections

import pytest

pytest.importorskip("public_tokenizers")
from tonewright.llm import queries  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[i * i % 23] + str(i % 97) for i in range(30_000))
PASSAGE = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 2))
#: Texts of documents 0 to 9, more rows of document 3 (its own and another text) and rows without an id.
TEXTS = [(0, PASSAGE), (1, None), (2, ""), (3, "first text of three"), (4, " \t\n"), (5, LONG), (6, "x " + PASSAGE + " y"), (7, LONG), (8, "\u00e9\U0001f600 z\u0000\u00c9"), (9, "one"), (3, "first text of three"), (3, "an other text " * 30), (None, "no id"), (None, None), (None, "no id")]
#: The contracts' columns.
COLUMNS = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op2_collision_counting": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_fertility": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_hyperminhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_phrase_automata": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_weighted_sampling": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}
VECTORS = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (7, [0.01, 1.0], 1), (8, [0.02, 1.0], 1), (9, None, 1), (10, [None, 1.0], 1), (11, [0.0, 0.0], 1), (12, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (13, [float("nan"), 1.0], 1), (14, [], 1), (6, [1.0, 0.01], 1)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(spark, tmp_path_factory, request):
    folder, n = tmp_path_factory.mktemp(request.param), None if request.param == "odd" else 0
    documents = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, k, "a", "b", "c", "d", "e") for k, (i, t) in enumerate(TEXTS)]
    frames = {
        "documents": (documents, "doc_id long, text string, lang string, source string, n_chars long, row int, id string, digest string, key string, words string, copies string"),
        "labels": ([(0, 1), (3, 0), (3, 1), (5, 1), (7, None), (None, 1), (8, 0), (9, 0), (99, 1)], "doc_id long, toxic int"),
        "embeddings": ([(*v, "z") for v in VECTORS], "vec_id long, embedding array<float>, label int, id string"),
        "conversations": ([(0, 1, "user", "a", 1), (0, None, None, None, 1), (1, 1, "user", "a", 1), (None, 1, "user", "x", 1), (4, 2, "user", "", 1), (4, 2, "user", "", 1)], "conv_id long, turn int, role string, text string, n_convs int"),
        "pages": ([(1, "u", "<p>text</p>", "q"), (None, None, None, None), (2, "u", "", "q"), (1, "u", "<p>text</p>", "q"), (3, None, "<div>" * 3000 + "deep", "q")], "page_id long, url string, html string, page0 string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows[:n], schema).coalesce(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), request.param == "empty"


@pytest.mark.parametrize("name", COLUMNS)
def test_query_on_odd_and_empty_tables(spark, tables, name):
    folder, empty = tables
    made = queries.QUERIES[name](spark, folder)
    types = dict(made.dtypes)
    assert {c.split()[0]: types.get(c.split()[0]) for c in COLUMNS[name].split(", ")} == dict(c.split() for c in COLUMNS[name].split(", "))
    rows = made.collect()
    if empty:
        assert rows == []
        return
    if name == "op11_prefix_trie":
        assert sum(r["n_convs"] for r in rows if r["depth"] == 0) == 3 and sum(r["n_children"] for r in rows) == len(rows) - 1
        return
    key, table = {"op1_html_extraction": ("page_id", "pages"), "op2_collision_counting": ("vec_id", "embeddings")}.get(name, ("doc_id", "documents"))
    wanted = collections.Counter(r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(key).collect())
    found = collections.Counter(r[key] for r in rows if name != "op4_packing" or r["start"] == 0)
    assert found == wanted
    if name == "op2_collision_counting":
        links = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in rows)
        assert links == {(5, 2, 5): 2, (6, 2, 5): 2, (7, 2, 5): 1, (8, 2, 5): 1, (None, 0, None): 1} | {(i, 0, i): 1 for i in (9, 10, 11, 12, 13, 14)}
    if name == "op7_hyperminhash":
        assert sorted(r["component_id"] for r in rows if r["doc_id"] == 3) == [3, 3, 3] and {r["component_id"] for r in rows if r["doc_id"] in (5, 7)} == {5}
    if name == "op10_phrase_automata":
        assert {r["doc_id"]: r["n_removed"] for r in rows if r["doc_id"] in (0, 5, 6, 7, 9)} == {0: 0, 5: 30_000 - LEFT_OF_LONG, 6: 48, 7: 30_000, 9: 0}


def _left_of_long() -> int:
    words, seen, gone = LONG.split(), set(), set()
    for i in range(len(words) - 19):
        window = tuple(words[i : i + 20])
        if window in seen:
            gone |= set(range(i, i + 20))
        seen.add(window)
    return len(words) - len(gone)


LEFT_OF_LONG = _left_of_long()


def test_pipeline_on_odd_and_empty_tables(spark, tables):
    import corpus_pipeline

    folder, empty = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        sizes.append(docs.count())
        assert name == "packing" or docs.columns == columns
        if name == "minhash_near_dedup" and not empty:
            kept = collections.Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
            assert kept[(3, "first text of three")] <= 1 and kept[(None, "no id")] == 2 and kept[(7, LONG)] == 0
    assert (max(sizes) == 0) == empty


def test_more_vector_lengths_than_any_cap(spark):
    """Two parallel vectors of each of 4,200 lengths."""
    from pyspark.sql import functions as F

    from tonewright.llm import embedding_dedup

    vector = F.transform(F.sequence(F.lit(1), (F.col("id") / 2).cast("int") + 1), lambda i: (i % 7 + 1) * (F.col("id") % 2 + 1).cast("double"))
    rows = spark.range(8400).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(1).alias("label"))
    assert embedding_dedup.grouped(rows).where("n_links = 1 AND component = id - id % 2").count() == 8400


def test_long_documents_are_searched_in_parts(spark, monkeypatch):
    """Parts meet again: the same result whatever their size."""
    import hashlib

    from tonewright.llm import phrase_dedup

    monkeypatch.setattr(phrase_dedup, "PART_WINDOWS", 50)
    monkeypatch.setattr(phrase_dedup, "SHARD_WINDOWS", 40)
    texts = [PASSAGE + " tail", " ".join(WORDS[i * 7 % 24] + str(i) for i in range(400)) + " " + PASSAGE, PASSAGE + " " + " ".join(WORDS[i * 7 % 24] + str(i) for i in range(100, 333))]
    seen, want = set(), {}
    for doc_id, text in enumerate(texts):
        words, gone = text.split(), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = [w for i, w in enumerate(words) if i not in gone]
        want[doc_id] = (len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: (r["n_removed"], r["kept_sha256"]) for r in phrase_dedup.summary(docs).collect()} == want
    assert {r["doc_id"]: len(r["text"].split()) for r in phrase_dedup.cleaned(docs).collect()} == {i: len(t.split()) - want[i][0] for i, t in enumerate(texts)}
