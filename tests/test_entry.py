"""Registered queries against their SQL on the smallest tables, where those are there."""

import collections
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = ["annotate_udf", "annotate_recorded", "extract_object", "strip_think", "parse_direct", "parse_truncated", "parse_commas", "parse_combined", "parse_salvage", "severity_coercion", "segment_severity", "consistency_audit", "rewrite_fidelity", "results_json_whole", "review_report_whole", "severity_counts", "validate_results", "repair_strategy_counts", "merge_segments", "outcomes", "mark_rewrite", "results_json"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["zstandard", "tonewright.llm", "corpus_pipeline"])
def test_missing_parts_take_only_their_own_queries(missing):
    """With a library, the subpackage or the pipeline blocked, all queries of the rest are there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from tonewright.plans import queries as q; print(set(q.QUERIES) <= set(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    root = Path(entry.__file__).parent
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert said == ["True", "False", "True"]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    wanted = con.sql(entry.oracle_sql()[name])
    columns = sorted(wanted.columns)
    text = lambda x: None if x is None else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    theirs = collections.Counter(tuple(text(r[wanted.columns.index(c)]) for c in columns) for r in wanted.fetchall())
    ours = collections.Counter(tuple(text(r[c]) for c in columns) for r in entry.queries()[name](spark, str(DATA)).collect())
    assert ours == theirs


def test_whole_results_are_marked_reported_and_serialised(spark, tmp_path):
    """On results as they come: long texts, quotes, line breaks, markup, phrases that repeat or stand inside replacements."""
    import hashlib
    import html
    import json

    from tonewright.plans import queries as own

    texts = ["A \"Moron\" & an idiot\nsaid: <b>stupid</b> moron, stupid person!", "a person and a rival met the loser, an IDIOT", "nothing \\ \"here\"\n\n<i>", "é😀 trash\ttrash material " + "worthless words, limited " * 3000, "clown colleague clown"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {"mark_rewrite_whole": {}, "review_report_whole": {}, "results_json_whole": {}}
    for i, text in enumerate(texts):
        text, found, rewrite, at = text.strip(), [], "", 0
        hits = sorted((text.lower().find(row[0]), row) for row in own.LEXICON if row[0] in text.lower())
        for start, (phrase, new, severity, kind, why) in hits:
            found.append({"original": phrase, "replacement": new, "severity": severity, "bias_type": kind, "reasoning": why, "start": start, "end": start + len(phrase)})
            rewrite, at = rewrite + text[at:start] + new, start + len(phrase)
        rewrite += text[at:]
        level = max([{"high": 4, "medium": 3, "low": 2}[s["severity"]] for s in found], default=0)
        marked = html.escape(rewrite, quote=True)
        for s in found:
            marked = marked.replace(s["replacement"], f'<mark class="replaced">{s["replacement"]}</mark>', 1)
        each = "\n".join(f"[{n}] {s['severity'].upper()}\nOriginal: {s['original']}\nReplacement: {s['replacement']}\nBias type: {s['bias_type']}\nReasoning: {s['reasoning']}" for n, s in enumerate(found, 1))
        report = (f"Segments found: {len(found)}\n{each}" if found else "No biased segments.\n") + f"\nNeutral rewrite:\n{rewrite}"
        whole = {"binary_label": "biased" if found else "unbiased", "severity": level, "bias_found": bool(found), "biased_segments": found, "unbiased_text": rewrite, "original_text": text}
        for name, out in zip(wanted, (marked, report, json.dumps(whole, ensure_ascii=False, separators=(",", ":")))):
            wanted[name][i] = hashlib.md5(out.encode()).hexdigest()
    for name, want in wanted.items():
        assert {r[0]: r[1] for r in entry.queries()[name](spark, str(tmp_path)).collect()} == want, name


@pytest.fixture
def without_text(spark, tmp_path):
    """Documents some of which have no text (null, empty, white space), at least one of each kind in each way of damage."""
    texts = ["A moron met an idiot.", "All is well.", None, "", " \n\t"]
    rows = [(i, texts[i % len(texts)], ("en", "de")[i % 2], f"s{i % 3}", len(texts[i % len(texts)] or "")) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _rows_and_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    wanted = con.sql(entry.oracle_sql()[name])
    text = lambda x: None if x is None else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    ours = collections.Counter(tuple(text(r[c]) for c in wanted.columns) for r in entry.queries()[name](spark, folder).collect())
    return ours, collections.Counter(tuple(map(text, r)) for r in wanted.fetchall())


@pytest.mark.parametrize("name", ["consistency_audit", "valid_spans", "results_json"])
def test_documents_without_text_have_clean_results(spark, without_text, name):
    ours, theirs = _rows_and_sql(spark, without_text, name)
    assert ours == theirs


@pytest.mark.parametrize("name", ["pending_texts", "validate_results", "severity_counts"])
def test_documents_without_text_have_outcomes(spark, without_text, name):
    ours, theirs = _rows_and_sql(spark, without_text, name)
    assert ours == theirs


@pytest.mark.parametrize("name", ["rejects", "label_rates_cube"])
def test_documents_without_text_are_counted(spark, without_text, name):
    ours, theirs = _rows_and_sql(spark, without_text, name)
    assert ours == theirs


def test_empty_texts_pass_the_gate_where_asked(spark):
    from tonewright.operators.prepare import gate_texts

    texts = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, " word "), (5, "x" * 9)], "text_id long, text string")
    passed = lambda *how: {r["text_id"]: (r["text"], r["reject_reason"]) for r in gate_texts(texts, *how).collect()}
    assert passed(8, True) == {1: ("", None), 2: ("", None), 3: ("", None), 4: ("word", None), 5: ("x" * 9, "too_long")}
    assert passed(None, True)[5] == ("x" * 9, None)
    assert [passed(8)[i][1] for i in range(1, 6)] == ["empty", "empty", "empty", None, "too_long"]
