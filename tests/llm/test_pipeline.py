"""The corpus pipeline, stage by stage, on a small table with planted cases."""

import collections
import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline

    pick = random.Random(9)
    words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passage = text(60)
    texts, toxic = [], []
    for i in range(300):
        t = text(80)
        if i % 6 == 0:
            t = t + " vilkrat " + pick.choice(words)
        if i % 50 == 1:
            t = f"{t} {passage} {text(10)}"
        texts.append(t)
        toxic.append(int(i % 6 == 0))
    texts += [texts[2], texts[3] + " more", texts[4]]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert kept == {i for i in range(303) if i >= 300 or not toxic[i]}
    assert {r["doc_id"] for r in seen["minhash_near_dedup"]} == kept - {300, 301, 302}
    holders = [r["doc_id"] for r in seen["substring_dedup"] if passage in r["text"]]
    assert holders == [min(i for i in range(300) if i % 50 == 1 and not toxic[i])] and len(seen["substring_dedup"]) == len(kept) - 3
    taken = collections.Counter(r["doc_id"] for r in seen["mixing"])
    assert max(taken.values()) <= 3 and set(taken) <= kept
    pieces = collections.Counter(r["doc_id"] for r in seen["packing"] if r["start"] == 0)
    assert pieces == taken
