"""Row fixtures of the repair ladder, validation, merging, locating and spans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tonewright.functions import repair
from tonewright.functions import spans as span_columns
from tonewright.operators import phrases as phrases_module
from tonewright.operators import merging, outcomes, parse, prepare, respond, segments, validate
from tonewright.plans import runs
from tonewright.plans.annotate import annotate, annotate_recorded, judge
from tonewright.schema import SEGMENT
from tonewright.sources import texts as sources
from tonewright.storage import scratch
from tonewright.streaming.annotate import annotate_stream

G = '{"binary_label":"biased","severity":3,"bias_found":true,"biased_segments":[{"original":"idiot","replacement":"person","severity":"high","bias_type":"slur","reasoning":"Insult."}],"unbiased_text":"A person."}'
GOOD = json.loads(G)


def changed(**fields):
    return json.dumps(GOOD | fields, ensure_ascii=False)


def without(*names):
    return json.dumps({k: v for k, v in GOOD.items() if k not in names})


def with_segments(*items):
    return changed(biased_segments=list(items))


SEG = GOOD["biased_segments"][0]
FIELDS = [
    ("severity", changed(severity="high"), 4), ("severity", changed(severity="none"), 0), ("severity", changed(severity=" Low "), 2),
    ("severity", changed(severity=1), 2), ("severity", changed(severity=6), 4), ("severity", changed(severity=-1), 0),
    ("severity", changed(severity=2.5), 4), ("severity", changed(severity=3.0), 3), ("severity", changed(severity="3"), 3), ("severity", changed(severity="9"), 4),
    ("severity", changed(severity="3.0"), 2), ("severity", changed(severity="abc"), 2), ("severity", changed(severity="1_0"), 4),
    ("severity", changed(severity=True), 2), ("severity", changed(severity=False), 0),
    ("reject_field", changed(severity=None), "severity"), ("reject_field", without("severity"), "severity"), ("reject_field", changed(severity=[]), "severity"),
    ("binary_label", changed(binary_label=" BIASED "), "biased"), ("reject_field", changed(binary_label="maybe"), "binary_label"), ("reject_field", changed(binary_label=1), "binary_label"),
    ("bias_found", changed(bias_found="yes"), True), ("bias_found", changed(bias_found=1), True), ("reject_field", changed(bias_found=" true"), "bias_found"), ("reject_field", changed(bias_found=2), "bias_found"),
    ("segment.severity", with_segments(SEG | {"severity": "HIGH"}), "high"), ("segment.severity", with_segments(SEG | {"severity": "extreme"}), "medium"),
    ("segment.severity", with_segments({k: v for k, v in SEG.items() if k != "severity"}), "medium"), ("reject_field", with_segments(SEG | {"severity": None}), "biased_segments"),
    ("segment.replacement", with_segments({k: v for k, v in SEG.items() if k != "replacement"}), ""), ("reject_field", with_segments(SEG | {"replacement": None}), "biased_segments"), ("reject_field", with_segments(SEG | {"replacement": 5}), "biased_segments"),
    ("severity", changed(note=1), 3), ("severity", changed(biased_segments=[]), 3), ("reject_field", changed(biased_segments="x"), "biased_segments"), ("reject_field", without("unbiased_text"), "unbiased_text"),
]
LINES = "{\n" + "\n".join(f'"{k}":{json.dumps(v, separators=(",", ":"))}' for k, v in GOOD.items()) + "}"
REORDERED = json.dumps({k: GOOD[k] for k in ("unbiased_text", "binary_label", "severity", "bias_found", "biased_segments")}, separators=(",", ":"))
COMBINED = "{\n" + "\n".join(f'"{k}":{json.dumps(v)}' for k, v in {"binary_label": "biased", "severity": 3, "bias_found": True, "unbiased_text": "A person.", "biased_segments": []}.items())
PARSES = [
    ("F10", G, "direct", None), ("F11", f"```json\n{G}\n```", "direct", None), ("F12", f"Here:\n{G}\nHope {{x}}", "direct", None), ("F13", f"{G} assistant\n<think>\nuser", "direct", None),
    ("F14", f"<think>plan</think>{G}", "direct", None), ("F15", f"<think>use {{a}}</think>{G}", None, "not_json"), ("F16", "<think>never closed", None, "not_json"),
    ("F17", G[:-1], "salvage", "schema_mismatch"), ("F18", G[:-1] + "\n", "truncated", None), ("F19", REORDERED[:-1], "truncated", None),
    ("F20", LINES, "commas", None), ("F21", COMBINED, "combined", None), ("F22", G.replace('"Insult."', '"He said "no" ok"'), "salvage", None),
    ("F23", f"[{G}]", "direct", None), ("F24", f"```json\n{G} extra }}\n```", "salvage", None), ("F24a", '{"binary_label":"unbiased",' + G[1:], "direct", None),
    ("F24b", '{"colour":["blue"],"n":1}', "direct", "schema_mismatch"), ("F24c", "No object here, sorry.", None, "not_json"), ("null", None, None, "not_json"), ("empty", "", None, "not_json"),
]


def validated(spark, raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "text_id long, raw_output string")
    out = validate.validate_results(parse.parse_responses(rows)).drop("data").collect()
    return [r for _, r in sorted((r["text_id"], r) for r in out)]


def test_fields(spark):
    for (field, raw, expected), row in zip(FIELDS, validated(spark, [raw for _, raw, _ in FIELDS])):
        found = row["biased_segments"][0][field[8:]] if field.startswith("segment.") else row[field]
        assert found == expected, (field, raw, row)


def test_ladder(spark):
    for (name, raw, strategy, reason), row in zip(PARSES, validated(spark, [p[1] for p in PARSES])):
        assert (row["repair_strategy"], row["reject_reason"]) == (strategy, reason), (name, row)
        if name == "F24a":
            assert row["binary_label"] == "biased"
        if name == "F22":
            assert row["biased_segments"] == [] and row["bias_found"]
        if name in ("F24", "F10", "F20"):
            assert row["biased_segments"][0]["original"] == "idiot"


def seg(original="idiot", **more):
    return {"original": original, "replacement": "person"} | more


MERGES = [
    ([seg(severity="low", bias_type="slur", reasoning="A."), seg(severity="high", bias_type="insult", reasoning="B.", replacement="other")], ("high", "slur / insult", "A. B.", "person")),
    ([seg(reasoning="Bad word here."), seg(reasoning="word")], ("medium", "", "Bad word here.", "person")),
    ([seg(bias_type="a / b"), seg(bias_type="a / b")], ("medium", "a / b / a / b", "", "person")),
    ([seg("  "), seg()], ("medium", "", "", "person")),
    ([seg(severity="low"), seg(severity=" HIGH ")], ("low", "", "", "person")),
    ([seg(), seg(severity="low")], ("medium", "", "", "person")),
    ([seg(bias_type="a"), seg(bias_type="a", reasoning="B.")], ("medium", "a", " B.", "person")),
]
BAD_MERGES = [[seg(), seg(bias_type="x")], [seg(), 5], [{"original": None}], [seg(bias_type=1), seg()]]


DEEP = '{"a":' * 9 + "1" + "}" * 9
EXTRACTED = [
    (DEEP + " }", DEEP), ("x " + DEEP[:-1] + ' "s', DEEP[:-1]), ('{"a":[1,{"b":"]}"}]} tail {}', '{"a":[1,{"b":"]}"}]}'), ('{"a":[{]},1} b}', '{"a":[{]},1}'),
    ('{"a":"\\"}{"}, {', '{"a":"\\"}{"}'), ("{}{}", "{}"), ("\u2003none\x1c\u00a0", "none"), (" \n ", ""), ('{"a":"open', '{"a":'),
]
CLOSED = [
    (DEEP[:-2], DEEP), (DEEP, DEEP), ('{"a":[{"b":[1,2]},{"c":"x', '{"a":[{"b":[1,2]},{"c":"x"}]}'), ('{"a":[1]}]{', '{"a":[1]}]{}'), ("[{]}[", "[{]}[]"),
    ('{"a":"\\"[', '{"a":"\\"["}'), ("", ""), ('{"k":"[{"', '{"k":"[{"}'),
]


def test_closed_brackets_count_as_one_token(spark):
    """Deeper than a token reaches, mixed kinds, brackets in strings and escaped quotes."""
    for cases, made in ((EXTRACTED, repair.extracted), (CLOSED, repair.closed)):
        rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string").select("i", made(F.col("raw")).alias("out")).collect()
        for row in rows:
            assert row["out"] == cases[row["i"]][1], (made.__name__, cases[row["i"]], row["out"])


def test_merging(spark):
    rows = validated(spark, [with_segments(*items) for items, _ in MERGES] + [with_segments(*items) for items in BAD_MERGES])
    for (items, expected), row in zip(MERGES, rows):
        (only,) = row["biased_segments"]
        assert (only["severity"], only["bias_type"], only["reasoning"], only["replacement"]) == expected, items
    assert {r["reject_reason"] for r in rows[len(MERGES) :]} == {"bad_segment"}


@pytest.mark.parametrize("block", [2, 1024])
def test_merging_rows_equals_merging_arrays(spark, monkeypatch, block):
    """Random segments, slashes, blanks, nested reasonings and nulls: the table's form against the answer's own."""
    monkeypatch.setattr(merging, "BLOCK", block)
    pick, answers = random.Random(block), []
    for i in range(150):
        items = []
        for _ in range(pick.randint(0, 12)):
            values = {"original": pick.choice(["x", " x", "y ", "z", " ", None]), "replacement": pick.choice(["r", "s", None]), "severity": pick.choice(["low", "HIGH", "medium", "odd", None]),
                      "bias_type": pick.choice(["a", " a ", "b", "a / b", "c/d", "", " ", None]), "reasoning": pick.choice(["A.", "A. B.", "B.", " B. ", "", "Long A. B. C.", None])}
            items.append({k: v for k, v in values.items() if v is not None})
        answers.append((i, items))
    fields = ("original", "replacement", "severity", "bias_type", "reasoning")
    rows = spark.createDataFrame([(i, p, *[x.get(f) for f in fields]) for i, items in answers for p, x in enumerate(items)], "text_id long, pos int, " + ", ".join(f"{f} string" for f in fields))
    arrays = spark.createDataFrame([(i, json.dumps(items)) for i, items in answers], "text_id long, raw string")
    merged = arrays.select("text_id", segments.merged(F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")).alias("m")).collect()
    want = {r["text_id"]: [tuple(x[f] for f in fields) for x in r["m"]["items"]] for r in merged if not r["m"]["bad"]}
    found, clashes = {i: [] for i, _ in answers}, set()
    for r in sorted(merging.merge_segment_rows(rows).collect(), key=lambda r: (r["text_id"], r["pos"])):
        found[r["text_id"]].append(tuple(r[f] for f in fields))
        clashes |= {r["text_id"]} if r["clash"] else set()
    assert clashes == {r["text_id"] for r in merged if r["m"]["bad"]} and clashes
    assert {i: x for i, x in found.items() if i not in clashes} == want and len(want) > 30


@pytest.mark.parametrize(
    ("text", "originals", "expected"),
    [
        ("Trash and trash", ["trash", "Trash"], [("trash", 0, 5), ("Trash", 10, 15)]),
        ("b then a then b", ["a then", "b then"], [("b then", 0, 6), ("a then", 7, 13)]),
        ("b", ["zzz", "b"], [("zzz", None, None), ("b", 0, 1)]),
        ("é😀 idiot", ["idiot"], [("idiot", 3, 8)]),
    ],
)
def test_locating(spark, text, originals, expected):
    items = [(o, "", "low", "", "", None, None) for o in originals]
    row = spark.createDataFrame([(text, items)], f"text string, s array<{SEGMENT}>").select(segments.located(F.col("text"), F.col("s")).alias("s")).first()
    assert [(s["original"], s["start"], s["end"]) for s in row["s"]] == expected


def test_spans(spark):
    items = [("x", "", "low", "", "", a, b) for a, b in ((0, 4), (2, 20), (5, 8))]
    frame = spark.createDataFrame([("0123456789abcdefghijkl", items)], f"text string, s array<{SEGMENT}>")
    row = frame.select(span_columns.selected(F.col("s")).alias("s"), span_columns.replaced(F.col("text"), F.col("s")).alias("r")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [(0, 4), (5, 8)] and row["r"] == "489abcdefghijkl"
    frame = spark.createDataFrame([("a<b & idiot", [("idiot", "person", "high", "", "", 6, 11)])], f"text string, s array<{SEGMENT}>")
    row = frame.select(span_columns.marked(F.col("text"), F.col("s")).alias("m"), span_columns.marked_rewrite(F.lit("a person & person"), F.col("s")).alias("w")).first()
    assert row["m"] == 'a&lt;b &amp; <mark class="severity-high">idiot</mark>'
    assert row["w"] == 'a <mark class="replaced">person</mark> &amp; person'


TEXTS = [(1, "What an idiot."), (2, "All is well."), (3, "What an idiot."), (4, "   "), (5, "x" * 6000), (6, None)]
LEXICON = "phrase string, replacement string, severity string, bias_type string, reasoning string"


def lexicon(spark):
    return spark.createDataFrame([("idiot", "person", "high", "insult", "Insults.")], LEXICON)


def test_every_text_has_one_outcome(spark):
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    judged = annotate(texts, lambda t: respond.lexicon_respond(t, lexicon(spark)))
    good, bad = outcomes.split_outcomes(judged)
    assert {r["text_id"]: (r["binary_label"], r["unbiased_text"]) for r in good.collect()} == {1: ("biased", "What an person."), 2: ("unbiased", "All is well."), 3: ("biased", "What an person.")}
    assert {r["text_id"]: (r["stage"], r["reason"]) for r in bad.collect()} == {4: ("gate", "empty"), 5: ("gate", "too_long"), 6: ("gate", "empty")}
    assert outcomes.outcomes(good, bad).count() == len(TEXTS)
    assert outcomes.pending_texts(texts, good, bad).count() == 0


def test_shards_of_a_lexicon_find_the_same(spark, monkeypatch):
    """Phrases of one, two and more characters, a repeated one, an empty and a null one, repeated and null ids and texts."""
    rows = [*TEXTS, (7, "zz AB zz idiot end"), (7, "q"), (None, "an ab q"), (8, "")]
    texts = spark.createDataFrame(rows, "text_id long, text string")
    phrases = [("idiot", "ab", "q", "Q", "ab", "end", "not there", "zz idiot", "", None)]
    lexicon = spark.createDataFrame([(p, None if p is None else p[::-1], "low", "t", "r") for p in phrases[0]], LEXICON)
    found = lambda: sorted(((r["text_id"] or -1, r["text"] or "", r["hits"]) for r in respond.lexicon_hits(texts, lexicon).collect()))
    small = found()
    assert len(small) == len(rows) and [(h["at"], h["phrase"], h["until"]) for _, text, hits in small for h in hits if text.startswith("zz")] == [(1, "", 1), (4, "ab", 6), (4, "ab", 6), (7, "zz idiot", 15), (10, "idiot", 15), (16, "end", 19)]
    monkeypatch.setattr(phrases_module, "SHARD_CHARS", 12)
    assert found() == small
    assert respond.lexicon_hits(texts, lexicon.limit(0)).where("size(hits) = 0").count() == len(rows)


def test_many_phrases_equal_plain_search(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abAB\u00e9\u0130") for _ in range(pick.randint(1, 5)))
    phrases, texts = sorted({word() for _ in range(400)}), [" ".join(word() for _ in range(30)) for _ in range(50)]
    lexicon = spark.createDataFrame([(p, "x", "low", "t", "r") for p in phrases], LEXICON)
    for i, text, hits in respond.lexicon_hits(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), lexicon).collect():
        low = text.lower()
        assert {h["phrase"] for h in hits} == {p for p in phrases if p.lower() in low}
        for h in hits:  # the place is the first one; letters that only a part of a phrase's lowered form falls on belong to it
            before = text[: h["at"] - 1].lower()
            assert len(before) <= low.find(h["phrase"].lower()) and h["phrase"].lower() in text[h["at"] - 1 : h["until"] - 1].lower()


def test_places_are_those_of_the_text_before_lowering(spark):
    texts = spark.createDataFrame([(1, "\u0130\u0130\u0130 xx idiot yy"), (2, "an \u0130diot \u0130"), (3, "IDIOT")], "text_id long, text string")
    lexicon = spark.createDataFrame([("idiot", "person", "high", "insult", "Insults."), ("\u0130", "i", "low", "letter", "Long.")], LEXICON)
    good = outcomes.split_outcomes(annotate(texts, lambda t: respond.lexicon_respond(t, lexicon)))[0]
    assert {r["text_id"]: r["unbiased_text"] for r in good.collect()} == {1: "i\u0130\u0130 xx person yy", 2: "an idiot \u0130", 3: "person"}


def test_responder_failures_stay_with_their_row(spark):
    def failing():
        def answer(talks):
            if any("well" in talk[-1]["content"] for talk in talks):
                raise ValueError("no")
            return [talk[-1]["content"][-6:] for talk in talks]

        return answer

    texts = spark.createDataFrame(TEXTS[:3], "text_id long, text string")
    rows = {r["text_id"]: r for r in respond.respond(texts, failing).collect()}
    assert rows[1]["raw_output"] == "idiot." and rows[2]["raw_output"] is None and "no" in rows[2]["error"] and rows[3]["raw_output"] == "idiot."
    assert {r["text_id"]: r["raw_output"] for r in respond.respond_once(texts, failing).collect()} == {1: "idiot.", 2: None, 3: "idiot."}
    nulls = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "xyz idiot.", None)], "text_id long, text string, error string")
    for way in (respond.respond, respond.respond_once):
        assert sorted((r["text_id"], r["error"]) for r in way(nulls, failing).collect()) == [(1, None), (2, None), (3, None)]
    assert respond.respond(texts, failing, max_prompt_chars=7).where("text_id = 1").first()["raw_output"] == "hat an"


def test_responder_end_to_end(spark):
    """From texts to results with a responder in Python; its error is the reject's detail."""
    base = dict(GOOD)

    def model():
        def answer(talks):
            if any("well" in talk[-1]["content"] for talk in talks):
                raise RuntimeError("no memory")
            return [json.dumps(base | {"unbiased_text": talk[-1]["content"]}) for talk in talks]

        return answer

    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    for way in (respond.respond, respond.respond_once):
        good, bad = outcomes.split_outcomes(annotate(texts, lambda t, way=way: way(t, model)))
        assert {r["text_id"]: r["biased_segments"][0]["start"] for r in good.collect()} == {1: 8, 3: 8}
        assert {r["text_id"]: (r["stage"], r["reason"], r["detail"]) for r in bad.collect() if r["stage"] != "gate"} == {2: ("respond", "no_answer", "RuntimeError: no memory")}


def test_recorded_answers(spark, tmp_path):
    spark.createDataFrame([(1, G, 5), (3, "nothing", 5)], "text_id int, raw_output string, more int").write.parquet(f"{tmp_path}/answers")
    texts = spark.createDataFrame(TEXTS[:4], "text_id long, text string")
    good, bad = outcomes.split_outcomes(annotate_recorded(texts, sources.read_responses(spark, f"{tmp_path}/answers")))
    assert [r["text_id"] for r in good.collect()] == [1]
    assert {r["text_id"]: (r["stage"], r["reason"]) for r in bad.collect()} == {2: ("respond", "no_answer"), 3: ("parse", "not_json"), 4: ("gate", "empty")}


def test_recorded_answers_that_repeat(spark):
    """One outcome a text: an answer recorded twice is one, of different ones none counts, a null beside another is nothing."""
    answers = [(1, G), (1, G), (2, G), (2, "{}"), (3, None), (3, G), (4, None), (9, G)]
    texts = spark.createDataFrame([(i, f"text {i} of an idiot") for i in (1, 2, 3, 4, 5)], "text_id long, text string")
    good, bad = outcomes.split_outcomes(annotate_recorded(texts, spark.createDataFrame(answers, "text_id long, raw_output string")))
    assert sorted(r["text_id"] for r in good.collect()) == [1, 3]
    assert sorted((r["text_id"], r["stage"], r["reason"], r["detail"]) for r in bad.collect()) == [(2, "respond", "no_answer", "different answers are recorded"), (4, "respond", "no_answer", None), (5, "respond", "no_answer", None)]


def test_prompts_are_cut_at_tokens(spark):
    """The longest beginning that ends with a token and fits, in words, letters of several tokens and white space."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, pick = Tokenizer.from_file(path), random.Random(2)
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    bits = ["word ", "another", " ", "\n\n", "\u6f22\u5b57", "\U0001f600", "\u0130", "don't ", "12345", "   "]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 60))) for _ in range(200)] + ["x" * 50_000, "\U0001f9ff" * 30, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for most in (1, 7, 40):
        for i, text, cut in frame.withColumn("cut", respond.cut_to_tokens(F.col("text"), path, most)).collect():
            if text is None or size(text) <= most:
                assert cut == text
                continue
            assert text.startswith(cut) and size(cut) <= most and cut != text
            if len(text) < 1000 and most > 3:  # what is lost at the end is the tokens of a letter, or of what it joined
                assert size(cut) >= most - 4, (text, cut)
    instructions = size(prepare.INSTRUCTIONS) + size(prepare.QUESTION)
    limit = respond.TokenLimit(instructions + 5, path)
    said = respond.respond(spark.createDataFrame([(1, "one two three four five six seven"), (2, "short")], "text_id long, text string"), lambda: lambda talks: [t[-1]["content"].removeprefix(prepare.QUESTION) for t in talks], limit=limit)
    assert {r["text_id"]: r["raw_output"] for r in said.collect()} == {1: "one two three four five", 2: "short"}
    with pytest.raises(ValueError):
        respond.room_for_text(respond.TokenLimit(instructions, path))


def test_batches_of_like_length(spark):
    """Same answers, each row once, failures with their row, and less padding than in the order that rows come in."""
    pick = random.Random(3)
    rows = [(i % 300, " ".join("w" * pick.randint(1, 9) for _ in range(pick.choice([1, 5, 200])))) for i in range(400)] + [(None, None), (7, ""), (8, "fails here")]

    def model():
        def answer(talks):
            if any("fails" in t[-1]["content"] for t in talks):
                raise ValueError("no")
            return [t[-1]["content"][-20:] for t in talks]

        return answer

    texts = spark.createDataFrame(rows, "text_id long, text string").repartition(3)
    found = respond.respond_by_length(texts, model, batch_chars=20_000, batch=16).collect()
    key = lambda r: (r["text_id"] or -1, r["text"] or "", r["raw_output"] or "", r["error"] or "")
    assert sorted(map(key, found)) == sorted(map(key, respond.respond(texts, model).collect())) and sum(r["error"] is not None for r in found) == 1
    assert all(len(r["text"] or "") <= r["batch_length"] for r in found)
    used = sum(len(r["text"] or "") for r in found)
    plain = [len(t or "") for _, t in rows]
    unsorted = sum(max(plain[at]) * len(plain[at]) for at in respond.padded_batches(plain, 20_000, 16))
    assert 1 - used / sum(r["batch_length"] for r in found) < 0.25 < 1 - used / unsorted
    assert list(respond.padded_batches([5, 5, 9, 100, 1], 20, 3)) == [slice(0, 2), slice(2, 3), slice(3, 4), slice(4, 5)] and list(respond.padded_batches([], 5, 5)) == []


def test_a_responders_resources_hold_for_its_stage_alone(spark, monkeypatch):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    profile, seen, plain = ResourceProfileBuilder().require(TaskResourceRequests().resource("gpu", 1)).build, [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, barrier=False, profile=None: seen.append(profile) or plain(self, f, schema))
    respond.respond_by_length(spark.createDataFrame(TEXTS, "text_id long, text string"), lambda: lambda talks: ["x"] * len(talks), profile=profile)
    assert seen == [profile]


def tables_left(spark):
    from pathlib import Path

    return {str(p) for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("tonewright/*/*")}


def test_tables_of_a_run_go_with_it(spark, tmp_path, monkeypatch):
    """A batch run leaves its outcomes alone, a stream nothing, whatever the responder writes."""
    monkeypatch.setattr(phrases_module, "SHARD_CHARS", 3)
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    words = spark.createDataFrame([(p, "x", "low", "t", "r") for p in ("idiot", "well", "all")], LEXICON)
    echo = lambda: lambda talks: [G] * len(talks)
    ways = [lambda t, keep: respond.lexicon_respond(t, words, keep), lambda t, keep: respond.respond_once(t, echo, keep=keep), lambda t, keep: respond.respond_by_length(t, echo, keep=keep)]
    texts.write.parquet(f"{tmp_path}/in")
    for n, way in enumerate(ways):
        before = tables_left(spark)
        annotate(texts, way)
        assert [p.rsplit("/", 1)[1] for p in tables_left(spark) - before] == ["outcomes"]
        before = tables_left(spark)
        annotate_stream(spark.readStream.schema(texts.schema).parquet(f"{tmp_path}/in"), way, f"{tmp_path}/good{n}", f"{tmp_path}/bad{n}", f"{tmp_path}/state{n}").awaitTermination(120)
        assert tables_left(spark) == before and spark.read.parquet(f"{tmp_path}/good{n}").count() == 3


def test_stored_answers_are_asked_for_once(spark, tmp_path):
    """A second run, a stream and a run after a failure ask for what the store lacks; unpublished batches don't count."""
    asked = spark.sparkContext.accumulator(0)

    def model():
        def answer(talks):
            if any("fails" in t[-1]["content"] for t in talks):
                raise ValueError("no")
            asked.add(len(talks))
            return [G] * len(talks)

        return answer

    def run(rows, version="1"):
        before = asked.value
        with scratch(spark, "test") as keep:
            found = respond.respond_stored(spark.createDataFrame(rows, "text_id long, text string"), model, f"{tmp_path}/store", version, keep=keep).collect()
        return {r["text_id"]: r["raw_output"] for r in found}, asked.value - before

    first = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "fails")]
    assert run(first) == ({1: G, 2: G, 3: G, 4: G, 5: None}, 3)
    assert run(first) == ({1: G, 2: G, 3: G, 4: G, 5: None}, 0)
    assert run([*first, (6, "c")])[1] == 1 and run([(6, "c")], "2")[1] == 1
    (batch,) = [p for p in (tmp_path / "store" / "2").iterdir()]
    (batch / "_SUCCESS").unlink()
    assert run([(6, "c")], "2")[1] == 1
    respond.compact_answers(spark, f"{tmp_path}/store", "1")
    assert len(list((tmp_path / "store" / "1").iterdir())) == 1 and run([*first, (6, "c")])[1] == 0


def test_a_killed_run_goes_on(spark, tmp_path):
    """A run that dies between two parts, and in a part: the next one does the rest, and each text has one outcome."""
    texts = spark.createDataFrame([(i, f"text {i} of an idiot") for i in range(40)] + [(99, " "), (None, "no id")], "text_id long, text string")
    words, calls = lexicon(spark), []

    def way(fail):
        def answer(rows, keep):
            calls.append(rows.count())
            if len(calls) == fail:
                raise RuntimeError("killed")
            return respond.lexicon_respond(rows, words, keep)

        return answer

    for fail in (2, 4):
        with pytest.raises(RuntimeError):
            runs.annotate_parts(texts, way(fail), f"{tmp_path}/out", parts=4)
        done = runs.published(spark, f"{tmp_path}/out")
        assert len(done) == fail // 2 and runs.pending(texts, f"{tmp_path}/out", 4).count() == texts.count() - sum(runs.outcomes_of(spark, f"{tmp_path}/out", k).count() for k in ("results", "rejects"))
    runs.annotate_parts(texts, way(0), f"{tmp_path}/out", parts=4)
    good, bad = (runs.outcomes_of(spark, f"{tmp_path}/out", kind) for kind in ("results", "rejects"))
    assert sorted(r["text_id"] for r in good.where("text_id IS NOT NULL").collect()) == list(range(40)) and good.where("text_id IS NULL").count() == 1
    assert [(r["text_id"], r["reason"]) for r in bad.collect()] == [(99, "empty")]
    before = len(calls)
    runs.annotate_parts(texts, way(0), f"{tmp_path}/out", parts=4)
    assert len(calls) == before and runs.pending(texts, f"{tmp_path}/out", 4).count() == 0
    with pytest.raises(ValueError):
        runs.annotate_parts(texts, way(0), f"{tmp_path}/out", parts=5)


def test_prompts(spark):
    (row,) = prepare.build_prompts(spark.createDataFrame(TEXTS[:1], "text_id long, text string")).collect()
    assert [m["role"] for m in row["messages"]] == ["system", "user"] and row["messages"][1]["content"].endswith("\n\nWhat an idiot.")
    assert all(f in row["messages"][0]["content"] for f in GOOD)


def test_sinks_and_sources(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    good, bad = outcomes.split_outcomes(annotate(texts, lambda t: respond.lexicon_respond(t, lexicon(spark))))
    sources.write_results(good, f"{tmp_path}/json", "json")
    sources.write_results(good, f"{tmp_path}/parquet")
    sources.write_rejects(bad, f"{tmp_path}/rejects")
    assert spark.read.parquet(f"{tmp_path}/rejects").where("stage = 'gate'").count() == 3
    assert sorted(spark.read.json(f"{tmp_path}/json").columns) == sorted(["binary_label", "severity", "bias_found", "biased_segments", "unbiased_text", "original_text"])
    (tmp_path / "one.txt").write_text("a\nb")
    assert sources.read_texts(spark, f"{tmp_path}/one.txt", fmt="text").first()["text"] == "a\nb"
    texts.write.json(f"{tmp_path}/in")
    assert sources.read_texts(spark, f"{tmp_path}/in", fmt="json").count() == len(TEXTS)


def test_stream_equals_batch(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    texts.write.parquet(f"{tmp_path}/in")
    answer = lambda t: respond.lexicon_respond(t, lexicon(spark))
    stream = spark.readStream.schema(texts.schema).parquet(f"{tmp_path}/in")
    annotate_stream(stream, answer, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state").awaitTermination(120)
    good, bad = outcomes.split_outcomes(annotate(texts, answer))
    keys = ["text_id", "binary_label", "severity"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/good").select(*keys).collect())) == sorted(map(tuple, good.select(*keys).collect()))
    assert spark.read.parquet(f"{tmp_path}/bad").count() == bad.count()


def test_judge_of_an_empty_table(spark):
    assert judge(spark.createDataFrame([], "text_id long, text string, raw_output string")).count() == 0


def test_a_large_lexicon_is_looked_up_in_one_read_of_the_texts(spark, monkeypatch):
    """However many times SHARD_CHARS a lexicon has, texts pass Python once; hits are those of one automaton."""
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abcABéİΣ ") for _ in range(pick.randint(1, 40)))
    phrases = [word() for _ in range(300)]
    phrases += [phrases[0], phrases[0].upper(), "", None, "x" * 1000]
    rows = [(n, " ".join(pick.choice([word(), *phrases[:300]]) for _ in range(40))) for n in range(60)]
    rows += [(None, "y" + "x" * 1001), (1, ""), (1, None), (1, "x" * 999)]
    texts = spark.createDataFrame(rows, "text_id long, text string")
    lexicon = spark.createDataFrame([(p, f"r{n}", "low", "t", None) for n, p in enumerate(phrases)], LEXICON)
    found = lambda: sorted((repr(r) for r in respond.lexicon_hits(texts, lexicon).collect()))
    whole = found()
    monkeypatch.setattr(phrases_module, "SHARD_CHARS", 50)
    monkeypatch.setattr(phrases_module, "SLICE_CHARS", 1000)
    names = []

    def keep(df, name, codec="zstd"):
        names.append(name)
        return phrases_module.materialise(df, name, codec)

    assert found() == whole
    respond.lexicon_hits(texts, lexicon, keep)
    assert names == ["lexicon", "texts"]


def test_a_prompt_is_cut_without_encoding_the_whole_text():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer, longest = respond._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert respond._by_words(tokenizer)
    pick, seen = random.Random(3), []
    parts = ["a", "word ", " ", "\n", "'s", "12", "é", "日本", "<|endoftext|>", "  x", "!?"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 3000))) for _ in range(200)]

    class Counted:
        def encode(self, text, **how):
            seen.append(len(text))
            return tokenizer.encode(text, **how)

    for most in (7, 100):
        for text in [*texts, "x" * 20_000, "plain words of a long text " * 5000]:
            assert respond._prefix(Counted(), text, most, longest, True) == respond._prefix(tokenizer, text, most, longest)
    seen.clear()
    respond._prefix(Counted(), "plain words of a long text " * 5000, 300, longest, True)
    assert sum(seen) < 5000


def test_a_batch_of_texts_is_searched_some_rows_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["an idiot", None, "", "well idiot idiot", "none"] * 7)
    finder = phrases_module.Finder([("idiot", "person", "high", "insult", "Insults."), ("", "x", "low", "t", "r")])
    whole, sizes, plain = finder.hits(texts).to_pylist(), [], phrases_module.Finder._hits
    monkeypatch.setattr(phrases_module, "ROWS_AT_ONCE", 4)
    monkeypatch.setattr(phrases_module.Finder, "_hits", lambda self, part: sizes.append(len(part)) or plain(self, part))
    assert finder.hits(texts).to_pylist() == whole and max(sizes) == 4 and sum(sizes) == len(texts)
    assert finder.hits(texts.slice(0, 0)).to_pylist() == []


def test_types_of_a_large_group_are_joined_in_linear_work(spark):
    """Against the plain fold, on blank, null and repeated types; and a group of 40,000 types with slashes, which ends."""
    import time

    pick = random.Random(5)
    kinds = ["a", "b", "c", " a ", "a / b", "d/e", "e", "/", "x //y", "y", None, " "]
    groups = [[pick.choice(kinds) for _ in range(pick.randint(1, 9))] for _ in range(150)]
    clean = lambda t: (t or "").strip()

    def plain(types):
        text, parts = types[0], [p.strip() for p in (types[0] or "").split("/")]
        for t in map(clean, types[1:]):
            if t and t not in parts:
                text = None if text is None else f"{text.strip()} / {t}"
                parts += [p.strip() for p in t.split("/")]
        return text

    rows = [(n, pos, "p", "r", "low", t, None) for n, types in enumerate(groups) for pos, t in enumerate(types)]
    schema = "text_id long, pos long, original string, replacement string, severity string, bias_type string, reasoning string"
    merged = {r["text_id"]: r["bias_type"] for r in merging.merge_segment_rows(spark.createDataFrame(rows, schema)).collect()}
    assert merged == {n: plain(types) for n, types in enumerate(groups)}
    began = time.time()
    many = spark.range(40_000).select(F.lit(1).alias("text_id"), F.col("id").alias("pos"), *[F.lit(x).alias(c) for c, x in zip(("original", "replacement", "severity", "bias_type", "reasoning"), ("p", "r", "low", "a / b", "why"))])
    assert merging.merge_segment_rows(many).select(F.length("bias_type")).first()[0] == 40_000 * 8 - 3
    assert time.time() - began < 60
