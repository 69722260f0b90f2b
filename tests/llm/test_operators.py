"""Each operator against a brute-force version on small tables with ties, copies, nulls, empty and long texts."""

import collections
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import embedding_dedup, html_text, hyperminhash, minhash_dedup, mixing, packing, periodic_runs, phrase_dedup, prefix_trie, quality, sharding, token_files, tokens, toxicity, weighted_sampling
from tonewright.llm import storage
from tonewright.llm.components import components
from tonewright.llm.wavelet import WaveletMatrix, build
from tonewright.llm.words import hashed_words, window_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARIES = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, score string"


def some_texts(seed=1, n=60):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(pick.choice(words) for _ in range(k))
    texts = [text(pick.randint(1, 120)) for _ in range(n)]
    passage = text(40)
    texts += [f"{text(30)} {passage}\n{text(10)}" for _ in range(6)]
    for t in list(texts[:8]):
        near = t.split()
        near[len(near) // 2] = "changed"
        texts += [t, " ".join(near)]
    return [*texts, texts[3], texts[3], "", "   ", None, "one", "one two", "é😀 x\tÉ", text(6000), "A B", "a b"]


def documents(spark, texts=None):
    texts = some_texts() if texts is None else texts
    rows = [(i * 3, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 5}", None if t is None else len(t), i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def with_odd_rows(spark):
    """Null ids, and rows that repeat an id and a text."""
    return documents(spark).unionByName(spark.createDataFrame([(None, "lost words here", None, None, 1, 1, "x"), (0, some_texts()[0], "en", None, 1, 1, "x")], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1


PAGE = """<html><head><title>T</title></head><body class="home"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies to make
this site wonderful for everyone, always and forever.</div><div class="wrap"><div class="content"><h2>My  story</h2><p>First paragraph &amp; long enough
to be an article of some sort.</p><div class="ad-box"><p>Buy this now</p></div><p>Short.</p><ul><li>one</li><li>two <a href=x>link</a></li></ul><p>And the
last paragraph, a bit longer than the others here.<script>if (a < b) "</p>"</script></p></div><aside><p>Side text of considerable length that should
not be there at all, really.</p></aside><section id="comments"><article class="comment"><p>A reader's comment, quite long, that should be gone by now.</p>
</article></section></div><form><p>Form text</p></form><footer><p>Copyright</p></footer></body></html>"""


def test_html_main_text(spark):
    want = ["My story", "First paragraph & long enough to be an article of some sort.", "Short.", "one", "two link", "And the last paragraph, a bit longer than the others here."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)
    article = "<nav><a>Home</a></nav><article><h1>T</h1><p><b>Bold<br><p>x</article><footer>f</footer>"
    assert html_text.main_text(article) == "T\n\nBold\n\nx"
    assert [html_text.main_text(x) for x in (None, "", "plain &lt; text", "<!-- open", '<p class="a>b">c', "<p>a <script>never closed")] == ["", "", "plain < text", "", "c", "a"]
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert {r["page_id"]: len(r["text"]) > 0 for r in html_text.extracted(pages).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("shape", ["<div id=x>{0}<div>{1}</div>{0}</div>", "<table><tr><td>{0}</td></tr><tr><td>{1}</td></tr></table>{0}", "{0}<section>{1}</section>{0}", "<div>{1}</div><div class=advert>Buy</div>{0}", "{1}<div class=advert>Buy</div><p>End.</p>"])
def test_html_without_article_keeps_all_but_asides(shape):
    short, long = "<p>" + "intro words " * 8 + "</p>", "<p>" + "many words " * 80 + "</p>"
    page = "<body><nav>Menu</nav>" + shape.format(short, long) + "<footer>f</footer></body>"
    want = re.findall(r"<p>(.*?)\s*</p>", page)
    assert html_text.main_text(page) == "\n\n".join(want)


def bare_page(pick):
    """A page without article, main or telling names, and the words of its text: link columns and odd lines stand around it."""
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(pick.randint(a, b)))
    links = lambda: "".join(f"<{t}><a href=x>{words(1, 3)}</a></{t}>" for t in [pick.choice(["div", "li", "td"])] for _ in range(pick.randint(3, 9)))
    blocks = [f"<h2>{words(2, 5)}</h2>"] + [f"<{t}>{words(20, 90) if t == 'p' or pick.random() < 0.5 else words(12, 20)}</{t}>" for t in [pick.choice(["p", "p", "div"]) for _ in range(pick.randint(3, 9))]] + [f"<p>{words(2, 4)}.</p>"]
    odd = lambda: f"<div>{words(1, 3)}</div>"
    page = f"<body><div>{odd()}{links()}</div><div>{''.join(blocks)}</div><div>{links()}{odd()}{odd()}</div></body>"
    return page, [re.sub("<[^>]*>", "", b) for b in blocks]


def test_html_without_article_is_bound_by_surge_and_dive(monkeypatch):
    """Menus of links and odd lines without a name go, the article's blocks stay; without the sums they don't go."""
    pick, hit, found_words, wanted_words = random.Random(9), 0, 0, 0
    pages = [bare_page(pick) for _ in range(200)]
    for page, blocks in pages:
        found, want = (collections.Counter(x.split()) for x in (html_text.main_text(page), " ".join(blocks)))
        hit, found_words, wanted_words = hit + (found & want).total(), found_words + found.total(), wanted_words + want.total()
    assert hit / found_words > 0.98 and hit / wanted_words > 0.98
    whole = [html_text.main_text(page) for page, _ in pages]
    monkeypatch.setattr(html_text, "stretches", lambda lengths, width=3: [(0, len(lengths), 1)])
    assert sum(a != html_text.main_text(page) for a, (page, _) in zip(whole, pages)) > 190


def framed_page(pick):
    """A page with an article or main of short and long blocks, with asides in it, and all sorts of unnamed text around it."""
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(pick.randint(a, b)))
    holder, title = pick.choice(["article", "main"]), words(2, 5)
    blocks = [words(*pick.choice([(1, 2), (5, 9), (40, 90)])) for _ in range(pick.randint(2, 9))] + [words(40, 90)]
    aside = lambda: pick.choice(["", "", f"<div class='{pick.choice(['ad', 'share-buttons', 'promo'])}'><p>{words(3, 9)}</p><p>{words(3, 9)}</p></div>", f"<nav>{words(2, 3)}</nav>"])
    inner = "".join(f"{aside()}<{t}>{b}</{t}>" for b in blocks for t in [pick.choice(["p", "div", "li", "h2"])])
    around = lambda: "".join(pick.choice([f"<div>{words(1, 30)}</div>", f"<nav>{words(2, 3)}</nav>", f"<p><a href=x>{words(1, 3)}</a></p>"]) for _ in range(pick.randint(0, 4)))
    head = pick.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"])
    return f"<body>{around()}<{holder}>{head}{inner}</{holder}>{around()}<footer>{words(9, 20)}</footer></body>", "\n\n".join([title, *blocks])


def test_html_article_is_bound_by_surge_and_dive(monkeypatch):
    """Exactly the article's blocks, whatever stands in and around it; the bounds come from the sums."""
    pick = random.Random(3)
    pages = [framed_page(pick) for _ in range(300)]
    assert [html_text.main_text(page) for page, _ in pages] == [want for _, want in pages]
    monkeypatch.setattr(html_text, "between_surges", lambda lines, weights: lines)
    assert sum(html_text.main_text(page) != want for page, want in pages) == 300


def test_html_banners_credits_and_responses():
    text = "words of the article " * 10
    want, banner = text.strip(), f"<div class=cookie-banner><p>{'we use cookies ' * 90}</p></div>"
    assert html_text.main_text(f"{banner}<div><p>{text}</p></div>") == want
    assert html_text.main_text(f"{banner}<article><p>{text}</p></article>") == want
    assert html_text.main_text(f"<div class=cookie-recipe><p>{text}</p></div><p>Baked.</p>").startswith(want)
    assert html_text.main_text(f"<article><p>{text}</p></article><div class=user-responses><p>{text * 5}</p></div>") == want
    assert html_text.main_text(f"<div><p>{text}</p><p>Copyright 2024. All rights reserved.</p><p>Powered by Foo</p></div>") == want
    assert html_text.main_text(f"<p>{text}</p><p>Copyright is a right.</p><p>{text}</p>") == f"{want}\n\nCopyright is a right.\n\n{want}"
    assert html_text.main_text("<p>We <label>x</label> go <span hidden>no</span>on</p>") == "We go on"


def test_html_time_grows_with_the_page():
    """Work a page is counted in interpreter calls: ten times the page makes some ten times the calls, however deep it nests."""
    for piece in ("<div class=ad>x", "<div>x", "<div class=ad><article>x</p></span>", "<p>x</div></section>", "<table><tr><td>x"):
        counts = []
        for n in (300, 3000):
            calls = [0]
            sys.setprofile(lambda *_, calls=calls: calls.__setitem__(0, calls[0] + 1))
            html_text.main_text(piece * n)
            sys.setprofile(None)
            counts.append(calls[0])
        assert counts[1] < 12 * counts[0], piece
    text = "words of the article " * 10
    assert html_text.main_text("<div>" * 700 + f"<nav>Menu</nav><p>{text}</p>" + "</div>" * 700) == text.strip()


def test_html_inline_names_forms_and_depth():
    text = "body words " * 30
    assert html_text.main_text('<p>We used <code class="search">grep</code> on it.</p>') == "We used grep on it."
    assert html_text.main_text('<p>Before <span class="alert">careful</span> after.</p>') == "Before careful after."
    assert html_text.main_text(f"<body><form id=aspnetForm><nav>Menu</nav><div><p>{text}</p></div></form></body>") == text.strip()
    assert html_text.main_text(f"<article><p>{text}</p><section class='related-work'><p>Earlier work.</p></section></article>").endswith("Earlier work.")
    for name in ("elementor-widget-container", "widget-content", "legal"):
        assert html_text.main_text(f"<body><div class={name}><p>{text}</p></div></body>") == text.strip()
    deep = html_text.main_text("<div>x" * 3000 + "</div>" * 3000 + "<p>end</p>")
    assert deep.count("x") == 3000 and deep.endswith("end")


def test_html_names_do_not_drop_the_article():
    text = "many words " * 40
    body, want = f"<h1>T</h1><p>{text}</p><p>Short.</p>", f"T\n\n{text.strip()}\n\nShort."
    for name in ("has-sidebar", "no-sidebar", "content-with-sidebar", "withSidebar", "article-body paywall", "overlay", "main-modal"):
        for inner in (body, f"<article>{body}</article>", f"<div class='related'>Other pages</div>{body}<div class='sidebar'><p>Side</p></div>"):
            assert html_text.main_text(f"<body><nav>Menu</nav><div class='{name}'>{inner}</div><div class='cookie-notice'>We use cookies</div></body>") == want, (name, inner)
    assert html_text.main_text(f"<body><article><h1>T</h1><div class='paywall'><p>{text}</p><p>Short.</p></div></article><p>{text[:99]}</p></body>") == want
    assert html_text.main_text(f"<article>{body}</article><div class=sidebar><article>A teaser</article></div>") == want
    assert html_text.main_text(f"<div>{body}</div><div id=comments><p>{text * 3}</p></div>") == want


# --- 2


def test_embedding_links_equal_brute_force(spark):
    pick = np.random.default_rng(3)
    base = pick.standard_normal((40, 16))
    vectors = np.concatenate([base, base[:20] + 0.1 * pick.standard_normal((20, 16)), base[:10], base[:5] * 3]).astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 2, "x") for i, v in enumerate(vectors)]
    odd = [(900, None, 1, "x"), (901, [], 1, "x"), (902, [0.0] * 16, 1, "x"), (903, [float("nan")] * 16, 1, "x"), (904, [None] + [1.0] * 15, 0, "x"), (905, rows[0][1], None, "x"), (906, [1.0, 2.0], 0, "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, links string")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(len(rows))[:, None] % 2 == np.arange(len(rows)) % 2)
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
    found = {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in embedding_dedup.grouped(frame).collect()}
    assert {i: found[i] for i in range(len(rows))} == {i: (int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(rows))}
    assert all(found[i][0] == 0 and found[i][1] == i for i in range(900, 907))
    assert embedding_dedup.grouped(frame.limit(0)).count() == 0


def test_collision_count_is_calibrated():
    pick, dim = np.random.default_rng(5), 64
    x = pick.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = pick.standard_normal((400, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    i, j = embedding_dedup.linked(x, y, 0.93)
    assert set(range(400)) <= set(i[i == j].tolist())


# --- 3


def test_sharding_levels_bytes_and_numbers_rows(spark, tmp_path):
    docs = with_odd_rows(spark)
    rows = sharding.assigned(docs, 5, f"{tmp_path}/map", n_slots=256).collect()
    assert len(rows) == docs.count()
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["place"])
    largest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load[s] for s in range(5)) <= largest
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert all(r["crc"] == zlib.crc32((texts[r["id"]] or "").encode()) and r["size"] == len((texts[r["id"]] or "").encode()) + 8 for r in rows if r["id"] is not None)
    assert sharding.assigned(empty(spark), 5, f"{tmp_path}/none", n_slots=64).count() == 0
    # The stored map is used again, and grown: a further shard takes rows only into itself.
    held = lambda rows: collections.Counter((r["id"], r["crc"], r["shard"]) for r in rows)
    assert held(sharding.assigned(docs, 5, f"{tmp_path}/map", n_slots=256).collect()) == held(rows)
    even = docs.where("text IS NULL OR length(text) < 5000")
    rows = sharding.assigned(even, 5, f"{tmp_path}/even", n_slots=256).collect()
    more = sharding.assigned(even, 6, f"{tmp_path}/even", n_slots=256).collect()
    before = {(r["id"], r["crc"]): r["shard"] for r in rows}
    assert len(more) == len(rows) and all(r["shard"] in (5, before[r["id"], r["crc"]]) for r in more) and any(r["shard"] == 5 for r in more)
    assert {r["version"] for r in spark.read.parquet(f"{tmp_path}/even").select("version").distinct().collect()} == {1, 2, 3}
    sharding.assigned(even, 6, f"{tmp_path}/even", n_slots=256, rebalance=True)
    assert sharding.load_map(spark, f"{tmp_path}/even").agg(F.max("version"), F.count("*")).first() == (4, 256)
    with pytest.raises(ValueError):
        sharding.assigned(even, 5, f"{tmp_path}/even", n_slots=256)


def test_slot_maps_are_edited_little(spark):
    stats = spark.createDataFrame([(s, (s * 7919) % 1000) for s in range(256)], "slot int, bytes long")
    first = sharding.first_map(spark, 6, 256)
    second = sharding.rebalanced(first, stats, 6)
    before, after = ({r["slot"]: r["shard"] for r in m.collect()} for m in (first, second))
    assert after.keys() == before.keys() and sum(before[s] != after[s] for s in before) < 64
    third = sharding.grown(second, stats, 6)
    last = {r["slot"]: r["shard"] for r in third.collect()}
    assert all(last[s] in (after[s], 6) for s in last) and {r["version"] for r in third.collect()} == {3}
    size = {s: (s * 7919) % 1000 for s in range(256)}
    held = sum(size[s] for s in last if last[s] == 6)
    assert 0.6 * sum(size.values()) / 7 <= held <= sum(size.values()) / 7


# --- 4, 6


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], "<u4") for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_holds_every_id_once(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(texts, ids_of("byte_bpe_50k.json", texts.values(), 0)))
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), open_windows=4).collect()
    got, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        got[p["id"]].append(p)
        windows[p["sequence"]].append(p)
    assert got.keys() == want.keys()
    for doc_id, parts in got.items():
        parts.sort(key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in parts) == want[doc_id].tobytes() and {p["doc_tokens"] for p in parts} == {len(want[doc_id])}
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts[:-1]]]).tolist()
    for parts in windows.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts[:-1]]]).tolist() and sum(p["length"] for p in parts) <= 1024
    assert len(windows) <= -(-sum(map(len, want.values())) // 1024) + 1
    assert packing.packed(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


ODD_TEXTS = [
    "a\tb\tc\n\n\nd", "x\u00a0y\u00a0z\n\n\nnext", "a\u2003b\n\nc", "a\x1cb  c", "a\x1c b \x1dc", " a b", "a b\n", "a b\nc d", "\n", "", " ", "  a", "\n\na", " \n a", "a \n b", "a\n b", "x  y   z  w", "x\n.y\n,z .", "a\r\nb", "a\0b c",
    "\u0130stanbul \u00c9\u00c0 x's don't it's 'tis a'b isn't.", "\ufb01n \u00bd x\u00b2 \u00aa \u00ba \u00b5 \u0178_a_b a_b. _x", "\u65e5\u672c\u8a9e \u30c6, \u043f\u0440!! \u043c", "<|endoftext|> x<|endoftext|>", "\u00c9's 1st 2nd, $$$ Stra\u00dfe! \u00df \u0149",
    "\u00e9a x\u0301 \u00e9.", "\u200b a", "x" * 70 + " " + "x" * 70 + "y", "word.### word.'s word'.s", "a \u2013 b \u2013. c", "Ab.cD.e,", "\u00c9COLE \u00c9lan \u00c0\u00c9.",
]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoders_equal_the_library(name, spaced):
    """Odd white space, symbols beside letters, contractions, other scripts, special strings: together and one by one."""
    encode = tokens.WordEncoder(public_tokenizers.path(name), spaced)
    want = [ids[:-1].tobytes() for ids in ids_of(name, ODD_TEXTS, 0)]
    raw = [t.encode() for t in ODD_TEXTS]
    assert encode(raw) == want and [encode([t])[0] for t in raw] == want and encode([]) == []


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoders_equal_the_library_on_random_texts(name, spaced):
    """20,000 texts with white space of all kinds at their ends and within, alone and in batches."""
    pick, edges = random.Random(5), ["", "", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\r\n", "  "]
    bits = [*edges, "a", "Word", "two", "\u00e9", "\u00dcnder", "x1", "12", "...", "'s", "don't", "\u0130st", "\u6f22\u5b57", "\U0001f600", "_", "-", "<|x", "\ufb01"]
    text = lambda: pick.choice(edges) + "".join(pick.choice(bits) + pick.choice(["", " ", " ", "\n"]) for _ in range(pick.randint(0, 12))) + pick.choice(edges)
    texts, encode = [text() for _ in range(20_000)], tokens.WordEncoder(public_tokenizers.path(name), spaced)
    want = [ids[:-1].tobytes() for ids in ids_of(name, texts, 0)]
    for size, part in ((1, texts[:2000]), (50, texts[2000:])):
        found = [x for at in range(0, len(part), size) for x in encode([t.encode() for t in part[at : at + size]])]
        assert found == (want[:2000] if size == 1 else want[2000:])


def test_encoders_forget_old_words_and_are_right(monkeypatch):
    monkeypatch.setattr(tokens, "HALF_WORDS", 20)
    pick, encode = random.Random(6), tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{pick.randint(0, 40)} {'often' * (i % 2)} n{i}" for _ in range(10)) for i in range(60)]
    want = [ids[:-1].tobytes() for ids in ids_of("byte_bpe_50k.json", texts, 0)]
    for text, ids in zip(texts, want):
        assert encode([text.encode()]) == [ids]
        assert len(encode.known) + len(encode.older) <= 80  # two halves and two texts' words


def test_workers_keep_no_words_after_packing(spark):
    """What a worker holds after its task is missing to the stages that follow."""

    def held(batches):
        import pyarrow as pa

        from tonewright.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.known) for e in tokens._ENCODERS.values())], pa.int64())], names=["n"])

    packing.packed(documents(spark), public_tokenizers.path("byte_bpe_50k.json")).count()
    assert {r["n"] for r in spark.range(64).repartition(16).mapInArrow(held, "n long").collect()} == {0}


def test_packing_texts_that_begin_with_white_space(spark):
    texts = ["\tIndented first line of a document.", "\r\nWindows text here", "\x0cPage two", "\x0b\x0bdown", " \t", "plain text"]
    rows = packing.packed(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["id"] // 3: r["ids"] for r in rows} == {i: ids.tobytes() for i, ids in enumerate(ids_of("byte_bpe_50k.json", texts, 0))}


def test_bounded_windows_emit_the_fullest():
    windows = packing.OpenWindows(0, 10, 2)
    assert [windows.place(n) for n in (6, 7, 3, 5)] == [(0, 0, None), (1, 0, None), (1, 7, None), (2, 0, None)]
    assert windows.place(9) == (3, 0, 0) and len(windows.rooms) == 2


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    texts = dict(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    want, start = {}, 0
    for doc_id, ids in zip(texts, ids_of("word_bpe_49k.json", texts.values(), 2)):
        want[doc_id] = (start, len(ids), ids.tobytes())
        start += len(ids)
    token_files.write_shards(docs, f"{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), 2, shard_tokens=500)
    assert {r["id"]: (r["start"], r["n_tokens"], r["ids"]) for r in token_files.read_documents(spark, f"{tmp_path}/t").collect()} == want
    shards = spark.read.parquet(f"{tmp_path}/t")
    assert sum(r["n"] for r in token_files.occurrences(shards, 2, most=3).collect()) == len(want)
    asked = shards.select("part", "seq", F.lit(0).cast("long").alias("place"))
    firsts = {(r["part"], r["seq"]): WaveletMatrix(r["file"]).tokens()[0] for r in shards.collect()}
    assert {(r["part"], r["seq"]): r["token"] for r in token_files.token_at(shards, asked).collect()} == firsts
    token_files.write_shards(with_odd_rows(spark), f"{tmp_path}/odd", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.read_documents(spark, f"{tmp_path}/odd").count() == len(want) + 2
    token_files.write_shards(empty(spark), f"{tmp_path}/none", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.read_documents(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    tokens = np.random.default_rng(n).integers(0, 50_000 if n % 2 else 7, n)
    matrix = WaveletMatrix(build(tokens))
    assert matrix.n_planes == max(1, int(tokens.max(initial=0)).bit_length()) and matrix.count(1 << 40) == 0
    assert (matrix.tokens() == tokens).all() and len(matrix) == n
    for i in range(0, n, 97):
        token = int(tokens[i])
        assert matrix.access(i) == token
        assert matrix.count(token) == (tokens == token).sum() and matrix.count(token, 5, i) == (tokens[5:i] == token).sum()
        assert [matrix.select(token, k) for k in range(min(4, matrix.count(token)))] == np.flatnonzero(tokens == token)[:4].tolist()


def test_wavelet_planes_come_from_the_ids():
    tokens = np.array([70_000, 3, (1 << 32) - 1, 70_000])
    matrix = WaveletMatrix(build(tokens))
    assert matrix.tokens().tolist() == tokens.tolist() and matrix.count(70_000) == 2 and matrix.select(70_000, 1) == 3
    for bad in ([-1], [1 << 32]):
        with pytest.raises(ValueError):
            build(np.array(bad))


# --- 5


def test_base_counts_and_bands(spark):
    for text in some_texts():
        words = WORD.findall(text or "")
        grams = list(zip(words, words[1:], words[2:]))
        times, cover, seen, doubled = collections.Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            cover |= {i, i + 1, i + 2} if times[g] > 1 else set()
        for line in (text or "").split("\n"):
            if WORD.search(line):
                doubled += line in seen
                seen.add(line)
        assert quality.base_counts(text or "") == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(cover))
    assert quality.base_counts("a b c a b c")[4] == 6 and quality.base_counts("x\nx\n \nx")[3] == 2
    pick = random.Random(2)
    plain = [" ".join(pick.choice(["the", "house", "of", "water", "and", "people", "made", "some", "light"]) + pick.choice("abcdefgh") for _ in range(100)) for _ in range(150)]
    odd = [" ".join(f"{pick.choice('qxzjk')}%%{pick.randint(0, 99)}$$$" for _ in range(100)) for _ in range(5)]
    rows = quality.judged(documents(spark, plain + odd + ["", None]), VOCABULARIES).collect()
    fate = {r["id"] // 3: r["kept"] for r in rows}
    assert sum(fate[i] for i in range(150)) >= 148 and not any(fate[i] for i in range(150, 157))
    assert quality.judged(empty(spark), VOCABULARIES).count() == 0


def test_measures_do_not_hang_on_neighbours():
    """Each word's tokens are those that it has alone, whatever is encoded with it: word marks, spaces of other kinds, control characters."""
    pick = random.Random(6)
    odd = ["\u2581", "ab\u2581cd", "\u2581\u2581x", "a\u00a0b", "\u2003", "x\u0085y", "\ufdfa", "\u0149a", "\u00a8", "\x00", "\x1c", "<s>", "</s>", "<unk>", "<0x41>", "\u6f22\u5b57", "\U0001f600", "it's", "\u00c9t\u00e9", "\ufb01n", "1.", "--", "\u00ad", "\u200b"]
    words = odd + ["".join(pick.choice("abcXYZ09.'\u00e9\u2581\u00df") for _ in range(pick.randint(1, 8))) for _ in range(500)]
    words = [w for w in dict.fromkeys(words) if WORD.fullmatch(w)]
    alone = quality.Fertility(*VOCABULARIES)
    for w in words:
        alone.learn([w.encode()])
    for _ in range(30):
        pick.shuffle(words)
        together = quality.Fertility(*VOCABULARIES)
        for at in range(0, len(words), 50):
            together.learn([w.encode() for w in words[at : at + 50]])
        assert together.known == alone.known
    assert all(alone.known[w.encode()][:-4] == np.array(alone.model.encode(w), np.int32).tobytes() for w in words)


@pytest.mark.parametrize("n", [1, 3, 30, 99, 100])
def test_languages_with_few_texts_have_their_own_band(spark, n):
    """A rare script is far from the band of all texts, and keeps its texts however few they are."""
    pick = random.Random(8)
    plain = [" ".join(pick.choice(["the", "house", "of", "water", "and", "people"]) + pick.choice("abcdefgh") for _ in range(100)) for _ in range(300)]
    rare = [" ".join("".join(chr(0x1200 + pick.randrange(300)) for _ in range(pick.randint(2, 6))) for _ in range(100)) for _ in range(n)]
    rows = [(i, t, "en" if i < len(plain) else "am") for i, t in enumerate(plain + rare)]
    judged = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARIES)
    assert judged.where("`group` = 'am' AND kept").count() == n and judged.where("`group` = 'en' AND kept").count() >= 298


# --- 7


def brute_components(ids, sets, least):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    docs = documents(spark)
    sets = {}
    for r in docs.collect():
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r["text"] or "")]
        sets[r["doc_id"]] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} - {()}
    want = brute_components(sorted(sets), sets, 80)
    found = {r["id"]: (r["n_shingles"], r["component"], r["kept"]) for r in minhash_dedup.grouped(docs, k=k).collect()}
    assert found == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_odd_tables(spark):
    rows = minhash_dedup.grouped(with_odd_rows(spark)).collect()
    assert len(rows) == documents(spark).count() + 2 and [r["component"] for r in rows if r["id"] is None] == [None]
    two = spark.createDataFrame([(0, "quite another text than the first", None, None, 1, 1, "x")] * 2, SCHEMA)
    left = minhash_dedup.deduplicated(with_odd_rows(spark).unionByName(two).withColumn("stays", F.lit(1)).withColumn("row", F.lit(2)))
    assert left.columns == [*documents(spark).columns, "stays", "row"] and left.where("doc_id = 0").count() == 2
    assert [r["n"] for r in left.where("doc_id > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").collect()] == []
    assert minhash_dedup.grouped(empty(spark)).count() == 0


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 2)
    test_near_duplicates_equal_brute_force(spark, 2)


def test_dissimilar_heads_hide_no_pair(spark, monkeypatch):
    """Documents drawn from common passages share buckets by chance, so a bucket's first one is rarely a near copy."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 4)
    pick = np.random.default_rng(11)
    n, words = 2000, 1200
    drawn = pick.random((n, words)) < 0.5
    twins = pick.random((12, words)) < 0.5
    others = twins ^ (pick.random((12, words)) < 0.08)
    drawn = np.concatenate([drawn, twins, others])
    both = drawn.astype(np.int64) @ drawn.T.astype(np.int64)
    size = drawn.sum(1)
    i, j = np.nonzero(np.triu(100 * both >= 80 * (size[:, None] + size - both), 1))
    assert len(i) >= 10 and (j - i == 12).all()
    rows = [(k, " ".join(f"w{w}" for w in np.flatnonzero(d))) for k, d in enumerate(drawn)]
    found = {r["id"]: r["component"] for r in minhash_dedup.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=1).collect()}
    assert found == {k: k for k in range(len(drawn))} | dict(zip(j.tolist(), i.tolist()))


def test_sketches_estimate_similarity():
    pick = random.Random(4)
    words = [str(i) for i in range(4000)]
    pick.shuffle(words)
    a, b = (hyperminhash.shingle_set(" ".join(w), 1) for w in (words[:3000], words[300:3300]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(float(hyperminhash.estimate(hyperminhash.sketch(a), hyperminhash.sketch(b))) - true) < 0.12
    registers = hyperminhash.compressed(np.array([0, 1, (1 << 63), (1 << 63) + 1, (1 << 64) - 1], np.uint64))
    assert registers.dtype == np.uint16 and registers[2] == registers[3] == 0 and registers[4] == 1023 and (registers[:2] >> 10 == 63).all()


@pytest.mark.parametrize("local", [0, 30, 1 << 18])
def test_components(spark, monkeypatch, local):
    """By rounds alone, by a few and one task, and by one task alone."""
    from tonewright.llm import components as module

    monkeypatch.setattr(module, "LOCAL_EDGES", local)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 1 for i in [*range(1, 41), 100]} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8


def test_toxicity_on_held_out_rows(spark):
    pick = random.Random(6)
    words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts, toxic = [], []
    for i in range(600):
        toxic.append(int(i % 5 == 0))
        body = [pick.choice(words) for _ in range(60)]
        if toxic[-1]:
            body[7] = pick.choice(["vilkrat", "vilkrok", "Vilkrum"])
        texts.append(" ".join(body))
    docs = documents(spark, [*texts, "", None])
    labels = spark.createDataFrame([(i * 3, t) for i, t in enumerate(toxic)] + [(99999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    weights, bias = toxicity.model(docs, labels)
    rows = {r["doc_id"] // 3: r["_t"] for r in toxicity.scored(docs, weights, bias, score_col="_t").collect()}
    outside = [i for i in range(600) if zlib.crc32(str(i * 3).encode()) % 5 == 0]
    assert sum((rows[i] >= 0.5) == bool(toxic[i]) for i in outside) >= 0.98 * len(outside)
    assert rows[600] == rows[601] < 0.5 and all(0 <= s <= 1 for s in rows.values())
    weights, bias = toxicity.model(docs, labels.limit(0))
    assert toxicity.scored(docs, weights, bias).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.scored(empty(spark), weights, bias).count() == 0


# --- 9


def test_mixing_comes_near_targets(spark):
    docs = with_odd_rows(spark)
    rows = mixing.planned(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.planned(docs.repartition(7)).collect())) and len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 3
    total = sum(r["size"] for r in rows)
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    sizes, targets, open_ = {s: sum(r["size"] for r in x) for s, x in by.items()}, {}, set(by)
    while True:
        left, share = total - sum(targets.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / share > 3 * sizes[s]}
        if not over:
            break
        targets |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    targets |= {s: left * weights[s] / share for s in open_}
    for s, x in by.items():
        assert {r["source_size"] for r in x} == {sizes[s]} and abs(x[0]["target"] - targets[s]) < 1e-6 * total
        assert abs(sum(r["copies"] * r["size"] for r in x) - targets[s]) <= 1.5 * max(r["size"] for r in x)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixing.mixed(empty(spark)).count() == 0 and mixing.planned(empty(spark)).count() == 0


# --- 10


def brute_passages(rows, window):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc_id] = (len(words), [w for w, g in zip(words, gone) if not g])
    return out


def test_repeated_passages_equal_brute_force(spark):
    texts = some_texts() + ["p q r s t u v w x y z " * 12, "alpha beta " * 3 + " ".join(some_texts()[10].split()[5:70]) + " omega"]
    docs = documents(spark, texts)
    want = brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()], 20)
    rows = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrase_dedup.summary(docs).collect()}
    assert rows == {i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, kept) in want.items()}
    cleaned = phrase_dedup.cleaned(docs)
    assert cleaned.columns == docs.columns
    assert {r["doc_id"]: WORD.findall(r["text"] or "") for r in cleaned.collect()} == {i: kept for i, (_, kept) in want.items()}
    untouched = {r["doc_id"]: r["text"] for r in docs.collect() if want[r["doc_id"]][0] == len(want[r["doc_id"]][1])}
    assert {r["doc_id"]: r["text"] for r in cleaned.collect() if r["doc_id"] in untouched} == untouched


def test_repeated_passages_of_odd_tables(spark):
    long_ = some_texts()[-3]
    odd = with_odd_rows(spark).unionByName(spark.createDataFrame([(None, long_, None, None, 1, 1, "x"), (None, long_, None, None, 1, 1, "x"), (6, long_, None, None, 1, 1, "x")], SCHEMA))
    rows = phrase_dedup.summary(odd).collect()
    assert len(rows) == odd.count() and sum(r["n_removed"] == r["n_words"] for r in rows if r["n_words"] == len(long_.split())) == 3
    assert phrase_dedup.cleaned(odd).count() == odd.count()
    assert phrase_dedup.summary(empty(spark)).count() == 0 and phrase_dedup.cleaned(empty(spark)).count() == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    text = ("ab cd " * 50 + "é xyz").encode()
    whole = hashed_words(text)
    assert whole[0] == whole[2] == hashed_words(b" ab\n")[0] and len(set(whole.tolist())) == 4
    monkeypatch.setattr("tonewright.llm.words.PIECE", 16)
    assert (hashed_words(text) == whole).all()
    assert window_hashes(whole, 3)[0] == window_hashes(whole[2:], 3)[0]


# --- 11


def brute_trie(rows, every=5, reach=9):
    """Nodes as (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own = collections.defaultdict(list)
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % reach
        turns = tuple(own.get(c - c % every, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return collections.Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def conversations(seed):
    """Few different turns, so that prefixes meet; one long conversation, copies of one, null and missing values."""
    pick = random.Random(seed)
    rows = [(c, t, pick.choice(["user", "assistant", None]), pick.choice(["a", "bb", "\u00e9", None, ""])) for c in range(120) if c % 11 for t in range(pick.randint(1, 7))]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(4)]
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(400)] + [(305, None, "user", "first"), (305, -1, None, "second"), (None, 1, "user", "lost"), (306, 5, "user", "only")]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    """With bounds as they are and with tiny ones: many shards, bands, blocks, pieces and spilled messages."""
    if small:
        for name, n in (("SHARD_NODES", 20), ("TOP_NODES", 7), ("BLOCK", 3), ("PIECE", 2), ("QUEUED", 4)):
            monkeypatch.setattr(prefix_trie, name, n)
        rows = conversations(1)
        rows = [r for r in rows if r[0] != 300 or r[1] < 60]
    else:
        rows = conversations(2)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, depth string").repartition(3)
    with storage.scratch(spark, "test") as keep:
        found = prefix_trie.trie(*prefix_trie.grafted(keep(prefix_trie.numbered(frame, keep), "numbered"), keep)).collect()
    assert collections.Counter(map(tuple, found)) == brute_trie(rows)


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_spilling_queue(most):
    pick, queue, plain = random.Random(most), prefix_trie.SpillingQueue(most), []
    for _ in range(3000):
        if plain and pick.random() < 0.4:
            assert queue.least() == min(plain) and queue.pop() == min(plain)
            plain.remove(min(plain))
        else:
            item = (pick.randint(0, 50), pick.randint(0, 3))
            queue.push(item)
            plain.append(item)
    assert [queue.pop() for _ in plain] == sorted(plain) and queue.least() is None and (queue.n_runs > 0) == (most < 1000)


# --- 12


def alike(a, b):
    """Generalised Jaccard similarity of two texts' words."""
    x, y = (collections.Counter(WORD.findall(t)) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


@pytest.mark.parametrize("part_rows", [4, 512])
def test_fingerprints_of_documents_in_order(spark, monkeypatch, part_rows):
    """Order, edited texts and likeness against a plain version: null ids last, repeated ids by text, equal rows apart."""
    monkeypatch.setattr(weighted_sampling, "PART_ROWS", part_rows)
    rows = sorted([((i * 37) % 101, t or "") for i, t in enumerate(some_texts())] + [(5, "b again"), (5, "a again"), (7, "same"), (7, "same")]) + [(None, ""), (None, "no id"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = weighted_sampling.fingerprints(frame).collect()
    want, pairs = collections.Counter(), collections.defaultdict(list)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[i, len(text), sha] += 1
        pairs[i, sha].append((alike(text, edited), alike(text, after)))
    assert collections.Counter((r["id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    errors = []
    for r in found:
        near = [sum(x == y for x, y in zip(r["samples"], r[c])) / weighted_sampling.N_SAMPLES for c in ("edited_samples", "next_samples")]
        true = pairs[r["id"], r["edited_sha256"]].pop()
        assert len(r["samples"]) == weighted_sampling.N_SAMPLES and all(x in (0.0, 1.0) or abs(x - y) < 0.4 for x, y in zip(near, true))
        assert all(y not in (0.0, 1.0) or x == y for x, y in zip(near, true))
        errors += [x - y for x, y in zip(near, true)]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09
    assert weighted_sampling.fingerprints(empty(spark)).count() == 0


@pytest.mark.parametrize("weights", [({"a": 3, "b": 1}, {"a": 1, "b": 5}), ({"a": 50}, {"a": 20, "b": 3}), ({chr(97 + i): 1 + i for i in range(20)}, {chr(100 + i): 20 - i for i in range(20)})])
def test_samples_agree_as_often_as_weights_are_alike(spark, weights):
    """One pair of texts in 80 wordings, 2,560 samples: the share that agrees is the generalised Jaccard similarity."""
    texts = lambda i: [" ".join(f"{w}{i} " * n for w, n in x.items()) for x in weights]
    rows = spark.createDataFrame([(i % 4, i, *texts(i)) for i in range(80)], "part int, nth int, text string, other string")
    found = weighted_sampling.sampled(rows, "text", "other", [F.col("nth")]).select(weighted_sampling.likeness(F.col("samples"), F.col("beside")).alias("x")).collect()
    true = alike(*texts(0))
    assert len(found) == 80 and abs(np.mean([r["x"] for r in found]) - true) < 4 * (true * (1 - true) / 2560) ** 0.5


def test_gamma_cells_have_the_distribution():
    x = np.array(weighted_sampling.gamma_quantiles())
    at = np.arange(len(x))
    p = 2.0 ** -(at // weighted_sampling.CELLS) * (0.5 + (at % weighted_sampling.CELLS + 0.5) / (2 * weighted_sampling.CELLS))
    assert np.allclose(-np.expm1(-x) - x * np.exp(-x), p, rtol=1e-6) and (x > 0).all()


def test_fingerprints_stay_with_dataframe_functions(spark):
    made = weighted_sampling.fingerprints(documents(spark))
    plan = made._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow")) and plan.split("Initial Plan")[-1].count("hashpartitioning(part") <= 2


# --- 13


def brute_runs(words, least, times):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(least, times * q) and not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                found.append((start, len(stretch), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n):
    """Stretches of few words repeated up to eight times, with random words between; nested periods and ties among them."""
    pick = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(pick.randint(0, 5)):
            base = [f"w{pick.randint(0, pick.choice([1, 2, 5]))}" for _ in range(pick.randint(1, 9))]
            words += base * pick.randint(1, 8) + base[: pick.randint(0, len(base))] + [f"w{pick.randint(0, 3)}" for _ in range(pick.choice([0, 1, 2, 3, 7, 20]))]
        yield words
    yield from (["w0"] * 500, ["w0", "w1"] * 300, ["w0"] * 5 + ["w1"], (["w0"] * 5 + ["w1"]) * 50)


@pytest.mark.parametrize("least, times", [(6, 4), (5, 3), (9, 2)])
def test_periodic_runs_equal_brute_force(least, times):
    texts = list(periodic_texts(least, 800))
    numbers = [np.array([int(w[1:]) for w in t], np.int64) for t in texts]
    found = [r for at in range(0, len(texts), 100) for r in periodic_runs.runs(numbers[at : at + 100], least, times)]
    assert found == [brute_runs(t, least, times) for t in texts] and sum(map(len, found)) > 500


def test_classes_of_lags_have_grams_no_shorter_than_their_lags():
    for least, times in ((6, 4), (20, 2), (2, 3)):
        dealt = list(periodic_runs.classes(10_000, least, times))
        assert [lo for lo, _, _ in dealt] == [1, *[hi + 1 for _, hi, _ in dealt[:-1]]] and times * (dealt[-1][1] + 1) > 10_000
        assert all(hi <= k == min(periodic_runs.overlap(q, least, times) for q in range(lo, hi + 1)) for lo, hi, k in dealt)


def test_collapsed_runs(spark):
    texts = [" ".join(t) for t in periodic_texts(3, 60)] + some_texts(n=5)
    rows = {r["id"]: r for r in periodic_runs.collapsed_runs(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        want = brute_runs(words, 6, 4)
        gone = {x for start, length, period in want for x in range(start + period, start + length)}
        found = rows[i * 3]
        assert (found["n_words"], [tuple(r) for r in found["runs"]], found["collapsed"]) == (len(words), want, " ".join(w for x, w in enumerate(words) if x not in gone))
    assert periodic_runs.collapsed_runs(with_odd_rows(spark)).where("id IS NULL").first()["collapsed"] == "lost words here"
    assert periodic_runs.collapsed_runs(empty(spark)).count() == 0


def test_periods_are_planted_as_agreed(spark):
    from tonewright.llm import queries

    texts = [" ".join(f"w{j}" for j in range(i % 70)) for i in range(400)] + [None, "", " \n"]
    rows = [(i, t) for i, t in enumerate(texts)]
    changed = 0
    for i, text in queries.with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words, h = WORD.findall(texts[i] or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            first = h // 10 % len(words)
            period = 1 + (len(words) - first) // (3 + h // 10 % 8)
            words = [w if k < first else words[first + (k - first) % period] for k, w in enumerate(words)]
            changed += 1
        assert WORD.findall(text or "") == words
    assert changed > 20
