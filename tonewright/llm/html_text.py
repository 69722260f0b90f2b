"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines (one a block element), and each line gets a weight. Weights are summed over a sliding window of
lines; a stretch runs from where the sum leaves zero to where it falls back to it, and surges where the sum passes a
threshold. The result is the text between the surge and dive points, in page order. What elements, names and roles say only
makes weights:

* Menus, headers, footers, sidebars, notices, adverts, forms, comments and the like weigh nothing and stand between blank lines; an
  element that only a word of its class or id says this of doesn't, where the article or most of the unlinked text lies in it.
* Where articles or mains are, the stretch with the most unlinked text shows which one holds the article. Each line in
  it, short or linked, is heavy enough to surge alone, and lines outside of it weigh nothing (but for a title before it).
* On other pages lines weigh their unlinked text, asides are left out before sums are made, and credits weigh nothing; text-like lines (headings,
  paragraphs, list items, longer lines) right before a surge and after a dive are kept. A page without any surge is kept as a whole.

Time and memory grow with the page, however deep its elements are.

Edge cases: a null or empty page has an empty text; unclosed tags, comments and quotes end where a browser would end
them or with the page; without any markup the whole text is one block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Lines whose lengths are summed, and the sum at which a stretch counts as text.
WINDOW_LINES = 3
SURGE_CHARS = 80
#: Unlinked text that makes a line text-like whatever its element.
LONG_LINE = 40

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a block start closes, or another of their own kind.
_SHORT = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
_ASIDE = frozenset("nav header footer aside button fieldset dialog menu head legend label input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that say what an element is for.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner sidebar sidebars side aside rail menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs crumbs "
    "header masthead topbar footer bottombar colophon comment comments commentlist reply replies disqus discussion respond responses cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login register share sharing social related recommended recommendations widget widgets toolbar search pagination pager copyright legal disclaimer tags tagcloud skip hidden form paywall".split()
)
#: With one of these beside it, a header or a rail belongs to the article.
_OWN = frozenset("article post entry story content main body text".split())
_SOFT = frozenset("header side banner tags notice alert search legal form".split())
#: Readers' words, however many there are.
_TALK = frozenset("comment comments commentlist reply replies disqus discussion respond responses".split())
#: Notices that may be longer than the article.
_BANNER = frozenset("cookie cookies consent gdpr".split())
#: What follows one of these tells what the page is like, not what the element is for.
_LIKE = frozenset("has have with without no".split())
#: Before one of these, `related` speaks of what the article treats.
_TREATED = frozenset("work works research literature studies".split())
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt figcaption caption td summary".split())
#: A short line of this kind has no weight: it is kept where text surges around it.
_CREDITS = re.compile(r"(?i)\A\s*(?:©|\(c\)|copyright\b|powered by\b)|\ball rights reserved\b")
CREDITS_CHARS = 200


class _Open:
    """An element: `aside` is what it alone says, the rest holds for it and all around it."""

    __slots__ = ("name", "aside", "number", "parent", "sure", "named", "talk", "within")

    def __init__(self, name: str, aside: str, number: int, parent: _Open | None):
        self.name, self.aside, self.number, self.parent = name, aside, number, parent
        self.sure = bool(parent and parent.sure)
        self.named = bool(parent and parent.named) or aside in _NAMED
        self.talk = bool(parent and parent.talk) or aside == "talk"
        #: The innermost article or main around it; one that is named an aside itself doesn't count.
        self.within = self if name in ("article", "main") and not aside else parent and parent.within


_NAMED = frozenset(["talk", "named", "banner"])

#: Text ('' in a gap), its length without link texts, innermost element, name of the line's element.
Line = tuple[str, int, _Open, str]


def _aside(name: str, attributes: str, in_article: bool) -> str:
    """Whether an element holds something beside the article: 'sure', or by a class or id 'talk', 'banner' or 'named', or ''."""
    if name in _ASIDE and not (name == "header" and in_article):
        return "sure"
    named = "named" if name == "form" else ""
    if not attributes or attributes.isspace():
        return named
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if name in ("html", "body", "article", "main") and key == "class" and not re.search(r"\bcomment", value):
                continue
            for one in value.split():
                ordered = [w.lower() for w in _WORDS.findall(one)]
                words = {w for before, w, after in zip(["", *ordered], ordered, [*ordered[1:], ""]) if before not in _LIKE and not (w == "related" and after in _TREATED)}
                if hit := words & _NAMES:
                    if not (words & _OWN and hit <= _SOFT):
                        named = "talk" if hit & _TALK or named == "talk" else "banner" if hit & _BANNER or named == "banner" else "named"
        elif key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "sure"
    return named


def _spared(lines: list[Line], elements: list[_Open]) -> set[int]:
    """Named asides that hold the article after all: a main, the only articles, or more than half of the unlinked text.

    Half of the text doesn't speak for an aside where an article stands outside of all asides, but for asides in an article; nor
    for a banner beside a longer line. One pass over lines, one over elements.
    """
    n = len(elements)
    held, lit, article, main = [0] * n, [False] * n, [False] * n, [False] * n
    total, outside, plain = 0, False, False
    for text, length, one, _ in lines:
        if text and not one.talk and not one.sure:
            total += length
            held[one.number] += length
            lit[one.number] = True
            outside |= one.within is not None and not one.named
            plain |= length >= LONG_LINE and not one.named
    for one in reversed(elements[1:]):  # those inside an element come after it
        i, up = one.number, one.parent.number
        held[up] += held[i]
        lit[up] |= lit[i]
        holds = article[i] or lit[i] and one.within is one
        article[up] |= holds
        main[up] |= main[i] or holds and one.name == "main"
    spared = set()
    for one in elements:
        if one.aside in _NAMED and not one.talk:
            most = 2 * held[one.number] > total and (one.parent.within is not None or not outside) and not (one.aside == "banner" and plain)
            if main[one.number] or article[one.number] and not outside or most:
                spared.add(one.number)
    return spared


def _beside(lines: list[Line], elements: list[_Open]) -> list[bool]:
    """For each element whether it stands beside the article."""
    spared, beside = _spared(lines, elements), [False] * len(elements)
    for one in elements[1:]:
        beside[one.number] = beside[one.parent.number] or one.sure or one.aside in _NAMED and one.number not in spared
    return beside


def page_lines(page: str) -> tuple[list[Line], list[_Open]]:
    """Lines in page order, with gaps around what may stand beside the article, and elements in the order of their begin."""
    root = _Open("", "", 0, None)
    lines: list[Line] = []
    elements, open_ = [root], [root]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    state = {"links": 0, "kind": ""}
    hidden = link_depth = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, max(0, len(text) - state["links"]), open_[-1], state["kind"]))
        parts.clear()
        state["links"] = 0

    def gap(one: _Open) -> None:
        lines.extend([("", 0, one, "")] * WINDOW_LINES)

    def close(upto: int) -> None:
        nonlocal hidden
        while len(open_) > upto:
            one = open_[-1]
            inline = one.aside == "hidden"
            if one.aside and not inline:
                flush()
            open_.pop()
            opened[one.name] -= 1
            hidden -= inline
            if one.aside and not inline:
                gap(one)

    def take(text: str) -> None:
        if text and not hidden:
            parts.append(text)
            if link_depth:
                state["links"] += len(" ".join(text.split()))

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in _RAW:
            if not ends and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name == "br":
            take(" ")
            continue
        block = name in _BLOCK
        if ends:
            if block:
                flush()
            if name == "a":
                link_depth = max(0, link_depth - 1)
            if opened[name]:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].name == name:
                        close(i)
                        break
                    if not block and open_[i].name in _BLOCK:
                        break
            if block:
                state["kind"] = ""
            continue
        if block:
            flush()
            while name in _SHORT.get(open_[-1].name, ()):
                close(len(open_) - 1)
            state["kind"] = name
        if name == "a":
            link_depth += 1
        elif block:
            link_depth = 0
        if name in _VOID:
            continue
        top = open_[-1]
        # A class or id of an inline element doesn't take its words out of their line.
        aside = "" if top.sure else _aside(name, attributes, top.within is not None)
        if block or aside == "sure":
            if not block:
                aside = "hidden"  # left out of its line
                hidden += 1
            one = _Open(name, aside, len(elements), top)
            one.sure |= aside == "sure"
            if aside and block:
                gap(one)
            elements.append(one)
            open_.append(one)
            opened[name] += 1
    flush()
    return lines, elements


def stretches(lengths: list[int], width: int = WINDOW_LINES) -> list[tuple[int, int, int]]:
    """(first line, past the last line, greatest window sum) between the points where the window sums leave and reach zero."""
    found, first, peak, now = [], None, 0, 0
    n = len(lengths)
    for i in range(n):
        now += lengths[i] - (lengths[i - width] if i >= width else 0)  # the sum of the window that ends with line i
        if now and first is None:
            first, peak = i, 0
        if first is not None:
            peak = max(peak, now)
            if not now:
                found.append((first, i - width + 1, peak))
                first = None
    if first is not None:
        found.append((first, n, peak))
    return found


def between_surges(lines: list[Line], weights: list[int]) -> list[Line]:
    """Lines from a stretch's surge to its dive, for each stretch that surges.

    The surge is the first line of SURGE_CHARS in the stretch's first window with as much, or else the heaviest in that window;
    the dive mirrors it in the last one. Text-like lines right before and after belong to the text.
    """
    kept = []

    def text_like(i: int) -> bool:
        return weights[i] >= LONG_LINE or weights[i] > 0 and lines[i][3] in _TEXTUAL

    for first, last, peak in stretches(weights):
        if peak < SURGE_CHARS:
            continue
        sums = [sum(weights[max(first, i - WINDOW_LINES + 1) : i + 1]) for i in range(first, last)]
        high = [first + i for i, n in enumerate(sums) if n >= SURGE_CHARS]
        window = lambda end: range(max(first, end - WINDOW_LINES + 1), end + 1)
        surge, dive = (([i for i in w if weights[i] >= SURGE_CHARS] or [max(w, key=weights.__getitem__)])[at] for w, at in ((window(high[0]), 0), (window(high[-1]), -1)))
        while surge > first and text_like(surge - 1):
            surge -= 1
        while dive + 1 < last and text_like(dive + 1):
            dive += 1
        kept += lines[surge : dive + 1]
    return kept


def _holder(lines: list[Line], beside: list[bool], elements: list[_Open]) -> int | None:
    """The article, or else the main, with most of the stretch with the most text."""
    # A line of links alone still counts as one character: what stands between asides decides, not links in the article.
    runs = stretches([max(1, x[1]) if x[0] and not beside[x[2].number] else 0 for x in lines])
    first, last, _ = max(runs, key=lambda r: (r[2] >= SURGE_CHARS, sum(x[1] for x in lines[r[0] : r[1]] if not beside[x[2].number])))
    sizes = [0] * len(elements)
    for text, length, one, _ in lines[first:last]:
        if text and not beside[one.number]:
            sizes[one.number] += length + 1
    for one in reversed(elements[1:]):
        sizes[one.parent.number] += sizes[one.number]
    for kind in ("article", "main"):
        if found := [one.number for one in elements if one.name == kind and sizes[one.number]]:
            return max(found, key=sizes.__getitem__)
    return None


def main_text(page: str | None) -> str:
    """The article of a page; blocks are separated by an empty line."""
    if not page:
        return ""
    lines, elements = page_lines(page)
    beside = _beside(lines, elements)
    lines = [x for x in lines if x[0] or beside[x[2].number]]  # nothing parts a spared aside from what stands around it
    texts = [x for x in lines if x[0] and not beside[x[2].number]]
    if not texts:
        return ""
    holder = _holder(lines, beside, elements)
    if holder is None:
        weights = [0 if x[1] < CREDITS_CHARS and _CREDITS.search(x[0]) else x[1] for x in texts]
        kept = between_surges(texts, weights) or texts
    else:
        inside = [False] * len(elements)
        inside[holder] = True
        for one in elements[holder + 1 :]:
            inside[one.number] = inside[one.parent.number]
        first = next(i for i, x in enumerate(lines) if x[0] and inside[x[2].number] and not beside[x[2].number])
        titled = any(x[3] == "h1" and inside[x[2].number] for x in texts)
        ours = [inside[x[2].number] or not titled and i < first and x[3] == "h1" and x[2].within is not None for i, x in enumerate(lines)]
        # Each of the article's lines is heavy enough to surge alone, none beside it has any weight.
        kept = between_surges(lines, [SURGE_CHARS + x[1] if x[0] and o and not beside[x[2].number] else 0 for x, o in zip(lines, ours)])
    return "\n\n".join(x[0] for x in kept if x[0])


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The pages' columns but the html, and the main text. A column named as text_col is replaced."""
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    page = next(name for name in (f"page{i}" for i in range(len(others) + 1)) if name not in {c.lower() for c in others})
    kept = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`").cast("string").alias(page))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, page):
                texts = pa.array([main_text(x) for x in part.column(page).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*part.schema.names[:-1], text_col])

    return kept.mapInArrow(run, f"{schema}, `{text_col}` string" if schema else f"`{text_col}` string")
