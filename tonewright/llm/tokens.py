"""Exact token ids of whole texts, each distinct word encoded once a task, or a few times where a task has very many.

Both vocabularies split a text into words before any merge, so the ids of a text are those of its words in turn. Words
are cut with numpy over many texts at once, and only where the vocabulary's own pre-tokeniser surely cuts; the tokenizers
library encodes those that a bounded cache doesn't hold, so the ids equal those of the whole text. Words of Latin letters
need none of its normalising and splitting: many are encoded as one text by the same model without these steps. Texts
that hold other white space than single spaces and line breaks, or a special token's beginning, are encoded as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from .words import SPACE, word_hashes

#: Words in each of the two halves of a task's cache; at about 200 bytes each, a bound on its memory.
HALF_WORDS = 200_000
#: Words that are encoded as one text.
TOGETHER = 512
#: UTF-8 bytes of text that are worked on at a time, and that are encoded at a time.
SLICE_BYTES = 1 << 20
TEXT_BYTES = 1 << 22
#: Bytes of a word from which on it is looked up by itself, whatever its hash.
LONG_WORD = 64


def _marked(which: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[which] = True
    return out


_LETTER = _marked([*range(65, 91), *range(97, 123)])
#: ASCII symbols but the apostrophe: both vocabularies cut between a letter and one of these.
_SYMBOL = _marked([b for b in range(33, 127) if not chr(b).isalnum() and b != 39])


def _visible_bytes() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, the others from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(others)}


_VISIBLE = _visible_bytes()


class WordEncoder:
    """UTF-8 texts -> ids as bytes (little-endian unsigned 32-bit), with a cache of words.

    `spaced` vocabularies (byte-level BPE) write a word with the one space before it; the others drop white space and case.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads; the library's own only wait for work
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.bare = Tokenizer(self.tokenizer.model)  # the same model in memory
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.edge = np.array([t.startswith(_VISIBLE[32]) if spaced else t.endswith("</w>") for t in tokens])
        self.breaks = self.tokenizer.token_to_id(_VISIBLE[10])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _jointly(self, words: list[bytes], text: str, between: str = " ") -> None:
        """Ids of words from one text (parted by NUL), by the tokens that begin or end a word, or by breaks."""
        if text.isascii():
            text = text.replace(" ", _VISIBLE[32])
        else:
            text = text.encode().decode("latin-1").translate(_VISIBLE | {0: "\0"})
        ids = np.array(self.bare.encode_batch_fast([text.replace("\0", between)], add_special_tokens=False)[0].ids, "<u4")
        if between != " ":
            ends = np.append(np.flatnonzero(ids == self.breaks), len(ids))
            begins = np.append(0, ends[:-1] + 1)
        else:
            edges = np.flatnonzero(self.edge[ids])
            begins = edges if self.spaced else np.append(0, edges[:-1] + 1)
            ends = np.append(begins[1:], len(ids))
        if len(begins) == len(words):
            raw = ids.tobytes()
            self.known.update(zip(words, [raw[x:y] for x, y in zip((4 * begins).tolist(), (4 * ends).tolist())]))
        else:  # some word isn't one to the vocabulary
            self._alone(words)

    def _alone(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            texts = [w.decode("utf-8", "surrogatepass") for w in part]
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    def learn(self, words: list[bytes]) -> None:
        plain, bare, wide, alone = [], [], [], []
        for w in words:
            if w.isalpha():
                (bare if self.spaced else plain).append(w)
            elif self.spaced and w[0] == 32 and w[1:].isalpha():
                plain.append(w)
            elif w.isascii():
                alone.append(w)
            else:
                wide.append(w)
        latin, bare_latin = [], []
        for w in wide:
            text = w.decode("utf-8", "surrogatepass")
            letters = text[1:] if self.spaced and text[0] == " " else text
            if not letters.isalpha() or max(letters) >= "\u0250" or "\u0130" in letters:
                alone.append(w)
            elif self.spaced:
                (bare_latin if letters is text else latin).append((w, text))
            else:
                latin.append((w, text.lower()))
        line_break = f" {_VISIBLE[10]} "
        for group, between in ((plain, " "), (bare, line_break)):
            for at in range(0, len(group), TOGETHER):
                part = group[at : at + TOGETHER]
                self._jointly(part, b"\0".join(part).decode(), between)
        for group, between in ((latin, " "), (bare_latin, line_break)):
            for at in range(0, len(group), TOGETHER):
                part, texts = zip(*group[at : at + TOGETHER])
                self._jointly(list(part), "\0".join(texts), between)
        self._alone(alone)

    def _odd(self, data: np.ndarray, ends_of_texts: np.ndarray) -> np.ndarray:
        """Which texts hold white space that their vocabulary's words don't begin with: next to other white space, at an end, tabs."""
        space = SPACE[data]
        last = np.zeros(len(data), bool)
        last[ends_of_texts] = True
        before, after = np.append(True, space[:-1]), np.append(space[1:], True)
        odd = np.zeros(len(ends_of_texts), bool)
        odd[np.searchsorted(ends_of_texts, np.flatnonzero(space & ~last & (before | after | (data != 32) & (data != 10))))] = True
        return odd

    def _cut(self, data: np.ndarray, ends_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last byte of each word. Each text ends with an added space, and none is odd to a spaced vocabulary."""
        space = SPACE[data]
        tail = np.append(False, _LETTER[data[:-1]]) & _SYMBOL[data]
        if not self.spaced:
            begin = ~space & (np.append(True, space[:-1]) | tail)
            end = np.append((begin | space)[1:], True) & ~space
            return np.flatnonzero(begin), np.flatnonzero(end) + 1
        last = np.zeros(len(data), bool)
        last[ends_of_texts] = True
        # A word begins with its space; a line break is one of its own, and so parts the word after it from any space.
        begin = ~last & (space | np.append(True, (last | (data == 10))[:-1]) | tail)
        end = np.append((begin | last)[1:], True) & ~last
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    @staticmethod
    def _joined(texts: list[bytes], lower: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts with a space after each, as bytes and as numbers, and where each one's space stands."""
        raw = b" ".join([*texts, b""])
        raw = raw.lower() if lower else raw
        return raw, np.frombuffer(raw, np.uint8), np.cumsum([len(t) + 1 for t in texts]) - 1

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        raw, data, ends_of_texts = self._joined(texts, not self.spaced)
        bad = self._odd(data, ends_of_texts) if self.spaced else np.zeros(len(texts), bool)
        if bad.any():  # they are encoded whole, below
            raw, data, ends_of_texts = self._joined([b"" if odd else t for odd, t in zip(bad, texts)], False)
        starts, ends = self._cut(data, ends_of_texts)
        hashes = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        long_ = np.flatnonzero(ends - starts >= LONG_WORD)
        hashes[long_] = np.arange(len(long_), dtype=np.uint64)  # each by itself
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > HALF_WORDS:  # words that come again are kept, those that don't go with the older half
            self.older, self.known = self.known, {}
        get, older = self.known.get, self.older
        ids = list(map(get, words))
        if None in ids:
            new = [w for w, x in zip(words, ids) if x is None]
            self.known.update((w, older[w]) for w in new if w in older)
            self.learn([w for w in new if w not in older])
            ids = [get(w) if x is None else x for w, x in zip(words, ids)]
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        flat, froms = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.cumsum(each)
        out = flat[np.repeat(froms[which] - (upto - each), each) + np.arange(len(each) and upto[-1])].tobytes()
        cuts = 4 * np.append(0, upto)[np.searchsorted(starts, np.append(-1, ends_of_texts))]
        made = [out[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        whole = [i for i, t in enumerate(texts) if bad[i] or b"<|" in t]
        if whole:
            coded = self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "surrogatepass") for i in whole], add_special_tokens=False)
            for i, e in zip(whole, coded):
                made[i] = np.array(e.ids, "<u4").tobytes()
        return made


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


@contextmanager
def encoder(path: str, spaced: bool) -> Iterator[WordEncoder]:
    """The worker's encoder for a vocabulary file, for a task.

    Its words go at the task's end: workers outlive their tasks, and what they hold is missing to the stages that follow.
    """
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, spaced)
    try:
        yield _ENCODERS[key]
    finally:
        _ENCODERS[key].forget()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A column's texts as UTF-8; null is empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about `most` bytes of text each; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)
