"""Words of UTF-8 texts and 64-bit hashes of words and word windows, computed with numpy over whole buffers.

A word is a longest run of bytes other than space and \\x09-\\x0D. Hashes are polynomial sums modulo 2**64 over mixed
inputs, so a window's hash is a difference of two prefix sums. They find candidates; what must be exact is confirmed
on the words themselves by the caller, or noted there.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at a time; a longer text is cut between two words, which changes no hash.
PIECE = 1 << 18
_U = np.uint64
_P, _Q = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed_bits(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, PIECE + 1), base, _U)
        out[0] = 1
        known = np.multiply.accumulate(out)
        if n <= 4 * PIECE:
            _POWERS[base] = known
    return known[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of x[i] * base**i, from 0."""
    out = np.zeros(len(x) + 1, _U)
    np.cumsum(x * _powers(base, len(x)), out=out[1:])
    return out


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word of one text's bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~SPACE[data]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from its bytes alone."""
    out, at = np.empty(len(starts), _U), 0
    inverse = _inverse(_P)
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        a, b = starts[at:upto] - base, ends[at:upto] - base
        sums = _sums(_BYTE[data[base : base + b[-1]]], _P)
        out[at:upto] = (sums[b] - sums[a]) * _powers(inverse, int(a[-1]) + 1)[a]
        at = upto
    return mixed_bits(out)


def hashed_words(text: bytes, lower: bool = False) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    return word_hashes(data, *spans(data))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out, block = np.empty(n, _U), PIECE
    inverse = _inverse(_Q)
    for at in range(0, n, block):
        part = words[at : at + block + k - 1]
        sums, m = _sums(part, _Q), len(part) - k + 1
        out[at : at + m] = (sums[k:] - sums[:m]) * _powers(inverse, m)
    return mixed_bits(out)


def hashed_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and where each text's begin (and the last one's end)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = spans(data)
    first_bytes = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return word_hashes(data, starts, ends), np.searchsorted(starts, first_bytes)


def minimiser_positions(hashes: np.ndarray, width: int, runs: np.ndarray | None = None) -> np.ndarray:
    """Winnowing: positions that hold the (rightmost) least hash of some run of width hashes; equal runs choose alike.

    Where `runs` is given, only runs that begin there choose.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.int64)
    # Least of each run by doubling: a run of width is two overlapping runs of a power of two.
    order = hashes.copy()
    least, have = order, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: n - width + 1], least[width - have :][: n - width + 1])
    chosen = np.zeros(n, bool)
    value = least[: n - width + 1]
    pending = np.arange(n - width + 1) if runs is None else runs
    for back in range(width - 1, -1, -1):
        hit = hashes[pending + back] == value[pending]
        chosen[pending[hit] + back] = True
        pending = pending[~hit]
        if not len(pending):
            break
    return np.flatnonzero(chosen)
