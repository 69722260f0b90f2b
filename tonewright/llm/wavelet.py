"""A wavelet matrix over token ids: succinct bit-planes with rank and select, in one compressed block of bytes.

Plane by plane, from the highest bit, the sequence is split stably into zeros and ones. Each plane keeps its bits and
the number of ones before every 512th bit, so that the n-th token, the number of occurrences of a token before a place
and the place of its k-th occurrence are found in one step a plane.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC, VERSION = b"TWWM", 1
_HEAD = struct.Struct("<4sHHQ")
_PLANE = struct.Struct("<QI")
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(tokens: np.ndarray, level: int = 1) -> bytes:
    """The file of a sequence of ids from 0 to 2**32 - 1; the greatest one says how many planes it has."""
    least, greatest = (int(tokens.min()), int(tokens.max())) if len(tokens) else (0, 0)
    if least < 0 or greatest >= 1 << 32:
        raise ValueError("ids must be from 0 to 2**32 - 1")
    n_planes = max(1, greatest.bit_length())
    tokens = tokens.astype(np.uint16 if n_planes <= 16 else np.uint32)
    out, press = [_HEAD.pack(MAGIC, VERSION, n_planes, len(tokens))], zstandard.ZstdCompressor(level=level)
    for plane in range(n_planes - 1, -1, -1):
        ones = (tokens >> plane & 1).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        by_block = _ONES[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        before = np.concatenate([[0], np.cumsum(by_block)]).astype("<u4")
        packed = press.compress(bits.tobytes() + before.tobytes())
        zeros = len(tokens) - int(before[-1])
        out += [_PLANE.pack(zeros, len(packed)), packed]
        tokens = np.concatenate([tokens[np.flatnonzero(~ones)], tokens[np.flatnonzero(ones)]])
    return b"".join(out)


class WaveletMatrix:
    """A file's reader. Planes are unpacked when they are first used."""

    def __init__(self, file: bytes):
        magic, version, self.n_planes, self.n = _HEAD.unpack_from(file)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a wavelet matrix of this version")
        self._packed, self.zeros, self._planes, at = [], [], {}, _HEAD.size
        for _ in range(self.n_planes):
            zeros, size = _PLANE.unpack_from(file, at)
            at += _PLANE.size
            self.zeros.append(zeros)
            self._packed.append(file[at : at + size])
            at += size

    def __len__(self) -> int:
        return self.n

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            raw = zstandard.ZstdDecompressor().decompress(self._packed[k])
            blocks = -(-self.n // BLOCK)
            self._planes[k] = np.frombuffer(raw, np.uint8, blocks * BLOCK // 8), np.frombuffer(raw, "<u4", blocks + 1, blocks * BLOCK // 8)
        return self._planes[k]

    def _rank1(self, k: int, i: int) -> int:
        bits, before = self._plane(k)
        block = i // BLOCK
        ones = int(before[block]) + int(_ONES[bits[block * BLOCK // 8 : i // 8]].sum(dtype=np.int64))
        return ones + (bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def _select(self, k: int, one: int, nth: int) -> int:
        """Place of the nth (from 0) bit that is `one` in plane k."""
        bits, before = self._plane(k)
        ranks = before.astype(np.int64) if one else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(ranks, nth, "right")) - 1
        inside = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == one)[nth - int(ranks[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.n_planes):
            one, ones = int(self._plane(k)[0][i // 8]) >> i % 8 & 1, self._rank1(k, i)
            token = token << 1 | one
            i = self.zeros[k] + ones if one else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if not 0 <= token < 1 << self.n_planes:  # no token of this file
            return lo, lo
        for k in range(self.n_planes):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.n_planes - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in places lo to hi."""
        lo, hi = max(0, lo), self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return 0
        a, b = self._range(token, lo, hi)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """The place of a token's nth occurrence, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in range(self.n_planes - 1, -1, -1):
            one = token >> (self.n_planes - 1 - k) & 1
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence: the splits undone from the last plane to the first."""
        kind = np.uint16 if self.n_planes <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.n_planes - 1, -1, -1):
            ones = np.unpackbits(self._plane(k)[0], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = now[: self.zeros[k]]
            out[np.flatnonzero(ones)] = now[self.zeros[k] :] | kind(1 << (self.n_planes - 1 - k))
            now = out
        return now
