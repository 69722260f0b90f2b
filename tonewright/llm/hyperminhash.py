"""HyperMinHash sketches of shingle sets.

A shingle's 64-bit hash, as a fraction, picks one of REGISTERS buckets; a bucket keeps its least hash, compressed to 16
bits: a count of leading zeros and the mantissa bits that follow. Empty buckets copy the register of the first filled
one in an order of their own, the same for all documents, so small sets fill all registers too. ROWS registers are a
band.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .words import hashed_words, mixed_bits, window_hashes

REGISTERS, ROWS = 160, 5
BANDS = REGISTERS // ROWS
MANTISSA = 10
_PROBES = np.argsort(mixed_bits(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)
#: Expected share of registers that agree by chance between disjoint sets of like size, from the published analysis.
CHANCE = 0.169919487 / (1 << MANTISSA)


def shingle_set(text: str | bytes, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of all its words as one where there are fewer."""
    words = hashed_words(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"), lower)
    if not len(words):
        return words
    return np.unique(window_hashes(words, k) if len(words) > k else window_hashes(words, len(words)))


def signature(shingles: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def compressed(rest: np.ndarray) -> np.ndarray:
    """Leading zeros of a hash's bits within its bucket (6 bits) and the mantissa after the first one (10 bits)."""
    rest = rest | np.uint64(1)  # a sentinel one ends the zeros
    # A float's exponent has the place of the first one, but for values that were rounded up to a power of two.
    high = np.minimum(np.frexp(rest.astype(np.float64))[1].astype(np.int64) - 1, 63)
    high -= (rest >> high.astype(np.uint64)) == 0
    zeros = (63 - high).astype(np.uint64)
    body = rest << zeros << np.uint64(1)
    return (zeros << np.uint64(MANTISSA) | body >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """All registers of a non-empty sorted set."""
    buckets = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[buckets[first]] = compressed(shingles[first] * np.uint64(REGISTERS))
    filled[buckets[first]] = True
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch (rows of registers)."""
    bands, key = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64), np.uint64(0)
    for k in range(ROWS):
        key = mixed_bits(key + bands[:, :, k] + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches (rows of registers), corrected for chance agreement."""
    agree = (a == b).mean(axis=-1)
    return np.clip((agree - CHANCE) / (1 - CHANCE), 0, 1)


def floor_of(n_a: np.ndarray, n_b: np.ndarray, least: float, deviations: float = 4.5) -> np.ndarray:
    """What an estimate surely passes if the similarity is `least`: sets of few shingles have few independent registers."""
    n = np.minimum(n_a, n_b)
    own = np.maximum(1.0, REGISTERS * (1 - np.exp(-n / REGISTERS)))
    return least - deviations * np.sqrt(least * (1 - least) / own)
