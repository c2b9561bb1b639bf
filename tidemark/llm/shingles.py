"""Shingle sets of whole texts and their HyperMinHash registers (numpy, one document at a time)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import xxhash

REGISTERS = 128
ROWS = 4  #: registers of a band: 4 * 16 bits are its 64-bit key
MANTISSA = 10  #: bits kept after the first one of a minimum
_SHIFT = 57  #: the top 7 bits choose the register
_STEPS = 32  #: sizes up to 2**32 are told apart by the correction

_U = np.uint64
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", k) | 1 for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and fold)."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Words(dict):
    """64-bit hashes of words met so far, within a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 1)
        if len(word) <= 48:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than ``width`` are one shingle."""
    own = text.encode("utf-8").lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, n)
    m = min(n, width)
    total = np.full(n - m + 1, _U(m), np.uint64)
    for k in range(m):
        total += mix(h[k : n - m + 1 + k] + _FACTORS[k]) * _FACTORS[k]
    return np.unique(mix(total))


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _priorities() -> np.ndarray:
    """For each register, the order in which it borrows from others: scrambled numbers, a row each."""
    grid = np.arange(REGISTERS * REGISTERS, dtype=np.uint64).reshape(REGISTERS, REGISTERS)
    return mix(grid + _U(0x51ED2701))


_PRIORITY = _priorities()
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << _U(_SHIFT)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty sorted set: leading zeros (6 bits) and mantissa (10 bits) of each bucket's minimum.

    An empty bucket borrows the register of the non-empty bucket that its own
    fixed random order puts first, so registers agree with probability J also
    for small sets.
    """
    at = np.searchsorted(hashes, _STARTS)
    at[at == len(hashes)] = len(hashes) - 1
    low = hashes[at]
    filled = (low >> _U(_SHIFT)) == np.arange(REGISTERS, dtype=np.uint64)
    value = (low & _U((1 << _SHIFT) - 1)) | _U(1)
    # Exponent by the float's own: numbers below 2**57 round up at most to the next power, which is taken back.
    bits = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    bits -= (value >> (bits - 1).clip(0).astype(np.uint64)) == 0
    zeros = _SHIFT - bits
    rest = np.where(bits - 1 >= MANTISSA, value >> (bits - 1 - MANTISSA).clip(0).astype(np.uint64), value << (MANTISSA - bits + 1).clip(0).astype(np.uint64)) & _U((1 << MANTISSA) - 1)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | rest.astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        have = np.flatnonzero(filled)
        out[empty] = out[have[_PRIORITY[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` registers, told apart by the band."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    bands = np.arange(packed.shape[-1], dtype=np.uint64)
    return mix(packed ^ mix(bands + _U(977)))


@functools.cache
def _chance_table() -> np.ndarray:
    """Expected share of registers of disjoint sets that agree by chance, by size in steps of half a power of two.

    The sum over all cells (exponent, mantissa) of the probabilities that the
    minimum of one and of the other bucket falls there.
    """
    edges = np.concatenate([2.0 ** -(k + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for k in range(_SHIFT - MANTISSA)])
    width = 2.0 ** -np.repeat(np.arange(1, _SHIFT - MANTISSA + 1), 1 << MANTISSA) / (1 << MANTISSA)
    # Empty buckets borrow, so each has one element at least.
    per_bucket = np.maximum(1.0, 2.0 ** (np.arange(2 * _STEPS) / 2) / REGISTERS)
    cells = np.array([np.exp(n * np.log1p(-edges)) * -np.expm1(n * np.log1p(np.maximum(-width / np.maximum(1 - edges, width), -1 + 1e-16))) for n in per_bucket])
    return cells @ cells.T


def expected_by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers of disjoint sets of sizes ``n`` and ``m`` that agree by chance."""
    at = [np.clip(np.rint(2 * np.log2(np.maximum(x, 1))), 0, 2 * _STEPS - 1).astype(np.int64) for x in (n, m)]
    return _chance_table()[at[0], at[1]]


def estimates(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from the shares of agreeing registers."""
    c = expected_by_chance(n, m)
    return np.maximum(0.0, (agreeing - c) / (1 - c))
