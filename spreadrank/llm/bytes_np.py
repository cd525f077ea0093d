"""Whole-batch byte work in numpy: words, their hashes and shingles, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
PIECE = 1 << 20
U = np.uint64
STEP, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed << 32)) * STEP)


BYTE = _numbers(256, 1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
BASE = int(_numbers(1, 2)[0]) | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i in 0..n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full((1 << (max(n, 1 << 16) - 1).bit_length()) + 1, U(base))
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have


def texts(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; null is empty."""
    a = batch.fill_null("").cast(pa.large_binary()) if not pa.types.is_binary(batch.type) else batch.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``size`` bytes."""
    data, offsets = texts(batch)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): an order in which the same hashes are neighbours, and where their groups begin there.

    Hashes are sorted with their places instead of their last bits, several times as fast as argsort. Where two hashes differ in
    these bits alone, their groups may come in more than one part.
    """
    bits = U(len(keys).bit_length())
    order = np.sort(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64))
    order = (order & ((U(1) << bits) - U(1))).astype(np.int64)
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1])))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where): 64-bit hashes of the words of texts, A-Z folded; text i has words where[i]:where[i + 1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space
    starts = np.flatnonzero(word & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((FOLDED if fold else BYTE)[data] * powers(BASE, n)[:n], dtype=np.uint64, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), n)[starts] + (ends - starts).astype(np.uint64) * STEP)
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; of fewer words the whole sequence is one; none without words."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    c = _numbers(n + 1, 3) | U(1)
    with np.errstate(over="ignore"):
        total = np.full(len(hashes) - k + 1, c[n] * U(k), np.uint64)
        for i in range(k):
            total += hashes[i : len(hashes) - k + 1 + i] * c[i]
        return mix(total)
