"""Whole-batch word and shingle hashes with numpy, over Arrow's text buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is
a polynomial over the ring of 64-bit integers with a random value per byte, read
off prefix sums, so that no Python object is made per word. Two different words
collide with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U64) | U64(1)
LOWER = _BYTE.copy()
LOWER[65:91] = _BYTE[97:123]
EXACT = _BYTE
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = int(_rng.integers(1, 2**63, dtype=U64)) * 8 + 5 & (2**64 - 1)
STEP = _rng.integers(1, 2**64, 64, dtype=U64) | U64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text handled at once: the work arrays take about 50 times as much. A longer text is hashed in parts.
SLICE = 1 << 19


def powers() -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for all i that a part of a text needs."""
    if not _powers:
        n = 2 * SLICE + 1
        with np.errstate(over="ignore"):
            for key, base in (("up", _P), ("down", pow(_P, -1, 2**64))):
                a = np.full(n, base, U64)
                a[0] = 1
                _powers[key] = np.cumprod(a, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its n + 1 offsets; a null is an empty text."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    n = len(texts)
    _, at, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(texts: pa.ChunkedArray | pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0), each of about `most` bytes or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    raw, offs = buffers(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of words before it (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def _raw_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The polynomials of ranges of at most 2 * SLICE bytes of data, not mixed yet."""
    up, down = powers()
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A hash per word. Data of any length are worked on in parts, so that only 8 bytes a word are held besides."""
    with np.errstate(over="ignore"):
        if len(data) <= 2 * SLICE:
            return mix(_raw_hashes(data, starts, ends, table))
        out = np.zeros(len(starts), U64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * SLICE, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            if b - a <= 2 * SLICE:
                out[i:j] = _raw_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a, table)
            else:  # one word of several parts
                for c in range(a, b, SLICE):
                    d = min(c + SLICE, b)
                    part = _raw_hashes(data[c:d], np.array([0]), np.array([d - c]), table)
                    out[i] += part[0] * U64(pow(_P, c - a, 2**64))
            i = j
        return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i; those across two texts are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:n] * STEP[0]
        for j in range(1, k):
            out += words[j : n + j] * STEP[j]
        return mix(out)


def shingle_sets(texts, k: int = 5, table: np.ndarray = LOWER) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct k-word shingle hashes). Fewer than k words: their whole sequence as one; no word: none."""
    for i, j, data, offs in slices(texts):
        starts, ends, at = word_spans(data, offs)
        words = word_hashes(data, starts, ends, table)
        grams = gram_hashes(words, k)
        for r in range(i, j):
            a, b = at[r - i], at[r - i + 1]
            if b - a >= k:
                yield r, np.unique(grams[a : b - k + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield r, mix(np.array([(words[a:b] * STEP[: b - a]).sum() + U64(b - a)], U64))
            else:
                yield r, np.zeros(0, U64)
