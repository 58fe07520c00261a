"""Words and shingles of many texts as 64-bit hashes, computed on the bytes of an Arrow column.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. Two words are taken as equal if their
64-bit hashes are; a chance meeting of two given words has odds of 1 to 2^64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; upper-case letters have that of their lower case.
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
CHAIN = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 .. n - 1, modulo 2^64."""
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text begins and ends among them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each word begins and ends among them, and the number of words before each text."""
    data, offsets = text_bytes(column)
    black = ~SPACE[data]
    begins = black.copy()
    begins[1:] &= ~black[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = black[edges]  # a text's first byte never continues the text before
    first = np.flatnonzero(begins)
    before = np.searchsorted(first, offsets)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = ~black | begins
    stops = np.flatnonzero(stop)
    last = stops[np.searchsorted(stops, first, side="right")] if len(first) else first
    return data, first, last, before


def hashed(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    if not len(first):
        return np.zeros(0, np.uint64)
    sizes = last - first
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    values = BYTE[data[place + np.repeat(first, sizes)]] * powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(values, starts) + sizes.astype(np.uint64) * CHAIN)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words before each text (one more than texts)."""
    data, first, last, before = spans(column)
    return hashed(data, first, last), before


def shingles(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text after text, and the number of runs before each text.

    A text of fewer words has its whole sequence as one run, which equals no run of another length.
    """
    counts = np.diff(before)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ahead = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(int(ahead[-1]), np.uint64)
    long = counts >= size
    at = np.arange(int(runs[long].sum())) + np.repeat(before[:-1][long] - np.concatenate(([0], np.cumsum(runs[long])[:-1])), runs[long])
    whole = np.zeros(len(at), np.uint64)
    for j in range(size):
        whole = whole * STEP + hashes[at + j]
    out[np.arange(len(at)) + np.repeat(ahead[:-1][long] - np.concatenate(([0], np.cumsum(runs[long])[:-1])), runs[long])] = mixed(whole)
    for i in np.flatnonzero((counts > 0) & ~long):
        with np.errstate(over="ignore"):
            value = np.uint64(counts[i]) * CHAIN
            for h in hashes[before[i] : before[i + 1]]:
                value = value * STEP + h
            out[ahead[i]] = mixed(np.array([value ^ CHAIN]))[0]
    return out, ahead
