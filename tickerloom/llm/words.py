"""64-bit hashes of words and word windows, computed on whole blocks of UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Equal words have equal hashes; two
different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(size: int) -> None:
    """Powers of BASE and of its inverse modulo 2**64, at least `size` of each."""
    global _powers, _inverse
    if len(_powers) >= size:
        return
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE)]))
        _inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, back)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; words do not cross the offsets."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
                most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets of the rows)."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends, lower, most), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False,
                most: int = 1 << 20) -> np.ndarray:
    """Hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + most, "right")), first + 1)
        lo, hi = starts[first], ends[last - 1]
        _grow(hi - lo + 1)
        part = data[lo:hi]
        with np.errstate(over="ignore"):
            terms = ((LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * _powers[:hi - lo]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            s, e = starts[first:last] - lo, ends[first:last] - lo
            out[first:last] = (sums[e] - sums[s]) * _inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weighted bytes before each place, factors that make a difference of sums independent of its place)."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[:len(data)], out=sums[1:])
    return sums, _inverse[:len(data) + 1]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; entry i starts at word i. Rows are not separated."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out + words[j:j + count]) * np.uint64(0x9E6C63D0876A9A75 + 2 * j)
            if j % 4 == 3:
                out ^= out >> np.uint64(29)
    return mix(out + np.uint64(width))
