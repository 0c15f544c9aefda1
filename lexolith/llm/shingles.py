"""Hashed word shingles of whole texts.

Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z lower-cased.
A word's hash is a polynomial over its bytes' random values, taken for all words of a text at once from running sums; a
shingle's hash mixes those of its words in order. 64 bits tell a document's shingles apart.
"""

from __future__ import annotations

import numpy as np
import xxhash

_WORD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _WORD)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, np.bool_)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: An odd base, so that it has an inverse; powers of both grow with the longest text seen.
_BASE = 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        _powers, _inverses = _run_of(_BASE, n), _run_of(pow(_BASE, -1, 1 << 64), n)


def _run_of(base: int, n: int) -> np.ndarray:
    run = np.full(n, base, np.uint64)
    run[0] = 1
    return np.cumprod(run, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not data.size:
        return np.zeros(0, np.uint64)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    _grow(data.size + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _powers[: data.size], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, ascending; the whole sequence as one if there are fewer words."""
    words = word_hashes(text or "")
    if not words.size:
        return words
    width = min(width, words.size)
    rolled = np.zeros(words.size - width + 1, np.uint64)
    for i in range(width):
        rolled = mixed(rolled * np.uint64(3) + words[i : words.size - width + 1 + i] + np.uint64(i))
    return np.unique(mixed(rolled + np.uint64(width)))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True)
