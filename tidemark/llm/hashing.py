"""Hashes of words and of windows over one text, in numpy.

A text is taken as UTF-8 bytes. A word is a run of bytes other than space and
\\t \\n \\v \\f \\r. Windows are hashed by a polynomial over 64-bit integers with an odd
base, so a window's hash comes from two prefix sums, whatever its length.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_ROOT = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(1, MASK, 256, np.uint64, endpoint=True) | np.uint64(1)
_SEPARATOR = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        factors = np.full((2, size), [[_BASE], [_ROOT]], np.uint64)
        factors[:, 0] = 1
        _powers = tuple(np.cumprod(factors, axis=1))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit integer over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers: one more than there are values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def windows_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    sums = prefix_sums(values)
    return mix((sums[n:] - sums[:-n]) * powers(len(sums))[1][: len(sums) - n])


def as_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def word_spans(data: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last one; separator: which bytes part words."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = separator[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    return spans_hash(prefix_sums(byte_values(data)), starts, ends)


def repeated(hashes: np.ndarray) -> np.ndarray | None:
    """Which values occur more than once; None if none does."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(hashes, twice) if len(twice) else None


def cover(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places lie in a window of n that begins at one of starts."""
    steps = np.zeros(size + n + 1, np.int32)
    steps[starts] += 1
    steps[starts + n] -= 1
    return np.cumsum(steps[:size]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]
