"""Vectorised hashing of words in UTF-8 texts (numpy, used inside tasks).

A word's hash is a polynomial over its bytes modulo 2^64, read off prefix sums
of a whole block at once, and then mixed.  No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
KEEP = np.arange(256, dtype=np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK + 1, 1 << int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
    return _tables[size]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values with good avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit values, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
    return x


def blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Cut after white space into blocks of about half a MB, words whole."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + _BLOCK)
        while to < n and not SPACE[data[to - 1]]:
            ahead = np.flatnonzero(SPACE[data[to : to + 4096]])
            to = to + int(ahead[0]) + 1 if len(ahead) else min(n, to + 4096)
        yield data[at:to]
        at = to


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=total[1:])
        return mix64((total[end] - total[start]) * inverse[start])


def word_hashes(data: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """Hashes of the words of a text, in order; bytes go through ``table``."""
    out = []
    for block in blocks(data):
        block = table[block]
        start, end = spans(block)
        out.append(span_hashes(block, start, end))
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words.

    Fewer words make one shingle of all of them; no word makes none.
    """
    n = len(words)
    if not n:
        return np.zeros(0, U)
    width = min(width, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, U)
        for k in range(width):
            h = mix64(h * U(0x9FB21C651E98DF25) + words[k : n - width + 1 + k])
    return np.unique(h)


def text_bytes(value) -> np.ndarray:
    """UTF-8 bytes of a str, bytes or None as array."""
    if value is None:
        return np.zeros(0, np.uint8)
    return np.frombuffer(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value, np.uint8)
