"""Words and their 64-bit hashes for many texts at once, in numpy.

Texts are laid end to end in one byte buffer, a space between two; word bounds come from a class table and word hashes from a
running polynomial modulo 2^64 with an odd base, whose prefix values give any span's hash in two lookups. A final mix with the
length spreads the bits. Work goes in chunks of a few MB, so memory stays bounded whatever the texts' number; one text is never
split, so a chunk is as large as the longest text at least.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
# Arrays of 4 MB and more go back to the system when they are freed, so workers that wait do not hold what they once needed.
_LIBC = None
with contextlib.suppress(OSError, AttributeError):
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 4 << 20)


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


@contextlib.contextmanager
def held(most: int) -> Iterator[None]:
    """Keep up to so many freed bytes for the arrays to come, where pages would else be given back and asked for again at every step."""
    if _LIBC:
        _LIBC.mallopt(-1, most)
        _LIBC.mallopt(-3, 32 << 20)
    try:
        yield
    finally:
        if _LIBC:
            _LIBC.mallopt(-1, 128 << 10)
            _LIBC.mallopt(-3, 4 << 20)
        release()


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Random odd numbers for the bytes, from a fixed seed.
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK + 65536), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] = B^s * (hash of data[s:e])."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _upto(len(data) + 1)[0][: len(data)], out=p[1:])
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * _upto(len(p))[1][start] + (end - start).astype(np.uint64) * _BASE)


def run_hashes(p: np.ndarray, n: int) -> np.ndarray:
    """span_hashes of all runs of n bytes."""
    h = p[n:] - p[:-n]
    h *= _upto(len(p))[1][: len(h)]
    h += np.uint64(n * int(_BASE) & (1 << 64) - 1)
    return mix(h)


@dataclass
class Words:
    """The words of a chunk of texts, in order."""

    rows: list  # what came with each text
    data: np.ndarray  # the chunk's bytes
    bounds: np.ndarray  # text i is data[bounds[i] : bounds[i + 1] - 1]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # words of text i are first[i] : first[i + 1]
    hashes: np.ndarray | None = None

    @property
    def text(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def buffers(pairs: Iterable[tuple[object, str | None]], limit: int = CHUNK) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) of texts up to limit bytes together, at least one text; a null text is empty."""
    rows, parts, size = [], [], 0
    for row, text in pairs:
        b = (text or "").encode("utf-8", "surrogatepass")
        if rows and size + len(b) + 1 > limit:
            yield _joined(rows, parts)
            rows, parts, size = [], [], 0
        rows.append(row)
        parts.append(b)
        size += len(b) + 1
    if rows:
        yield _joined(rows, parts)


def _joined(rows: list, parts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in parts], out=bounds[1:])
    return rows, np.frombuffer(b" ".join(parts) + b" ", np.uint8), bounds


def words(pairs: Iterable[tuple[object, str | None]], lower: bool = True, hashed: bool = True, limit: int = CHUNK) -> Iterator[Words]:
    for rows, data, bounds in buffers(pairs, limit):
        if lower:
            data = LOWER[data]
        space = IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        w = Words(rows, data, bounds, start, end, np.searchsorted(start, bounds))
        if hashed:
            w.hashes = span_hashes(prefix_hashes(data), start, end)
        yield w


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of n words inside a text; a text of fewer words, but one, gives all its words as one run."""
    h, first = w.hashes, w.first
    count = np.diff(first)
    at = w.text
    full = np.flatnonzero(np.arange(len(h)) + n <= first[1:][at]) if len(h) else np.zeros(0, np.int64)
    out = h[full].copy()
    for k in range(1, n):
        out = mix(out * _BASE + h[full + k])
    short = np.flatnonzero((count > 0) & (count < n))
    tail = np.zeros(len(short), np.uint64)
    for j, i in enumerate(short):
        x = h[first[i] : first[i] + 1].copy()
        for k in range(first[i] + 1, first[i + 1]):
            x = mix(x * _BASE + h[k : k + 1])
        # Not equal to any full run, which has n words.
        tail[j] = mix(x ^ np.uint64(int(count[i])))[0]
    texts = np.concatenate([at[full], short])
    order = np.argsort(texts, kind="stable")
    return texts[order], np.concatenate([out, tail])[order]


def distinct_sets(texts: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): the sorted distinct values of each of n texts."""
    order = np.lexsort((h, texts))
    t, v = texts[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    t, v = t[new], v[new]
    return np.searchsorted(t, np.arange(n + 1)), v
