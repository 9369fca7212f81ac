"""Arrays as bytes: whole numbers in planes of equal significance, each compressed on its own, so that small and repeated numbers cost little."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard


def squeezed(a: np.ndarray) -> tuple[int, list[bytes]]:
    """Numbers from 0 up."""
    a = np.asarray(a)
    planes = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    by = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)
    z = zstandard.ZstdCompressor(level=1)
    return len(a), [z.compress(np.ascontiguousarray(by[:, k])) for k in range(planes)]


def spread(x: tuple[int, list[bytes]]) -> np.ndarray:
    """What squeezed() took, as int64."""
    size, planes = x
    out, z = np.zeros((size, 8), np.uint8), zstandard.ZstdDecompressor()
    for k, p in enumerate(planes):
        out[:, k] = np.frombuffer(z.decompress(p), np.uint8)
    return out.view("<i8").reshape(-1)


def packed(x) -> bytes:
    """Any structure of arrays and plain values; arrays are compressed together."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def unpacked(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))
