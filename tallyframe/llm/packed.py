"""Lists of numbers as compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(x: np.ndarray) -> bytes:
    """Compressed numbers, byte plane by byte plane, because high bytes are mostly zero."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()
