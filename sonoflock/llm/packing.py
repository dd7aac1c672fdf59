"""Arrays of numbers as compact bytes, to be sent from task to task."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    """An array as bytes, byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(planes) else planes.view(kind)


def small(a: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)
