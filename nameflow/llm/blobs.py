"""Integer and float arrays as compact binary values, for tables and shuffles of few, large rows.

Each array goes in the narrowest integer type that holds it (floats as they are), all compressed
together.  Sorted arrays are cheaper as differences: see `steps` and `totals`.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard


def _narrow(a: np.ndarray) -> np.ndarray:
    a = np.ascontiguousarray(a)
    if a.dtype.kind == "b":
        return a.astype(np.uint8)
    if a.dtype.kind not in "iu" or not len(a):
        return a
    lo, hi = int(a.min()), int(a.max())
    for kind in ((np.uint8, np.uint16, np.uint32, np.int64, np.uint64) if lo >= 0 else (np.int8, np.int16, np.int32, np.int64)):
        if np.iinfo(kind).min <= lo and hi <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def pack(**arrays: np.ndarray) -> bytes:
    head, parts = [], []
    for name, a in arrays.items():
        small = _narrow(np.asarray(a))
        head.append([name, small.dtype.str, len(small)])
        # bytes of equal rank side by side compress better
        parts.append(small.view(np.uint8).reshape(len(small), -1).T.tobytes() if small.itemsize > 1 and len(small) else small.tobytes())
    meta = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(meta)) + meta + b"".join(parts))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    """Integers come back as 64-bit (unsigned if they were beyond 2**63)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, {}
    for name, kind, count in json.loads(raw[4:at]):
        dtype = np.dtype(kind)
        flat = np.frombuffer(raw, dtype=np.uint8, count=count * dtype.itemsize, offset=at)
        a = np.ascontiguousarray(flat.reshape(dtype.itemsize, count).T).view(dtype).reshape(count) if dtype.itemsize > 1 and count else flat.view(dtype)
        at += count * dtype.itemsize
        out[name] = a.astype(np.int64) if dtype.kind in "iu" and dtype != np.uint64 else a
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array (the first entry stays)."""
    return np.diff(a, prepend=a[:1] * 0)


def totals(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=d.dtype)
