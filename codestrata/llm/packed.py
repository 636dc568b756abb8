"""Arrays of unsigned integers as small byte strings, for columns that go through a shuffle.

A sorted array is kept as its differences; the bytes of equal weight stand together, so that zstd
finds the zero ones.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<QB")


def pack(values: np.ndarray) -> bytes:
    x = np.ascontiguousarray(values, np.dtype("<u8"))
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _HEAD.pack(len(x), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    n, width = _HEAD.unpack_from(blob)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[_HEAD.size :], max_output_size=n * width), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.dtype("<u8"))


def pack_sorted(values: np.ndarray) -> bytes:
    x = np.ascontiguousarray(values, np.uint64)
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return unpack(blob).cumsum(dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return struct.pack("<Q", len(flags)) + np.packbits(flags).tobytes()


def unpack_bits(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=8), count=struct.unpack_from("<Q", blob)[0]).astype(bool)
