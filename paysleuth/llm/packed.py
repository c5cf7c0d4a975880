"""Arrays as compressed bytes, for runs that are exchanged or stored as one value."""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few whole bytes each as the largest needs, byte by byte in planes, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=_LEVEL).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :width] = planes.T
    return wide.reshape(-1).view("<u8").astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending non-negative integers, as differences."""
    return pack(np.diff(values, prepend=0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


def pack_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + zstandard.ZstdCompressor(level=_LEVEL).compress(np.packbits(flags).tobytes())


def unpack_bits(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), dtype=np.uint8)
    return np.unpackbits(raw, count=int.from_bytes(blob[:8], "little")).astype(bool)
