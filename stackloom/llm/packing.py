"""Integers of a fixed number of bits, packed one after the other."""

from __future__ import annotations

import numpy as np


def bit_width(size: int) -> int:
    """Least number of bits for ids below ``size``."""
    return max(1, (size - 1).bit_length())


def pack(values: np.ndarray, width: int) -> bytes:
    """Most significant bit first, filled up to whole bytes."""
    if width in (8, 16, 32):
        return values.astype(f">u{width // 8}").tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((values.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()


def unpack(data: bytes | np.ndarray, width: int, n: int, first: int = 0) -> np.ndarray:
    """Values ``first`` to ``first + n`` as unsigned 32-bit integers, or 64-bit beyond a width of 32."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview)) else data
    kind = np.uint32 if width <= 32 else np.uint64
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(data[first * size : (first + n) * size].tobytes(), f">u{size}").astype(kind)
    at = (np.arange(n, dtype=np.int64) + first) * width
    padded = np.concatenate([data[: ((first + n) * width + 7) // 8], np.zeros(9, np.uint8)])
    byte, out = at >> 3, np.zeros(n, np.uint64)
    size = (width + 14) // 8
    if size > 8:
        raise ValueError("packed integers have up to 57 bits")
    for j in range(size):
        out = (out << np.uint64(8)) | padded[byte + j]
    out >>= (8 * size - (at & 7) - width).astype(np.uint64)
    return (out & np.uint64((1 << width) - 1)).astype(kind)


def gather(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at any places ``at`` of packed integers; ``data`` goes on for 8 bytes at least behind the last one."""
    if width == 0:
        return np.zeros(len(at), np.int64)
    place = at * width
    byte, out = place >> 3, np.zeros(len(at), np.uint64)
    size = (width + 14) // 8
    for j in range(size):
        out = (out << np.uint64(8)) | data[byte + j]
    out >>= (8 * size - (place & 7) - width).astype(np.uint64)
    return (out & np.uint64((1 << width) - 1)).astype(np.int64)


def pack_open(values: np.ndarray, width: int) -> np.ndarray:
    """Packed in steps of bounded memory, for ``gather``."""
    step = 1 << 16  # a multiple of 8, so that steps end at whole bytes
    parts = [pack(values[a : a + step], width) for a in range(0, len(values), step)] if width else []
    return np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
