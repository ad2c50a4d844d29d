"""Monotone sequences in about 2 + log2(range / length) bits an element, read at any place."""

from __future__ import annotations

import numpy as np

from stackloom.llm.packing import gather, pack_open

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th 1 of a byte, from the most significant bit.
_SELECT = np.array([[([b for b in range(8) if v >> (7 - b) & 1] + [0] * 8)[k] for k in range(8)] for v in range(256)], np.uint8)


class EliasFano:
    """The low bits of the elements are packed; their high parts are places of 1s in a bit vector, with a count of 1s every 64 bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, width: int):
        self.low, self.high, self.ones, self.width = low, high, ones, int(width)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: integers from 0 on, none smaller than the one before it."""
        n = len(values)
        width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        place = (values >> width) + np.arange(n)
        bits = np.zeros(-(-(int(place[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits)
        ones = np.concatenate([[0], np.cumsum(_POPCOUNT[high].reshape(-1, 8).sum(1, dtype=np.int64))[:-1]])
        return cls(pack_open(values & ((1 << width) - 1), width), high, ones, width)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}_low": self.low, f"{name}_high": self.high, f"{name}_ones": self.ones, f"{name}_width": np.array([self.width])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*(arrays[f"{name}_{x}"] for x in ("low", "high", "ones")), arrays[f"{name}_width"][0])

    def get(self, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """The elements at the places ``at``."""
        out = np.empty(len(at), np.int64)
        for a in range(0, len(at), step):
            i = at[a : a + step]
            word = np.searchsorted(self.ones, i, "right") - 1
            rest = i - self.ones[word]
            raw = self.high[(word * 8)[:, None] + np.arange(8)]
            count = np.cumsum(_POPCOUNT[raw], axis=1, dtype=np.int64)
            byte = (count <= rest[:, None]).sum(1)
            rows = np.arange(len(i))
            rest = rest - np.where(byte > 0, count[rows, np.maximum(byte - 1, 0)], 0)
            place = word * 64 + byte * 8 + _SELECT[raw[rows, byte], rest]
            out[a : a + step] = ((place - i) << self.width) | gather(self.low, self.width, i)
        return out
