"""A map from integers from 0 on to integers, looked up many at a time."""

from __future__ import annotations

import numpy as np

from stackloom.llm.words import mix


class IntMap:
    """Open addressing in two arrays that double when half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.clear(max(1024, len(keys)))
        self.add(keys, values)

    def clear(self, room: int = 1024) -> None:
        size = 1 << int(2 * room - 1).bit_length()
        self.mask, self.n = np.uint64(size - 1), 0
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & self.mask).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the map doesn't hold."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            held, kept = self.keys[old], self.values[old]
            self.clear(2 * (len(held) + len(keys)))
            self.add(held, kept)
        self.n += len(keys)
        slot = self._slot(np.ascontiguousarray(keys))
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys for a slot one stays
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that the map doesn't hold."""
        slot = self._slot(np.ascontiguousarray(keys))
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out
