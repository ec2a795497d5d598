"""A static hash table from 64-bit keys to row numbers, for whole arrays of keys at once."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Linear probing over twice as many slots as keys. ``keys`` are distinct; row i answers to keys[i]."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(2 * len(keys) - 1).bit_length() if len(keys) else 4)
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        rank = np.arange(len(keys))
        # Sorted by slot, each key stands at its slot or right after the key before it.
        spot = rank + np.maximum.accumulate(slot[order] - rank) if len(keys) else rank
        size = max(1 << bits, int(spot[-1]) + 2 if len(keys) else 0) + 1
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.keys[spot], self.rows[spot] = keys[order], order
        self.probes = int((spot - slot[order]).max()) + 1 if len(keys) else 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        spot = self._slot(keys)
        rows = self.rows[spot]
        todo = np.nonzero((self.keys[spot] != keys) & (rows >= 0))[0]
        out = rows.copy()
        for step in range(1, self.probes + 1):
            if not len(todo):
                break
            at = spot[todo] + step
            rows = self.rows[at]
            out[todo] = rows
            todo = todo[(self.keys[at] != keys[todo]) & (rows >= 0)]
        out[todo] = -1
        return out
