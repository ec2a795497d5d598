"""Hilbert keys of integer grid points, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (n x d, values below 2**bits) on the d-dimensional Hilbert curve.

    Works on transposed coordinates: Gray decoding by bit planes, then the planes are interleaved,
    highest first. d * bits may be 63 at most, so that a key is a non-negative long.
    """
    x = [np.ascontiguousarray(c).astype(np.int64) for c in cells.T]
    d = len(x)
    if d * bits > 63:
        raise ValueError("a Hilbert key has 63 bits at most")
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for axis in range(d):
            up = (x[axis] & plane) != 0
            swap = np.where(up, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] = x[axis] ^ swap
        plane >>= 1
    for axis in range(1, d):
        x[axis] = x[axis] ^ x[axis - 1]
    flip = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        flip = np.where((x[-1] & plane) != 0, flip ^ (plane - 1), flip)
        plane >>= 1
    x = [v ^ flip for v in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> bit) & 1)
    return key
