"""Hilbert keys of points (Skilling's transform, AIP Conf. Proc. 707, 2004), vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates in [0, 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("a key must fit 62 bits")
    q = 1 << (bits - 1)
    while q > 1:  # undo the reflections and exchanges of each level, from the coarsest
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
