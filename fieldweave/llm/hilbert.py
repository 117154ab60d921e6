"""Places of points along a Hilbert curve in several dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of whole numbers below 2**bits; rows x bits at most 63.

    The coordinates are turned bit by bit, from the highest, into the axes of the sub-cube they lie
    in; the Gray code of the turned bits is then undone and the bits are interleaved.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        low = q - one
        for d in range(dims):
            set_ = (x[d] & q) != 0
            # a set bit mirrors the lower bits of the first axis, a clear one swaps them with this axis
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
        q >>= one
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    out = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((x[d] >> np.uint64(b)) & one)
    return out.view(np.int64)
