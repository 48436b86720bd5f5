"""Random numbers and orders that depend on their keys alone, so that whoever needs them again draws them again."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(*keys: int | np.ndarray) -> np.ndarray:
    """64 bits for each combination of keys, which are broadcast against each other."""
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            out = mixed(out * _STEP + np.asarray(k, np.int64).astype(np.uint64) + _STEP)
    return out


def uniform(*keys: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each combination of keys."""
    return (hashed(*keys) >> np.uint64(11)) / float(1 << 53)


def place(x: np.ndarray, n: int, *keys: int, inverse: bool = False) -> np.ndarray:
    """Where each of x (from 0 to n - 1) stands in an order of these n numbers; inverse: which number stands there.

    A Feistel network on an even number of bits, walked until it is back among the n numbers. So any part of an order can be
    worked out anywhere: the first m of it are exactly m, and nothing is sorted.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def walked(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for r in reversed(range(4)) if inverse else range(4):
            if inverse:
                left, right = right ^ (hashed(*keys, r, left.astype(np.int64)) & mask), left
            else:
                left, right = right, left ^ (hashed(*keys, r, right.astype(np.int64)) & mask)
        return (left << shift) | right

    out = walked(np.asarray(x).astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = walked(out[far])
    return out.astype(np.int64)
