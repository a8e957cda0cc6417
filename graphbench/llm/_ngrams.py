"""Hashed n-gram features of bytes, by numpy."""

from __future__ import annotations

import numpy as np

_K = np.uint32(0x9E3779B1)


def hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    """uint32 codes to buckets."""
    codes = codes * _K
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x85EBCA77)
    return codes >> np.uint32(32 - bits)


def windows(a: np.ndarray, n: int) -> np.ndarray:
    """uint32 codes of the n-byte windows of a byte array, n <= 4."""
    size = len(a) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    out = a[:size].astype(np.uint32)
    for k in range(1, n):
        out = (out << np.uint32(8)) | a[k : k + size]
    return out
