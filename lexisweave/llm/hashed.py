"""Hashed n-gram counts of byte sequences and small dense models over them."""

from __future__ import annotations

import numpy as np


def hashed_ngrams(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the n-grams of a uint8 array in 2^bits slots, by multiplicative hashing; n up to 4."""
    slots = []
    a = codes.astype(np.uint32)
    gram = a
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(a) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | a[n - 1 :]
        if n in sizes:
            h = (gram + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            slots.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits))
    if not slots:
        return np.zeros(1 << bits, dtype=np.int64)
    return np.bincount(np.concatenate(slots), minlength=1 << bits)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows: the first is the mean direction's farthest-point start, made certain by order alone."""
    k = min(k, len(rows))
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    nearest = rows @ rows[chosen[0]]
    for _ in range(k - 1):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        centroids = np.where(np.bincount(own, minlength=k)[:, None] > 0, unit_rows(sums), centroids)
    return centroids
