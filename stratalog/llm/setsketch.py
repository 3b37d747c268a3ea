"""SetSketch registers of shingle sets, in numpy over blocks of texts.

A sketch holds M registers.  Every set element throws points at exponentially spaced
heights into the registers, in an order without repeats; a register keeps the lowest
point, truncated to an integer on a logarithmic scale of base B.  The register-wise
maximum of two sketches is the sketch of the union, and two sets agree in a register
with about the probability of their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import LOWER, WordHashes, mix, split_words, windows

#: Registers (a prime: any start and step then visit each register once), scale and base.
M, A, B = 127, 20.0, 1.001
TOP = (1 << 16) - 1
#: Bands of registers: of two sets of similarity 0.8 all bands differ with probability (1 - 0.8 ** 4) ** 31 = 8e-8.
ROWS, BANDS = 4, 31
SHINGLE = 4


def shingle_sets(texts: list[bytes], hashes: WordHashes, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (fewer words: of the whole sequence)."""
    words, counts = split_words(texts, LOWER)
    own = hashes.of(words)
    every = windows(own, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(every[at : at + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(mix(windows(own[at : at + n], n) ^ np.uint64(n)))
        else:
            out.append(own[:0])
        at += n
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (texts x M, uint16) of sets of 64-bit hashes; zeros for the empty set."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    low = np.full(n * M, np.inf)
    seed = mix(h ^ np.uint64(0xA0761D6478BD642F))
    at = (seed % np.uint64(M)).astype(np.int64)
    step = (1 + (seed >> np.uint64(20)) % np.uint64(M - 1)).astype(np.int64)
    x = np.zeros(len(h))
    with np.errstate(over="ignore", divide="ignore"):
        for t in range(M):
            if not len(h):
                break
            u = (mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(t + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            x = x - np.log1p(-u) / (A * (M - t))
            np.minimum.at(low, doc * M + at, x)
            most = low.reshape(n, M).max(1)
            live = x < most[doc]  # later points of an element only lie higher
            h, doc, x, step, at = h[live], doc[live], x[live], step[live], at[live]
            at = at + step
            at[at >= M] -= M
        level = np.floor(1 - np.log(low) / np.log(B))
    return np.where(np.isinf(low), 0, np.clip(level, 0, TOP)).astype(np.uint16).reshape(n, M)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def buckets(regs: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each sketch (rows x BANDS); its five lowest bits are the band."""
    four = regs[:, : ROWS * BANDS].astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    packed = four[:, :, 0]
    for j in range(1, ROWS):
        packed = (packed << np.uint64(16)) | four[:, :, j]
    with np.errstate(over="ignore"):
        mixed = mix(mix(packed) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed & ~np.uint64(31) | np.arange(BANDS, dtype=np.uint64)


def first_band(equal: np.ndarray) -> np.ndarray:
    """The first band that pairs share, from which registers are equal (pairs x M); -1 for none."""
    bands = equal[:, : ROWS * BANDS].reshape(len(equal), BANDS, ROWS).all(2)
    return np.where(bands.any(1), bands.argmax(1), -1)


def _fit(j: np.ndarray | float, above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j, given how many registers of the first sketch are higher and lower; sizes are known."""
    u = na / np.maximum(na + nb, 1)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    hi, lo = p(u - v * j), p(v - u * j)
    eps = 1e-12
    return above * np.log(hi + eps) + below * np.log(lo + eps) + (M - above - below) * np.log(np.maximum(1 - hi - lo, 0) + eps)


def reaches(limit: float, above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the joint maximum-likelihood estimate is limit at least: the likelihood is concave, so its slope there tells."""
    most = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    step = 1e-4
    slope = _fit(limit + step, above, below, na, nb) - _fit(limit - step, above, below, na, nb)
    return (most >= limit) & ((slope >= 0) | (most <= limit + step))


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of pairs of sketches whose set sizes are known."""
    above, below = (a > b).sum(1).astype(np.float64), (a < b).sum(1).astype(np.float64)
    most = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    lo, hi = np.zeros(len(a)), most.astype(np.float64)
    for _ in range(40):
        left, right = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = _fit(left, above, below, na, nb) < _fit(right, above, below, na, nb)
        lo, hi = np.where(up, left, lo), np.where(up, hi, right)
    return (lo + hi) / 2
