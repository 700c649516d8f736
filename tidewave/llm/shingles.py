"""Hashed words and word shingles of whole texts, computed for many texts at once on their bytes."""

from __future__ import annotations

import numpy as np

from tidewave.llm.common import LOWER, SPACES, distinct

WORDS = 5
_RNG = np.random.default_rng(20240101)
_OF_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(int(_RNG.integers(1 << 62, 1 << 63)) | 1)
_FOLD = np.frombuffer(LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n - 1, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, the text that it is in) for the texts of common.utf8()."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _FOLD[data]
    solid = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[at] = True
    before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~cut[1:]
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[low] * powers(_BASE, n))])
    h = (total[last + 1] - total[first]) * powers(_INVERSE, n)[first]
    return mix(h), np.searchsorted(at, first, "right") - 1


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of words, sorted distinct shingle hashes) of each text; a text with fewer words than a shingle has
    all of them as its one shingle, a text without words none."""
    n = len(at) - 1
    h, doc = words(data, at)
    count = np.bincount(doc, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    out: list[np.ndarray] = []
    m = len(h) - WORDS + 1
    full = np.zeros(max(m, 0), np.uint64)
    for k in range(WORDS if m > 0 else 0):
        full = full * _STEP + h[k : k + m]
    full = mix(full)
    for i in range(n):
        a, b = start[i], start[i + 1]
        if b - a >= WORDS:
            out.append(distinct(full[a : b - WORDS + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = one * _STEP + x
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return count, out
