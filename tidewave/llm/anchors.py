"""Anchors of fixed-length byte strings: which part of a string stands for it depends on the string alone, so equal
strings have equal anchors wherever they start."""

from __future__ import annotations

import numpy as np

from tidewave.llm.shingles import _BASE, _INVERSE, _OF_BYTE, mix, powers

#: So many bits of a window's key hold a place: what is anchored at once is shorter than this.
PLACE_BITS = 23


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` bytes."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * powers(_BASE, n))])
    return mix((total[size:] - total[:-size]) * powers(_INVERSE, n)[: n - size + 1])


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each part data[first:end], its length included."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * powers(_BASE, len(data)))])
    return mix((total[end] - total[first]) * powers(_INVERSE, len(data) + 1)[first] + mix((end - first).astype(np.uint64)))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of `size` values: of each run, what is left of a block's end and what is right of it."""
    n = len(x) - size + 1
    padded = np.concatenate([x, np.full(-len(x) % size, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    up = np.minimum.accumulate(padded, 1).ravel()
    down = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[size - 1 : size - 1 + n])


def runs(data: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, place of the anchor, hash of the anchor, hash of all bytes) of each run of strings
    of `length` bytes that share one anchor: of the `anchor`-byte parts of a string, the first with the least hash.
    data, at: as of common.utf8(); strings don't cross from one text to the next."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    most = 1 << PLACE_BITS
    if len(data) > most:  # in parts that overlap by all but one byte of a string
        parts = []
        for b in range(0, len(data), most - length + 1):
            part = runs(data[b : b + most], np.clip(at - b, 0, min(most, len(data) - b)), length, anchor)
            parts.append((part[0], part[1] + b, part[2] + b, part[3] + b, part[4], part[5]))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))
    h = window_hashes(data, anchor)
    key = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(key, length - anchor + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    good = np.arange(len(place)) + length <= at[text + 1]
    start = np.flatnonzero(good)
    if not len(start):
        return none, none, none, none, none, none
    place, text = place[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = start[np.append(first[1:], len(start)) - 1]
    content = span_hashes(data, start[first], last + length)
    return text[first], start[first], last, place[first], h[place[first]].view(np.int64), content.view(np.int64)
