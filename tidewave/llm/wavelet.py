"""Wavelet matrices of token ids: bit planes in separately compressed blocks of one file, read in whole or at single places."""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"TIDEWM1\n"
#: A plane's bits are compressed in blocks of so many, each of which can be read alone.
BLOCK_BITS = 1 << 16


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little")


def halves(values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values whose bit (packed) is 0, and those whose bit is 1, each in their order."""
    n, kind = len(values), pa.from_numpy_dtype(values.dtype)
    array = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(values)])
    mask = lambda b: pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(b)])
    return array.filter(mask(~bits)).to_numpy(), array.filter(mask(bits)).to_numpy()


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file of ids (not negative), which belong to documents one after another, null doc_ids first.

    Ids are renamed by how frequent they are, the most frequent first, so that the first planes are mostly zeros. Plane k
    holds the k-th bit, from the top, of every name, in the order that results when names are divided, keeping
    their order, by each of the bits before. The directory at the end has the names, each plane's number of zeros, and
    for each block its place and the ones before it; counting ones up to a place needs one block.
    """
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
    width = max(1, int(len(alphabet) - 1).bit_length())
    small = np.uint16 if width <= 16 else np.uint32
    names = np.zeros(len(counts), small)
    names[alphabet] = np.arange(len(alphabet))
    rest = names[ids]
    compress = zstandard.ZstdCompressor(level=1).compress
    body, zeros, sizes, ones = [MAGIC], [], [], []
    for bit in range(width - 1, -1, -1):
        plane = packed((rest & small(1 << bit)) != 0)
        zero, one = halves(rest, plane)
        zeros.append(len(zero))
        rest = np.concatenate([zero, one])
        before = 0
        for at in range(0, len(plane), BLOCK_BITS // 8):
            block = plane[at : at + BLOCK_BITS // 8]
            body.append(compress(block.tobytes()))
            sizes.append(len(body[-1]))
            ones.append(before)
            before += int(np.bitwise_count(block).sum())
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    arrays = {"alphabet": alphabet.astype(np.uint32), "zeros": np.array(zeros, np.int64), "sizes": np.array(sizes, np.int32), "ones": np.array(ones, np.int64), "docs": known, "lengths": np.array(lengths, np.int64)}
    head = json.dumps({"n": len(ids), "width": width, "nulls": len(doc_ids) - len(known), "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    directory = compress(struct.pack("<I", len(head)) + head + b"".join(v.tobytes() for v in arrays.values()))
    return b"".join([*body, directory, struct.pack("<Q", len(directory)), MAGIC])


class WaveletFile:
    """Reads an open file of build(). A single place or id touches a block or two of each plane."""

    def __init__(self, f, cached: int = 256):
        self.f, size = f, f.seek(0, 2) if not hasattr(f, "size") else f.size()
        tail = self.at(size - 8 - len(MAGIC), 8 + len(MAGIC))
        if tail[8:] != MAGIC or self.at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of a wavelet matrix")
        n = struct.unpack("<Q", tail[:8])[0]
        raw = zstandard.ZstdDecompressor().decompress(self.at(size - 8 - len(MAGIC) - n, n))
        cut = 4 + struct.unpack("<I", raw[:4])[0]
        head = json.loads(raw[4:cut])
        found = {}
        for name, kind, count in head["arrays"]:
            found[name] = np.frombuffer(raw, kind, count, cut)
            cut += found[name].nbytes
        self.n, self.width, self.alphabet, self.zeros, self.ones = head["n"], head["width"], found["alphabet"], found["zeros"], found["ones"]
        self.doc_ids: list[int | None] = [None] * head["nulls"] + found["docs"].tolist()
        self.lengths = found["lengths"]
        self.starts = len(MAGIC) + np.concatenate([[0], np.cumsum(found["sizes"], dtype=np.int64)])
        self.blocks = -(-self.n // BLOCK_BITS)
        self.block = lru_cache(maxsize=cached)(self.read_block)
        self.names = {int(c): i for i, c in enumerate(self.alphabet)}

    def at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def read_block(self, plane: int, k: int) -> np.ndarray:
        """The bits of a block, one in a byte."""
        i = plane * self.blocks + k
        raw = zstandard.ZstdDecompressor().decompress(self.at(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i])))
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=min(BLOCK_BITS, self.n - k * BLOCK_BITS))

    def rank1(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i <= 0:
            return 0
        k, rest = divmod(i, BLOCK_BITS)
        if k == self.blocks:
            k, rest = k - 1, BLOCK_BITS
        return int(self.ones[plane * self.blocks + k]) + int(np.count_nonzero(self.block(plane, k)[:rest]))

    def selected(self, plane: int, bit: int, order: np.ndarray) -> np.ndarray:
        """Places of the order-th (from 0) zeros or ones of a plane."""
        first = np.arange(self.blocks) * BLOCK_BITS
        before = self.ones[plane * self.blocks : (plane + 1) * self.blocks]
        before = before if bit else first - before
        block, out = np.searchsorted(before, order, "right") - 1, np.empty(len(order), np.int64)
        for k in np.unique(block):
            here = block == k
            out[here] = first[k] + np.flatnonzero(self.block(plane, int(k)) == bit)[order[here] - before[k]]
        return out

    def access(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        name = 0
        for p in range(self.width):
            k, rest = divmod(i, BLOCK_BITS)
            bit, before = int(self.block(p, k)[rest]), self.rank1(p, i)
            i = int(self.zeros[p]) + before if bit else i - before
            name = 2 * name + bit
        return int(self.alphabet[name])

    def span(self, token: int, i: int) -> tuple[int, int]:
        """The stretch below the last plane that holds the occurrences of an id before place i."""
        name = self.names.get(token)
        if name is None:
            return 0, 0
        lo, hi = 0, i
        for p in range(self.width):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if name >> (self.width - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often an id occurs before place i."""
        lo, hi = self.span(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def places(self, token: int, order: np.ndarray | None = None) -> np.ndarray:
        """Where an id occurs, or its order-th occurrences (from 0) only."""
        lo, hi = self.span(token, self.n)
        if lo == hi:
            return np.zeros(0, np.int64)
        at = np.arange(lo, hi) if order is None else lo + np.asarray(order)
        if len(at) and (at.min() < lo or at.max() >= hi):
            raise IndexError(f"{token} occurs {hi - lo} times")
        name = self.names[token]
        for p in range(self.width - 1, -1, -1):
            bit = name >> (self.width - 1 - p) & 1
            at = self.selected(p, bit, at - (int(self.zeros[p]) if bit else 0))
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane upwards: each plane says how its order's halves were dealt."""
        small = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.n, small)
        unzip = zstandard.ZstdDecompressor().decompress
        for p in range(self.width - 1, -1, -1):
            first, last = p * self.blocks, (p + 1) * self.blocks
            base = int(self.starts[first])
            raw = self.at(base, int(self.starts[last]) - base)
            plane = b"".join(unzip(raw[self.starts[i] - base : self.starts[i + 1] - base]) for i in range(first, last))
            ones = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(np.bool_)
            zeros, above = int(self.zeros[p]), np.empty_like(out)
            above[ones] = out[zeros:] | small(1 << (self.width - 1 - p))
            above[~ones] = out[:zeros]
            out = above
        return self.alphabet[out]
