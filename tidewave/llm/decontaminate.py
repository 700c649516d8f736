"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

If a passage of m characters occurs with at most k edits, at least m - q + 1 - k * q of its q-grams occur unchanged,
on diagonals (place in the text less place in the passage) that differ by at most 2 * k. So it is enough to count
the passage's q-grams within bands of diagonals that overlap by that much, and to align where the count is reached.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import distinct, slices, table

_BASE = 0x9E3779B97F4A7C15 | 1
_NOT_WORD = re.compile(r"[\W_]")
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, anything but letters and digits as single spaces."""
    return _GAP.sub(" ", lower(text)).strip()


def lower(text: str | None) -> str:
    """Lower case of the same length."""
    return (text or "").replace("İ", "I").lower()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of each window of q characters, from windows of half the length and so on."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    h, size = code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1
    while size < q:
        step = min(size, q - size)
        h = h[: len(h) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        size += step
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Rule:
    """A passage of m characters may differ by edits_percent of m edits, or by as many as the lemma can bound; one of
    fewer than least_chars characters, after normalisation, is no evidence of a leak and isn't looked for."""

    q: int = 8
    edits_percent: int = 10
    least_chars: int = 24

    def budget(self, m: int) -> int:
        return min(m * self.edits_percent // 100, (m - self.q) // self.q)

    def least_shared(self, m: int) -> int:
        return m - self.q + 1 - self.budget(m) * self.q


class Passages:
    """One block of benchmark passages, indexed by q-gram."""

    TABLE = 20  # bits of the table of possible hashes
    CHUNK = 4_000_000

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule = rule
        kept = [(i, c) for i, t in items if len(c := codes(normal(t))) >= max(rule.least_chars, rule.q)]
        self.ids, self.codes = [i for i, _ in kept], [c for _, c in kept]
        m = np.array([len(c) for c in self.codes], np.int64)
        self.length = m
        self.budget = np.array([rule.budget(x) for x in m], np.int64)
        self.least = np.array([rule.least_shared(x) for x in m], np.int64)
        found = [grams(c, rule.q) for c in self.codes]
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(h)))
        self.maybe = np.zeros(1 << self.TABLE, bool)
        self.maybe[(self.hashes >> np.uint64(64 - self.TABLE)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, passage, first character, end, edits, shared q-grams) of the closest place of each passage that a
        text has; characters of the normalised text."""
        if not len(self.hashes) or not texts:
            return []
        q = self.rule.q
        parts = [codes(t) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        code = np.concatenate(parts)
        h = grams(code, q)
        pos = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.TABLE)).astype(np.int64)])
        gram = np.searchsorted(self.hashes, h[pos])
        gram[gram == len(self.hashes)] = 0
        doc = np.searchsorted(at, pos, "right") - 1
        good = (self.hashes[gram] == h[pos]) & (pos + q <= at[doc + 1])
        pos, gram, doc = pos[good], gram[good], doc[good]
        most, held, begin = int(self.length.max()), [], 0
        reach = np.cumsum(self.many[gram])
        bands = int(max((len(p) for p in parts), default=0)) + 2 * most + 2
        while begin < len(pos):  # a q-gram that many passages have is counted for each, about CHUNK at a time
            end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + self.CHUNK, "right")))
            n = self.many[gram[begin:end]]
            row = np.repeat(np.arange(begin, end), n)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[gram[row]]
            item, place = self.item[entry], self.place[entry]
            # bands of diagonals: each is 2 * step wide and begins step after the one before
            step = 2 * self.budget[item] + 1
            band = (pos[row] - at[doc[row]] - place + self.length[item]) // step + 1  # diagonals from -m on
            pair = doc[row] * len(self.ids) + item
            key = np.concatenate([band, band - 1]) * most + np.tile(place, 2)  # a passage's q-gram counts once in a band
            both = np.unique(np.stack([np.tile(pair, 2), key]), axis=1) if len(self.ids) * len(parts) >= (1 << 62) // (bands * most) else None
            if both is None:
                both = distinct(np.tile(pair, 2) * (bands * most) + key)
                both = np.stack([both // (bands * most), both % (bands * most)])
            held.append(both)
            begin = end
        if not held:
            return []
        pair, key = held[0] if len(held) == 1 else np.unique(np.concatenate(held, 1), axis=1)
        place, band = key % most, key // most
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
        first = np.flatnonzero(new)
        shared = np.diff(np.append(first, len(pair)))
        pair, band = pair[first], band[first] - 1
        doc, item = pair // len(self.ids), pair % len(self.ids)
        reached = shared >= self.least[item]
        doc, item, band, shared = doc[reached], item[reached], band[reached], shared[reached]
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        order = np.argsort(self.length[item], kind="stable")
        for some in np.array_split(order, math.ceil(len(order) / 64) or 1):
            for c, (edits, start, end) in zip(some, self.align(parts, doc[some], item[some], band[some]), strict=True):
                if edits <= self.budget[item[c]]:
                    at_ = (int(doc[c]), int(item[c]))
                    best[at_] = min(best.get(at_, (1 << 40, 0, 0, 0)), (edits, start, end, int(shared[c])))
        return [(d, i, s, e, edits, n) for (d, i), (edits, s, e, n) in sorted(best.items())]

    def align(self, texts: list[np.ndarray], doc: np.ndarray, item: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int]]:
        """(edits, first, end) of the closest place of each passage in its text within its band of diagonals."""
        if not len(doc):
            return []
        m, k = self.length[item], self.budget[item]
        low = band * (2 * k + 1) - m - k  # the lowest diagonal, with room for k edits
        width, rows = int((2 * (2 * k + 1) + 2 * k).max()), int(m.max())
        text = np.full((len(doc), rows + width), 0xFFFFFFFF, np.uint32)
        passage = np.zeros((len(doc), rows), np.uint32)
        for c in range(len(doc)):
            t, a = texts[doc[c]], int(low[c])
            part = t[max(a, 0) : a + rows + width]
            text[c, max(-a, 0) : max(-a, 0) + len(part)] = part
            passage[c, : m[c]] = self.codes[item[c]]
        one = np.int64(1 << 32)  # an edit; the lower half holds the diagonal on which the place begins
        cost = np.tile(np.arange(width, dtype=np.int64), (len(doc), 1))
        slope = np.arange(width, dtype=np.int64) * one
        ends: list = [None] * len(doc)
        for i in range(1, rows + 1):
            new = cost + one * (text[:, i - 1 : i - 1 + width] != passage[:, i - 1 : i])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + one)  # a character of the passage is left out
            cost = np.minimum.accumulate(new - slope, 1) + slope  # characters of the text are left out
            for c in np.flatnonzero(m == i):
                x = int(np.argmin(cost[c]))
                v = int(cost[c, x])
                first, end = int(low[c]) + (v & 0xFFFFFFFF), int(low[c]) + i + x
                ends[c] = (v >> 32, max(first, 0), min(end, len(texts[doc[c]])))
        return ends


def original(text: str, first: int, end: int) -> tuple[int, int]:
    """Where a part of the normalised text is in the text itself."""
    low = lower(text)
    places, gap, begun = [], False, False
    for i, ch in enumerate(low):
        if _NOT_WORD.match(ch):
            gap = begun
        else:
            if gap:
                places.append(i - 1)
            places.append(i)
            gap, begun = False, True
    return (places[min(first, len(places) - 1)], places[min(end, len(places)) - 1] + 1) if places else (0, 0)


def blocks(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct passages in blocks of about most_chars characters, each small enough for every task to hold."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / most_chars))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str)


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), *, most_chars: int = 2_000_000) -> DataFrame:  # noqa: B008
    """A row for each row of docs (doc_id, text) and benchmark passage (item_id, text) that occurs in it within the edit
    budget: doc_id, item_id, first and end (characters of the text, end exclusive) of the closest place, edits,
    shared_grams. Documents without a leak have no row.

    Letters are compared in lower case, and whatever isn't a letter or digit as one space. Each block of the
    benchmark makes one pass over all documents, without a shuffle; a benchmark of up to most_chars characters is
    one block. Null texts match nothing, and passages that are null or too short aren't looked for. Rows of docs
    that repeat give rows that repeat. A very long text is searched whole, in memory that grows with it, and of places
    with equally few edits the first is reported. A passage that the benchmark has twice is reported for each of its ids. Empty tables
    give no rows; other columns are ignored.
    """
    out = None
    for items in blocks(benchmark, most_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = Passages(shared.value, rule)
            for whole in batches:
                for batch in slices(whole, "text", 1 << 20):
                    texts = batch.column("text").to_pylist()
                    found = passages.search([normal(t) for t in texts])
                    if found:
                        doc = batch.column("doc_id").take(pa.array([f[0] for f in found]))
                        spans = [original(texts[f[0]], f[2], f[3]) for f in found]
                        arrays = [doc, pa.array([passages.ids[f[1]] for f in found], pa.int64()), *(pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1)), *(pa.array([f[i] for f in found], pa.int64()) for i in (4, 5))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "first", "end", "edits", "shared_grams"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, first long, end long, edits long, shared_grams long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), *, most_chars: int = 2_000_000) -> DataFrame:  # noqa: B008
    """docs without the rows that have a leak. A row goes for its own text, also where its doc_id is null or repeats;
    rows are judged where they are, once for each block of the benchmark, and nothing is shuffled."""
    for items in blocks(benchmark, most_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = Passages(shared.value, rule)
            for whole in batches:
                for batch in slices(whole, "text", 1 << 20):
                    kept = np.ones(batch.num_rows, bool)
                    kept[[f[0] for f in passages.search([normal(t) for t in batch.column("text").to_pylist()])]] = False
                    yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
