"""Runs of repeating words within texts, found with a suffix automaton and merged sets of end positions."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewave.llm.common import free_name, slices, table

#: Words a run has at least, and how many times its period.
LEAST, TIMES = 6, 4
#: Each string of so many words within a run occurs again in it, as far away as the run's period (see stretches).
GRAM = 5


class Places:
    """An ordered set of integers in blocks, so that adding one moves a bounded number of others."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.n = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Adds x; the neighbours that it then has."""
        heads, blocks = self.heads, self.blocks
        k = max(0, bisect_left(heads, x) - 1)
        block = blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else blocks[k - 1][-1] if k else None
        after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        block.insert(i, x)
        heads[k] = block[0]
        self.n += 1
        if len(block) > 2048:
            blocks[k : k + 1] = [block[:1024], block[1024:]]
            heads[k : k + 1] = [block[0], block[1024]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string, first end position or -1 for copies) of each state of the
    suffix automaton of a list of words. A state's only transition is kept in two integers, more of them in a dict."""
    link, size, end = [-1], [0], [-1]
    word: list[int] = [-1]  # of a state's first transition
    to: list[int] = [-1]
    more: list[dict[int, int] | None] = [None]
    last = 0
    for at, w in enumerate(words):
        new = len(link)
        link.append(0)
        size.append(size[last] + 1)
        end.append(at)
        word.append(-1)
        to.append(-1)
        more.append(None)
        p, q = last, -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            else:
                rest = more[p]
                if rest is None:
                    more[p] = {w: new}
                elif w in rest:
                    q = rest[w]
                    break
                else:
                    rest[w] = new
            p = link[p]
        if q >= 0:
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(-1)
                word.append(word[q])
                to.append(to[q])
                more.append(dict(more[q]) if more[q] else None)
                while p >= 0:
                    if word[p] == w and to[p] == q:
                        to[p] = copy
                    elif more[p] and more[p].get(w) == q:
                        more[p][w] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return link, size, end


def seeds(words: list[int], times: int) -> dict[tuple[int, int], int]:
    """(start, period) -> end of the runs of at least `times` periods in a list of words.

    Sets of end positions go up the suffix links, the smaller one into the larger. Where that makes two end positions
    neighbours in a state, the state's longest string is the longest that ends at both: what ends at the later one
    repeats with their distance, and begins where the repetition can't be extended. It has enough periods when
    times - 1 distances fit into the state's length. A run's last such pair gives its end. If two neighbours are so near,
    nothing smaller is a period, else there would be an end position between them.
    """
    link, size, end = automaton(words)
    found: dict[tuple[int, int], int] = {}
    sets: list[Places | None] = [None] * len(link)
    for v in sorted(range(1, len(link)), key=size.__getitem__, reverse=True):
        own = sets[v]
        if own is None:
            own = Places(end[v])
        elif end[v] >= 0:
            put(own, (end[v],), size[v], times, found)
        sets[v] = None
        up = link[v]
        if up <= 0:
            continue  # the root has no strings
        there = sets[up]
        if there is None:
            if end[up] < 0:
                sets[up] = own
                continue
            there = Places(end[up])
            end[up] = -1
        if there.n < own.n:
            there, own = own, there
        sets[up] = there
        put(there, own, size[up], times, found)
    return found


def put(into: Places, places, size: int, times: int, found: dict[tuple[int, int], int]) -> None:
    """Adds end positions, ascending, to a state's set, and what the neighbours from both sets say to the runs. Two of one set
    that are neighbours have been so in a state of longer strings."""
    last = after = None
    for x in places:
        before, following = into.add(x)
        if last is None or before != last:
            if after is not None and (times - 1) * (after - last) <= size:
                note(found, last, after, size)
            if before is not None and (times - 1) * (x - before) <= size:
                note(found, before, x, size)
        last, after = x, following
    if after is not None and (times - 1) * (after - last) <= size:
        note(found, last, after, size)


def note(found: dict[tuple[int, int], int], one: int, two: int, size: int) -> None:
    key = (one - size + 1, two - one)
    if found.get(key, -1) < two:
        found[key] = two


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Parts of a list of words outside of which there is no run.

    Let a run have period q and length of at least max(6, 4 q). A string of five words in it that begins at i also
    begins at i + q if that is within the run, and else at i - q: then i is at least the run's length less q less 4 after
    its begin, which is q or more (for q = 1 because there are six words). So a run lies in a stretch each of whose
    strings of five words occurs again in the stretch. Strings are compared by a hash, of which equal values
    make a stretch longer only. Other limits than (6, 4) take the whole list.
    """
    n = len(ids)
    if n < least:
        return []
    if (least, times) != (LEAST, TIMES):
        return [(0, n)]
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = (h ^ x[k : n - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ordered = np.sort(h)
    same = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(same):
        return []
    place = np.searchsorted(same, h)
    at = np.flatnonzero(same[np.minimum(place, len(same) - 1)] == h)
    while len(at):  # each round leaves out what occurs again in other stretches only
        group = np.cumsum(np.diff(at, prepend=at[0]) > 1)
        order = np.lexsort((h[at], group))
        g, k = group[order], h[at[order]]
        equal = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
        keep = np.zeros(len(at), bool)
        keep[order[1:][equal]] = keep[order[:-1][equal]] = True
        if keep.all():
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            return [(int(a[0]), int(a[-1]) + GRAM) for a in np.split(at, starts[1:])]
        at = at[keep]
    return []


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a list of words, by start and period: stretches of at least `least` words and
    `times` periods, of smallest period, that can't be extended. least is at most times + 2 only where a period of
    one word is meant to need more than `times` words."""
    out = []
    for first, last in stretches(ids, least, times):
        for (start, period), end in seeds(ids[first:last].tolist(), times).items():
            length = end - start + 1
            if length >= max(least, times * period):
                out.append((first + start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words into which a repetition is put, for one in ten ids."""
    if doc_id is None or n == 0:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those of a run after its first period."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES, keep_text: bool = False, plant: bool = False, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Finds the runs of repeating words of every whole text of docs (doc_id, text, ...) and takes them out.

    Words are what stands between ASCII white space. A run is a stretch of at least max(least, times * period) words of
    which those a period apart are equal, with the smallest such period, that can't be extended; collapsing it
    leaves its first period. plant puts a repetition into the texts of one in ten ids first, by a rule of the id.

    A null or empty text has no words and no runs. A null doc_id gets nothing planted. Rows that repeat give rows that
    repeat; an empty table gives none. Of runs equally long the first is reported, of those the one with the smaller period.
    There is one pass over the rows without a shuffle. What a task holds grows with its longest text, and the
    automaton with that text's repeating stretches. Columns not in carry are ignored.

    Returns the columns in carry, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256,
    collapsed_sha256, and with keep_text runs (array of start, length, period) and collapsed.
    """
    fields = [f for f in docs.schema.fields if f.name in carry]
    names = [f.name for f in fields]
    source, id_ = free_name(carry, "text"), free_name([*carry, "text"], "id")
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    made = ", ".join([*(f"{n} long" for n in numbers), "runs_sha256 string, collapsed_sha256 string"]) + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * keep_text
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {n: pa.int64() for n in numbers} | {"runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
        if keep_text:
            kinds |= {"runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string()}
        for whole in batches:
            for batch in slices(whole, source):
                out: dict[str, list] = {k: [] for k in kinds}
                for doc_id, text in zip(batch.column(id_).to_pylist(), batch.column(source).cast(pa.large_binary()), strict=True):
                    words = (text.as_py() or b"").split()  # on ASCII white space
                    known: dict[bytes, int] = {}
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                    if plant and (index := planted(doc_id, len(words))) is not None:
                        ids, words = ids[index], [words[i] for i in index.tolist()]
                    found = runs(ids, least, times)
                    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                    text_left = collapsed(words, found)
                    values = [len(found), *(best or [None] * 3), best and 1000 * best[1] // best[2]]
                    values += [hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(text_left).hexdigest()]
                    if keep_text:
                        values += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found], text_left.decode()]
                    for k, v in zip(kinds, values, strict=True):
                        out[k].append(v)
                arrays = [pa.array(out[k], t) for k, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *kinds])

    ids = docs["doc_id"].cast("long").alias(id_)
    return docs.select(*[docs[n] for n in names], docs["text"].cast("string").alias(source), ids).mapInArrow(run, schema)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
