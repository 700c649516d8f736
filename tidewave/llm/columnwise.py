"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Round t inserts one symbol for each string: the suffix of length t. The sorted list of all suffixes so far is never
compared symbol by symbol: where a new suffix goes follows from how many equal symbols the transform has before the
string's last insertion, and its common prefix with the suffix before it is one more than the least common prefix on
the way back to the last equal symbol. Transform and prefixes are only looked up in most rounds. What the last rounds
inserted is kept beside them, in order and with its place among them, and merged into them every so many rounds: reading
and writing everything in each round would cost the square of a string's length. They can live in files.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np


class Columns:
    """Stores for the transform and the common prefixes; in memory, or as files in a folder. What is read can be changed in
    place until it is written anew."""

    def __init__(self, folder: str | None = None):
        self.folder, self.held = folder, {}

    def read(self, name: str, kind: type) -> np.ndarray:
        return self.held[name] if self.folder is None else np.memmap(Path(self.folder, name), kind, "r+")

    def write(self, name: str, values: np.ndarray) -> None:
        if self.folder is None:
            self.held[name] = values
        else:
            values.tofile(Path(self.folder, name + ".new"))
            Path(self.folder, name + ".new").replace(Path(self.folder, name))

    def clear(self) -> None:
        self.held = {}
        for name in ("symbols", "common") if self.folder else ():
            Path(self.folder, name).unlink(missing_ok=True)


def build(strings: list[bytes], store: Columns | None = None, watch: int = 0, rounds: int = 24) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(transform, common prefixes, repeated) of the strings.

    The transform holds byte + 1, or 0 before a whole string; entry i of the prefixes is how many symbols suffix i
    shares with suffix i - 1. Ends of strings are different symbols. With watch, repeated[i] holds for each of
    string i's suffixes of at least `watch` symbols, by start, whether it shares that many with some other suffix.

    Between rounds the transform is kept by symbol: ascending (symbol, place) in one number each, so that an entry's
    rank among equal symbols is its index. The store has it between two bounds, and the prefixes with a 0 after them.
    Insertions since the last merge are kept likewise, with places among themselves; `gap` says how many suffixes of
    the store are before each. `rounds` is how many are merged at once; it doesn't change the result.
    """
    store = store or Columns()
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(0, np.int32), []
    length = np.array([len(s) for s in strings])
    most = int(length.max())
    kind, bits = (np.int32, 22) if length.sum() + n < 1 << 22 else (np.int64, 40)  # symbols above, places below
    low_bits, one = kind((1 << bits) - 1), kind(1 << bits)
    column = np.zeros((most + 1, n), kind)  # column[t]: the symbol before each suffix of length t
    for i, s in enumerate(strings):
        column[: len(s), i] = np.frombuffer(s, np.uint8)[::-1].astype(kind) + kind(1)
    column <<= kind(bits)
    store.write("symbols", np.array([-1, np.iinfo(kind).max], kind))
    store.write("common", np.zeros(1, np.int32))
    entries, common = store.read("symbols", kind), store.read("common", np.int32)
    added = column[0] | np.arange(n, dtype=kind)
    who = np.argsort(added)  # strings that go on, and the index of each one's last entry
    rank = np.arange(n)
    held, gap, near = added[who], np.zeros(n, kind), np.zeros(n + 1, np.int32)
    for t in range(1, most + 1):
        going = length[who] >= t
        if not going.all():
            who, rank = who[going], rank[going]
        if not len(who):
            break
        here, mine = held[rank], held & low_bits
        symbol, at = here >> bits, mine[rank]
        inner = gap[at]
        index = np.searchsorted(entries, here - at.astype(kind) + inner)
        # the nearest equal symbols before and after, in the store and among those held
        far, close = entries[index - 1], held[np.maximum(rank - 1, 0)]
        is_far, is_close = far >> bits == symbol, (rank > 0) & (close >> bits == symbol)
        far, close, same = far & low_bits, close & low_bits, is_far | is_close
        lower = np.where(same, np.maximum((far + 1) * is_far, gap[close] * is_close), inner)
        lower_near = np.where(same, np.maximum(np.searchsorted(gap, far, "right") * is_far, (close + 1) * is_close), at + 1)
        far, close = entries[index], held[np.minimum(rank + 1, len(held) - 1)]
        is_far, is_close = far >> bits == symbol, (rank + 1 < len(held)) & (close >> bits == symbol)
        far, close, same_after = far & low_bits, close & low_bits, is_far | is_close
        upper = np.where(same_after, np.minimum(np.where(is_far, far + 1, low_bits), np.where(is_close, gap[close], low_bits)), inner)
        upper_near = np.where(same_after, np.minimum(np.where(is_far, np.searchsorted(gap, far, "right"), len(held)), np.where(is_close, close + 1, len(held))), at + 1)
        stored = least(common, np.append(lower, inner), np.append(inner, upper))
        kept_back = least(near, np.append(lower_near, at + 1), np.append(at + 1, upper_near))
        up, down = ((np.minimum(stored, kept_back) + 1) * np.append(same, same_after)).reshape(2, -1)
        # suffixes of no symbols come first, then the others as their first symbols stand in the transform
        whole = np.searchsorted(entries, one) + np.searchsorted(held, one)
        before = (n - whole + index + rank - np.arange(len(who))).astype(kind)  # older suffixes
        places = gap + np.arange(len(gap), dtype=kind)
        fresh = np.searchsorted(places, before)
        outer = (before - fresh).astype(kind)
        # the older suffix after a new one, or after the last of several in a row
        last = np.append(before[1:] != before[:-1], True)
        beside = np.append(places, kind(-1))[fresh] == before
        near[fresh[last & beside]] = down[last & beside]
        follows = last & ~beside & (outer < len(common) - 1)
        common[outer[follows]] = down[follows]
        fresh = fresh + np.arange(len(fresh))
        old = others(fresh, len(gap) + len(fresh))
        gap, near = spliced(old, gap, fresh, outer), spliced(np.append(old, len(old) + len(fresh)), near, fresh, up)
        held += old.astype(kind)[mine] - mine
        added = column[t, who] | fresh.astype(kind)
        by_symbol = np.argsort(added)
        added, who = added[by_symbol], who[by_symbol]
        rank = np.searchsorted(held, added) + np.arange(len(added))
        old = others(rank, len(held) + len(rank))
        held = spliced(old, held, rank, added)
        if t % rounds == 0:  # the new ones stay
            kept = np.zeros(len(gap), bool)
            kept[fresh] = True
            entries, common = merge(store, bits, held[old], gap, near, kept)
            gap, near = gap[kept] + np.cumsum(~kept)[kept].astype(kind), np.append(near[:-1][kept], np.int32(0))
            held = held[rank]
            held += (np.cumsum(kept) - 1).astype(kind)[held & low_bits] - (held & low_bits)
            rank = np.arange(len(held))
    entries, common = merge(store, bits, held, gap, near, np.zeros(len(gap), bool))
    entries, common = entries[1:-1], common[:-1]
    store.clear()
    symbols = np.empty(len(entries), np.uint16)
    symbols[entries & low_bits] = entries >> bits
    return symbols, common, repeated(entries, common, n, length, watch, bits) if watch else []


def spliced(old: np.ndarray, values: np.ndarray, at: np.ndarray, added: np.ndarray) -> np.ndarray:
    """values in the places old and added in the places at."""
    out = np.empty(len(old) + len(at), values.dtype)
    out[old], out[at] = values, added
    return out


def others(at: np.ndarray, n: int) -> np.ndarray:
    """The numbers below n that aren't in at."""
    left = np.ones(n, bool)
    left[at] = False
    return np.flatnonzero(left)


def merge(store: Columns, bits: int, held: np.ndarray, gap: np.ndarray, near: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts what is held, but for the kept, into the store, and reads it; held: the entries of what goes there, by symbol."""
    kind = held.dtype.type
    entries, common = store.read("symbols", kind), store.read("common", np.int32)
    low_bits = kind((1 << bits) - 1)
    at = gap + np.cumsum(~kept).astype(kind) - kind(1)  # in the store, of those that go there
    new = at[~kept]
    old = others(new, len(common) + len(new))  # with the 0 after all
    store.write("common", spliced(old, common, new, near[:-1][~kept]))
    places = entries[1:-1] & low_bits
    entries[1:-1] += old.astype(kind)[places] - places
    places = held & low_bits
    held = held + (at[places] - places)
    new = np.searchsorted(entries, held) + np.arange(len(held))
    store.write("symbols", spliced(others(new, len(entries) + len(new)), entries, new, held))
    return store.read("symbols", kind), store.read("common", np.int32)


def least(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[first:end], the largest number where that is nothing. values has one more entry than is asked for."""
    size = end - first
    out = np.where(size > 0, values[first], np.iinfo(np.int32).max - 1)
    pick = np.flatnonzero(size > 1)
    pick = pick[np.argsort(first[pick])[::-1]]  # downwards, so that what lies between two isn't read
    if len(pick):
        cuts = np.empty((len(pick), 2), np.int64)
        cuts[:, 0], cuts[:, 1] = first[pick], end[pick]
        out[pick] = np.minimum.reduceat(values, cuts.ravel())[::2]
    return out


def repeated(entries: np.ndarray, common: np.ndarray, n: int, length: np.ndarray, watch: int, bits: int) -> list[np.ndarray]:
    """Walks each string through the finished transform, from its end to its start."""
    step = np.empty(len(entries), np.int64)
    one = entries.dtype.type(1 << bits)
    step[entries & (one - 1)] = np.arange(len(entries)) + n - np.searchsorted(entries, one)
    shared = np.append(common >= watch, False)
    shared = shared[:-1] | shared[1:]
    size = np.maximum(0, length - watch + 1)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1], bool)
    place = np.arange(n)
    for t in range(1, int(length.max()) + 1):
        going = np.flatnonzero(length >= t)
        place[going] = step[place[going]]
        if t >= watch:
            found = going[shared[place[going]]]
            out[(ends - size + length - t)[found]] = True
    return np.split(out, ends[:-1])
