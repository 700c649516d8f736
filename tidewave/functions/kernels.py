"""Small numeric helpers that run on one bounded group at a time inside Spark tasks."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])


def compared(t, v, interval: float, best: int, i: int) -> int:  # type: ignore[no-untyped-def]
    """What candidate i is compared with: the last peak while that lies within `interval` before it, else the largest candidate
    there (of equals the latest), suppressed or not, or -1 if there is none."""
    if best >= 0 and t[best] >= t[i] - interval:
        return best
    best, j = -1, i - 1
    while j >= 0 and t[j] >= t[i] - interval:
        if best < 0 or v[j] > v[best]:
            best = j
        j -= 1
    return best


def keep_peaks(t, v, interval: float, first: int = 0, best: int = -1) -> list[bool]:  # type: ignore[no-untyped-def]
    """Which candidates (ascending times t, sizes v) stay, from the first-th on, when `best` is the last peak before (-1: none
    within the interval). A candidate stays if it is larger than what it is compared with or nothing is there, and then
    what it was compared with goes."""
    keep = [False] * len(t)
    for i in range(first, len(t)):
        best = compared(t, v, interval, best, i)
        if best < 0 or v[i] > v[best]:
            if best >= 0:
                keep[best] = False
            keep[i], best = True, i
    return keep


def border_states(t, v, interval: float, first: int, end: float) -> list[tuple[int, int]]:  # type: ignore[no-untyped-def]
    """The fold of keep_peaks over a block as a function: for each last peak that there may be before the block's first
    candidate (-1, or one of those ahead of it), the last peak at its end (-1 where that is too far back to matter), both
    as times. Equal states are followed as one, so that a block costs little more than one fold once they have met."""
    now: dict[int, list[int]] = {s: [s] for s in range(-1, first)}
    for i in range(first, len(t)):
        after: dict[int, list[int]] = {}
        for s, starts in now.items():
            best = compared(t, v, interval, s, i)
            after.setdefault(i if best < 0 or v[i] > v[best] else best, []).extend(starts)
        now = after
    far = lambda s: -1 if s < 0 or t[s] < end - interval else int(t[s])
    return sorted((-1 if s0 < 0 else int(t[s0]), far(s)) for s, starts in now.items() for s0 in starts)


def bandpass_gain(n: int, samplerate: float, freq_min: float, freq_max: float, freq_wid: float) -> np.ndarray:
    """Gain at the frequencies of a real transform of n samples: smooth edges from error functions, 0 at frequency 0
    when there is a lower edge."""
    f = np.abs(np.fft.rfftfreq(n, 1 / samplerate))
    gain = np.ones(len(f))
    if freq_min:
        gain *= (1 + _erf(3 * (f - freq_min) / freq_min)) / 2
        gain[0] = 0
    if freq_max:
        gain *= (1 - _erf((f - freq_max) / freq_wid)) / 2
    return np.sqrt(gain)


def filter_signal(x: np.ndarray, samplerate: float, freq_min: float, freq_max: float, freq_wid: float) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(x) * bandpass_gain(len(x), samplerate, freq_min, freq_max, freq_wid), len(x))


def principal_axes(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading directions of the rows of x (no mean is taken off), as columns; signs make the largest entry positive."""
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :k]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def isotonic(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least-squares nondecreasing fit, its squared error over each beginning of y)."""
    blocks: list[list[float]] = []  # weight, sum, sum of squares, entries
    fit_error, error = np.zeros(len(y)), 0.0
    cost = lambda b: b[2] - b[1] * b[1] / b[0]
    for i, (a, b) in enumerate(zip(y, w, strict=True)):
        blocks.append([b, a * b, a * a * b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            error -= cost(blocks[-1]) + (cost(last) if last[3] > 1 else 0)
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
            error += cost(blocks[-1])
        fit_error[i] = max(error, 0.0)
    return np.concatenate([np.full(int(b[3]), b[1] / b[0]) for b in blocks]) if blocks else np.zeros(0), fit_error


def unimodal(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least-squares fit that first rises and then falls."""
    up, down = isotonic(y, w)[1], isotonic(y[::-1], w[::-1])[1][::-1]
    peak = int(np.argmin(up + np.append(down[1:], 0)))
    return np.concatenate([isotonic(y[: peak + 1], w[: peak + 1])[0], isotonic(y[peak + 1 :][::-1], w[peak + 1 :][::-1])[0][::-1]])


def largest_gap(seen: np.ndarray, fitted: np.ndarray, peak: int) -> tuple[float, int, int]:
    """(largest scaled distance of two cumulated counts, first and end of the range that has it). Both sides of the fit's
    peak are looked at, each in ranges from its outer end, each half as long as the one before: a small second
    peak far from the bulk shows in a short range. The scale is the root of the mean of both counts in the range."""
    n, best = len(seen), (-1.0, 0, len(seen))
    for from_left, size in ((True, peak + 1), (False, n - peak)):
        whole = size
        while size >= 4 or size == whole:
            first = 0 if from_left else n - size
            a, b = seen[first : first + size], fitted[first : first + size]
            if a.sum() > 0 and b.sum() > 0:
                x, y = (a, b) if from_left else (a[::-1], b[::-1])
                gap = float(np.abs(np.cumsum(x) / x.sum() - np.cumsum(y) / y.sum()).max() * math.sqrt((a.sum() + b.sum()) / 2))
                best = max(best, (gap, first, first + size))
            if size < 2:
                break
            size //= 2
    return max(best[0], 0.0), best[1], best[2]


def tapered(n: float) -> np.ndarray:
    """Ranks from 0 to n - 1, about the root of their number, closer to one another towards both ends."""
    half = max(2, math.ceil(math.sqrt(n / 2) / 2))
    steps = np.concatenate([np.arange(1, half + 1), np.arange(half, 0, -1)]).astype(float)
    return np.concatenate([[0], np.cumsum(steps * (n - 1) / steps.sum())])


def dip_between(knots: np.ndarray, inside: np.ndarray, least: float) -> tuple[float, float]:
    """(dip, cut) for counts between knots: densities from spacings are fitted by a curve with one peak, and the dip is the
    largest gap of counts to that curve. From the range that has it to the peak, the density is fitted by a curve with
    one valley, and the cut lies where the density is least in that valley."""
    spacing = np.maximum(np.diff(knots), least)
    density = inside / spacing
    fit = unimodal(density, inside)
    peak = int(fit.argmax())
    dip, first, end = largest_gap(inside, fit * spacing, peak)
    first, end = min(first, peak), max(end, peak + 1)
    valley = -unimodal(-density[first:end], spacing[first:end])
    bottom = first + np.flatnonzero(valley <= valley.min() * (1 + 1e-12))
    at = int(bottom[density[bottom].argmin()])
    return dip, float((knots[at] + knots[at + 1]) / 2)


def dip_cut(values: np.ndarray) -> tuple[float, float]:
    """(dip, cut): how far the values' density is from having one peak, and where to cut between two. Sorted values are
    thinned, more finely towards both ends."""
    x = np.sort(values)
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 0.0, float(x[n // 2]) if n else 0.0
    picks = np.unique(np.floor(tapered(n) + 1e-9).astype(int))
    picks[-1] = n - 1
    return dip_between(x[picks], np.diff(picks).astype(float), 1e-12 * max(abs(x[0]), abs(x[-1]), 1.0))


def dip_of_counts(counts: np.ndarray, edges: np.ndarray, least: int = 6, ratio: float = 1.2) -> tuple[float, float]:
    """The same for counts in bins, within which values are taken to lie evenly. Knots are `least` values apart at both
    ends and from there on by a fifth of the values outside of them, so that a small second peak far from the bulk
    shows alike whatever the number of values in the bulk."""
    n = float(counts.sum())
    used = np.flatnonzero(counts)
    if n < 4 or len(used) < 2:
        return 0.0, float((edges[used[0]] + edges[used[0] + 1]) / 2) if len(used) else 0.0
    ranks, step = [0.0], float(least)
    while ranks[-1] + step < n / 2:
        ranks.append(ranks[-1] + step)
        step = max(float(least), (ratio - 1) * ranks[-1])
    ranks = np.unique([*ranks, n / 2, *(n - r for r in ranks)])
    first, end = int(used[0]), int(used[-1]) + 1
    upto = np.concatenate([[0], np.cumsum(counts[first:end])])
    # where the cumulated counts are flat there are empty bins; the small slope keeps knots on either side apart
    knots = np.interp(ranks, upto + np.arange(len(upto)) * 1e-9, edges[first : end + 1])
    return dip_between(knots, np.diff(ranks), 1e-12 * max(abs(edges[0]), abs(edges[-1]), 1.0))


def assignment(gain: np.ndarray) -> list[int]:
    """For each row the column, or -1, of the one-to-one choice with the largest total gain, by shortest augmenting paths."""
    rows, cols = gain.shape
    size = max(rows, cols)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : rows + 1, 1 : cols + 1] = -gain
    u, v, owner = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        owner[0], j, least, done, back = i, 0, np.full(size + 1, np.inf), np.zeros(size + 1, bool), np.zeros(size + 1, int)
        while True:
            done[j] = True
            slack = cost[owner[j]] - u[owner[j]] - v
            better = ~done & (slack < least)
            better[0] = False
            least[better], back[better] = slack[better], j
            open_ = np.where(done, np.inf, least)
            open_[0] = np.inf
            nxt = int(open_.argmin())
            step = open_[nxt]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    out = [-1] * rows
    for j in range(1, cols + 1):
        if 1 <= owner[j] <= rows:
            out[owner[j] - 1] = j - 1
    return out
