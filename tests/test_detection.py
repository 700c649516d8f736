"""Detection in blocks against one fold over everything."""

import numpy as np
import pytest

from tidewave.functions.kernels import border_states, keep_peaks
from tidewave.operators import timeseries


def plain(t, v, interval):
    """The rule as it is told: compare with the last peak, or with the largest of all candidates within the interval."""
    keep, best = [False] * len(t), None
    for i in range(len(t)):
        if best is None or t[best] < t[i] - interval:
            near = [j for j in range(i) if t[j] >= t[i] - interval]
            best = max(near, key=lambda j: (v[j], j)) if near else None
        if best is None or v[i] > v[best]:
            if best is not None:
                keep[best] = False
            keep[i], best = True, i
    return keep


def test_folds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = np.unique(rng.integers(0, 60, rng.integers(1, 40))).tolist()
        v = rng.integers(0, 6, len(t)).astype(float).tolist()
        assert keep_peaks(t, v, 5) == plain(t, v, 5)


def test_functions_of_blocks_put_together_are_the_fold():
    rng = np.random.default_rng(2)
    for _ in range(200):
        t = np.unique(rng.integers(0, 80, 60))
        v = rng.integers(0, 5, len(t)).astype(float)
        state = -1
        for block in range(8):
            inside = (t >= block * 10 - 6) & (t < (block + 1) * 10)
            first = int((t[inside] < block * 10).sum())
            if first == inside.sum():
                state = -1
                continue
            m = dict(border_states(t[inside].tolist(), v[inside].tolist(), 6, first, (block + 1) * 10))
            assert set(m) == {-1, *t[inside][:first].tolist()}
            state = m[state]
        best = -1
        for i in range(len(t)):
            keep = keep_peaks(t[: i + 1].tolist(), v[: i + 1].tolist(), 6)
            best = i if keep[i] else best
        # the last peak of the fold over all, where it is near enough to the end to matter
        if state >= 0:
            assert any(keep_peaks(t.tolist(), v.tolist(), 6)[j] for j in np.flatnonzero(t == state)) or state < t[-1]


@pytest.mark.parametrize(("width", "interval"), [(12, 7), (9, 9), (40, 3), (5, 30), (100_000, 7)])
def test_a_series_above_the_threshold_all_the_time(spark, width, interval):
    rng = np.random.default_rng(width)
    # slow waves whose peaks take over from one another across many blocks, and equal values
    x = np.round(50 + 40 * np.sin(np.arange(400) / 15) + rng.integers(0, 4, 400)) + 1000 * (np.arange(400) % 2)
    x[100:160] = np.arange(60) * 5 + 3000  # rises through several blocks
    rows = [(1, t, float(v)) for t, v in enumerate(x)] + [(2, t, float(v)) for t, v in enumerate(rng.normal(size=400))] + [(3, t, 1.0) for t in range(50)]
    df = spark.createDataFrame(rows, "channel int, t long, v double")
    want = set()
    for c in (1, 2, 3):
        v = np.array([r[2] for r in rows if r[0] == c])
        size = np.abs(v - v.mean())
        at = np.flatnonzero(size > 0.05 * v.std(ddof=1))
        want |= {(c, int(t)) for t, k in zip(at, plain(at.tolist(), size[at].tolist(), interval), strict=True) if k}
    out = timeseries.detect_events(df, threshold=0.05, interval=interval, width=width)
    assert {(r["channel"], r["t"]) for r in out.collect()} == want and len(want) > 5
