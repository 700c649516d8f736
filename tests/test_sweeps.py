"""Sweeps that use events up, and decisions in rounds, against the loops that they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import joins, matching, sorting


def table(spark, rows):
    return spark.createDataFrame([(i, float(t), int(k)) for i, (t, k) in enumerate(rows)], "event_id long, time double, label int")


def test_previous_times(spark):
    rng = np.random.default_rng(1)
    rows = sorted(zip(rng.integers(0, 3000, 500).tolist(), rng.integers(1, 4, 500).tolist(), strict=True))
    out = {r["event_id"]: r["p"] for r in joins.with_previous(table(spark, rows), ["label"], "time", "event_id", 9, "p").collect()}
    assert len(out) == 500
    for i, (t, k) in enumerate(rows):
        before = [u for u, j in rows[:i] if j == k]
        assert out[i] == (before[-1] if before and t - before[-1] <= 9 else None)


def pointer_sweep(a, b, tolerance):
    """Two pointers: events of b within reach of the current one of a are counted and passed; on the way to a's next one the
    pointer steps back over what isn't before that one, and one further."""
    counts, j = {}, 0
    for i, (t1, k1) in enumerate(a):
        if i:
            j = min(j, len(b) - 1)
            while j > 0 and b[j][0] >= t1:
                j -= 1
        while j < len(b) and b[j][0] <= t1 + tolerance:
            if b[j][0] >= t1 - tolerance:
                counts[k1, b[j][1]] = counts.get((k1, b[j][1]), 0) + 1
            j += 1
    return counts


@pytest.mark.parametrize("spread", [60, 400, 3000])
def test_loose_confusion_is_the_sweep(spark, spread):
    rng = np.random.default_rng(spread)
    draw = lambda n: sorted(zip(rng.integers(0, spread, n).tolist(), rng.integers(1, 4, n).tolist(), strict=True))
    a, b = draw(90), draw(120) + [(spread + 500, 1)]  # one far behind all, so that the pointer never falls off the end
    out = {(r["k1"], r["k2"]): r["n"] for r in matching.loose_confusion(table(spark, a), table(spark, b), 10).collect()}
    assert out == pointer_sweep(a, b, 10)


def test_links_by_the_sweep(spark):
    rng = np.random.default_rng(4)
    t = np.arange(0, 6000, 40)
    k = rng.integers(1, 4, len(t))
    a, b = table(spark, list(zip(t, k, strict=True))), table(spark, list(zip(t + rng.integers(-2, 3, len(t)), 4 - k, strict=True)))
    for sweep in (False, True):
        assert {r["label"]: r["linked_label"] for r in matching.link_labels(a, b, sweep=sweep).collect()} == {1: 3, 2: 2, 3: 1}


def sequential(times, pairs, order, reach, share):
    kept = []
    for k in order:
        others = sorted(t + lag for k1, k2, lag in pairs if k1 == k and k2 in kept for t in times[k2])
        count, j = 0, 0
        for t in sorted(times[k]):
            while j < len(others) and others[j] < t - reach:
                j += 1
            hit = False
            while j < len(others) and others[j] <= t + reach:
                hit, j = True, j + 1
            count += hit
        if not (others and count and count >= share * len(times[k])):
            kept.append(k)
    return set(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_decide_as_one_after_another(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    base = {k: rng.integers(0, 2000, rng.integers(20, 60)) for k in range(1, 10)}
    for k in (3, 5, 6, 9):  # repeats of others
        base[k] = base[k - 1 - k % 2] + rng.integers(-3, 4, len(base[k - 1 - k % 2]))
    times = {k: v.tolist() for k, v in base.items()}
    peaks = {k: float(p) for k, p in zip(base, rng.permutation(9) + 1, strict=True)}
    order = sorted(peaks, key=lambda k: -peaks[k])
    pairs = [(a, b, int(rng.integers(-2, 3))) for a in base for b in base if a != b and rng.random() < 0.6]
    rows = table(spark, [(t, k) for k, v in times.items() for t in v])
    means = spark.createDataFrame([(k, 1, 0, p) for k, p in peaks.items()], "label int, channel int, t int, v double")
    central = means.select("label", F.lit(1).alias("m"))
    monkeypatch.setattr(sorting, "best_lags", lambda *_: spark.createDataFrame(pairs, "k1 int, k2 int, lag int"))
    out = sorting.merge_across_channels(rows, means, central, reach=4, share=0.5).select("label").distinct().collect()
    assert {r["label"] for r in out} == sequential(times, pairs, order, 4, 0.5)
