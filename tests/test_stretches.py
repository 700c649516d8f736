"""Counts and choices among crowded events, of which no pairs could be made: 30,000 by 30,000 of them lie near each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import matching, metrics, synthesis

CROWD, TIMES = 30_000, 40


def crowd(spark, first_label=1, labels=1, start=0):
    i = F.col("id")
    return spark.range(CROWD).select(i.alias("event_id"), (i % labels + first_label).cast("int").alias("label"), (i % TIMES + start).alias("time"))


def table(spark, rows):
    return spark.createDataFrame([(i, int(t), int(k)) for i, (t, k) in enumerate(rows)], "event_id long, time long, label int")


def drawn(seed, n, span, labels=3):
    rng = np.random.default_rng(seed)
    return list(zip(rng.integers(-span, span, n).tolist(), rng.integers(1, labels + 1, n).tolist(), strict=True))


def passes(a, b, most, rounds):
    """The matching by all pairs."""
    near = [(i, j) for i, (t, _) in enumerate(a) for j, (u, _) in enumerate(b) if abs(u - t) <= most]
    share = {}
    for k in {k for _, k in a}:
        for m in {k for _, k in b}:
            one = {i for i, j in near if a[i][1] == k and b[j][1] == m}
            two = {j for i, j in near if a[i][1] == k and b[j][1] == m}
            share[k, m] = min(len(one) / sum(x[1] == k for x in a), len(two) / sum(x[1] == m for x in b))
    found = set()
    for _ in range(rounds):
        best1, best2 = {}, {}
        for i, j in near:
            s, gap = -share[a[i][1], b[j][1]], abs(a[i][0] - b[j][0])
            best1[i] = min(best1.get(i, (9,)), (s, gap, b[j][0], j))
            best2[j] = min(best2.get(j, (9,)), (s, gap, a[i][0], i))
        now = {(i, z[3]) for i, z in best1.items() if best2[z[3]][3] == i}
        found |= now
        one, two = {i for i, _ in now}, {j for _, j in now}
        near = [(i, j) for i, j in near if i not in one and j not in two]
    return found


@pytest.mark.parametrize(("n", "span", "rounds"), [(150, 300, 10), (150, 20, 10), (120, 3000, 2), (150, 12, 1)])
def test_matches_are_those_of_all_pairs(spark, n, span, rounds):
    a, b = drawn(n + span, n, span), drawn(rounds, n, span)
    out = {(r["e1"], r["e2"]) for r in matching.match_events(table(spark, a), table(spark, b), 6, most_passes=rounds).collect()}
    assert out == passes(a, b, 6, rounds)


def test_a_crowd_is_matched(spark):
    a, b = crowd(spark), crowd(spark)
    c = {(r["k1"], r["k2"]): r["n"] for r in matching.confusion_matrix(matching.match_events(a, b, 50), a, b).collect()}
    assert c == {(1, 1): 10 * TIMES, (1, 0): CROWD - 10 * TIMES, (0, 1): CROWD - 10 * TIMES}


def test_partners_in_a_crowd_are_counted(spark):
    a, b = crowd(spark), crowd(spark, 2, 2, 30)
    out = {(r["k1"], r["k2"]): (r["n12"], r["n21"]) for r in matching.match_counts(a, b, 10).collect()}
    # times 20 .. 39 have a partner at 30 or later; those of label 2 are even, of label 3 odd, up to 49
    assert out == {(1, 2): (CROWD // 2, CROWD // 4), (1, 3): (CROWD // 40 * 19, CROWD // 4)}


@pytest.mark.parametrize("auto", [False, True])
def test_correlograms_are_those_of_all_pairs(spark, auto):
    rows = drawn(4, 300, 40)
    want = {}
    for i, (t, k) in enumerate(rows):
        for j, (u, m) in enumerate(rows):
            if i != j and -9 <= u - t < 9 and (k == m or not auto):
                want[k, m, (u - t + 9) // 3] = want.get((k, m, (u - t + 9) // 3), 0) + 1
    out = {(r["k1"], r["k2"], r["bin"]): r["n"] for r in metrics.cross_correlograms(table(spark, rows), 9, 3, auto=auto).collect()}
    assert {k: n for k, n in out.items() if n} == want


def test_a_crowd_has_parents(spark):
    later = crowd(spark, 2, 1, 45)
    shape = [(k, 1, t, float(t == 3) * k) for k in (1, 2) for t in range(8)]
    means = spark.createDataFrame(shape, "label int, channel int, t int, v double")
    both = crowd(spark).unionByName(later)
    assert {r["label"]: r["bursting_parent"] for r in metrics.bursting_parents(both, means, window=100).collect()} == {1: 0, 2: 0}
    assert {r["label"]: r["bursting_parent"] for r in metrics.bursting_parents(both, means.withColumn("v", F.when(F.col("t") == 3, F.lit(1.0)).otherwise(F.lit(0.0))), window=100).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("span", [15, 200, 4000])
def test_the_sweep_counts_what_all_pairs_do(spark, span):
    a, b = drawn(span, 200, span), drawn(5, 200, span)
    order, want = sorted(range(200), key=lambda i: (a[i][0], i)), {}
    for at, i in enumerate(order):
        t, before = a[i][0], a[order[at - 1]][0] if at else -(10**9)
        near = [j for j in range(200) if abs(b[j][0] - t) <= 10]
        last = max(((b[j][0], j) for j in near if b[j][0] < t), default=None)
        for j in near:
            if b[j][0] > before + 10 or b[j][0] >= t or (b[j][0], j) == last:
                want[a[i][1], b[j][1]] = want.get((a[i][1], b[j][1]), 0) + 1
    out = {(r["k1"], r["k2"]): r["n"] for r in matching.loose_confusion(table(spark, a), table(spark, b), 10).collect()}
    assert out == want


def test_a_crowd_is_swept(spark):
    out = matching.loose_confusion(crowd(spark), crowd(spark), 50).first()["n"]
    each = CROWD // TIMES
    # at each time all events meet the later ones, and the last one before; the first event of all meets no earlier one
    assert out == sum(each * each * (TIMES - t) + (each if t else 0) for t in range(TIMES))


@pytest.mark.parametrize(("kind", "gap", "widths"), [("long", 7, 1024), ("long", 7, 2), ("double", 3.3, 4), ("double", 0.1, 8)])
def test_a_long_chain_keeps_its_distance(spark, kind, gap, widths):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 3000, 6000).tolist() if kind == "long" else np.round(rng.uniform(-900, 900, 6000), 1).tolist()
    rows = [(i, x, None if i % 11 == 0 else i % 2) for i, x in enumerate(t)]
    want, last = set(), {}
    for i, x, k in sorted(rows, key=lambda r: (r[1], r[0])):
        if k not in last or x - last[k] >= gap:
            want.add(i)
            last[k] = x
    df = spark.createDataFrame(rows, f"event_id long, time {kind}, label int")
    assert {r["event_id"] for r in synthesis.enforce_refractory(df, gap, widths=widths).collect()} == want
