"""Nearest neighbours against brute force."""

import tracemalloc

import numpy as np
import pytest

from tidewave.operators import neighbours
from tidewave.operators.neighbours import fitted, nearest, nearest_of


def brute(points, queries, k):
    out = {}
    for qid, f, wanted, but in queries:
        d = sorted((float(((np.array(p) - f) ** 2).sum()), i, label) for i, label, p in points if (wanted is None or label in wanted) and i != but)
        out[qid] = [(i, label) for _, i, label in d[:k]]
    return out


def run(spark, points, queries, k, **options):
    p = spark.createDataFrame([(i, label, list(map(float, f))) for i, label, f in points], "id long, label int, f array<double>").repartition(3)
    q = spark.createDataFrame([(i, list(map(float, f)), w, b) for i, f, w, b in queries], "qid long, f array<double>, wanted array<int>, but long")
    out = {}
    for r in nearest(p, q, k, **options).orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["id"], r["label"]))
    return out


def test_every_point_has_a_leaf_and_no_near_leaf_is_missed():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 3)) * 2)  # many equal values
    tree = fitted(x, 40)
    leaf = tree.leaf(x)
    assert leaf.min() >= 0 and leaf.max() < tree.leaves and 20 < tree.leaves <= 40
    q, radius = rng.normal(size=(60, 3)) * 3, rng.random(60) * 4
    rows, to = tree.reached(q, radius)
    visited = set(zip(rows.tolist(), to.tolist(), strict=True))
    for i in range(60):
        assert {(i, int(leaf[j])) for j in np.flatnonzero(((x - q[i]) ** 2).sum(1) <= radius[i])} <= visited
    assert len(visited) < 60 * tree.leaves / 2  # most leaves are ruled out
    assert fitted(np.ones((9, 2)), 5).leaves == 1


@pytest.mark.parametrize(("k", "leaf_rows", "hot"), [(1, 10, 20_000), (4, 25, 3), (3, 10_000, 20_000)])
def test_neighbours_are_those_of_brute_force(spark, monkeypatch, k, leaf_rows, hot):
    monkeypatch.setattr(neighbours, "HOT", hot)  # crowded leaves are copied
    rng = np.random.default_rng(k)
    points = [(i, int(rng.integers(1, 5)), np.round(rng.normal(size=3) * 3)) for i in range(240)]
    points += [(1000 + i, 1 + i % 2, np.ones(3)) for i in range(80)]  # one vector has a quarter of the rows
    queries = [(i, f, None, i) for i, _, f in points[:120]] + [(2000 + i, rng.normal(size=3) * 4, [[1], [2, 3], [9], None][i % 4], None) for i in range(40)]
    want = {q: z for q, z in brute(points, queries, k).items() if z}
    assert run(spark, points, queries, k, leaf_rows=leaf_rows) == want


def test_fewer_points_than_asked_for(spark):
    assert run(spark, [(1, 1, [0.0]), (2, 1, [5.0])], [(7, [4.0], None, None)], 5) == {7: [(2, 1), (1, 1)]}
    assert run(spark, [], [(7, [4.0], None, None)], 5) == {}


def test_leaves_that_the_sample_cannot_tell_apart_are_dealt_into_cells(spark):
    begin, cells = neighbours.cells_of(np.array([10, 95, 0, 20, 21]), 10)
    assert begin.tolist() == [0, 1, 11, 12, 13] and cells.tolist() == [1, 10, 1, 1, 3]
    rng = np.random.default_rng(7)
    points = [(i, int(rng.integers(1, 5)), np.round(rng.normal(size=3) * 3)) for i in range(300)]
    queries = [(i, f, None, i) for i, _, f in points[:60]] + [(2000 + i, points[i][2], [[1], [2, 3], None][i % 3], None) for i in range(30)]
    want = {q: z for q, z in brute(points, queries, 3).items() if z}
    assert run(spark, points, queries, 3, leaf_rows=10, sample=16) == want  # two leaves of 150


def test_a_task_holds_few_distances_at_once():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(19_000, 8)), np.ones((1000, 8))])  # a thousand at one place
    q = np.concatenate([rng.normal(size=(380, 8)), np.ones((20, 8))])
    tracemalloc.start()
    near = list(nearest_of((np.arange(len(x)), np.ones(len(x), int), x), q, [None] * len(q), np.full(len(q), np.inf), 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # blocks of 256 queries took 83 MB
    row, d, ids, _ = map(np.concatenate, zip(*near, strict=True))
    far = ((x[None] - q[:, None]) ** 2).sum(2)
    assert row.tolist() == np.repeat(np.arange(len(q)), 2).tolist()
    assert ids.reshape(-1, 2).tolist() == [np.lexsort((np.arange(len(x)), v))[:2].tolist() for v in far] and np.allclose(d, np.sort(far, 1)[:, :2].ravel())
