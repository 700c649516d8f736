"""Axes by block power iteration and clusters of all vectors, on planted units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions.kernels import dip_cut, dip_of_counts
from tidewave.operators.clustering import assigned, cluster_all
from tidewave.operators.sweeps import leading_axes, projected
from tidewave.plans.storage import checkpointed


def table(spark, groups, slices=4):
    rows = [(i, m, x.tolist()) for i, (m, x) in enumerate((m, x) for m, xs in groups.items() for x in xs)]
    order = np.random.default_rng(0).permutation(len(rows)).tolist()
    return checkpointed(spark.createDataFrame([rows[i] for i in order], "event_id long, m int, f array<double>").repartition(slices)), rows


def test_axes_are_those_of_the_eigen_solution(spark):
    rng = np.random.default_rng(1)
    data = {1: rng.normal(size=(300, 12)) * np.linspace(5, 0.5, 12) + 2, 2: rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5)), 3: np.zeros((4, 3))}
    df, _ = table(spark, data)
    for centred in (False, True):
        out = leading_axes(df, "m", "f", 3, centred=centred)
        for m in (1, 2):
            x = data[m] - data[m].mean(0) * centred
            _, v = np.linalg.eigh(x.T @ x)
            assert np.allclose(np.abs((v[:, ::-1][:, :3] * out[m][1]).sum(0)), 1, atol=1e-6)
            assert (out[m][1][np.abs(out[m][1]).argmax(0), np.arange(3)] > 0).all()
    y = {r["event_id"]: r["y"] for r in projected(df, "m", "f", leading_axes(df, "m", "f", 3), "y").where("m = 2").collect()}
    assert len(y) == 40 and all(len(v) == 3 for v in y.values())
    assert leading_axes(df.limit(0), "m", "f", 3) == {}


def test_axes_of_long_clips(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(10_000, 3)))[0]
    x = (rng.normal(size=(60, 3)) * [9, 5, 2]) @ basis.T
    df, _ = table(spark, {1: x})
    q = leading_axes(df, "m", "f", 3)[1][1]
    assert q.shape == (10_000, 3) and np.allclose(np.abs(np.linalg.svd(q.T @ np.linalg.svd(x, full_matrices=False)[2][:3].T)[1]), 1)


def test_dips_of_counts_are_those_of_values():
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=3000), np.concatenate([rng.normal(size=2000), rng.normal(7, 1, 300)]), rng.exponential(size=5000), rng.uniform(size=1000)):
        edges = np.linspace(values.min(), values.max(), 2049)
        a, b = dip_cut(values), dip_of_counts(np.histogram(values, edges)[0].astype(float), edges)
        two = len(values) == 2300
        assert min(a[0], b[0]) > 3 and 2 < b[1] < 5.5 if two else max(a[0], b[0]) < 1.5
    for n in (1000, 30_000, 1_000_000):  # twenty values far from the bulk show alike beside any number
        values, edges = np.concatenate([rng.normal(size=n), rng.normal(19, 1, 20)]), np.linspace(-8, 27, 2049)
        dip, cut = dip_of_counts(np.histogram(values, edges)[0].astype(float), edges)
        assert dip > 1.6 and 3 < cut < 18
    assert dip_of_counts(np.zeros(8), np.arange(9.0))[0] == 0 and dip_of_counts(np.array([0, 9.0, 0]), np.arange(4.0)) == (0.0, 1.5)


def agrees(rows, units, labels):
    """Each unit's vectors have one label, which no other unit has."""
    of = {}
    for (i, m, _), u in zip(rows, units, strict=True):
        of.setdefault((m, u), set()).add(labels[i])
    return all(len(s) == 1 for s in of.values()) and len({(m, *s) for (m, _), s in of.items()}) == len(of)


def test_a_rare_unit_is_found(spark):
    rng = np.random.default_rng(5)
    sizes = [24_000, 15_000, 980, 20]  # the last is one in two thousand
    middles = np.array([[0, 0, 0], [14, 0, 0], [0, 14, 5], [-12, -12, 9]]) * np.ones(1)
    x = np.concatenate([rng.normal(size=(n, 3)) + c for n, c in zip(sizes, middles, strict=True)])
    df, rows = table(spark, {1: x, 7: x[::40], 9: x[:3]})
    out, tree = cluster_all(df)
    labels = {r["event_id"]: r["label"] for r in out.collect()}
    unit = np.repeat(np.arange(4), sizes)
    near = np.array([labels[i] for i in range(len(x))])
    assert sorted(set(near)) == [1, 2, 3, 4]
    for u in range(4):
        values, n = np.unique(near[unit == u], return_counts=True)
        assert n.max() >= 0.999 * sizes[u]
    assert len(set(near[unit == 3])) == 1 and (near == near[-1]).sum() == 20
    assert {r["label"] for r in out.where("m = 9").collect()} == {1}
    again = {r["event_id"]: r["label"] for r in assigned(df.repartition(7), tree).collect()}
    assert again == labels


def test_clusters_within_clusters(spark):
    rng = np.random.default_rng(6)
    # the first axes are taken up by far groups; two of them differ in a direction that only their own axes show
    far = np.zeros((3, 6))
    far[0, 0], far[1, 1] = 400, 400
    x = np.concatenate([rng.normal(size=(400, 6)) * [1, 1, 1, 1, 1, 0.1] + c for c in far])
    x[:200, 5] += 3
    df, rows = table(spark, {1: x})
    out, _ = cluster_all(df, num_features=2)
    unit = [0] * 200 + [1] * 200 + [2] * 400 + [3] * 400
    assert agrees(rows, unit, {r["event_id"]: r["label"] for r in out.collect()})


def test_equal_and_missing_vectors(spark):
    df, _ = table(spark, {1: np.ones((500, 4)), 2: np.concatenate([np.zeros((300, 4)), np.ones((300, 4))])})
    out = cluster_all(df)[0].groupBy("m", "label").agg(F.count("*").alias("n")).collect()
    assert sorted((r["m"], r["n"]) for r in out) == [(1, 500), (2, 300), (2, 300)]
    empty, tree = cluster_all(df.limit(0))
    assert empty.count() == 0 and tree.roots == {}


@pytest.mark.parametrize("share", [0.33])
def test_one_group_may_hold_most_rows(spark, share):
    rng = np.random.default_rng(8)
    many = {1: np.concatenate([rng.normal(size=(3000, 2)), rng.normal(size=(3000, 2)) + 12])} | {m: rng.normal(size=(30, 2)) for m in range(2, 30)}
    out = {(r["m"], r["label"]) for r in cluster_all(table(spark, many)[0])[0].collect()}
    assert {k for m, k in out if m == 1} == {1, 2} and all(k == 1 for m, k in out if m > 1)


def test_passes_read_blocks_of_vectors(spark):
    from tidewave.operators.clustering import BLOCK, Tree, open_nodes
    from tidewave.operators.sweeps import group_means

    rng = np.random.default_rng(2)
    x = rng.normal(size=(BLOCK + 100, 3))
    rows = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(x.tolist())], "event_id long, m int, f array<double>").coalesce(1)
    tree = Tree({0: 0, 1: 1}, {}, 2)
    out = open_nodes(rows, tree, {0, 1})
    assert dict(out.dtypes) == {"node": "int", "ids": "binary", "f": "binary"} and out.count() == 2
    for g, (n, mean) in group_means(out, "node", "f").items():
        assert n == len(x[g::2]) and np.allclose(mean, x[g::2].mean(0))
    ids = [i for r in out.collect() for i in np.frombuffer(r["ids"], np.int64).tolist()]
    assert sorted(ids) == list(range(len(x)))
