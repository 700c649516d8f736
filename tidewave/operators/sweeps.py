"""Passes over rows of vectors in groups: each task adds up a few arrays for each group, and Spark adds these up.

What comes to the driver is as large as the arrays of all groups, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(x: np.ndarray) -> bytes:
    """A matrix as the bytes of its width and its rows, for a table of blocks: a row of such a table is a group's block."""
    return np.concatenate([[float(x.shape[1])], x.reshape(-1)]).tobytes()


def grouped(batch: pa.RecordBatch, key: str, value: str) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(group, rows, matrix) for each value of key: the rows that have it and their vectors, which are equally long; of packed
    vectors for each row."""
    if not batch.num_rows:
        return
    if pa.types.is_binary(batch.schema.field(value).type):
        for i, (name, block) in enumerate(zip(batch.column(key).to_pylist(), batch.column(value), strict=True)):
            flat = np.frombuffer(block.as_buffer(), np.float64)
            yield name, np.array([i]), flat[1:].reshape(-1, int(flat[0]))
        return
    codes = batch.column(key).dictionary_encode()
    index, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    lists = batch.column(value)
    starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
    sizes = np.asarray(pa.compute.list_value_length(lists))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for k in np.unique(index):
        rows = np.flatnonzero(index == k)
        yield names[k], rows, flat[starts[rows][:, None] + np.arange(sizes[rows[0]])]


def swept(rows: DataFrame, key: str, value: str, add: Callable, extra: list[str] = []) -> dict[tuple, tuple[np.ndarray, float, float]]:  # noqa: B006
    """(group, name) -> (sum of arrays, least lo, greatest hi).

    add(state, group, matrix, columns) puts into the dict `state`, for names of whole numbers, (array, lo, hi), or adds
    to what is there; columns are the values of the extra columns in the matrix's rows. Arrays of one name may differ in
    length: they are added from their beginning.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple[np.ndarray, float, float]] = {}
        schema = None
        for b in batches:
            schema = b.schema.field(key).type
            for g, those, x in grouped(b, key, value):
                own: dict[int, tuple[np.ndarray, float, float]] = {}
                add(own, g, x, *[b.column(c).take(pa.array(those)) for c in extra])
                for name, (a, lo, hi) in own.items():
                    if (g, name) in state:
                        was, low, high = state[g, name]
                        size = max(len(was), len(a))
                        state[g, name] = np.pad(was, (0, size - len(was))) + np.pad(a, (0, size - len(a))), min(low, lo), max(high, hi)
                    else:
                        state[g, name] = a, lo, hi
        if state:
            keys, kept = list(state), list(state.values())
            at = [np.flatnonzero(v) for v, _, _ in kept]
            arrays = [pa.array([g for g, _ in keys], schema), pa.array([n for _, n in keys], pa.int32()), pa.array([x[1] for x in kept]), pa.array([x[2] for x in kept])]
            arrays += [pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([v[a] for a, (v, _, _) in zip(at, kept, strict=True)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "name", "lo", "hi", "at", "v"])

    parts = rows.select(key, value, *extra).mapInArrow(run, f"{key} {kind}, name int, lo double, hi double, at array<int>, v array<double>")
    flat = parts.select(key, "name", "lo", "hi", F.explode_outer(F.arrays_zip("at", "v")).alias("x")).groupBy(key, "name", "x.at").agg(F.sum("x.v").alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = flat.toPandas()  # groups, names and the length of an array
    out = {}
    for (g, name), part in found.groupby([key, "name"], sort=True) if len(found) else ():
        given = part[part["at"].notna()]
        values = np.zeros(int(given["at"].max()) + 1 if len(given) else 0)
        values[given["at"].astype(int)] = given["v"]
        out[g, int(name)] = values, float(part["lo"].min()), float(part["hi"].max())
    return out


def group_means(rows: DataFrame, key: str, value: str) -> dict[object, tuple[int, np.ndarray]]:
    """group -> (number of vectors, their mean)."""

    def add(state: dict, g: object, x: np.ndarray) -> None:
        state[x.shape[1]] = np.concatenate([[len(x)], x.sum(0)]), 0.0, 0.0

    return {g: (int(v[0]), np.pad(v[1:], (0, size + 1 - len(v))) / v[0]) for (g, size), (v, _, _) in swept(rows, key, value, add).items()}


def signed(axes: np.ndarray) -> np.ndarray:
    """Columns with a positive largest entry."""
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def leading_axes(rows: DataFrame, key: str, value: str, k: int, *, centred: bool = False, width: int = 64, most_rounds: int = 60, tolerance: float = 1e-13, seed: int = 1) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """group -> (mean or zeros, the k leading directions of the group's vectors as columns).

    Block power iteration: each round is one pass, in which a task adds up x (x' Q) over its vectors for the group's basis
    Q of `width` columns, so that nothing as large as a vector squared is ever held. The basis is turned to the
    directions in which its products are uncorrelated, of which the first k are reported, and rounds end when their
    strengths no longer change; where vectors are no longer than width, the first round is exact. Groups without
    vectors are missing.
    """
    spark = rows.sparkSession
    sizes = group_means(rows, key, value)
    zero = {g: mean if centred else np.zeros(len(mean)) for g, (_, mean) in sizes.items()}
    rng = np.random.default_rng(seed)
    basis = {g: np.linalg.qr(rng.normal(size=(len(mean), min(len(mean), max(width, k + 8)))))[0] for g, (_, mean) in sizes.items()}
    strength: dict[object, np.ndarray] = {}
    for _ in range(most_rounds):
        shared = spark.sparkContext.broadcast((zero, basis))

        def add(state: dict, g: object, x: np.ndarray) -> None:
            centre, q = shared.value[0][g], shared.value[1][g]  # noqa: B023
            y = x - centre
            state[0] = (y.T @ (y @ q)).reshape(-1), 0.0, 0.0

        done = True
        for (g, _), (flat, _, _) in swept(rows, key, value, add).items():
            q = basis[g]
            z = np.pad(flat, (0, q.size - len(flat))).reshape(q.shape)
            inner = q.T @ z
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            now = values[::-1][:k]
            done &= q.shape[0] == q.shape[1] or g in strength and bool(np.abs(now - strength[g]).max(initial=0) <= tolerance * max(now.max(initial=0), 1e-300))
            strength[g] = now
            basis[g] = q @ turn[:, ::-1] if q.shape[0] == q.shape[1] else np.linalg.qr(z @ turn[:, ::-1])[0]
        if done:
            break
    return {g: (zero[g], signed(q[:, :k])) for g, q in basis.items()}


def projected(rows: DataFrame, key: str, value: str, axes: dict[object, tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """rows with `name`, the products of each vector with its group's axes, instead of the vector."""
    shared = rows.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def project(g: pd.Series, v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(g), dtype=object)
        for k, at in g.groupby(g).indices.items():
            zero, q = shared.value[k]
            for i, y in zip(at, ((np.stack(v.to_numpy()[at]) - zero) @ q).tolist(), strict=True):
                out.iat[i] = y
        return out

    return rows.withColumn(name, project(key, value)).drop(*[c for c in (value,) if c != name])
