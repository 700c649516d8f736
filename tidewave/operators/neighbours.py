"""Exact nearest neighbours with a space-partitioning tree: rows are dealt by the tree's leaves, and a query visits the leaves
that its neighbours so far don't rule out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.metrics import drawn_order
from tidewave.plans.storage import checkpointed

#: Queries of one cell above which they are dealt to several tasks, each with the cell's points.
HOT = 10_000
#: Distances, and numbers of vectors, that a task holds at once.
BLOCK = 1 << 19


@dataclass
class Tree:
    """Inner nodes by number: the dimension and the value that divide it, and its two children; a child below 0 is leaf
    -child - 1."""

    dims: np.ndarray
    cuts: np.ndarray
    kids: np.ndarray
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x: values up to the cut go left."""
        if self.leaves == 1:
            return np.zeros(len(x), np.int64)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            n = node[rows]
            node[rows] = self.kids[n, (x[rows, self.dims[n]] > self.cuts[n]).astype(int)]
            rows = rows[node[rows] >= 0]
        return -node - 1

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, leaves) of all leaves that have some point within the row's squared radius."""
        found: list[tuple[np.ndarray, int]] = []
        if self.leaves == 1:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        # how far the node's box is from each row, by dimension and in all
        open_ = [(0, np.arange(len(x)), np.zeros_like(x), np.zeros(len(x)))]
        while open_:
            node, rows, gap, total = open_.pop()
            if node < 0:
                found.append((rows, -node - 1))
                continue
            dim, cut = self.dims[node], self.cuts[node]
            v = x[rows, dim]
            for side in (0, 1):
                beyond = np.where((v > cut) != bool(side), np.abs(v - cut), 0.0)
                more = np.maximum(gap[:, dim], beyond)
                sums = total - gap[:, dim] ** 2 + more**2
                keep = np.flatnonzero(sums <= radius[rows] * (1 + 1e-9))
                if len(keep):
                    wider = gap[keep].copy()
                    wider[:, dim] = more[keep]
                    open_.append((int(self.kids[node, side]), rows[keep], wider, sums[keep]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), leaf) for r, leaf in found])


def fitted(x: np.ndarray, leaves: int) -> Tree:
    """A tree of about so many leaves: a node is divided at the middle value of the dimension in which it is widest."""
    dims, cuts, kids, count = [], [], [], 0
    open_ = [(np.arange(len(x)), max(1, leaves), None)]
    while open_:
        rows, share, parent = open_.pop()
        part = x[rows]
        wide = part.max(0) - part.min(0) if len(rows) else np.zeros(1)
        dim = int(wide.argmax()) if x.shape[1] else 0
        if share < 2 or len(rows) < 2 or wide[dim] <= 0:
            node, count = -count - 1, count + 1
        else:
            values = np.sort(part[:, dim])
            cut = values[(len(values) - 1) // 2]
            cut = cut if cut < values[-1] else values[values < values[-1]][-1]
            node = len(dims)
            dims.append(dim)
            cuts.append(cut)
            kids.append([0, 0])
            right = part[:, dim] > cut
            open_ += [(rows[right], share - share // 2, (node, 1)), (rows[~right], share // 2, (node, 0))]
        if parent:
            kids[parent[0]][parent[1]] = node
    return Tree(np.array(dims, int), np.array(cuts, float), np.array(kids, int).reshape(-1, 2), count)


def cells_of(held: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first cell, count of cells) of each leaf, for leaves that hold so many points."""
    cells = np.where(held > 2 * leaf_rows, -(-held // leaf_rows), 1)
    return np.cumsum(cells) - cells, cells


def matrix(f: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(f.combine_chunks().flatten(), float).reshape(len(f), -1) if len(f) else np.zeros((0, 0))


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed at every level, as in a schema written out."""
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable(kind.value_type)))
    return pa.struct([(x.name, nullable(x.type)) for x in kind]) if pa.types.is_struct(kind) else kind


def nearest_of(points: tuple, queries: np.ndarray, wanted: list, radius: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, squared distance, id, label) of up to k points for each query within its squared radius, by query,
    distance and id, for one stretch of queries after another. Candidates are chosen by products, with some room for
    their rounding, and measured exactly, BLOCK distances or values at a time."""
    ids, labels, f = points
    n, width = f.shape
    norm = (f**2).sum(1)
    top_norm = norm.max(initial=0)
    masks: dict[tuple, np.ndarray] = {}
    step = max(1, BLOCK // max(n, 1))
    for first in range(0, len(queries) if n else 0, step):
        q = queries[first : first + step]
        own = (q**2).sum(1)
        far = q @ f.T
        far *= -2
        far += own[:, None]
        far += norm
        rows_of: dict[tuple, list[int]] = {}
        for i, w in enumerate(wanted[first : first + step]):
            if w is not None:
                rows_of.setdefault(tuple(w), []).append(i)
        for w, rows in rows_of.items():
            if w not in masks:
                masks[w] = np.flatnonzero(~np.isin(labels, w))
            far[np.ix_(rows, masks[w])] = np.inf
        top = np.partition(far, k - 1, 1)[:, k - 1] if k < n else np.full(len(q), np.inf)
        limit = np.minimum(np.minimum(top, radius[first : first + step]) + 1e-9 * (own + top_norm), np.finfo(float).max)
        row, col = np.nonzero(far <= limit[:, None])
        exact = np.empty(len(row))
        part = max(1, BLOCK // max(width, 1))
        for at in range(0, len(row), part):
            here = slice(at, at + part)
            exact[here] = ((f[col[here]] - q[row[here]]) ** 2).sum(1)
        good = exact <= radius[first + row]
        row, col, exact = row[good], col[good], exact[good]
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, exact = row[rank < k], col[rank < k], exact[rank < k]
        yield first + row, exact, ids[col], labels[col]


def nearest(points: DataFrame, queries: DataFrame, k: int = 1, *, leaf_rows: int = 10_000, sample: int = 20_000) -> DataFrame:
    """qid, rank (1 .. k), id, label, distance: the k points nearest to each query, of equals those with the smaller id.

    points: id, label, f; queries: qid, f, and `wanted` (array) with the labels whose points count, or null for all. A
    point isn't its own neighbour where the query has a column `but` with its id.

    The tree is fitted on the `sample` points with the smallest digest of their id; leaves hold about leaf_rows points,
    or as many as the sample can tell apart. A query is first answered within its own leaf, which bounds how far its
    neighbours are, and then visits every leaf whose box comes as near as that. Points that are equal in all but
    their id are kept k + 1 of a label only, the first ones, so that they fill no leaf. A leaf that holds more than twice
    leaf_rows points, as the sample can't tell them apart, is dealt into cells of about leaf_rows; a query begins in one
    of them and visits the others. Queries of a crowded cell are dealt to copies of it. So a task holds some leaf_rows points and
    HOT queries, however many there are. Vectors are equally long; a query without any wanted point has no rows.
    """
    spark = points.sparkSession
    has_wanted, has_but = "wanted" in queries.columns, "but" in queries.columns
    q = queries.select("qid", "f", (F.col("wanted") if has_wanted else F.lit(None)).cast("array<int>").alias("wanted"), (F.col("but") if has_but else F.lit(None)).cast("long").alias("but"))
    first = F.slice(F.sort_array(F.collect_set("id")), 1, k + 1)
    p = points.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "f")
    # equal vectors are thinned within a part of the ids first, then among the parts
    thin = p.groupBy("f", "label", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(first.alias("ids"))
    thin = thin.select("f", "label", F.explode("ids").alias("id")).groupBy("f", "label").agg(first.alias("ids"))
    p = checkpointed(thin.select(F.explode("ids").alias("id"), "label", "f"))
    n = p.count()
    drawn = p.orderBy(*drawn_order("id")).limit(sample).select("f").collect()  # `sample` points
    if not drawn:
        return q.select("qid", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("label"), F.lit(0.0).alias("distance")).limit(0)
    tree = spark.sparkContext.broadcast(fitted(np.array([r["f"] for r in drawn], float), min(-(-n // leaf_rows), max(1, len(drawn) // 8))))

    @F.pandas_udf("int")
    def leaf(f: pd.Series) -> pd.Series:
        return pd.Series(tree.value.leaf(np.stack(f.to_numpy()).astype(float)) if len(f) else [], dtype="int32")

    sizes = {r["leaf"]: r["n"] for r in p.groupBy(leaf("f").alias("leaf")).agg(F.count("*").alias("n")).collect()}  # one row a leaf
    dealt = spark.sparkContext.broadcast(cells_of(np.array([sizes.get(i, 0) for i in range(tree.value.leaves)]), leaf_rows))

    @F.pandas_udf("int")
    def cell(f: pd.Series, h: pd.Series) -> pd.Series:
        begin, cells = dealt.value
        at = tree.value.leaf(np.stack(f.to_numpy()).astype(float)) if len(f) else []
        return pd.Series(begin[at] + h.to_numpy() % cells[at] if len(f) else [], dtype="int32")

    p = checkpointed(p.withColumn("cell", cell("f", F.xxhash64("f", "id"))))
    columns = ["qid", "f", "wanted", "but", "radius", "cell"]
    near_type = pa.struct([("d", pa.float64()), ("id", pa.int64()), ("label", pa.int32())])

    def answer(asked: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` of asked (qid, f, wanted, but, radius, cell) with what each cell says."""
        crowd = checkpointed(asked.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("cell", F.expr(f"cast(c div {HOT} + 1 AS int)").alias("copies")))  # queries over HOT rows
        many = F.coalesce("copies", F.lit(1))
        a = asked.join(F.broadcast(crowd), "cell", "left").withColumn("copy", F.pmod(F.hash("qid"), many)).drop("copies")
        b = p.join(F.broadcast(crowd), "cell", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), many - 1))).drop("copies")
        kinds = dict(asked.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", found array<struct<d:double,id:long,label:int>>"

        def one(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            count = np.zeros(mine.num_rows + 1, np.int32)
            parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            but, none = np.asarray(mine["but"].fill_null(0), np.int64), np.asarray(mine["but"].is_null())
            points = np.asarray(theirs["id"]), np.asarray(theirs["label"]), matrix(theirs["f"])
            for row, *near in nearest_of(points, matrix(mine["f"]), mine["wanted"].to_pylist() if has_wanted else [], np.asarray(mine["radius"]), k + has_but):
                if has_but:  # itself, or the last of k + 1
                    other = (near[1] != but[row]) | none[row]
                    row, near = row[other], [x[other] for x in near]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, near = row[first], [x[first] for x in near]
                np.add.at(count, row + 1, 1)
                parts.append(tuple(near))
            values = [np.concatenate(x) for x in zip(*parts, strict=True)]
            said = pa.StructArray.from_arrays([pa.array(x, t.type) for x, t in zip(values, near_type, strict=True)], fields=list(near_type))
            said = pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), said, type=pa.list_(pa.field("element", near_type)))
            return pa.table([*(mine[c].cast(nullable(mine[c].type)) for c in keep), said], names=[*keep, "found"])

        return a.select(*columns, "copy").groupBy("cell", "copy").cogroup(b.groupBy("cell", "copy")).applyInArrow(one, schema)

    q = q.withColumn("radius", F.lit(float("inf"))).withColumn("cell", cell("f", F.xxhash64("qid")))
    home = checkpointed(answer(q, columns))
    bound = home.withColumn("radius", F.when(F.size("found") == k, F.element_at("found", -1)["d"]).otherwise(F.lit(float("inf"))))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, cells = dealt.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, leaves = tree.value.reached(matrix(pa.chunked_array([b.column("f")])), np.asarray(b.column("radius")))
                mine = np.asarray(b.column("cell"))
                for i in range(int(cells[leaves].max(initial=0))):
                    to = begin[leaves] + i
                    new = np.flatnonzero((i < cells[leaves]) & (to != mine[rows]))
                    for part in range(0, len(new), 4096):
                        z = new[part : part + 4096]
                        yield b.take(pa.array(rows[z])).set_column(5, "cell", pa.array(to[z], pa.int32()))

    kinds = dict(bound.dtypes)
    away = checkpointed(bound.select(*columns).mapInArrow(visits, ", ".join(f"{c} {kinds[c]}" for c in columns)))
    every = home.select("qid", "found").unionByName(answer(away, ["qid"]))
    best = every.select("qid", F.explode("found").alias("z")).groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("z")), 1, k).alias("z"))  # k of each leaf visited
    return best.select("qid", F.posexplode("z").alias("r", "z")).select("qid", (F.col("r") + 1).alias("rank"), "z.id", "z.label", F.sqrt("z.d").alias("distance"))
