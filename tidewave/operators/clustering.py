"""Clusters of all vectors of each group, by rounds of passes: parcels, tests of neighbouring parcels, and cuts.

No vector is left out and none is gathered: a pass assigns every vector by the rules found so far and adds up counts along
the lines between middles, from which the driver decides on the next rules. Rules are as many as clusters are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.kernels import dip_of_counts
from tidewave.operators.sweeps import grouped, leading_axes, packed, projected, swept
from tidewave.plans.storage import checkpointed

#: Bins of the counts along a line between two middles.
BINS = 2048
#: Vectors of a block, and bytes of vectors that a task holds before it writes its blocks.
BLOCK, HELD = 8192, 1 << 24
#: Vectors of a task in each pass.
DEALT = 500_000


@dataclass
class Rules:
    """How one node's vectors are told apart: projected on axes, taken to the nearest centre, then moved by steps
    (a, b, way, cut): vectors of a and b go to b where their product with way exceeds cut, and else to a; without a
    way all go to a."""

    axes: np.ndarray
    centres: np.ndarray
    steps: list[tuple[int, int, np.ndarray | None, float]] = field(default_factory=list)
    children: dict[int, int] = field(default_factory=dict)

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(projected vectors, labels)."""
        y = x @ self.axes
        if not len(self.centres):
            return y, np.zeros(len(y), np.int64)
        label = ((self.centres**2).sum(1) - 2 * (y @ self.centres.T)).argmin(1)
        for a, b, way, cut in self.steps:
            if way is None:
                label[label == b] = a
            else:
                both = (label == a) | (label == b)
                label[both] = np.where(y[both] @ way > cut, b, a)
        return y, label


@dataclass
class Tree:
    """Nodes of clusters within clusters: roots by group, rules of the nodes that have been told apart."""

    roots: dict[object, int] = field(default_factory=dict)
    rules: dict[int, Rules] = field(default_factory=dict)
    nodes: int = 0

    def place(self, group: object, x: np.ndarray) -> np.ndarray:
        """The node that each of a group's vectors is in at last."""
        node = np.full(len(x), self.roots[group])
        open_ = [self.roots[group]]
        while open_:
            n = open_.pop()
            if n in self.rules and self.rules[n].children:
                here = np.flatnonzero(node == n)
                _, label = self.rules[n].labels(x[here])
                kids = self.rules[n].children
                node[here] = [kids[k] for k in label.tolist()]
                open_ += set(kids.values())
        return node

    def add(self) -> int:
        self.nodes += 1
        return self.nodes - 1


def open_nodes(features: DataFrame, tree: Tree, active: set[int]) -> DataFrame:
    """node, ids, f: the vectors in the nodes that are still to be told apart, in blocks that passes read as they are (see
    sweeps.packed), so that a pass costs what its sums cost."""
    shared = features.sparkSession.sparkContext.broadcast((tree, np.array(sorted(active))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, wanted = shared.value
        held: dict[int, list] = {}
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            for n, parts in held.items():
                ids, x = (np.concatenate(z) for z in zip(*parts, strict=True))
                for at in range(0, len(x), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids[at : at + BLOCK].tobytes()], pa.binary()), pa.array([packed(x[at : at + BLOCK])], pa.binary())], names=["node", "ids", "f"])

        for b in batches:
            ids = b.column("event_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for g, those, x in grouped(b, "m", "f"):
                node = t.place(g, x)
                for n in np.intersect1d(node, wanted).tolist():
                    here = node == n
                    held.setdefault(n, []).append((ids[those[here]], x[here]))
                    size += x[here].nbytes
            if size > HELD:
                yield from blocks()
                held.clear()
                size = 0
        yield from blocks()

    return features.select("event_id", "m", "f").mapInArrow(run, "node int, ids binary, f binary")


def chance(ids: pa.Array, turn: int) -> np.ndarray:
    """A number in (0, 1) for each id and turn, the same wherever it is made."""
    h = ids.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / 2**52 + 2.0**-54


def drawn_centres(rows: DataFrame, rules: dict[int, Rules], each: dict[int, int], turn: int) -> dict[int, np.ndarray]:
    """node -> up to each[node] of its vectors (projected), drawn with chances by their squared distance from the nearest centre:
    those with the least exponential times over that distance. A task keeps that many of a node."""
    shared, most = rows.sparkSession.sparkContext.broadcast((rules, each)), max(each.values())
    by = "node int, event_id long, t double, y array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for g, those, x in grouped(b, "node", "f"):
                r, n = shared.value[0][g], shared.value[1][g]
                y = x @ r.axes
                near = ((r.centres**2).sum(1) - 2 * (y @ r.centres.T)).argmin(1)
                far = ((y - r.centres[near]) ** 2).sum(1)
                ids = pa.array(np.frombuffer(b.column("ids")[int(those[0])].as_buffer(), np.int64))
                t = -np.log(chance(ids, turn)) / np.maximum(far, 1e-300)
                some = np.flatnonzero(far > 0)
                some = some[np.argsort(t[some], kind="stable")[:n]]
                found = best.get(g, []) + list(zip(t[some].tolist(), ids.take(pa.array(some)).to_pylist(), y[some].tolist(), strict=True))
                best[g] = sorted(found, key=lambda z: z[:2])[:n]
        flat = [(g, i, t, y) for g, found in best.items() for t, i, y in found]
        yield pa.RecordBatch.from_arrays([pa.array([z[0] for z in flat], pa.int32()), pa.array([z[1] for z in flat], pa.int64()), pa.array([z[2] for z in flat], pa.float64()), pa.array([z[3] for z in flat], pa.list_(pa.float64()))], names=["node", "event_id", "t", "y"])

    top = F.slice(F.sort_array(F.collect_list(F.struct("t", "event_id", "y"))), 1, most)
    parts = rows.mapInArrow(run, by)
    # tasks give that many rows a node; these meet in two steps, so that no task gets those of all tasks
    first = parts.groupBy("node", F.pmod(F.xxhash64("event_id"), F.lit(32)).alias("part")).agg(top.alias("z"))
    second = first.select("node", F.explode("z").alias("z")).select("node", "z.*").groupBy("node").agg(top.alias("z"))
    return {r["node"]: np.array([z["y"] for z in r["z"][: each[r["node"]]]]) for r in second.collect()}  # so many vectors a node


def parcel_sums(rows: DataFrame, rules: dict[int, Rules], only: dict[int, set[int]] | None = None) -> dict[int, dict[int, tuple[float, np.ndarray, np.ndarray]]]:
    """node -> label -> (number, mean, scatter about 0 by number) of the projected vectors; of some labels only if asked for."""
    shared = rows.sparkSession.sparkContext.broadcast((rules, only))

    def add(state: dict, g: int, x: np.ndarray) -> None:
        r, some = shared.value[0].get(g), shared.value[1]
        if r is None or (some is not None and g not in some):
            return
        y, label = r.labels(x)
        for k in np.unique(label).tolist():
            if some is None or k in some[g]:
                z = y[label == k]
                state[k] = np.concatenate([[len(z)], z.sum(0), (z.T @ z).reshape(-1)]), 0.0, 0.0

    out: dict[int, dict[int, tuple[float, np.ndarray, np.ndarray]]] = {}
    for (g, k), (v, _, _) in swept(rows, "node", "f", add).items():
        d = rules[g].axes.shape[1]
        v = np.pad(v, (0, 1 + d + d * d - len(v)))
        out.setdefault(g, {})[k] = v[0], v[1 : 1 + d] / v[0], v[1 + d :].reshape(d, d) / v[0]
    return out


def nearest_pairs(sums: dict[int, tuple], tried: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Labels that are each other's nearest by their middles, among pairs that weren't tried as they are."""
    ids = sorted(sums)
    if len(ids) < 2:
        return []
    means = np.stack([sums[k][1] for k in ids])
    d = ((means[:, None] - means[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    place = {k: i for i, k in enumerate(ids)}
    for a, b in tried:
        d[place[a], place[b]] = d[place[b], place[a]] = np.inf
    near = d.argmin(1)
    return [(ids[a], ids[int(b)]) for a, b in enumerate(near) if a < b and near[b] == a and np.isfinite(d[a, b])]


def line_between(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(way, edges): the direction between two middles, whitened by both spreads, and the edges of BINS bins that hold eight
    deviations around both."""
    spread = lambda s: s[2] - np.outer(s[1], s[1])
    both, apart = spread(one) + spread(two), two[1] - one[1]
    way = np.linalg.solve(both + (1e-9 * np.trace(both) + 1e-12 * (apart @ apart)) * np.eye(len(both)), apart)
    centre = np.array([one[1] @ way, two[1] @ way])
    wide = np.sqrt(np.maximum([way @ spread(one) @ way, way @ spread(two) @ way], 0)) * 8 + 1e-9 * max(np.abs(centre).max(), 1e-300)
    return way, np.linspace((centre - wide).min(), (centre + wide).max(), BINS + 1)


def line_counts(rows: DataFrame, rules: dict[int, Rules], asked: dict[int, list]) -> dict[tuple[int, int], tuple[np.ndarray, float, float]]:
    """(node, i) -> (counts by bin, least and greatest value) of the vectors of the i-th asked pair (a, b, way, edges)."""
    shared = rows.sparkSession.sparkContext.broadcast((rules, asked))

    def add(state: dict, g: int, x: np.ndarray) -> None:
        pairs = shared.value[1].get(g)
        if not pairs:
            return
        y, label = shared.value[0][g].labels(x)
        for i, (a, b, way, edges) in enumerate(pairs):
            line = y[(label == a) | (label == b)] @ way
            if len(line):
                at = np.clip(((line - edges[0]) * (BINS / (edges[-1] - edges[0]))).astype(np.int64), 0, BINS - 1)
                state[i] = np.bincount(at, minlength=BINS).astype(float), float(line.min()), float(line.max())

    return swept(rows, "node", "f", add)


def told_apart(rows: DataFrame, axes: dict[int, np.ndarray], sizes: dict[int, float], *, parcels: int, threshold: float, min_size: int, rounds: int) -> tuple[dict[int, Rules], dict[int, dict]]:
    """Rules for each node, and what is known of its clusters."""
    rules = {g: Rules(q, np.zeros((1, q.shape[1]))) for g, q in axes.items()}
    each = {g: max(1, int(min(parcels, sizes[g] // min_size)) // 5) for g in axes}
    for turn in range(5):
        for g, more in drawn_centres(rows, rules, each, turn).items():
            rules[g].centres = np.concatenate([rules[g].centres, more]) if turn else more
    for _ in range(2):  # centres go to the middles of what is nearest to them
        for g, found in parcel_sums(rows, rules).items():
            rules[g].centres = np.stack([found[k][1] for k in sorted(found)])
    sums = parcel_sums(rows, rules)
    for g, found in sums.items():  # none is without vectors but by a change in the last move
        keep = sorted(found)
        rules[g].centres = rules[g].centres[keep]
        sums[g] = {i: found[k] for i, k in enumerate(keep)}
    tried: dict[int, set[tuple[int, int]]] = {g: set() for g in rules}
    for _ in range(rounds):
        asked = {}
        for g, found in sums.items():
            if pairs := nearest_pairs(found, tried[g]):
                asked[g] = [(a, b, *line_between(found[a], found[b])) for a, b in pairs]
        if not asked:
            break
        # parcels too small to have two peaks of their own join the nearest without a test
        tested = {g: [p for p in pairs if min(sums[g][p[0]][0], sums[g][p[1]][0]) >= min_size] for g, pairs in asked.items()}
        counts = line_counts(rows, rules, tested) if any(tested.values()) else {}
        changed: dict[int, set[int]] = {}
        for g, pairs in asked.items():
            order = {id(p): i for i, p in enumerate(tested[g])}
            for p in pairs:
                a, b, way, edges = p
                cut = None
                if id(p) in order and (g, order[id(p)]) in counts:
                    seen, lo, hi = counts[g, order[id(p)]]
                    bounds = edges.copy()
                    bounds[0], bounds[-1] = min(bounds[0], lo), max(bounds[-1], hi)
                    dip, at = dip_of_counts(np.pad(seen, (0, BINS - len(seen))), bounds)
                    cut = at if dip >= threshold else None
                if cut is None:
                    rules[g].steps.append((a, b, None, 0.0))
                    (n, m1, s1), (k, m2, s2) = sums[g][a], sums[g].pop(b)
                    sums[g][a] = n + k, (n * m1 + k * m2) / (n + k), (n * s1 + k * s2) / (n + k)
                    tried[g] = {t for t in tried[g] if a not in t and b not in t}
                else:
                    rules[g].steps.append((a, b, way, cut))
                    tried[g].add((a, b))
                    changed.setdefault(g, set()).update((a, b))
        if changed:
            now = parcel_sums(rows, rules, changed)
            for g, labels in changed.items():
                for k in labels:
                    if k in now.get(g, {}):
                        sums[g][k] = now[g][k]
                    else:  # a cut left nothing on one side
                        sums[g].pop(k, None)
                        tried[g] = {t for t in tried[g] if k not in t}
    return rules, sums


def cluster_all(features: DataFrame, *, num_features: int = 10, parcels: int = 200, threshold: float = 1.6, min_size: int = 10, rounds: int = 200, levels: int = 8) -> tuple[DataFrame, Tree]:
    """(event_id, m, label; the rules) for features event_id, m, f: labels 1 .. within m from all vectors.

    Within each m vectors are projected on their num_features leading axes, put into up to `parcels` parcels (of
    min_size vectors or more on average) around drawn centres, and parcels that are each other's nearest are merged if counts along the line between their middles
    have one peak, or else cut at the valley; each cluster is then told apart by its own axes in the same way, and so on
    until it stays one. Every pass goes over all vectors of the clusters in question. A cluster of min_size vectors is
    told apart wherever it lies far enough from others, however many these have.

    f has the same length within m. Vectors that repeat count as often as they are there; an m with fewer than two
    times min_size vectors is one cluster; an empty table gives no rows. features is read once a level and should be a
    written table. Each level writes the vectors that it reads.
    """
    tree = Tree()
    found = {r["m"]: r["n"] for r in features.groupBy("m").agg(F.count("*").alias("n")).collect()}  # a row for each m
    active: dict[int, float] = {}
    for m in sorted(found):
        tree.roots[m] = tree.add()
        active[tree.roots[m]] = found[m]
    for _ in range(levels):
        active = {n: k for n, k in active.items() if k >= 2 * min_size}
        if not active:
            break
        tasks = max(features.sparkSession.sparkContext.defaultParallelism, int(sum(active.values())) // DEALT + 1)
        rows = checkpointed(open_nodes(features, tree, set(active)).repartition(tasks))  # however few files they came from
        axes = {g: q for g, (_, q) in leading_axes(rows, "node", "f", num_features).items()}
        rules, sums = told_apart(rows, axes, active, parcels=parcels, threshold=threshold, min_size=min_size, rounds=rounds)
        active = {}
        for g in sorted(rules):
            if len(sums.get(g, {})) < 2:
                continue
            for k in sorted(sums[g]):
                rules[g].children[k] = tree.add()
                active[rules[g].children[k]] = sums[g][k][0]
            tree.rules[g] = rules[g]
    return assigned(features, tree), tree


def assigned(features: DataFrame, tree: Tree) -> DataFrame:
    """event_id, m, label by the rules of a tree, which need not have seen these vectors."""
    leaves: dict[object, dict[int, int]] = {}
    for m, root in tree.roots.items():
        order, open_ = [], [root]
        while open_:
            n = open_.pop()
            kids = tree.rules[n].children if n in tree.rules else {}
            open_ += [kids[k] for k in sorted(kids, reverse=True)]
            order += [] if kids else [n]
        leaves[m] = {n: i + 1 for i, n in enumerate(order)}
    shared = features.sparkSession.sparkContext.broadcast((tree, leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, names = shared.value
        for b in batches:
            label = np.ones(b.num_rows, np.int32)
            for m, those, x in grouped(b, "m", "f"):
                label[those] = [names[m][n] for n in t.place(m, x).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("m"), pa.array(label)], names=["event_id", "m", "label"])

    kinds = dict(features.dtypes)
    return features.select("event_id", "m", "f").mapInArrow(run, f"event_id {kinds['event_id']}, m {kinds['m']}, label int")


def channel_features(clips: DataFrame, num_features: int = 10) -> DataFrame:
    """event_id, m, f for clips event_id, m, channel, clip: each channel's clips of an m are projected on their own leading
    axes, and f has the channels' features one after another, so that a channel counts by what varies on it and f
    is as long as num_features times the channels, whatever a clip's length."""
    rows = clips.select("event_id", "m", "channel", F.concat_ws(":", "m", "channel").alias("g"), "clip")
    axes = leading_axes(rows, "g", "clip", num_features)
    each = projected(rows, "g", "clip", axes, "y")
    return each.groupBy("event_id", "m").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("channel", "y"))), lambda x: x["y"])).alias("f"))  # an event's channels
