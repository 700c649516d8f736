"""Near duplicates by b-bit MinHash: band collisions, packed signatures, and links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewave.llm.common import LOWER, free_name, join_unique, scratch, slices, table, utf8, written
from tidewave.llm.components import connected
from tidewave.llm.shingles import mix, shingles

BITS = 2


@dataclass(frozen=True)
class Scheme:
    """bands of `rows` minima each; percent: the least similarity, as 100 * common >= percent * all. With 32 bands of
    4, a pair of similarity 0.8 meets in no band with a chance of 5e-8, one of 0.85 with 5e-11."""

    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: Minima that no band uses: they only make the estimate of similarity from packed values more exact.
    extra: int = 128
    #: Candidates are dropped whose estimate lies so many standard deviations under the least similarity.
    deviations: float = 5.0
    #: A bucket's pairs are tested in blocks of about so many members, and of about so many shingles.
    block: int = 512
    block_shingles: int = 1_000_000

    @property
    def size(self) -> int:
        return self.bands * self.rows + self.extra

    @property
    def least_matches(self) -> int:
        """Of the packed values: unequal minima still agree in their low bits with a chance of 1 / 2**BITS."""
        chance = 2.0**-BITS
        p = chance + (1 - chance) * self.percent / 100
        return math.floor(self.size * (p - self.deviations * math.sqrt(p * (1 - p) / self.size)))


class Hasher:
    def __init__(self, scheme: Scheme):
        rng = np.random.default_rng(7)
        self.scheme = scheme
        self.a = rng.integers(0, 1 << 32, (scheme.size, 1), dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (scheme.size, 1), dtype=np.uint32)
        self.band = mix(np.arange(1, scheme.bands + 1, dtype=np.uint64))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x, out = (hashes >> np.uint64(32)).astype(np.uint32)[None], None
        for i in range(0, x.shape[1], 4096):
            part = (self.a * x[:, i : i + 4096] + self.b).min(1)
            out = part if out is None else np.minimum(out, part)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        key = self.band.copy()
        for column in minima[: self.scheme.bands * self.scheme.rows].reshape(self.scheme.bands, self.scheme.rows).T.astype(np.uint64):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low BITS of each (mixed) minimum, 64 / BITS of them in a long."""
        low = mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
        each = 64 // BITS
        return (low.reshape(-1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def matches(a: Column, b: Column, size: int) -> Column:
    """How many packed values two signatures share: equal values leave no bit in their exclusive or."""
    low = sum(1 << (BITS * i) for i in range(64 // BITS))
    total = F.lit(size)
    for i in range(size * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total - F.bit_count(any_bit.bitwiseAND(F.lit(low)))
    return total


def normal_form(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(LOWER).split())


def sketch(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, text_key (null without words), bands, packed for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(scheme)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                sets = shingles(*utf8(batch.column("text")))[1]
                texts = batch.column("text").to_pylist()
                keys = [hashlib.blake2b(normal_form(t), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets, strict=True)]
                low = [hasher.minima(s) if len(s) else None for s in sets]
                arrays = [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([None if m is None else hasher.bands(m) for m in low], pa.list_(pa.int64())),
                    pa.array([None if m is None else hasher.packed(m) for m in low], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "text_key", "bands", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, text_key binary, bands array<long>, packed array<long>")


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node and the deflated words of each of classes (node, text_key, first_doc). Only rows of docs with a class's first
    doc_id can be the ones that are read for it, so copies of a text go to many tasks, which drop them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}  # rows that repeat are taken once
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if form := normal_form(t.as_py()):
                    found[i, hashlib.blake2b(form, digest_size=16).digest()] = zlib.compress(form, 1)
            arrays = [pa.array([i for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary()), pa.array(list(found.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "deflated"])

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_key binary, deflated binary")
    wanted = classes.select("node", F.col("text_key").alias("k"), "first_doc")
    one = each.join(wanted, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return one.groupBy("node").agg(F.first("deflated").alias("deflated"))


def sets_of(deflated: pa.Array) -> list[np.ndarray]:
    return shingles(*utf8(pa.array([zlib.decompress(z) for z in deflated.to_pylist()], pa.large_binary())))[1]


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full shingle sets are similar enough. texts: node, deflated. Very many pairs may
    have the same a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                left, right = sets_of(batch.column("za")), sets_of(batch.column("zb"))
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
                good = [100 * c >= percent * (len(x) + len(y) - c) for c, x, y in zip(common, left, right, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = join_unique(written(pairs, "minhash-likely"), texts.select(F.col("node").alias("a"), F.col("deflated").alias("za")), ["a"])
    two = one.join(texts.select(F.col("node").alias("b"), F.col("deflated").alias("zb")), "b")
    return two.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


CANDIDATE = "key long, i int, j int, home int, band int, node long, label long, n long, packed array<long>, bands array<long>"


def dealt(side: DataFrame, sizes: DataFrame, scheme: Scheme) -> DataFrame:
    """Members of buckets, as of CANDIDATE, for the comparison of all pairs in bounded groups: a bucket is cut into blocks
    of about scheme.block members, or fewer where their sets are large, and group (i, j) holds blocks i and j."""
    side = written(side, "minhash-side")
    total = side.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    side = join_unique(side, total, ["key"], counts=sizes)
    most = F.least("held", F.greatest(F.ceil(F.col("held") / scheme.block), F.ceil(F.col("total") / scheme.block_shingles))).cast("int")
    side = side.withColumn("most", most).withColumn("home", F.pmod(F.xxhash64("node"), F.col("most")).cast("int"))
    side = side.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    return side.select("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", F.col("band").cast("int").alias("band"), "node", "label", "n", "packed", "bands")


class Block:
    """The members of a group, in order of node, and which of them may be alike."""

    def __init__(self, members: pa.Table, scheme: Scheme):
        self.members = members = members.combine_chunks().sort_by("node")
        column = lambda name: members.column(name).to_numpy()
        matrix = lambda name: np.stack(column(name)) if members.num_rows else np.zeros((0, 0), np.int64)
        self.scheme, self.node, self.label, self.n, self.home = scheme, column("node"), column("label"), column("n"), column("home")
        self.packed, self.bands = matrix("packed").view(np.uint64), matrix("bands")
        self.band, self.across = (int(column("band")[0]), column("i")[0] != column("j")[0]) if members.num_rows else (0, False)
        self.low = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))

    def partners(self, x: int, label: np.ndarray) -> np.ndarray:
        """Later members with another label that may be like member x by their sizes and packed values, and
        that it meets in no earlier band; of the other block where the group has two."""
        other = label[x + 1 :] != label[x]
        if self.across:
            other &= self.home[x + 1 :] != self.home[x]
        y = np.flatnonzero(other) + x + 1
        y = y[100 * np.minimum(self.n[y], self.n[x]) >= self.scheme.percent * np.maximum(self.n[y], self.n[x])]
        bits = self.packed[y] ^ self.packed[x]
        unequal = bits
        for k in range(1, BITS):
            unequal = unequal | (bits >> np.uint64(k))
        y = y[self.scheme.size - np.bitwise_count(unequal & self.low).sum(1, dtype=np.int64) >= self.scheme.least_matches]
        return y[~(self.bands[y, : self.band] == self.bands[x, : self.band]).any(1)]


def candidates(scheme: Scheme):
    """The members of a group that may be like another one, so that only their texts are read."""

    def run(members: pa.Table) -> pa.Table:
        block = Block(members, scheme)
        wanted = np.zeros(len(block.node), bool)
        for x in range(len(wanted)):
            y = block.partners(x, block.label)
            wanted[y] = True
            wanted[x] |= len(y) > 0
        return block.members.filter(pa.array(wanted))

    return run


def block_links(scheme: Scheme):
    """Links (a, b) of a group's members by their full sets, as many as connect what is connected within the group."""

    def run(members: pa.Table) -> pa.Table:
        block = Block(members, scheme)
        sets = sets_of(block.members.column("deflated"))
        label, links = block.label.copy(), []
        for x in range(len(sets)):
            y = block.partners(x, label)
            if not len(y):
                continue
            there = np.concatenate([sets[k] for k in y])  # none of them is empty
            at = np.minimum(np.searchsorted(sets[x], there), len(sets[x]) - 1)
            common = np.add.reduceat((sets[x][at] == there).astype(np.int64), np.cumsum([0, *(len(sets[k]) for k in y[:-1])]))
            for k in y[100 * common >= scheme.percent * (block.n[x] + block.n[y] - common)]:
                if label[k] != label[x]:
                    links.append((block.node[x], block.node[k]))
                    label[label == label[k]] = label[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def near_classes(docs: DataFrame, scheme: Scheme = Scheme(), *, keys: bool = False) -> DataFrame:  # noqa: B008
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, and with keys text_key.

    Texts with the same words form a class, which counts once below. Classes that meet in a band are candidates, in
    stages, so that no bucket yields all its pairs:
    1. each with the smallest class of its bucket;
    2. in buckets that hold several components after that, each with the most central class, the one whose buckets have
       the most members in all, as the source of many edited copies has; then with the most central class outside the
       component of that one;
    3. in buckets that still hold several components, pairs from different components, in groups of two blocks of members:
       tested by their packed signatures first, and those that are left by their full sets. A group reads each of its texts
       once, whatever the number of pairs, and leaves out pairs that its links so far connect.
    Candidates are confirmed on full shingle sets; components follow from confirmed links. Stage 3 makes the result
    the same as if all pairs of each bucket had been compared: pairs left out by then are in one component already.

    component_id is the smallest doc_id of a component and kept says whether a row has it. A null, empty or blank text
    has no shingles and is linked with nothing. Rows that repeat a doc_id share its fate if their texts are alike.
    A row without doc_id has its component's id, and is kept only where there is none. A very long text is hashed whole,
    in memory that grows with it. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession):
        rows, fate = fates(docs, scheme)
    found = join_unique(rows.select("doc_id", "n_shingles", "text_key"), fate, ["text_key"], "left")
    component = F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), *["text_key"] * keys)


def fates(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key and so on of every row as of sketch(); text_key and component_id of every class)."""
    rows = written(sketch(docs, scheme), "minhash-rows", keep=True)
    classes = rows.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.first("n_shingles").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    packed = classes.select("node", "packed", "n")

    spread = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = written(spread.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1"), "minhash-buckets")
    sizes = buckets.select("key", F.col("members").alias("_n"))
    members = written(join_unique(spread, buckets, ["key"], counts=sizes), "minhash-members")
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    central = written(members.groupBy("node").agg(F.sum("members").alias("meets")), "minhash-central")

    met = central.select("node").join(classes.select("node", "text_key", "first_doc"), "node")
    texts = written(class_texts(docs, met), "minhash-texts")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: packed.select(F.col("node").alias(x), F.col("packed").alias(f"p{x}"))
        one = join_unique(written(pairs, "minhash-pairs"), side("a"), ["a"])
        return one.join(side("b"), "b").where(matches(F.col("pa"), F.col("pb"), scheme.size) >= scheme.least_matches).select("a", "b")

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components; one of two members has its only pair in stage 1."""
        named = members.where("members > 2").select("key", "band", "node", "members").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
        return written(join_unique(written(named, "minhash-named"), several, ["key"], "left_semi", counts=sizes), "minhash-mixed")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after further links: a component so far counts as the star of its label."""
        links = written(links, "minhash-links")
        if not links.limit(1).count():
            return labels
        return written(connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)), "minhash-labels")

    labels = written(connected(confirmed(likely(stars), texts, scheme.percent)), "minhash-labels")
    left = mixed(labels)

    for outside in (False, True):
        if not left.limit(1).count():
            break
        ranked = left.join(central, "node")
        order = F.struct("meets", -F.col("node"))
        best = ranked.groupBy("key").agg(F.max_by(F.struct("node", "label"), order).alias("top"))
        if outside:
            best = join_unique(written(ranked, "minhash-ranked"), best, ["key"], counts=sizes).where("label <> top.label").groupBy("key").agg(F.max_by(F.struct("node", "label"), order).alias("top"))
        to = best.select("key", F.col("top.node").alias("pivot"), F.col("top.label").alias("pivot_label"))
        star = join_unique(left, to, ["key"], counts=sizes).where("label <> pivot_label")
        star = star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        labels = joined(labels, confirmed(likely(star), texts, scheme.percent))
        left = mixed(labels)

    if left.limit(1).count():
        side = left.join(classes.select("node", "packed", "n", "bands"), "node")
        found = written(dealt(side, sizes, scheme).groupBy("key", "i", "j").applyInArrow(candidates(scheme), CANDIDATE), "minhash-candidates")
        near = join_unique(found, texts, ["node"])
        labels = joined(labels, near.groupBy("key", "i", "j").applyInArrow(block_links(scheme), "a long, b long").distinct())

    ids = labels.join(classes.select("node", "first_doc"), "node")
    least = ids.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    fate = classes.select("text_key", "node", "first_doc").join(join_unique(labels, least, ["label"]).select("node", "component_id"), "node", "left")
    fate = fate.select("text_key", F.coalesce("component_id", "first_doc").alias("component_id"))
    return rows, written(fate, "minhash-fate", keep=True)


def without_copies(docs: DataFrame, scheme: Scheme = Scheme(), *, most_broadcast: int = 1_000_000) -> DataFrame:  # noqa: B008
    """docs with all its columns, one row of each component and those without words. A row goes by its doc_id and text, so
    rows that share an id with a copy but not its text stay. Up to most_broadcast rows that go are sent to the tasks, which
    then leave texts where they are; beyond that the rows are joined by id."""
    gone = written(near_classes(docs, scheme, keys=True).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "minhash-gone")
    names = docs.columns
    key = free_name(names, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = (normal_form(t.as_py()) for t in batch.column("text"))
            keys = pa.array([hashlib.blake2b(f, digest_size=16).digest() if f else None for f in forms], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*names, key])

    keyed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    side = F.broadcast(gone) if gone.count() <= most_broadcast else gone  # 24 bytes a row
    return keyed.join(side, (F.col("doc_id") == F.col("_id")) & (F.col(key) == F.col("_key")), "left_anti").select(*[f"`{n}`" for n in names])


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), Scheme(percent=85))

#: All pairs that share a shingle, and what is reachable from each document.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
