"""What the corpus operators share: reading tables, written intermediate tables, text as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.plans.storage import shared_folder

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores after it as keep it apart from the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_open: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that written() makes within, at the end, but for those that are to be kept."""
    paths: list[str] = []
    outer = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(outer)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: its lineage ends there, so that a lost
    executor costs no earlier stage again, and what its rows were dealt by can't change between two uses. Within
    scratch() the table goes at the end unless it is to be kept."""
    path = new_path(df.sparkSession, name)
    if not keep and (paths := _open.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", *, counts: DataFrame | None = None, least: int = 4096, most_hot: int = 500_000) -> DataFrame:
    """left joined with right, which has one row for each key at most, so that no key brings all its rows to one task.

    Rows are counted by key first, within tasks before the shuffle, unless counts (keys, _n) says how many there are. Keys with more than `least` rows, and more than a
    most_hot-th of all rows, are hot: there are at most most_hot of them, so their rows of right can be broadcast, and
    rows of left with a hot key stay where they are. Rows with other keys are joined as usual. left is read up to four
    times and should be a written table.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")) if counts is None else counts
    large = counts.where(F.col("_n") > least)
    top = large.agg(F.max("_n").alias("m")).first()["m"]
    if top is None:
        return left.join(right, keys, how)
    floor = max(least, left.count() // most_hot)
    if top <= floor:
        return left.join(right, keys, how)
    hot = written(large.where(F.col("_n") > floor).select(*keys), "hot-keys")  # most_hot rows at most
    known = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    # where rows without a partner are dropped, the hot rows of right choose those of left by themselves
    here = (left if how in ("inner", "left_semi") else left.join(F.broadcast(hot), keys, "left_semi")).join(known, keys, how)
    return here.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def fold(doc_id: str, n: int) -> Column:
    """Which of n folds a document is in: crc32 of its id as text, modulo n; fold 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and where each text begins (one more entry for the end);
    null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: for integers much faster than by hashing."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch with about `most` bytes of text each, and at least one row."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], where: Column | None = None) -> DataFrame:
    """Whole texts (null: empty) with a label: of each label value at most so many ids, those with the smallest hash, so
    that the same rows are taken however the tables are split, and at most as many texts, also where an id has
    several. Rows of labels without a label or id are left out, and an id's texts that repeat are taken once."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL")
    ids = ids if where is None else ids.where(where)
    parts = [ids.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen.distinct()), "doc_id").dropDuplicates(["doc_id", "label", "text"])  # bounded by `most`
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
    ranked = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(most.values()))
    allowed = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    return ranked.where(F.col("_r") <= allowed[F.col("label")]).drop("_r")
