"""Series in chunks: one row for each channel and stretch of time, whose samples are an array.

Clips, templates, filters and products of channels are made from the arrays where they are; what is shuffled is a row for
each chunk and not for each sample. Chunks get the samples around them by an exchange of their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.kernels import filter_signal
from tidewave.operators.templates import middle
from tidewave.operators.timeseries import inverse_root
from tidewave.plans.storage import checkpointed

#: Events of one chunk above which they are dealt to several tasks, each with the chunk.
HOT = 50_000


@dataclass(frozen=True)
class Chunked:
    """rows: channel, chunk, samples, with sample i of a chunk at t = chunk * size + i; all chunks have `size` samples but
    the last, which ends with the series. channels are those of the rows, where they are known."""

    rows: DataFrame
    size: int
    length: int
    channels: tuple[int, ...] | None = None

    @property
    def last(self) -> int:
        return max(0, (self.length - 1) // self.size)

    def names(self) -> DataFrame:
        """channel: one row each."""
        if self.channels is None:
            return self.rows.select("channel").distinct()
        return self.rows.sparkSession.createDataFrame([(m,) for m in self.channels], "channel int")


def chunked(series: DataFrame, length: int, *, size: int = 4096, channels: list[int] | None = None) -> Chunked:
    """A series in long form (channel, t, v) as chunks of samples 0 .. length - 1; samples that are missing or null are 0, of
    those that are there twice one counts, and others are left out. Every channel (by default those that occur) has
    every chunk."""
    spark = series.sparkSession
    inside = series.where((F.col("t") >= 0) & (F.col("t") < length) & F.col("v").isNotNull())
    names = spark.createDataFrame([(c,) for c in channels], "channel int") if channels else series.select(F.col("channel").cast("int").alias("channel")).distinct()
    spans = spark.range(-(-length // size)).select(F.col("id").alias("chunk"))
    grid = spans.crossJoin(F.broadcast(names))  # a few channels
    parts = inside.groupBy(F.col("channel").cast("int").alias("channel"), F.expr(f"t div {size}").alias("chunk")).agg(F.collect_list(F.struct((F.col("t") % size).cast("int").alias("i"), F.col("v").cast("double").alias("v"))).alias("x"))  # `size` samples

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, x = b.column("chunk").to_pylist(), b.column("x")
            flat, ends = x.flatten(), np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(x).to_pylist()])
            at, v, out, before = np.asarray(flat.field("i")), np.asarray(flat.field("v")), [], 0
            for k, end in zip(chunk, ends.tolist(), strict=True):
                row = np.zeros(min(size, length - k * size))
                row[at[before:end]] = v[before:end]
                out.append(row)
                before = end
            yield pa.RecordBatch.from_arrays([b.column("channel"), b.column("chunk"), pa.array(out, pa.list_(pa.float64()))], names=["channel", "chunk", "samples"])

    rows = grid.join(parts, ["channel", "chunk"], "left").mapInArrow(fill, "channel int, chunk long, samples array<double>")
    return Chunked(rows, size, length, tuple(channels) if channels else None)


def unchunked(c: Chunked) -> DataFrame:
    """The long form: channel, t, v."""
    return c.rows.select("channel", "chunk", F.posexplode("samples").alias("i", "v")).select("channel", (F.col("chunk") * c.size + F.col("i")).alias("t"), "v")


def with_halo(c: Chunked, before: int, after: int | None = None) -> DataFrame:
    """channel, chunk, samples: each chunk with `before` samples ahead of its own and `after` behind, 0 beyond the series.

    A chunk sends its ends to as many neighbours as they reach, and takes what it gets: the exchange has a row for each
    chunk and one for each end sent.
    """
    after = before if after is None else after
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))
    ahead = [min(c.size, before - k * c.size) for k in range(-(-before // c.size))]  # what the k-th neighbour before gives
    behind = [min(c.size, after - k * c.size) for k in range(-(-after // c.size))]
    piece = lambda chunk, place, x: F.struct(chunk.alias("chunk"), F.lit(place).alias("place"), x.alias("x"))
    k, x = F.col("chunk"), F.col("samples")
    sent = [piece(k, 0, x)]
    sent += [piece(k + i + 1, -i - 1, F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n)) for i, n in enumerate(ahead)]
    sent += [piece(k - i - 1, i + 1, F.slice(x, 1, n)) for i, n in enumerate(behind)]
    moved = c.rows.select("channel", F.explode(F.array(*sent)).alias("p")).select("channel", "p.*").where(F.col("chunk").between(0, c.last))
    got = moved.groupBy("channel", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"))  # neighbours' ends
    at = lambda i: F.try_element_at("m", F.lit(i))
    parts = [F.coalesce(at(-i - 1), zeros(F.lit(n))) for i, n in reversed(list(enumerate(ahead)))]
    parts += [at(0)]
    parts += [F.concat(F.coalesce(at(i + 1), zeros(F.lit(0))), zeros(F.lit(n) - F.size(F.coalesce(at(i + 1), zeros(F.lit(0)))))) for i, n in enumerate(behind)]
    return got.where(F.map_contains_key("m", F.lit(0))).select("channel", "chunk", F.concat(*parts).alias("samples"))


def begins(events: DataFrame, clip_size: int, rounding: str) -> DataFrame:
    """events with _begin, where their clips begin."""
    at = F.round("time") if rounding == "round" else F.col("time")
    return events.withColumn("_begin", at.cast("long") - middle(clip_size))


def home(c: Chunked, clip_size: int) -> Column:
    """The chunk whose halo of a clip's length holds the clip, or null where a clip and the series don't meet."""
    chunk = F.greatest(F.floor(F.col("_begin") / c.size), F.lit(0).cast("long"))
    return F.when((F.col("_begin") > -clip_size) & (F.col("_begin") < c.length), chunk)


def chunk_clips(c: Chunked, events: DataFrame, clip_size: int, *, channels: list[int] | None = None, near: DataFrame | None = None, rounding: str = "truncate", edge: str = "pad") -> DataFrame:
    """event_id, label and m (where events have them), channel, clip: `clip_size` samples around each event on each channel, as
    an array. Samples beyond the series are 0; with edge="drop" a clip that isn't wholly inside is 0 everywhere. With
    near (m, channel) an event has clips on the channels of its m only.

    Events meet the chunk in which their clip begins, and the clip is cut from its array. A chunk with very many
    events is repeated, and its events are dealt to the copies by id.
    """
    carry = [x for x in ("event_id", "label", "m") if x in events.columns]
    part = Chunked(c.rows.where(F.col("channel").isin(channels)), c.size, c.length, tuple(channels)) if channels else c
    asked = begins(events, clip_size, rounding).select(*carry, "_begin", home(c, clip_size).alias("chunk"))
    if edge == "drop":
        asked = asked.withColumn("chunk", F.when((F.col("_begin") >= 0) & (F.col("_begin") + clip_size <= c.length), F.col("chunk")))
    asked = checkpointed(asked)
    hot = asked.where("chunk IS NOT NULL").groupBy("chunk").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = checkpointed(hot.select("chunk", F.expr(f"n div {HOT} + 1").alias("copies")))  # at most an event count over HOT
    wide = with_halo(part, clip_size).join(F.broadcast(hot), "chunk", "left")
    wide = wide.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1))).drop("copies")
    inside = asked.where("chunk IS NOT NULL").join(F.broadcast(hot), "chunk", "left").withColumn("copy", F.pmod(F.xxhash64("event_id"), F.coalesce("copies", F.lit(1).cast("long")))).drop("copies")
    if near is not None:
        inside = inside.join(F.broadcast(near), "m")  # channels squared at most
    clip = F.slice("samples", (F.col("_begin") - F.col("chunk") * c.size + clip_size + 1).cast("int"), clip_size)
    found = inside.join(wide, ["chunk", "copy"] + ["channel"] * (near is not None)).select(*carry, "channel", clip.alias("clip"))
    out = asked.where("chunk IS NULL")
    out = out.crossJoin(F.broadcast(part.names())) if near is None else out.join(F.broadcast(near), "m")
    out = out.select(*carry, "channel", F.array_repeat(F.lit(0.0), clip_size).alias("clip"))  # a few channels
    return found.unionByName(out)


def clip_rows(clips: DataFrame) -> DataFrame:
    """Clips in long form: clip becomes t, v."""
    return clips.select(*[x for x in clips.columns if x != "clip"], F.posexplode("clip").alias("t", "v"))


def chunk_templates(c: Chunked, events: DataFrame, clip_size: int, *, rounding: str = "truncate") -> DataFrame:
    """label, channel, t, v: mean clip of each label above 0, samples beyond the series counting as 0.

    Events of a label at one time are one place with a weight. A chunk gets its places as one list, of at most labels
    times size, and a task adds up the clips of its chunks, so that it gives one array for each label and channel.
    """
    rows = events.where("label > 0")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    places = begins(rows, clip_size, rounding).groupBy("label", "_begin").agg(F.count("*").alias("w"))
    places = places.withColumn("chunk", home(c, clip_size)).where("chunk IS NOT NULL")
    offset = (F.col("_begin") - F.col("chunk") * c.size + clip_size).cast("int")
    lists = places.groupBy("chunk").agg(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), offset.alias("at"), "w")).alias("places"))  # labels times size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x, p = b.column("samples"), b.column("places")
            for i, channel in enumerate(b.column("channel").to_pylist()):
                wave, place = np.asarray(x[i].values), p[i].values
                label, at, w = (np.asarray(place.field(f)) for f in ("label", "at", "w"))
                order = np.argsort(label, kind="stable")
                first = np.flatnonzero(np.diff(label[order], prepend=label[order[0]] - 1))
                views = np.lib.stride_tricks.sliding_window_view(wave, clip_size)
                for k, those in zip(label[order[first]].tolist(), np.split(order, first[1:]), strict=True):
                    some = w[those].astype(float) @ views[at[those]]
                    total[k, channel] = total[k, channel] + some if (k, channel) in total else some
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([m for _, m in keys], pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["label", "channel", "sums"])

    each = with_halo(c, clip_size).join(lists, "chunk").select("channel", "samples", "places").mapInArrow(sums, "label int, channel int, sums array<double>")
    added = each.select("label", "channel", F.posexplode("sums").alias("t", "s")).groupBy("label", "channel", "t").agg(F.sum("s").alias("s"))
    grid = sizes.crossJoin(F.broadcast(c.names())).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))))  # a row for each value of the templates
    return grid.join(added, ["label", "channel", "t"], "left").select("label", "channel", "t", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("v"))


def chunk_bandpass(c: Chunked, samplerate: float, freq_min: float, freq_max: float, freq_wid: float = 1000.0, *, padding: int = 3_000) -> Chunked:
    """Filters each chunk with `padding` samples on either side, which are dropped after; freq_max = 0 leaves values as they
    are. The last chunk is filtered as if zeros filled it."""
    if freq_max <= 0:
        return c
    size = c.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("samples"):
                whole = np.zeros(size + 2 * padding)
                own = np.asarray(x.values)
                whole[: len(own)] = own
                out.append(filter_signal(whole, samplerate, freq_min, freq_max, freq_wid)[padding : len(own) - padding])
            yield pa.RecordBatch.from_arrays([b.column("channel"), b.column("chunk"), pa.array(out, pa.list_(pa.float64()))], names=["channel", "chunk", "samples"])

    return Chunked(with_halo(c, padding).mapInArrow(run, "channel int, chunk long, samples array<double>"), size, c.length, c.channels)


def side_by_side(c: Chunked) -> DataFrame:
    """chunk, x: the channels of each chunk in one row, of a few channels' samples."""
    return c.rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("x"))  # a chunk's channels


def matrix_of(x: pa.Scalar) -> tuple[list[int], np.ndarray]:
    """The channels of a row of side_by_side, and their samples as the rows of a matrix."""
    names = x.values.field("channel").to_pylist()
    return names, np.asarray(x.values.field("samples").flatten()).reshape(len(names), -1)


def chunk_covariance(c: Chunked) -> DataFrame:
    """m1, m2, w: sums of products over time, without taking off means, divided by the number of samples less one. A task
    gives one matrix for all its chunks."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], float] = {}
        for b in batches:
            for x in b.column("x"):
                names, rows = matrix_of(x)
                for m1, line in zip(names, (rows @ rows.T).tolist(), strict=True):
                    for m2, v in zip(names, line, strict=True):
                        total[m1, m2] = total.get((m1, m2), 0.0) + v
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.float64())], names=["m1", "m2", "s"])

    sums = side_by_side(c).select("x").mapInArrow(products, "m1 int, m2 int, s double").groupBy("m1", "m2").agg(F.sum("s").alias("s"))
    return sums.select("m1", "m2", (F.col("s") / (c.length - 1)).alias("w"))


def chunk_mixed(c: Chunked, matrix: list[tuple[int, int, float]], unit: float = 0.0) -> Chunked:
    """Each channel m1 as the sum over channels m2 of w * v for (m1, m2, w) of a few channels; unit > 0 rounds to that grid."""
    made = sorted({m1 for m1, _, _ in matrix})
    weight = {(m1, m2): w for m1, m2, w in matrix}

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            channel, chunk, out = [], [], []
            for k, x in zip(b.column("chunk").to_pylist(), b.column("x"), strict=True):
                names, rows = matrix_of(x)
                mixed = np.array([[weight.get((m1, m2), 0.0) for m2 in names] for m1 in made]) @ rows
                out += list(np.floor(mixed / unit + 0.5) * unit if unit > 0 else mixed)
                channel, chunk = channel + made, chunk + [k] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(channel, pa.int32()), pa.array(chunk, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["channel", "chunk", "samples"])

    return Chunked(side_by_side(c).mapInArrow(mix, "channel int, chunk long, samples array<double>"), c.size, c.length, tuple(made))


def chunk_whiten(c: Chunked, unit: float = 1e-4) -> Chunked:
    """Channels without correlation and of unit variance, on a grid of `unit`."""
    found = chunk_covariance(c).collect()  # channels squared
    return chunk_mixed(c, inverse_root([(r["m1"], r["m2"], r["w"]) for r in found]), unit)


def read_chunks(spark: SparkSession, path: str, size: int = 4096, **options) -> Chunked:  # type: ignore[no-untyped-def]
    """Array files as chunks, which tasks read as arrays: no sample is ever a row."""
    from tidewave.sources.arrays import array_length, register

    register(spark)
    kind = "rawchunks" if "num_channels" in options else "mdachunks"
    return Chunked(spark.read.format(kind).options(size=size, **options).load(path), size, array_length(path, **options))
