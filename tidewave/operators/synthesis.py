"""Synthetic recordings with a known truth. Values come from hashes of their place, so they don't depend on how Spark
deals out the work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.plans.storage import checkpointed


def uniform(*parts: Column) -> Column:
    """Between 0 and 1, neither included."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit(1)))) * F.cos(2 * np.pi * uniform(*parts, F.lit(2)))


def random_waveforms(spark: SparkSession, *, channels: int = 5, size: int = 500, units: int = 20, upsample: int = 13, seed: int = 7) -> DataFrame:
    """label, channel, t (size * upsample steps), v: a dip and a slow rise for each unit, strongest on one channel."""
    rng = np.random.default_rng(seed)
    steps = np.arange(size * upsample) / upsample
    rows = []
    for k in range(1, units + 1):
        home, sign, width = rng.uniform(1, channels), -1 if rng.random() < 0.8 else 1, rng.uniform(3, 8)
        shape = sign * np.exp(-(((steps - size / 2) / width) ** 2)) - sign * 0.4 * np.exp(-(((steps - size / 2 - 2.5 * width) / (2 * width)) ** 2))
        top = rng.uniform(7, 20)
        for c in range(1, channels + 1):
            rows += [(k, c, i, float(x)) for i, x in enumerate(top * np.exp(-abs(c - home)) * shape)]
    return spark.createDataFrame(rows, "label int, channel int, t int, v double")


def random_firings(spark: SparkSession, *, units: int = 20, samplerate: float = 30_000, duration: float = 60, rate: float = 3.0, refractory_ms: float = 10, seed: int = 7) -> DataFrame:
    """event_id, channel (0), time, label: each unit fires at random, never twice within its refractory time: of events too
    close to the one before, every first of a group goes, until none is left."""
    per_unit = max(1, round(rate * duration))
    rows = spark.range(units * per_unit).select((F.col("id") % units + 1).cast("int").alias("label"), (uniform(F.col("id"), F.lit(seed)) * (samplerate * duration - 1)).alias("time"), F.col("id"))
    kept = enforce_refractory(rows.withColumnRenamed("id", "event_id"), refractory_ms / 1000 * samplerate)
    return kept.select("event_id", F.lit(0).alias("channel"), "time", "label")


def enforce_refractory(firings: DataFrame, gap: float, *, widths: int = 1024) -> DataFrame:
    """Events of which none follows another of its label by less than gap: of events too close to the one before, every first
    of a group goes, until none is left. Events at one time are taken by event_id.

    So an event stays if it comes gap or more after the last one that stays, and of a label's events at one time the first at
    most. A block of time, `widths` times gap wide, says with which event it ends for each with which it can begin, and these
    lie within gap of its beginning. A label's blocks are put together from what they say, and then each takes its own events.
    """
    if gap <= 0:
        return firings
    block = F.floor(F.col("time") / F.lit(float(widths * gap)))
    row = F.min_by(F.struct(*firings.columns), F.col("event_id")).alias("row")
    first = checkpointed(firings.where("time IS NOT NULL").groupBy("label", "time").agg(row).withColumn("block", block))
    kinds = dict(first.dtypes)
    by = f"label {kinds['label']}, block long"

    def says(t: pa.Table) -> pa.Table:
        t = t.sort_by("time")
        times = t.column("time").to_numpy()
        end = next_kept(times, gap)
        while (further := end[end] != end).any():
            end[further] = end[end[further]]
        begin = min(next_at(times, times[0], gap, 0) + 1, len(times))
        return pa.table({"label": t.column("label")[:1], "block": t.column("block")[:1], "begins": pa.array([times[:begin]]), "ends": pa.array([times[end[:begin]]])})

    def joined(t: pa.Table) -> pa.Table:
        t, last, before = t.sort_by("block"), None, []
        for begins, ends in zip(t.column("begins"), t.column("ends"), strict=True):
            before.append(last)
            times = begins.values.to_numpy()
            i = 0 if last is None else next_at(times, last, gap, 0)
            last = ends[i].as_py() if i < len(times) else last
        return pa.table({"label": t.column("label"), "block": t.column("block"), "before": pa.array(before, begins.type.value_type)})

    def kept(t: pa.Table) -> pa.Table:
        t = t.sort_by("time")
        times, last = t.column("time").to_numpy(), t.column("before")[0].as_py()
        i, stay = 0 if last is None else next_at(times, last, gap, 0), []
        follows = next_kept(times, gap).tolist()
        while i < len(times):
            stay.append(i)
            i = follows[i] if follows[i] != i else len(times)
        rows = t.column("row").combine_chunks().take(pa.array(stay, pa.int64()))
        return pa.Table.from_arrays(rows.flatten(), names=[f.name for f in rows.type])

    spoken = first.select("label", "block", "time").groupBy("label", "block").applyInArrow(says, f"{by}, begins array<{kinds['time']}>, ends array<{kinds['time']}>")
    before = spoken.groupBy("label").applyInArrow(joined, f"{by}, before {kinds['time']}")  # what lies within gap of a block's first event
    both = first.withColumnRenamed("label", "_label").join(before.withColumnRenamed("block", "_block"), F.col("_label").eqNullSafe(F.col("label")) & (F.col("block") == F.col("_block")))
    return both.select("label", "block", "time", "before", "row").groupBy("label", "block").applyInArrow(kept, first.select("row.*").schema)


def next_at(times: np.ndarray, last: float, gap: float, start: int) -> int:
    """The first place from start in the sorted times that comes gap or more after last."""
    i = max(start, int(np.searchsorted(times, last + gap)) - 1)
    while i < len(times) and times[i] - last < gap:
        i += 1
    return i


def next_kept(times: np.ndarray, gap: float) -> np.ndarray:
    """For each of the sorted times the place of the first that comes gap or more after it, or its own without any."""
    own = np.arange(len(times))
    at = np.searchsorted(times, times + gap)
    at -= (at > own + 1) & (times[np.maximum(at - 1, 0)] - times >= gap)  # sums are rounded, differences count
    at += (at < len(times)) & (times[np.minimum(at, len(times) - 1)] - times < gap)
    return np.where(at < len(times), at, own)


def synthesize_timeseries(spark: SparkSession, waveforms: DataFrame, firings: DataFrame, *, channels: int, length: int, size: int, upsample: int = 13, noise: float = 1.0, amplitude: str | None = None, seed: int = 7) -> DataFrame:
    """channel, t, v: noise plus each event's waveform at its fraction of a sample, times its amplitude if that is a column."""
    grid = spark.range(channels * length).select((F.col("id") % channels + 1).cast("int").alias("channel"), F.expr(f"id div {channels}").alias("t"))
    noisy = grid.withColumn("v", normal(F.col("channel"), F.col("t"), F.lit(seed)) * noise)
    mid = -(-(size + 1) // 2) - 1
    at = F.floor("time")
    phase = F.floor((F.col("time") - at) * upsample).cast("int")
    gain = F.col(amplitude) if amplitude else F.lit(1.0)
    asked = firings.select("label", gain.cast("double").alias("g"), at.cast("long").alias("t0"), phase.alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"))
    asked = asked.select("label", "g", (F.col("t0") + F.col("i") - mid).alias("ts"), (F.col("i") * upsample + upsample - 1 - F.col("phase")).alias("t"))
    stamped = asked.join(F.broadcast(waveforms), ["label", "t"]).groupBy("channel", F.col("ts").alias("t")).agg(F.sum(F.col("g") * F.col("v")).alias("s"))  # units by size
    return noisy.join(stamped, ["channel", "t"], "left").select("channel", "t", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("v"))


def synthesize_drifting_timeseries(spark: SparkSession, nodes: list[DataFrame], firings: DataFrame, *, channels: int, length: int, size: int, upsample: int = 13, noise: float = 1.0, seed: int = 7) -> DataFrame:
    """As above with waveforms that change over the recording: nodes hold at equally spaced times, and an event has the
    two nodes around it with weights that add up to 1."""
    units = None
    for i, n in enumerate(nodes):
        part = n.withColumn("label", (F.col("label") * len(nodes) + i).cast("int"))
        units = part if units is None else units.unionByName(part)
    place = F.col("time") / length * (len(nodes) - 1)
    low = F.least(F.floor(place), F.lit(max(len(nodes) - 2, 0)))
    weight = F.explode(F.array(F.struct(low.alias("node"), (1 - (place - low)).alias("w")), F.struct((low + 1).alias("node"), (place - low).alias("w")))).alias("x")
    rows = firings.select("*", weight).where(F.col("x.w") > 0).select("event_id", "time", (F.col("label") * len(nodes) + F.col("x.node")).cast("int").alias("label"), F.col("x.w").alias("amplitude"))
    return synthesize_timeseries(spark, units, rows, channels=channels, length=length, size=size, upsample=upsample, noise=noise, amplitude="amplitude", seed=seed)
