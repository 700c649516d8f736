"""Clips around events, mean waveforms per label, and amplitudes, over series in long form: channel, t, v."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.functions.kernels import filter_signal
from tidewave.operators.joins import join_counted
from tidewave.operators.sweeps import leading_axes, projected
from tidewave.plans.storage import checkpointed


def middle(clip_size: int) -> int:
    """Which sample of a clip lies at the event."""
    return (clip_size + 1) // 2 - 1


def sampled(series: DataFrame) -> DataFrame:
    """channel, t, v to be joined with places by merging: places and samples compress so well that Spark would take millions of them
    for a small table, and send them through the driver."""
    return series.select("channel", "t", "v").hint("merge")


def extract_clips(series: DataFrame, events: DataFrame, clip_size: int, *, channels: list[int] | None = None, rounding: str = "truncate", edge: str = "pad") -> DataFrame:
    """event_id, channel, t (0 .. clip_size - 1), v, with label where events have one.

    Samples beyond the series are 0; with edge="drop" a clip that isn't wholly inside is 0 everywhere. Each event is
    repeated for the samples of its clip and joined with the series on time, so neither side is gathered.
    """
    carry = [c for c in ("event_id", "label") if c in events.columns]
    at = F.round("time") if rounding == "round" else F.col("time")
    offsets = F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))).alias("t")
    asked = events.select(*carry, at.cast("long").alias("_at"), offsets).withColumn("_ts", F.col("_at") + F.col("t") - middle(clip_size))
    wanted = series.where(F.col("channel").isin(channels)) if channels else series
    names = wanted.select("channel").distinct()
    grid = asked.crossJoin(F.broadcast(names))  # a few channels
    out = grid.join(sampled(wanted).withColumnRenamed("t", "_ts"), ["channel", "_ts"], "left")
    value = F.coalesce("v", F.lit(0.0))
    if edge == "drop":
        value = F.when(F.count("v").over(Window.partitionBy("event_id", "channel")) == clip_size, value).otherwise(F.lit(0.0))
    return out.select(*carry, "channel", "t", value.alias("v"))


def templates(series: DataFrame, events: DataFrame, clip_size: int, *, clusters: list[int] | None = None, rounding: str = "truncate") -> DataFrame:
    """label, channel, t, v: mean clip of each label. Sums are made on both sides of the shuffle, and samples beyond the
    series count as 0."""
    rows = events.where(F.col("label").isin(clusters)) if clusters else events.where("label > 0")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    offsets = F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))).alias("t")
    at = F.round("time") if rounding == "round" else F.col("time")
    asked = rows.select("label", at.cast("long").alias("_at"), offsets).withColumn("_ts", F.col("_at") + F.col("t") - middle(clip_size))
    asked = asked.groupBy("label", "t", "_ts").agg(F.count("*").alias("w"))  # events at one time are one row
    sums = asked.join(sampled(series).withColumnRenamed("t", "_ts"), "_ts").groupBy("label", "channel", "t").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    grid = sizes.crossJoin(F.broadcast(series.select("channel").distinct())).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))))
    return grid.join(sums, ["label", "channel", "t"], "left").select("label", "channel", "t", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("v"))


def densify_labels(means: DataFrame, clip_size: int) -> DataFrame:
    """Adds zero templates for the labels up to the largest that have no events."""
    top = means.agg(F.coalesce(F.max("label"), F.lit(0)).alias("k"))
    labels = top.where("k > 0").select(F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("label"))
    grid = labels.crossJoin(means.select("channel").distinct()).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))))
    return grid.join(means, ["label", "channel", "t"], "left").select("label", "channel", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def clip_statistics(clips: DataFrame) -> DataFrame:
    """label, channel, t, mean, stdev (of the population); both 0 for labels with fewer than two clips."""
    stats = clips.groupBy("label", "channel", "t").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    many = F.col("n") >= 2
    return stats.select("label", "channel", "t", F.when(many, F.col("m")).otherwise(F.lit(0.0)).alias("mean"), F.when(many, F.col("s")).otherwise(F.lit(0.0)).alias("stdev"))


def event_statistics(series: DataFrame, events: DataFrame, clip_size: int) -> DataFrame:
    """clip_statistics of the clips of all events, without making the clips: events of a label at one time are one row with
    a weight. Samples beyond the series count as 0."""
    sizes = events.groupBy("label").agg(F.count("*").alias("n"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))).alias("t")
    places = events.groupBy("label", F.col("time").cast("long").alias("_at")).agg(F.count("*").alias("w"))
    asked = places.select("label", "w", "_at", steps).withColumn("_ts", F.col("_at") + F.col("t") - middle(clip_size))
    found = asked.join(sampled(series).withColumnRenamed("t", "_ts"), "_ts")
    by = ["label", "channel", "t"]
    sums = found.groupBy(*by).agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    grid = sizes.crossJoin(F.broadcast(series.select("channel").distinct())).withColumn("t", steps)
    means = checkpointed(grid.join(sums, by, "left").select(*by, "n", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean")))
    # squares are taken from the mean, so that equal samples have a deviation of 0
    squares = found.join(F.broadcast(means), by).groupBy(*by).agg(F.sum(F.pow(F.col("v") - F.col("mean"), 2) * F.col("w")).alias("ss"), F.sum("w").alias("inside"))  # labels by channels by clip size
    beyond = (F.col("n") - F.coalesce("inside", F.lit(0))) * F.col("mean") * F.col("mean")
    many = F.col("n") >= 2
    stdev = F.sqrt((F.coalesce("ss", F.lit(0.0)) + beyond) / F.col("n"))
    return means.join(squares, by, "left").select(*by, F.when(many, F.col("mean")).otherwise(F.lit(0.0)).alias("mean"), F.when(many, stdev).otherwise(F.lit(0.0)).alias("stdev"))


def view_templates(series: DataFrame, events: DataFrame, clip_size: int, *, max_events: int = 500, subtract_mean: bool = True, samplerate: float = 0, freq_min: float = 0, freq_max: float = 0, freq_wid: float = 1000, padding: int = 50) -> DataFrame:
    """Templates over at most max_events evenly spaced events of each label, less their mean over time if asked for. With
    a samplerate and a band they are made with `padding` more samples on either side, filtered and cut."""
    from tidewave.operators.events import subsample_firings

    band = samplerate and (freq_min or freq_max)
    extra = padding if band else 0
    means = templates(series, subsample_firings(events, max_per_label=max_events), clip_size + 2 * extra)
    if band:

        @F.pandas_udf("array<double>")
        def filtered(x: pd.Series) -> pd.Series:
            return pd.Series([filter_signal(np.asarray(v, float), samplerate, freq_min, freq_max, freq_wid)[extra : extra + clip_size].tolist() for v in x])

        wave = means.groupBy("label", "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("f"))  # one template
        means = wave.select("label", "channel", F.posexplode(filtered("f")).alias("t", "v"))
    if not subtract_mean:
        return means
    return means.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("label", "channel")))


def clip_features(clips: DataFrame) -> DataFrame:
    """One row for each clip: its values as an array by channel and time."""
    keys = [c for c in clips.columns if c not in ("channel", "t", "v")]
    return clips.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "t", "v"))), lambda x: x["v"]).alias("f"))  # one clip


def principal_features(clips: DataFrame, num_features: int = 10, *, subtract_mean: bool = False) -> DataFrame:
    """The keys of clips and features, the projections of each clip on the leading axes of all, from passes over the clips
    that hold a few arrays as long as a clip (see leading_axes)."""
    rows = checkpointed(clip_features(clips).withColumn("_all", F.lit(0)))
    axes = leading_axes(rows, "_all", "f", num_features, centred=subtract_mean)
    return projected(rows, "_all", "f", axes, "features").drop("_all")


def shift_clips(clips: DataFrame, shift: int, clip_size: int) -> DataFrame:
    """Clips moved later by `shift` samples, around the ends."""
    return clips.withColumn("t", F.pmod(F.col("t") + F.lit(shift), F.lit(clip_size)).cast("int"))


def sliding_correlations(means1: DataFrame, means2: DataFrame, radius: int = 10) -> DataFrame:
    """k1, k2, correlation, lag: how alike two tables of templates are, without taking off means, at the lag up to radius
    by which k2's template is moved earlier to be most like k1's (samples beyond a template are 0); of equals the
    least lag, and 0 where nothing is positive."""
    a = means1.select(F.col("label").alias("k1"), "channel", F.col("t").alias("at"), F.col("v").alias("v1"))
    b = means2.select(F.col("label").alias("k2"), "channel", "t", F.col("v").alias("v2"))
    moved = b.withColumn("lag", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("at", F.col("t") - F.col("lag"))
    inside = moved.join(F.broadcast(means1.agg(F.max("t").alias("top"))), (F.col("at") >= 0) & (F.col("at") <= F.col("top")))
    norm1 = a.groupBy("k1").agg(F.sum(F.col("v1") * F.col("v1")).alias("s11"))
    norm2 = inside.groupBy("k2", "lag").agg(F.sum(F.col("v2") * F.col("v2")).alias("s22"))
    both = inside.join(a, ["channel", "at"]).groupBy("k1", "k2", "lag").agg(F.sum(F.col("v1") * F.col("v2")).alias("s12"))
    r = both.join(norm1, "k1").join(norm2, ["k2", "lag"]).where("s11 > 0 AND s22 > 0").withColumn("r", F.col("s12") / F.sqrt(F.col("s11") * F.col("s22"))).where("r > 0")
    best = r.groupBy("k1", "k2").agg(F.max("r").alias("correlation"), F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"))
    pairs = means1.select(F.col("label").alias("k1")).distinct().crossJoin(F.broadcast(means2.select(F.col("label").alias("k2")).distinct()))  # labels only
    return pairs.join(best, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("correlation", F.lit(0.0)).alias("correlation"), F.coalesce("lag", F.lit(0)).alias("lag"))


def amplitudes(series: DataFrame, events: DataFrame, central_channel: int = 0) -> DataFrame:
    """event_id, amplitude: the series at the event on the given channel, or where it is largest in size (of equals, on the
    lowest channel). Events beyond the series have 0."""
    at = events.select("event_id", F.col("time").cast("long").alias("t"))
    values = series.where(F.col("channel") == central_channel) if central_channel else series
    values = sampled(values).join(at.select("t").distinct(), "t", "left_semi")  # of the samples at events
    top = values.groupBy("t").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("channel"))).alias("v"))
    return at.join(top.hint("merge"), "t", "left").select("event_id", F.coalesce("v", F.lit(0.0)).alias("amplitude"))


def peak_amplitudes(series: DataFrame, events: DataFrame, means: DataFrame, clip_size: int) -> DataFrame:
    """event_id, amplitude: the series at the place of each event's clip where its label's template is largest in size."""
    peak = means.groupBy("label").agg(F.max_by(F.struct("channel", "t"), F.struct(F.abs("v"), -F.col("t"), -F.col("channel"))).alias("p"))
    at = join_counted(events, checkpointed(peak), "label").select("event_id", F.col("p.channel").alias("channel"), (F.col("time").cast("long") + F.col("p.t") - middle(clip_size)).alias("t"))
    return at.join(sampled(series), ["channel", "t"], "left").select("event_id", F.coalesce("v", F.lit(0.0)).alias("amplitude"))


def discrimination(clips: DataFrame, labels: list[int]) -> DataFrame:
    """k1, k2, clip_id, label, score for each two of the labels, in list order: the clips of both, projected on the
    difference of their means and divided by its squared length."""
    means = clips.where(F.col("label").isin(labels)).groupBy("label", "channel", "t").agg(F.avg("v").alias("m"))
    order = {k: i for i, k in enumerate(labels)}
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    a = means.select(F.col("label").alias("k1"), "channel", "t", F.col("m").alias("m1"))
    b = means.select(F.col("label").alias("k2"), "channel", "t", F.col("m").alias("m2"))
    way = a.join(b, ["channel", "t"]).where(rank[F.col("k1")] < rank[F.col("k2")]).select("k1", "k2", "channel", "t", (F.col("m2") - F.col("m1")).alias("d"))
    norm = way.groupBy("k1", "k2").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    dots = clips.join(F.broadcast(way), ["channel", "t"]).where("label = k1 OR label = k2").groupBy("k1", "k2", "clip_id", "label").agg(F.sum(F.col("d") * F.col("v")).alias("dv"))
    return dots.join(F.broadcast(norm), ["k1", "k2"]).select("k1", "k2", "clip_id", "label", F.when(F.col("dd") > 0, F.col("dv") / F.col("dd")).otherwise(F.lit(0.0)).alias("score"))
