"""Operators on multichannel series in long form: channel, t, v."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.functions.kernels import border_states, filter_signal, keep_peaks
from tidewave.plans.storage import checkpointed


def extract_timeseries(series: DataFrame, channels: list[int] | None = None, t1: int = -1, t2: int = -1) -> DataFrame:
    """Samples t1 to t2, both included (-1: the ends), of some channels; times count from t1, channels from 1 in the
    order asked for."""
    out = series
    if t1 >= 0:
        out = out.where(F.col("t") >= t1)
    if t2 >= 0:
        out = out.where(F.col("t") <= t2)
    out = out.withColumn("t", F.col("t") - max(t1, 0))
    if not channels:
        return out.select("channel", "t", "v")
    place = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")).cast("int")
    return out.where(F.col("channel").isin(channels)).select(place.alias("channel"), "t", "v")


def extract_geom(geom: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """Coordinates of some channels, renumbered in the order asked for."""
    if not channels:
        return geom
    place = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")).cast("int")
    return geom.where(F.col("channel").isin(channels)).withColumn("channel", place)


def concat_timeseries(parts: list[DataFrame], lengths: list[int]) -> DataFrame:
    """One recording after another."""
    out, offset = None, 0
    for part, n in zip(parts, lengths, strict=True):
        moved = part.select("channel", (F.col("t") + F.lit(offset)).alias("t"), "v")
        out, offset = moved if out is None else out.unionByName(moved), offset + n
    return out


def normalize_channels(series: DataFrame) -> DataFrame:
    """(v - mean) / stdev of each channel; a constant channel only loses its mean."""
    stats = series.groupBy("channel").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    scale = F.when(F.coalesce("s", F.lit(0.0)) > 0, F.col("s")).otherwise(F.lit(1.0))
    return series.join(F.broadcast(stats), "channel").select("channel", "t", ((F.col("v") - F.col("m")) / scale).alias("v"))


def quantize(series: DataFrame, unit: float) -> DataFrame:
    """Values rounded to whole units by truncation of v / unit + 0.5, as integers."""
    return series.withColumn("v", F.expr(f"cast(v / {unit!r}D + 0.5D AS int)"))


def multiscale(series: DataFrame, length: int) -> DataFrame:
    """factor, stat (min or max), channel, t, v: extremes of each 3, 9, 27, ... samples, up to the first power of 3 that
    holds the whole series; samples beyond its end count as 0. The first level is made once; each of its buckets
    counts for all levels above, whose extremes are taken within tasks before the shuffle."""
    factors = [3]
    while factors[-1] < length:
        factors.append(3 * factors[-1])
    first = checkpointed(series.groupBy("channel", F.expr("t div 3").alias("u")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))
    each = first.withColumn("factor", F.explode(F.array(*[F.lit(f).cast("long") for f in factors])))
    level = each.groupBy("factor", "channel", F.expr("u div (factor div 3)").alias("t")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    beyond = F.col("n") < F.col("factor")
    lo, hi = F.when(beyond, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")), F.when(beyond, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    both = F.array(F.struct(F.lit("min").alias("stat"), lo.alias("v")), F.struct(F.lit("max").alias("stat"), hi.alias("v")))
    return level.select("factor", "channel", "t", F.explode(both).alias("x")).select("factor", "x.stat", "channel", "t", "x.v")


def mask_out_artifacts(series: DataFrame, length: int, *, interval: int = 2000, threshold: float = 6.0) -> DataFrame:
    """Zeroes intervals whose norm on some channel exceeds mean + threshold * stdev over intervals, their neighbours, and the
    incomplete interval at the end."""
    whole = length // interval
    part = F.expr(f"t div {interval}")
    norms = series.where(part < whole).groupBy("channel", part.alias("i")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    stats = norms.groupBy("channel").agg(F.avg("norm").alias("m"), F.coalesce(F.stddev_samp("norm"), F.lit(0.0)).alias("s"))
    bad = norms.join(F.broadcast(stats), "channel").where(F.col("norm") > F.col("m") + threshold * F.col("s")).select(F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("i")).distinct().withColumn("bad", F.lit(True))
    joined = series.withColumn("i", part).join(bad, "i", "left")
    return joined.select("channel", "t", F.when(F.col("bad").isNotNull() | (F.col("i") >= whole), F.lit(0.0)).otherwise(F.col("v")).alias("v"))


def covariance(series: DataFrame, length: int | None = None) -> DataFrame:
    """m1, m2, w: sums of products over time, without taking off means, divided by the number of samples less one. Channels of
    one time are put in one row, so that a pair of channels isn't a join."""
    wide = series.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("channel", "v"))).alias("x"))  # a sample's channels
    pairs = wide.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"))
    sums = pairs.groupBy(F.col("a.channel").alias("m1"), F.col("b.channel").alias("m2")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("s"))
    n = F.lit(length) if length else F.col("n")
    if not length:
        sums = sums.crossJoin(F.broadcast(series.agg(F.countDistinct("t").alias("n"))))
    return sums.select("m1", "m2", (F.col("s") / (n - 1)).alias("w"))


def threshold_candidates(series: DataFrame, *, threshold: float = 3.0, sign: int = 0) -> DataFrame:
    """channel, t, v: samples whose value less the channel's mean, by its sign (0: either), exceeds threshold * stdev."""
    stats = series.groupBy("channel").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    centred = F.col("v") - F.col("m")
    size = F.abs(centred) if sign == 0 else centred * sign
    return series.join(F.broadcast(stats), "channel").where(size > threshold * F.col("s")).select("channel", "t", size.alias("v"))


def sessions(candidates: DataFrame, gap: float, *, part: int = 1_000_000) -> DataFrame:
    """Adds session: candidates of a channel belong together while no gap of more than `gap` lies between them.

    Sessions are numbered within parts of time, so that no task sees a whole channel; numbers go on from those of the
    parts before, of which there is one row for each `part` units of time."""
    rows = checkpointed(candidates.withColumn("_part", F.floor(F.col("t") / part)))
    by = Window.partitionBy("channel", "_part").orderBy("t")
    new = (F.coalesce(F.col("t") - F.lag("t").over(by), F.lit(0)) > gap).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_s", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("channel", "_part").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.max("_s").alias("_s1"))
    order = Window.partitionBy("channel").orderBy("_part")
    fresh = F.coalesce((F.col("_t0") - F.lag("_t1").over(order)) > gap, F.lit(False)).cast("int")
    ends = ends.withColumn("_step", fresh + F.coalesce(F.lag("_s1").over(order), F.lit(0)))
    ends = ends.select("channel", "_part", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_base"))
    return rows.join(ends, ["channel", "_part"]).withColumn("session", (F.col("_s") + F.col("_base")).cast("int")).select(*candidates.columns, "session")


def in_blocks(candidates: DataFrame, width: int, before: int, after: int) -> DataFrame:
    """Candidates with the block of `width` units of time that they are in, and again for the blocks that they lie up to
    `before` ahead of or up to `after` behind."""
    own = F.floor(F.col("t") / width)
    ahead = F.when(F.col("t") >= (own + 1) * width - before, own + 1)
    behind = F.when(F.col("t") <= own * width + after, own - 1)
    return candidates.select("channel", "t", "v", F.explode(F.array_compact(F.array(own, ahead, behind))).alias("block"))


def entering_states(functions: DataFrame) -> DataFrame:
    """channel, block, state: the last peak before each block, from what each block makes (m) of the peak before it.

    Blocks that make the same of every peak, or have no block before them, are settled at once; each of the others is
    put together with the block before it, and then with what that one was put together with, so that the stretch
    of unsettled blocks that a row stands for doubles from round to round."""
    settled = lambda m, first_of_all: F.when(first_of_all | (F.size(F.array_distinct(F.map_values(m))) == 1), F.coalesce(F.try_element_at(m, F.lit(-1).cast("long")), F.element_at(F.map_values(m), 1)))
    there = functions.select("channel", (F.col("block") + 1).alias("block"), F.lit(True).alias("has"))
    f = functions.join(there, ["channel", "block"], "left").select("channel", "block", F.col("block").alias("first"), "m", settled(F.col("m"), F.col("has").isNull()).alias("out"))
    f = checkpointed(f)
    while f.where("out IS NULL").limit(1).count():
        one = f.where("out IS NULL").withColumn("at", F.col("first") - 1)
        other = f.select("channel", F.col("block").alias("at"), F.col("first").alias("first0"), F.col("m").alias("m0"), F.col("out").alias("out0"))
        of = lambda s: F.coalesce(F.try_element_at("m", s), F.try_element_at("m", F.lit(-1).cast("long")))
        joined = one.join(other, ["channel", "at"]).select("channel", "block", F.col("first0").alias("first"), F.transform_values("m0", lambda k, s: of(s)).alias("m"), F.when(F.col("out0").isNotNull(), of(F.col("out0"))).alias("out"))
        joined = joined.withColumn("out", F.coalesce("out", settled(F.col("m"), F.lit(False))))
        f = checkpointed(f.where("out IS NOT NULL").unionByName(joined))
    return f.select("channel", (F.col("block") + 1).alias("block"), F.col("out").alias("state"))


def detect_events(series: DataFrame, *, threshold: float = 3.0, interval: int = 10, sign: int = 0, width: int = 100_000) -> DataFrame:
    """channel, t, v of the candidates that no larger one suppresses (see keep_peaks).

    Time is cut into blocks of `width`, and a task holds a block's candidates and those within the interval around it, also
    where the series is above the threshold all the time. Each block first says what it makes of any last peak before
    it; these functions, put together, give the peak that each block begins with, and then each decides its own
    candidates."""
    width = max(width, interval)
    rows = checkpointed(threshold_candidates(series, threshold=threshold, sign=sign).withColumn("t", F.col("t").cast("long")))
    kind = dict(rows.dtypes)["channel"]

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        block, t = int(pdf["block"].iloc[0]), pdf["t"].tolist()
        first = sum(x < block * width for x in t)
        if first == len(t):
            return pd.DataFrame(columns=["channel", "block", "m"], dtype=object)
        states = border_states(t, pdf["v"].tolist(), interval, first, (block + 1) * width)
        return pd.DataFrame({"channel": pdf["channel"].iloc[:1], "block": [block], "m": [[{"key": a, "value": b} for a, b in states]]})

    ahead = in_blocks(rows, width, interval, -1)
    functions = ahead.groupBy("channel", "block").applyInPandas(function, f"channel {kind}, block long, m array<struct<key:long,value:long>>")
    functions = checkpointed(functions.select("channel", "block", F.map_from_entries("m").alias("m")))
    states = entering_states(functions)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        block, t, state = int(pdf["block"].iloc[0]), pdf["t"].to_numpy(), int(pdf["state"].iloc[0])
        first = int(np.searchsorted(t, block * width))
        best = int(np.searchsorted(t, state)) if state >= 0 else -1
        keep = np.array(keep_peaks(t.tolist(), pdf["v"].tolist(), interval, first, best), bool)
        own = (t >= block * width) & (t < (block + 1) * width)
        return pdf.loc[keep & own, ["channel", "t", "v"]]

    around = in_blocks(rows, width, interval, interval).join(states, ["channel", "block"], "left").withColumn("state", F.coalesce("state", F.lit(-1).cast("long")))
    return around.groupBy("channel", "block").applyInPandas(decide, f"channel {kind}, t long, v double")


def bandpass_filter(series: DataFrame, samplerate: float, freq_min: float, freq_max: float, freq_wid: float = 1000.0, *, chunk: int = 30_000, padding: int = 3_000, quantize_unit: float = 0.0, subsample: int = 1) -> DataFrame:
    """Filters each channel chunk by chunk; a chunk also sees `padding` samples on either side, which are dropped after.
    freq_max = 0 leaves values as they are. A sample is repeated for the chunks whose padding it lies in, and each
    chunk of a channel is one bounded group."""
    if freq_max <= 0:
        out = series.select("channel", "t", "v")
    else:
        near = F.explode(F.sequence(F.greatest(F.expr(f"(t - {padding}) div {chunk}"), F.lit(0).cast("long")), F.expr(f"(t + {padding}) div {chunk}")))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            first = int(pdf["chunk"].iloc[0]) * chunk
            x = np.zeros(chunk + 2 * padding)
            x[(pdf["t"] - first + padding).to_numpy()] = pdf["v"].to_numpy()
            y = filter_signal(x, samplerate, freq_min, freq_max, freq_wid)
            own = pdf[(pdf["t"] >= first) & (pdf["t"] < first + chunk)]
            return pd.DataFrame({"channel": own["channel"], "t": own["t"], "v": y[(own["t"] - first + padding).to_numpy()]})

        out = series.select("channel", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"), near.alias("chunk")).groupBy("channel", "chunk").applyInPandas(run, "channel int, t long, v double")
    if subsample > 1:
        out = out.where(F.col("t") % subsample == 0).withColumn("t", F.expr(f"t div {subsample}"))
    return quantize(out, quantize_unit) if quantize_unit > 0 else out


def mixed_channels(rows: DataFrame, matrix: DataFrame, by: list[str]) -> DataFrame:
    """by, channel, v for rows (by, channel, v): each channel m1 as the sum over channels m2 of w * v. The channels of one
    sample are put in one row, and a row is multiplied where it is. matrix: m1, m2, w of a few channels."""
    wide = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("channel", "v"))).alias("x"))  # a sample's channels
    weights = matrix.groupBy("m1").agg(F.sort_array(F.collect_list(F.struct("m2", "w"))).alias("ws")).agg(F.sort_array(F.collect_list(F.struct("m1", "ws"))).alias("all"))
    each = wide.crossJoin(F.broadcast(weights)).select(*by, "x", F.explode("all").alias("m"))  # one row of channels squared
    here = F.filter("m.ws", lambda c: F.map_contains_key(F.col("x"), c["m2"]))
    total = F.aggregate(here, F.lit(0.0), lambda s, c: s + c["w"] * F.element_at(F.col("x"), c["m2"]))
    return each.where(F.size(here) > 0).select(*by, F.col("m.m1").alias("channel"), total.alias("v"))


def apply_matrix(series: DataFrame, matrix: DataFrame, unit: float = 0.0) -> DataFrame:
    """Each channel m1 as the sum over channels m2 of w * v; unit > 0 rounds to that grid. matrix: m1, m2, w of a few
    channels."""
    out = mixed_channels(series, matrix, ["t"]).select("channel", "t", "v")
    return out.withColumn("v", F.floor(F.col("v") / unit + 0.5) * F.lit(unit)) if unit > 0 else out


def whitening_matrix(series: DataFrame, length: int | None = None, *, channels: list[int] | None = None) -> DataFrame:
    """m1, m2, w: the inverse square root of the covariance of all or some channels, whose size is that of the channels
    only. With a subset, its channels are numbered from 1 in the order asked for."""
    if channels:
        series = extract_timeseries(series, channels)
    rows = covariance(series, length).collect()  # channels squared
    return series.sparkSession.createDataFrame(inverse_root([(r["m1"], r["m2"], r["w"]) for r in rows]), "m1 int, m2 int, w double")


def inverse_root(entries: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The inverse square root of a symmetric matrix of a few channels, given and returned by its entries."""
    names = sorted({m1 for m1, _, _ in entries})
    place = {c: i for i, c in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for m1, m2, w in entries:
        cov[place[m1], place[m2]] = w
    values, vectors = np.linalg.eigh(cov)
    scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0) if len(values) else values
    w = (vectors * scale) @ vectors.T
    return [(a, b, float(w[place[a], place[b]])) for a in names for b in names]


def whiten(series: DataFrame, length: int | None = None, unit: float = 1e-4) -> DataFrame:
    """Channels without correlation and of unit variance, on a grid of `unit`."""
    return apply_matrix(series, whitening_matrix(series, length), unit)


def whiten_clips(clips: DataFrame, matrix: DataFrame) -> DataFrame:
    """The same for clips (clip_id, channel, t, v), without a grid."""
    return mixed_channels(clips, matrix, ["clip_id", "t"]).select("clip_id", "channel", "t", "v")
