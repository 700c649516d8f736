"""Numbers for each cluster and each pair of clusters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.functions.kernels import principal_axes
from tidewave.operators.stretches import pair_counts
from tidewave.plans.storage import checkpointed


def cluster_metrics(firings: DataFrame, samplerate: float = 0) -> DataFrame:
    """label, num_events, t1_sec, t2_sec, dur_sec, firing_rate (0 for a cluster without duration)."""
    rate = samplerate or 1.0
    spans = firings.groupBy("label").agg(F.count("*").alias("num_events"), (F.min("time") / F.lit(rate)).alias("t1_sec"), (F.max("time") / F.lit(rate)).alias("t2_sec"))
    spans = spans.withColumn("dur_sec", F.col("t2_sec") - F.col("t1_sec"))
    return spans.withColumn("firing_rate", F.when(F.col("dur_sec") > 0, F.col("num_events") / F.col("dur_sec")).otherwise(F.lit(0.0)))


def view_metrics(firings: DataFrame, samplerate: float = 0) -> DataFrame:
    """label, num_events, tmin_sec, tmax_sec, dur_sec."""
    return cluster_metrics(firings, samplerate).select("label", "num_events", F.col("t1_sec").alias("tmin_sec"), F.col("t2_sec").alias("tmax_sec"), "dur_sec")


def metrics_long(metrics: DataFrame) -> DataFrame:
    """label, name, value from a wide table of metrics."""
    names = [c for c in metrics.columns if c != "label"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    return metrics.select("label", pairs.alias("m")).select("label", "m.name", "m.value")


def combine_cluster_metrics(sources: list[DataFrame]) -> DataFrame:
    """label, name, value over long tables of metrics: of a name that several give for a label, the last one's."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select("label", "name", "value", F.lit(i).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("label", "name").agg(F.max_by("value", "source").alias("value"))


def metrics_document(long: DataFrame) -> DataFrame:
    """One row a label with its metrics as a map."""
    return long.groupBy("label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metrics"))  # a label's own metrics


def run_metrics_script(long: DataFrame, script: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lets a user's function add, change or remove metrics (label, name, value)."""
    return script(long).select("label", "name", "value")


def cross_correlograms(firings: DataFrame, max_dt: float, bin_size: float, *, clusters: list[int] | None = None, auto: bool = False) -> DataFrame:
    """k1, k2, bin, n: pairs of different events with labels k1, k2 by the bin of t2 - t1, of 2 * ceil(max_dt / bin_size)
    bins from below; the upper edge isn't included. With auto only k1 = k2. Bins without pairs are there, with 0.

    Pairs are counted by places in sorted times, and none is made.
    """
    half = math.ceil(max_dt / bin_size)
    edge = half * bin_size
    rows = firings.where("label > 0")
    if clusters:
        rows = rows.where(F.col("label").isin(clusters))
    counts = pair_counts(rows, edge, lambda dt: np.where(dt < edge, np.floor((dt + edge) / bin_size), 2 * half), 2 * half, auto=auto)
    k = rows.select("label").distinct()
    grid = k.select(F.col("label").alias("k1")).crossJoin(k.select(F.col("label").alias("k2")))  # labels only
    if auto:
        grid = grid.where("k1 = k2")
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))))
    return grid.join(counts, ["k1", "k2", "bin"], "left").select("k1", "k2", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def peak_metrics(template_stats: DataFrame) -> DataFrame:
    """label, peak_amp, peak_noise, peak_snr from label, channel, t, mean, stdev."""
    top = template_stats.groupBy("label").agg(F.max(F.abs("mean")).alias("peak_amp"), F.max(F.abs("stdev")).alias("peak_noise"))
    return top.withColumn("peak_snr", F.when(F.col("peak_noise") > 0, F.col("peak_amp") / F.col("peak_noise")).otherwise(F.lit(0.0)))


def template_correlations(templates: DataFrame) -> DataFrame:
    """k1, k2, distance (Euclidean), correlation of each two different labels' templates (label, channel, t, v)."""
    a = templates.select(F.col("label").alias("k1"), "channel", "t", F.col("v").alias("v1"))
    b = templates.select(F.col("label").alias("k2"), "channel", "t", F.col("v").alias("v2"))
    both = a.join(b, ["channel", "t"]).where("k1 <> k2")
    return both.groupBy("k1", "k2").agg(F.sqrt(F.sum(F.pow(F.col("v1") - F.col("v2"), 2))).alias("distance"), F.corr("v1", "v2").alias("correlation"))


def pairs_to_compare(templates: DataFrame, *, nearest: int = 3, most: int = 10, min_correlation: float = 0.8) -> DataFrame:
    """k1, k2, distance: for each label the `nearest` others, and up to `most` whose templates correlate well."""
    ranked = template_correlations(templates).withColumn("rank", F.row_number().over(Window.partitionBy("k1").orderBy("distance", "k2")))
    return ranked.where((F.col("rank") <= nearest) | ((F.col("correlation") >= min_correlation) & (F.col("rank") <= most))).select("k1", "k2", "distance")


def bursting_parents(firings: DataFrame, templates: DataFrame, *, window: float = 1500, min_correlation: float = 0.8, threshold: float = 8.0) -> DataFrame:
    """label, bursting_parent (0: none): another label k2 with a similar, no smaller template, whose events come before
    the label's own more often than after, by score (before - 2 * after) / sqrt(max(15, 2 * after)) of k2's events
    around it; of several, the largest label."""
    peaks = templates.groupBy("label").agg(F.max(F.abs("v")).alias("peak"))
    p1, p2 = peaks.select(F.col("label").alias("k1"), F.col("peak").alias("peak1")), peaks.select(F.col("label").alias("k2"), F.col("peak").alias("peak2"))
    pairs = template_correlations(templates).where(F.col("correlation") >= min_correlation).join(p1, "k1").join(p2, "k2").where("peak2 >= peak1").select("k1", "k2")
    # before, at the same time, after
    near = pair_counts(firings, window, lambda dt: (dt >= -window).astype(int) + (dt >= 0) + (dt > 0) + (dt > window) - 1, 3)
    of = lambda j: F.coalesce(F.sum(F.when(F.col("bin") == j, F.col("n"))), F.lit(0))
    counts = pairs.join(near.groupBy("k1", "k2").agg(of(0).alias("left"), of(2).alias("right")), ["k1", "k2"])
    score = (F.col("left") - 2 * F.col("right")) / F.sqrt(F.greatest(F.lit(15.0), 2.0 * F.col("right")))
    best = counts.where(score > threshold).groupBy(F.col("k1").alias("label")).agg(F.max("k2").alias("p"))
    return peaks.select("label").join(best, "label", "left").select("label", F.coalesce("p", F.lit(0)).cast("int").alias("bursting_parent"))


def isolation(overlaps: DataFrame, labels: DataFrame) -> DataFrame:
    """label, isolation (1 less the largest overlap with another cluster, 1 without any), overlap_cluster (0: none), from
    k1, k2, overlap in either direction."""
    both = overlaps.select(F.col("k1").alias("label"), F.col("k2").alias("other"), "overlap").unionByName(overlaps.select(F.col("k2").alias("label"), F.col("k1").alias("other"), "overlap"))
    worst = both.groupBy("label").agg(F.max("overlap").alias("o"), F.max_by("other", F.struct("overlap", -F.col("other"))).alias("c"))
    return labels.select("label").distinct().join(worst, "label", "left").select("label", (1 - F.coalesce("o", F.lit(0.0))).alias("isolation"), F.when(F.coalesce("o", F.lit(0.0)) > 0, F.col("c")).otherwise(0).cast("int").alias("overlap_cluster"))


def drawn_order(column: str) -> list:
    """A fixed order that has nothing to do with the values: by the digest of an id."""
    return [F.md5(F.col(column).cast("string").cast("binary")), F.col(column)]


def pair_overlap(points: DataFrame, pairs: DataFrame, *, k: int = 5, most: int = 500, num_features: int = 0, fewest: int = 0) -> DataFrame:
    """k1, k2, overlap: how many of the k nearest neighbours of a pair's points belong to the other cluster, as a share. With
    num_features a pair's points are reduced to their leading axes first; a pair of which one has fewer points than
    fewest has no overlap.

    points: id, label, f (array). Of each cluster the `most` points with the smallest digest of their id are taken, as
    many of either; the neighbours of a point are found among those of its pair only, which one task compares. Of
    points at one distance the smaller id is nearer.
    """
    some = points.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*drawn_order("id")))).where(F.col("r") <= most)
    some = checkpointed(some)
    n = some.groupBy("label").agg(F.count("*").alias("n"))
    sized = pairs.select("k1", "k2").join(n.select(F.col("label").alias("k1"), F.col("n").alias("n1")), "k1").join(n.select(F.col("label").alias("k2"), F.col("n").alias("n2")), "k2").withColumn("take", F.least("n1", "n2"))
    members = sized.withColumn("label", F.explode(F.array("k1", "k2"))).join(some, "label").where("r <= take").select("k1", "k2", "label", "id", "f")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """2 * most points at most."""
        pdf = pdf.sort_values("id")
        x, label = np.stack(pdf["f"].to_numpy()), pdf["label"].to_numpy()
        if num_features:
            x = x @ principal_axes(x, min(num_features, x.shape[1]))
        other = []
        for i in range(len(x)):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            other += (label[near] != label[i]).tolist()
        return pd.DataFrame({"k1": pdf["k1"].iloc[:1], "k2": pdf["k2"].iloc[:1], "overlap": [float(np.mean(other)) if other and len(x) >= 2 * fewest else 0.0]})

    return members.groupBy("k1", "k2").applyInPandas(compare, "k1 int, k2 int, overlap double")
