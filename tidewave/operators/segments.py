"""Recordings that were sorted segment by segment, put together under one set of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.operators.neighbours import nearest
from tidewave.operators.templates import clip_features, extract_clips, sliding_correlations
from tidewave.plans.storage import checkpointed


def edge_events(firings: DataFrame, n: int, last: bool) -> DataFrame:
    """The n first or last events of each label."""
    time = F.desc("time") if last else F.asc("time")
    ranked = firings.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(time, "event_id")))
    return ranked.where(F.col("_r") <= n).drop("_r")


def label_votes(before: DataFrame, after: DataFrame, lags: DataFrame | None = None) -> DataFrame:
    """k1, k2, share: of the clips labelled k2 in after, how many have a clip labelled k1 as their nearest in before, of
    equals the smallest label. Both are clips (event_id, label, channel, t, v); lags (k1, k2, lag) moves those of k1
    first, around the ends: a clip of k2 asks once for each lag that it has, moved the other way, among the labels that
    have it."""
    one, two = checkpointed(clip_features(before)), checkpointed(clip_features(after))
    channels = before.select("channel").distinct().count()
    queries = two.select("event_id", F.col("label").alias("k2"), "f")
    if lags is None:
        asked = queries.withColumn("lag", F.lit(0)).withColumn("wanted", F.lit(None).cast("array<int>"))
    else:
        pairs = one.select(F.col("label").alias("k1")).distinct().crossJoin(F.broadcast(two.select(F.col("label").alias("k2")).distinct()))  # labels only
        pairs = pairs.join(lags, ["k1", "k2"], "left").groupBy("k2", F.coalesce("lag", F.lit(0)).alias("lag")).agg(F.sort_array(F.collect_list(F.col("k1").cast("int"))).alias("wanted"))

        @F.pandas_udf("array<double>")
        def moved(f: pd.Series, lag: pd.Series) -> pd.Series:
            return pd.Series([np.roll(np.asarray(x).reshape(channels, -1), -int(n), 1).reshape(-1).tolist() for x, n in zip(f, lag, strict=True)])

        asked = queries.join(F.broadcast(pairs), "k2").withColumn("f", F.when(F.col("lag") == 0, F.col("f")).otherwise(moved("f", "lag")))  # labels by lags
    asked = asked.select(F.struct("k2", "event_id", "lag").alias("qid"), "f", "wanted")
    # points are named by their label, so that of equals the smallest label is taken
    near = nearest(one.select(F.col("label").alias("id"), "label", "f"), asked, 1)
    votes = near.groupBy("qid.k2", "qid.event_id").agg(F.min_by("label", F.struct("distance", "label")).alias("k1"))
    return votes.groupBy("k1", "k2").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("k2"))).select("k1", "k2", "share")


def combine_firing_segments(series: list[DataFrame], firings: list[DataFrame], lengths: list[int], *, clip_size: int = 60, edge: int = 1000, threshold: float = 0.6) -> DataFrame:
    """Events of all segments, times one segment after another, labels joined across segments: between neighbouring
    segments pairs of labels are matched one to one, best share of votes first, while it exceeds the threshold;
    unmatched labels get new numbers. Votes come from the clips of each label's last and first `edge` events, those of
    the segment before moved by the lag at which their templates are most alike."""
    names: dict[int, int] = {}
    top, offset, out, before = 0, 0, None, None
    for i, (x, f, n) in enumerate(zip(series, firings, lengths, strict=True)):
        local = sorted(r["label"] for r in f.where("label > 0").select("label").distinct().collect())  # labels only
        mine: dict[int, int] = {}
        if before is not None:
            first = checkpointed(extract_clips(x, edge_events(f, edge, False).select("event_id", "time", "label"), clip_size))
            means = lambda c: c.groupBy("label", "channel", "t").agg(F.avg("v").alias("v"))
            lags = sliding_correlations(means(first), means(before)).select(F.col("k2").alias("k1"), F.col("k1").alias("k2"), (-F.col("lag")).alias("lag"))
            votes = label_votes(before, first, lags).where(F.col("share") > threshold).collect()
            used: set[int] = set()
            for v in sorted(votes, key=lambda v: (-v["share"], v["k1"], v["k2"])):
                if v["k2"] not in mine and v["k1"] not in used:
                    mine[v["k2"]] = names[v["k1"]]
                    used.add(v["k1"])
        for k in local:
            if k not in mine:
                top += 1
                mine[k] = top
        named = f.sparkSession.createDataFrame(sorted(mine.items()) or [(0, 0)], "label int, new int")
        part = f.join(F.broadcast(named), "label").select(F.lit(i).alias("segment"), "event_id", "channel", (F.col("time") + F.lit(offset)).alias("time"), F.col("new").alias("label"))
        out = part if out is None else out.unionByName(part)
        before = checkpointed(extract_clips(x, edge_events(f, edge, True).select("event_id", "time", "label"), clip_size))
        names, offset = mine, offset + n
    return out
