"""Event tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def firing_rates(stream: DataFrame, *, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """label, start, num_events, firing_rate for each window of a stream of events (ts, label); a window is final, and its
    state is dropped, once events come that are `late` after its end. Works on tables as well."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "label").agg(F.count("*").alias("num_events"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return counts.select("label", F.col("w.start").alias("start"), "num_events", (F.col("num_events") / seconds).alias("firing_rate"))
