"""Algebra of event tables ("firings"): event_id, channel, time, label and, where known, amplitude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.operators.joins import join_counted, numbered, running_total
from tidewave.plans.storage import checkpointed


def parse_int_list(text: str) -> list[int]:
    """"1,3-5" as [1, 3, 4, 5]; blanks are skipped."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, dash, last = part.partition("-") if not part.startswith("-") else (part, "", "")
        out += range(int(first), int(last) + 1) if dash else [int(first)]
    return out


def create_firings(times: DataFrame, labels: DataFrame, amplitudes: DataFrame | None = None, central_channel: int = 0) -> DataFrame:
    """Puts times (event_id, time), labels (event_id, label) and amplitudes (event_id, amplitude) side by side."""
    out = times.join(labels, "event_id").withColumn("channel", F.lit(central_channel))
    if amplitudes is None:
        return out.select("event_id", "channel", "time", "label")
    return out.join(amplitudes, "event_id").select("event_id", "channel", "time", "label", "amplitude")


def apply_timestamp_offset(firings: DataFrame, offset: float) -> DataFrame:
    kind = firings.schema["time"].dataType
    return firings.withColumn("time", (F.col("time") + F.lit(offset)).cast(kind))


def extract_firings(firings: DataFrame, t1: float = 0, t2: float = -1, clusters: list[int] | None = None, metrics: DataFrame | None = None, exclusion_tags: list[str] | None = None) -> DataFrame:
    """Events from t1 to t2 (no end if t2 < 0), of the given clusters, without those whose cluster has an excluded tag
    in metrics (label, tags)."""
    out = firings.where(F.col("time") >= t1)
    if t2 >= 0:
        out = out.where(F.col("time") <= t2)
    if clusters:
        out = out.where(F.col("label").isin(list(clusters)))
    if metrics is not None and exclusion_tags:
        bad = metrics.select("label", F.explode("tags").alias("tag")).where(F.col("tag").isin(exclusion_tags)).select("label").distinct()
        out = out.join(bad, "label", "left_anti")
    return out.select(firings.columns)


def split_firings(firings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assigns events of a concatenated recording to its sessions (session, length), in order of session: time counts
    from the session's start. Events before the first session belong to it, those after the last to that."""
    spans = running_total(sessions, "session", "length", "start")
    last = Window.partitionBy(F.lit(1))
    spans = spans.withColumn("end", F.col("start") + F.col("length")).withColumn("lo", F.when(F.col("start") == F.min("start").over(last), F.lit(-1e300)).otherwise(F.col("start").cast("double"))).withColumn("hi", F.when(F.col("session") == F.max("session").over(last), F.lit(1e300)).otherwise(F.col("end").cast("double")))
    packed = spans.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "session", "start"))).alias("spans"))  # one entry a session
    found = firings.crossJoin(F.broadcast(packed)).withColumn("span", F.element_at(F.filter("spans", lambda s: (F.col("time") >= s["lo"]) & (F.col("time") < s["hi"])), 1))
    return found.select(*[c for c in firings.columns if c != "time"], F.col("span.session").alias("session"), (F.col("time") - F.col("span.start")).alias("time"))


def subsample_firings(firings: DataFrame, labels: list[int] | None = None, max_per_label: int = 0) -> DataFrame:
    """Of each label at most max_per_label events (0: all), evenly spaced in order of event_id."""
    rows = firings.where(F.col("label").isin(labels)) if labels else firings
    if max_per_label <= 0:
        return rows
    ranked = numbered(rows, "label", "event_id")
    # the k-th kept event is number floor(k * n / most): event i is kept if a multiple of n lies in [i * most, (i + 1) * most)
    upto = lambda i: F.expr(f"({i} * {max_per_label}L + _n - 1) div _n")
    keep = (F.col("_n") <= max_per_label) | (upto("_i") < upto("(_i + 1)"))
    return ranked.where(keep).select(firings.columns)


def combine_firings(sources: list[DataFrame], increment_labels: bool = True) -> DataFrame:
    """All events with a positive label, by time; labels of later sources go on after the largest so far."""
    shared = [c for c in sources[0].columns if all(c in s.columns for s in sources)]
    rows = sources[0].select(*shared, F.lit(0).alias("source"))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.select(*shared, F.lit(i).alias("source")))
    rows = rows.where("label > 0")
    if increment_labels:
        tops = running_total(rows.groupBy("source").agg(F.max("label").alias("top")), "source", "top", "shift")
        rows = rows.join(F.broadcast(tops.select("source", "shift")), "source").withColumn("label", (F.col("label") + F.col("shift")).cast("int"))
    return rows.select("source", *shared)


def concat_firings(sources: list[DataFrame], lengths: list[int] | None = None) -> DataFrame:
    """Events one recording after another: times of each are shifted by the lengths of those before (0 if unknown)."""
    out, offset = None, 0
    for i, s in enumerate(sources):
        part = s.withColumn("source", F.lit(i)).withColumn("time", F.col("time") + F.lit(offset))
        out = part if out is None else out.unionByName(part)
        offset += lengths[i] if lengths else 0
    return out


def concat_event_times(sources: list[DataFrame]) -> DataFrame:
    """Times as they are, with the number of their source."""
    return concat_firings([s.select("event_id", "time") for s in sources])


def in_time_order(events: DataFrame, *ties: str) -> DataFrame:
    """events with position (from 0): their place in order of time, of equals by ties (by default source, where events have one,
    and event_id), so that an order survives tables and files, which have none."""
    ties = ties or tuple(c for c in ("source", "event_id") if c in events.columns)
    return numbered(events.withColumn("_all", F.lit(0)), "_all", "time", *ties).withColumnRenamed("_i", "position").drop("_all", "_n")


def create_label_map(metrics: DataFrame, *, min_rate: float = 0.05, min_isolation: float = 0.95, max_noise_overlap: float = 0.03, min_snr: float = 1.5) -> DataFrame:
    """old_label, new_label: 0 for clusters that fail a threshold, the bursting parent where there is one, else the
    label itself. metrics: label, firing_rate, isolation, noise_overlap, peak_snr, bursting_parent."""
    fails = (F.col("firing_rate") < min_rate) | (F.col("isolation") < min_isolation) | (F.col("noise_overlap") > max_noise_overlap) | (F.col("peak_snr") < min_snr)
    new = F.when(fails, 0).when(F.coalesce("bursting_parent", F.lit(0)) != 0, F.col("bursting_parent")).otherwise(F.col("label"))
    return metrics.select(F.col("label").alias("old_label"), new.cast("int").alias("new_label"))


def resolve_label_map(label_map: DataFrame, most_steps: int = 32) -> DataFrame:
    """Follows merge chains (3 to 2, 2 to 1: 3 to 1) by doubling the way with each join, so that 32 steps are enough
    for any map; chains that meet 0 end there, and a label on a cycle stays itself."""
    step = checkpointed(label_map.select(F.col("old_label").alias("a"), F.col("new_label").alias("b")).where("a <> b"))
    for _ in range(most_steps):
        nxt = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = checkpointed(step.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
        moved = new.join(step, ["a", "b"], "left_anti").limit(1).count()
        step = new
        if not moved:
            break
    all_labels = label_map.select(F.col("old_label").alias("a"))
    return all_labels.join(step, "a", "left").select(F.col("a").alias("old_label"), F.coalesce("b", "a").alias("new_label"))


def apply_label_map(firings: DataFrame, label_map: DataFrame) -> DataFrame:
    """Relabels events through the map's chains and drops those that end at label 0; other labels stay."""
    final = checkpointed(resolve_label_map(label_map))
    out = join_counted(firings, final, F.col("label") == F.col("old_label"), "left").withColumn("label", F.coalesce("new_label", "label").cast("int"))
    return out.where("label <> 0").select(firings.columns)


def reorder_labels(firings: DataFrame, templates: DataFrame) -> DataFrame:
    """Renumbers labels by their template's peak: labels without one last, then by the peak's channel, larger peaks
    first. templates: label, channel, t, v. Labels without a template stay."""
    peak = templates.groupBy("label").agg(F.max_by(F.struct(F.abs("v").alias("size"), "channel"), F.struct(F.abs("v"), -F.col("channel"), -F.col("t"))).alias("p"))
    order = Window.orderBy((F.col("p.size") == 0).cast("int"), "p.channel", F.col("p.size").desc(), "label")  # one row a label
    ranks = checkpointed(peak.select("label", F.row_number().over(order).alias("new")))
    return join_counted(firings, ranks, "label", "left").withColumn("label", F.coalesce("new", "label").cast("int")).select(firings.columns)
