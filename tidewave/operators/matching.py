"""Matching of two event tables over the same recording, and what follows from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.functions.kernels import assignment
from tidewave.operators.stretches import mutual_matches, partner_counts, sweep_counts
from tidewave.plans.storage import checkpointed


def match_counts(firings1: DataFrame, firings2: DataFrame, max_offset: float) -> DataFrame:
    """k1, k2, n12 (events labelled k1 that have one labelled k2 nearby), n21 (the other way)."""
    return partner_counts(firings1, firings2, max_offset)


def match_events(firings1: DataFrame, firings2: DataFrame, max_offset: float = 30, most_passes: int = 10) -> DataFrame:
    """e1, k1, t1, e2, k2, t2 of events that choose each other, in passes: each unmatched event chooses, of the
    unmatched ones nearby, that with the best label match, then the nearest in time, then the earliest."""
    counts = match_counts(firings1, firings2, max_offset)
    n1 = firings1.where("label > 0").groupBy(F.col("label").alias("k1")).agg(F.count("*").alias("all1"))
    n2 = firings2.where("label > 0").groupBy(F.col("label").alias("k2")).agg(F.count("*").alias("all2"))
    share = F.least(F.col("n12") / F.col("all1"), F.col("n21") / F.col("all2"))
    scores = {(r["k1"], r["k2"]): r["score"] for r in counts.join(n1, "k1").join(n2, "k2").select("k1", "k2", share.alias("score")).collect()}  # labels only
    sides = [f.where("label > 0").select(F.lit(i).alias("side"), "label", "time", "event_id") for i, f in ((1, firings1), (2, firings2))]
    # of a label's events at one time a pass takes the one with the smallest id at most, so that later ones are never asked
    first = F.row_number().over(Window.partitionBy("side", "label", "time").orderBy("event_id"))
    rows = sides[0].unionByName(sides[1]).withColumn("_r", first).where(F.col("_r") <= most_passes).drop("_r")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"e{i} {kinds['event_id']}, k{i} {kinds['label']}, t{i} {kinds['time']}" for i in (1, 2))
    return checkpointed(mutual_matches(rows, scores, max_offset, most_passes, schema))


def confusion_matrix(matched: DataFrame, firings1: DataFrame, firings2: DataFrame) -> DataFrame:
    """k1, k2, n: events by their labels in both tables; 0 stands for no matching event."""
    f1 = firings1.where("label > 0").select(F.col("event_id").alias("e1"), F.col("label").alias("k1"))
    f2 = firings2.where("label > 0").select(F.col("event_id").alias("e2"), F.col("label").alias("k2"))
    rows = matched.select("k1", "k2")
    rows = rows.unionByName(f1.join(matched.select("e1"), "e1", "left_anti").select("k1", F.lit(0).alias("k2")))
    rows = rows.unionByName(f2.join(matched.select("e2"), "e2", "left_anti").select(F.lit(0).alias("k1"), "k2"))
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))


def best_relabelling(confusion: DataFrame) -> DataFrame:
    """k2, new_k2: labels of the second table renamed one to one so that most events agree; labels left over go on
    after the largest. The matrix is as large as there are labels, and is solved on the driver."""
    rows = confusion.where("k1 > 0 AND k2 > 0").collect()
    k1, k2 = sorted({r["k1"] for r in rows}), sorted({r["k2"] for r in rows})
    gain = np.zeros((len(k1), len(k2)))
    for r in rows:
        gain[k1.index(r["k1"]), k2.index(r["k2"])] = r["n"]
    new = {k2[j]: k1[i] for i, j in enumerate(assignment(gain)) if j >= 0} if rows else {}
    top = max([*k1, *k2], default=0)
    for k in k2:
        if k not in new:
            top += 1
            new[k] = top
    return confusion.sparkSession.createDataFrame(sorted(new.items()), "k2 int, new_k2 int")


def compute_accuracies(confusion: DataFrame) -> DataFrame:
    """k1, accuracy: for each true label the best of n / (row sum + column sum - n), sums being 1 at least."""
    row = F.greatest(F.sum("n").over(Window.partitionBy("k1")), F.lit(1))
    col = F.greatest(F.sum("n").over(Window.partitionBy("k2")), F.lit(1))
    each = confusion.withColumn("acc", F.col("n") / (row + col - F.col("n"))).where("k1 > 0 AND k2 > 0")
    return each.groupBy("k1").agg(F.max("acc").alias("accuracy"))


#: The accuracies whose numbers of units are reported.
LEVELS = [0.99, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.60, 0.50]


def accuracy_counts(accuracies: DataFrame) -> DataFrame:
    """level, units with at least that accuracy."""
    levels = accuracies.sparkSession.createDataFrame([(x,) for x in LEVELS], "level double")
    return F.broadcast(levels).crossJoin(accuracies).groupBy("level").agg(F.count_if(F.col("accuracy") >= F.col("level")).alias("units"))


def loose_confusion(firings1: DataFrame, firings2: DataFrame, tolerance: float) -> DataFrame:
    """k1, k2, n: pairs of events at most `tolerance` apart that a sweep over both tables in order of time counts.

    The sweep takes the events of the first table one by one. What it has passed in the second is used up, but for what
    isn't before the event at hand and the one just before it. So an event meets those within the tolerance that come
    after the reach of the event before it, or not before itself, or last before itself; that needs the neighbours
    of each event only, and no place in the sweep. Events at one time are taken by event_id.
    """
    return sweep_counts(firings1, firings2, tolerance)


def link_pairs(firings_prev: DataFrame, firings: DataFrame, tolerance: float, threshold: float, sweep: bool = False) -> DataFrame:
    """k1, k2, n of labels that are each other's best by n events at most `tolerance` apart, at least threshold of either's. n is
    the lesser number of events that have a partner, or with sweep the number of pairs that loose_confusion counts."""
    if sweep:
        counts = loose_confusion(firings_prev.where("label > 0"), firings.where("label > 0"), tolerance)
    else:
        counts = match_counts(firings_prev, firings, tolerance).withColumn("n", F.least("n12", "n21"))
    ranked = counts.withColumn("r1", F.row_number().over(Window.partitionBy("k1").orderBy(F.desc("n"), "k2"))).withColumn("r2", F.row_number().over(Window.partitionBy("k2").orderBy(F.desc("n"), "k1")))
    n1 = firings_prev.where("label > 0").groupBy(F.col("label").alias("k1")).agg(F.count("*").alias("all1"))
    n2 = firings.where("label > 0").groupBy(F.col("label").alias("k2")).agg(F.count("*").alias("all2"))
    return ranked.where("r1 = 1 AND r2 = 1").join(n1, "k1").join(n2, "k2").where((F.col("n") >= threshold * F.col("all1")) & (F.col("n") >= threshold * F.col("all2"))).select("k1", "k2", "n")


def link_labels(firings_prev: DataFrame, firings: DataFrame, *, tolerance: float = 10, threshold: float = 0.7, sweep: bool = False) -> DataFrame:
    """label, linked_label, score for the labels of a segment that overlaps the one before: linked where two labels are
    each other's best by events at most `tolerance` apart, which are at least threshold of either's; other labels go
    on after the largest earlier one. Both tables are those of the overlap."""
    linked = link_pairs(firings_prev, firings, tolerance, threshold, sweep)
    n2 = firings.where("label > 0").groupBy(F.col("label").alias("k2")).agg(F.count("*").alias("all2"))
    top = firings_prev.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
    out = n2.join(linked.select("k2", "k1", "n"), "k2", "left").crossJoin(F.broadcast(top))
    fresh = F.row_number().over(Window.partitionBy(F.col("k1").isNull()).orderBy("k2"))  # one row a label
    return out.select(F.col("k2").alias("label"), F.coalesce("k1", F.col("top") + fresh).cast("int").alias("linked_label"), (F.coalesce("n", F.lit(0)) / F.col("all2")).alias("score"))


def link_segments(firings_prev: DataFrame, firings: DataFrame, *, t1_prev: float, t2_prev: float, t1: float, t2: float, kmax_prev: int = 0, tolerance: float = 10, threshold: float = 0.7, sweep: bool = False) -> DataFrame:
    """firings with the labels of the segment before, and fresh, whether an event comes after that segment's end t2_prev.

    Labels are linked by the events of the time that both segments have. Others get new numbers after kmax_prev and the
    largest earlier label, in order of their first event."""
    both = F.col("time").between(max(t1, t1_prev), min(t2, t2_prev))
    links = link_pairs(firings_prev.where(both), firings.where(both), tolerance, threshold, sweep).select(F.col("k2").alias("label"), "k1")
    top = firings_prev.agg(F.greatest(F.coalesce(F.max("label"), F.lit(0)), F.lit(kmax_prev)).alias("top"))
    labels = firings.groupBy("label").agg(F.min(F.struct("time", "event_id")).alias("first")).join(links, "label", "left").crossJoin(F.broadcast(top))
    number = F.row_number().over(Window.partitionBy(F.col("k1").isNull()).orderBy("first"))  # one row a label
    named = labels.select("label", F.coalesce("k1", F.col("top") + number).cast("int").alias("new"))
    out = firings.join(F.broadcast(named), "label")
    return out.select(*[F.col("new").alias("label") if c == "label" else c for c in firings.columns], (F.col("time") > t2_prev).alias("fresh"))
