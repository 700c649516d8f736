"""From a series to labelled events: detection, clustering per channel, merging, and a final fit.

What grows with the recording stays in Spark; a task holds one chunk, one bucket of time, or a bounded sample of a
channel's clips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.operators.chunks import Chunked, chunk_clips, chunk_templates, chunked, unchunked
from tidewave.operators.clustering import channel_features, cluster_all
from tidewave.operators.joins import band_join, with_previous
from tidewave.operators.metrics import drawn_order
from tidewave.operators.templates import clip_features, clip_statistics, event_statistics, extract_clips, middle, templates
from tidewave.operators.timeseries import detect_events
from tidewave.plans.storage import checkpointed


def neighbourhoods(geom: DataFrame, radius: float) -> DataFrame:
    """m, channel: of each channel m the channels within radius (below 0: all, 0: itself). geom: channel, x, y."""
    a = geom.select(F.col("channel").alias("m"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    both = a.crossJoin(F.broadcast(geom))  # channels only
    if radius >= 0:
        both = both.where(F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2) <= radius * radius)
    return both.select("m", "channel")


def consolidate(means: DataFrame, clip_size: int, factor: float = 0.9, most_offset: int = 10) -> DataFrame:
    """m, label, new_label: clusters of a channel m whose own peak is at least factor of their largest and lies at most
    most_offset from the middle, numbered again. means: m, label, channel, t, v."""
    peak = means.groupBy("m", "label").agg(F.max(F.abs("v")).alias("top"), F.max(F.when(F.col("channel") == F.col("m"), F.abs("v"))).alias("own"), F.max_by("t", F.when(F.col("channel") == F.col("m"), F.struct(F.abs("v"), -F.col("t")))).alias("at"))
    good = peak.where((F.col("own") >= factor * F.col("top")) & (F.abs(F.col("at") - middle(clip_size)) <= most_offset))
    return good.select("m", "label", F.row_number().over(Window.partitionBy("m").orderBy("label")).alias("new_label"))


def merge_candidates(means: DataFrame, central: DataFrame, ratio: float = 0.3) -> DataFrame:
    """k1, k2 on different central channels, each of which has a peak of one sign on both channels, the smaller over
    `ratio` of the larger. means: label, channel, t, v; central: label, m."""
    peaks = means.groupBy("label", "channel").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("t"))).alias("p"))
    own = central.select("label", "m")
    a, b = own.select(F.col("label").alias("k1"), F.col("m").alias("m1")), own.select(F.col("label").alias("k2"), F.col("m").alias("m2"))
    pairs = a.crossJoin(F.broadcast(b)).where("m1 <> m2")  # labels only
    for k, m, name in (("k1", "m1", "p11"), ("k1", "m2", "p12"), ("k2", "m1", "p21"), ("k2", "m2", "p22")):
        pairs = pairs.join(peaks.select(F.col("label").alias(k), F.col("channel").alias(m), F.col("p").alias(name)), [k, m])
    fits = lambda x, y: (F.col(x) * F.col(y) > 0) & (F.least(F.abs(x), F.abs(y)) > ratio * F.greatest(F.abs(x), F.abs(y)))
    return pairs.where(fits("p11", "p12") & fits("p21", "p22") & fits("p11", "p21") & fits("p12", "p22")).select("k1", "k2")


def best_lags(means: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """k1, k2, lag: by how much, up to `most` either way, events of k2 are moved so that its template fits k1's best: the
    lag with the largest positive product of the templates (around the ends), of equals the largest, 0 without any."""
    size = means.agg(F.max("t") + 1).first()[0]
    lags = pairs.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))  # labels only
    a = means.select(F.col("label").alias("k1"), "channel", F.col("t").alias("at"), F.col("v").alias("v1"))
    b = means.select(F.col("label").alias("k2"), "channel", "t", F.col("v").alias("v2"))
    moved = lags.join(b, "k2").withColumn("at", F.pmod(F.col("t") - F.col("lag"), F.lit(size)))
    fit = moved.join(a, ["k1", "channel", "at"]).groupBy("k1", "k2", "lag").agg(F.sum(F.col("v1") * F.col("v2")).alias("fit"))
    best = fit.groupBy("k1", "k2").agg(F.max_by("lag", F.when(F.col("fit") > 0, F.struct("fit", "lag"))).alias("lag"))
    return pairs.join(best, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("lag", F.lit(0)).alias("lag"))


def used_events(firings: DataFrame, pairs: DataFrame, reach: float) -> DataFrame:
    """k1, n: how many events of k1 have an event of one of their k2 within `reach`, after moving k1 by the pair's lag, that the
    event of k1 before them hasn't used up: one uses up all that come no later than reach after it. pairs: k1, k2, lag."""
    before = with_previous(firings.select("event_id", F.col("label").alias("k1"), F.col("time").alias("t")), ["k1"], "t", "event_id", 2 * reach, "p")
    a = before.join(F.broadcast(pairs), "k1").withColumn("t1", F.col("t") - F.col("lag"))  # labels squared at most
    b = firings.select(F.col("label").alias("kb"), F.col("time").alias("t2"))
    near = band_join(a, b, left_time="t1", right_time="t2", before=reach, after=reach, on=F.col("k2") == F.col("kb"))
    free = near.where(F.col("p").isNull() | (F.col("t2") > F.col("p") - F.col("lag") + reach))
    return free.groupBy("k1", "event_id").agg(F.lit(1)).groupBy("k1").agg(F.count("*").alias("n"))


def merge_across_channels(firings: DataFrame, means: DataFrame, central: DataFrame, *, reach: float = 4, share: float = 0.3) -> DataFrame:
    """Drops clusters that repeat one seen on another channel. Clusters are taken by their own peak, largest first; one
    goes if `share` of its events meet events of candidates already kept that aren't used up (see used_events).

    A cluster decides as soon as all its candidates with larger peaks have, so that a round decides all clusters that
    don't wait for one another, and counts their events against kept candidates only. What comes to the driver is a
    row for each label, or for each pair of candidates.
    """
    spark = firings.sparkSession
    pairs = [(r["k1"], r["k2"], r["lag"]) for r in best_lags(means, merge_candidates(means, central)).collect()]  # labels squared at most
    sizes = {r["label"]: r["n"] for r in firings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    own = means.join(central, "label").where("channel = m").groupBy("label").agg(F.max(F.abs("v")).alias("p")).collect()
    place = {r["label"]: i for i, r in enumerate(sorted(own, key=lambda r: (-r["p"], r["label"])))}
    larger = {k: [(k2, lag) for k1, k2, lag in pairs if k1 == k and place[k2] < place[k]] for k in place}
    kept: set[int] = set()
    decided: set[int] = set()
    while len(decided) < len(place):
        ready = [k for k in place if k not in decided and all(k2 in decided for k2, _ in larger[k])]
        asked = [(k, k2, lag) for k in ready for k2, lag in larger[k] if k2 in kept]
        used = {r["k1"]: r["n"] for r in used_events(firings, spark.createDataFrame(asked, "k1 int, k2 int, lag int"), reach).collect()} if asked else {}
        kept |= {k for k in ready if not used.get(k) or used[k] < share * sizes.get(k, 0)}
        decided |= set(ready)
    return firings.join(F.broadcast(spark.createDataFrame([(k,) for k in sorted(kept)], "label int")), "label", "left_semi")


def template_products(shape: DataFrame) -> DataFrame:
    """k1, k2, lag, c: by how much the score of an event of k2 falls, which begins `lag` after an event of k1, when that one's
    template is subtracted. shape: label, channel, t, w."""
    one, two = shape.select("channel", F.col("label").alias("k1"), F.col("t").alias("t1"), F.col("w").alias("w1")), shape.select("channel", F.col("label").alias("k2"), F.col("t").alias("t2"), F.col("w").alias("w2"))
    return one.join(two, "channel").groupBy("k1", "k2", (F.col("t1") - F.col("t2")).cast("long").alias("lag")).agg((2 * F.sum(F.col("w1") * F.col("w2"))).alias("c"))


def fit_stage(series: DataFrame, firings: DataFrame, means: DataFrame, clip_size: int, *, mask: float = 0.1, most_passes: int = 1000) -> DataFrame:
    """Events that explain the series best. In passes, an event's score is by how much subtracting its template lessens
    the squared signal where the template is larger than mask; events that have the best score within a clip's length,
    of equals the first, are accepted and subtracted, and events without a positive score are dropped for good. An
    event whose clip isn't wholly inside the series is left out.

    The series is read once, for the first scores. What an accepted event takes from the score of another depends on
    their labels and their distance alone, so a pass only joins events with events: no task holds more than the
    events of some clip lengths of time, however long the series is without a gap.
    """
    ends = series.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends["a"] is None:
        return firings.limit(0)
    shape = checkpointed(means.where(F.abs("v") > mask).select("label", "channel", F.col("t").cast("int").alias("t"), F.col("v").alias("w")))
    products = checkpointed(template_products(shape))
    begin = F.floor(F.col("time") - middle(clip_size) + 0.5).cast("long")
    rows = firings.select("event_id", F.col("time").cast("double").alias("time"), "label", begin.alias("begin")).where((F.col("begin") >= ends["a"]) & (F.col("begin") + clip_size - 1 <= ends["b"]))
    places = rows.select("label", "begin").distinct()
    asked = places.join(shape, "label").select("label", "begin", "channel", (F.col("begin") + F.col("t")).alias("ts"), "w")
    seen = asked.join(series.select("channel", F.col("t").alias("ts"), "v"), ["channel", "ts"]).groupBy("label", "begin").agg(F.sum(2 * F.col("v") * F.col("w")).alias("vw"))
    size = shape.groupBy("label").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    first = seen.join(size, "label").select("label", "begin", (F.col("vw") - F.col("ww")).alias("score"))
    least = 1e-9  # sums are taken in any order
    open_ = checkpointed(rows.join(first, ["label", "begin"]).where(F.col("score") > least))

    width = 16 * clip_size
    reach = F.sequence(F.floor((F.col("time") - clip_size) / width), F.floor((F.col("time") + clip_size) / width))
    around = Window.partitionBy("bucket").orderBy("time").rangeBetween(-clip_size, clip_size)
    rank = F.struct(F.round("score", 6).alias("s"), (-F.col("time")).alias("t"), (-F.col("event_id")).alias("e"))
    kept = []
    for _ in range(most_passes):
        near = open_.withColumn("bucket", F.explode(reach)).withColumn("best", F.max(rank).over(around))  # in each bucket that its neighbours lie in
        own = near.where(F.col("bucket") == F.floor(F.col("time") / width))
        judged = checkpointed(own.select(*open_.columns, (F.col("best") == rank).alias("top")))
        top = judged.where("top")
        kept.append(top.select("event_id"))
        rest = judged.where("NOT top").drop("top")
        a = top.select(F.col("label").alias("k1"), F.col("begin").alias("b1"))
        hits = band_join(rest, a, left_time="begin", right_time="b1", before=clip_size - 1, after=clip_size - 1)
        loss = hits.select("event_id", "k1", F.col("label").alias("k2"), (F.col("begin") - F.col("b1")).alias("lag")).join(products, ["k1", "k2", "lag"])
        loss = loss.groupBy("event_id").agg(F.sum("c").alias("loss"))
        open_ = checkpointed(rest.join(loss, "event_id", "left").withColumn("score", F.col("score") - F.coalesce("loss", F.lit(0.0))).drop("loss").where(F.col("score") > least))
        if not open_.limit(1).count():
            break
    else:
        raise RuntimeError(f"events are still left after {most_passes} passes")
    used = kept[0]
    for more in kept[1:]:
        used = used.unionByName(more)
    return firings.join(used, "event_id", "left_semi")


def sort_events(series: DataFrame | Chunked, geom: DataFrame, *, length: int | None = None, adjacency_radius: float = -1, clip_size: int = 50, detect_interval: int = 10, detect_threshold: float = 3.0, detect_sign: int = 0, num_features: int = 10, consolidation_factor: float = 0.9, merge: bool = True, fit: bool = True) -> DataFrame:
    """event_id, channel, time, label for a filtered, whitened series: detection on each channel, clusters of the clips of
    its neighbourhood, consolidation, merging across channels and the final fit.

    Clips are cut from chunks, on the channels of an event's neighbourhood only; each channel's clips are reduced to
    num_features first, and all events of a channel take part in its clusters."""
    if isinstance(series, Chunked):
        c = series
    else:
        c = chunked(series, length or (series.agg(F.max("t")).first()[0] or 0) + 1)
    c = Chunked(checkpointed(c.rows), c.size, c.length, c.channels)
    long = unchunked(c)
    found = detect_events(long, threshold=detect_threshold, interval=detect_interval, sign=detect_sign)
    found = checkpointed(found.select(F.col("channel").alias("m"), F.col("t").alias("time")).withColumn("event_id", F.monotonically_increasing_id()))
    near = checkpointed(neighbourhoods(geom, adjacency_radius))
    features = checkpointed(channel_features(checkpointed(chunk_clips(c, found, clip_size, near=near)), num_features))
    labels = checkpointed(cluster_all(features, num_features=num_features)[0])
    codes = checkpointed(labels.select("m", "label").distinct().withColumn("code", F.row_number().over(Window.orderBy("m", "label"))))  # one row a cluster
    labelled = checkpointed(found.join(labels.join(F.broadcast(codes), ["m", "label"]), ["event_id", "m"]))
    every = checkpointed(chunk_templates(c, labelled.select("time", F.col("code").alias("label")), clip_size)).withColumnRenamed("label", "code")
    means = every.join(codes, "code").join(F.broadcast(near), ["m", "channel"]).select("m", "label", "channel", "t", "v")
    good = consolidate(means, clip_size, consolidation_factor).join(codes, ["m", "label"])
    numbered = checkpointed(good.select("code", F.row_number().over(Window.orderBy("m", "new_label")).cast("int").alias("k")))  # one row a label
    rows = checkpointed(labelled.join(F.broadcast(numbered), "code").select("event_id", F.col("m").alias("channel"), "time", F.col("k").alias("label")))
    shapes = checkpointed(every.join(F.broadcast(numbered), "code").select(F.col("k").alias("label"), "channel", "t", "v"))
    if merge:
        rows = checkpointed(merge_across_channels(rows, shapes, rows.select("label", F.col("channel").alias("m")).distinct()))
    return fit_stage(long, rows, shapes, clip_size) if fit else rows


def noise_overlap(series: DataFrame, firings: DataFrame, clip_size: int, *, length: int, most: int = 500, seed: int = 7, k: int = 5, num_features: int = 10, fewest: int = 100) -> DataFrame:
    """label, noise_overlap: how often nearest neighbours of a cluster's clips are clips of noise, and the other way. Up
    to `most` events of each label are compared with as many clips at times drawn by digest; the shape that noise shares
    with the cluster's peak is taken off both."""
    from tidewave.operators.metrics import pair_overlap

    rank = Window.partitionBy("label").orderBy(*drawn_order("event_id"))
    some = firings.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most).select("event_id", "time", "label", F.lit(0).alias("noise"))
    anywhere = F.conv(F.substring(F.md5(F.concat_ws(":", "event_id", "label", F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("long") % length
    drawn = some.select((-F.col("event_id") - 1).alias("event_id"), anywhere.alias("time"), "label", F.lit(1).alias("noise"))
    both = some.unionByName(drawn)
    clips = checkpointed(extract_clips(series, both, clip_size).join(both.select("event_id", "noise"), "event_id"))
    peak = clip_statistics(clips.where("noise = 0")).groupBy("label").agg(F.max_by(F.struct("channel", "t"), F.struct(F.abs("mean"), -F.col("channel"), -F.col("t"))).alias("p"))
    at_peak = clips.join(peak, "label").where("channel = p.channel AND t = p.t").select("event_id", F.col("v").alias("w"))
    shape = clips.where("noise = 1").join(at_peak, "event_id").groupBy("label", "channel", "t").agg(F.avg(F.col("v") * F.col("w")).alias("s"))
    size = shape.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    on = clips.join(shape, ["label", "channel", "t"]).join(size, "label")
    by = Window.partitionBy("event_id")
    flat = on.withColumn("v", F.col("v") - F.sum(F.col("v") * F.col("s")).over(by) / F.greatest("ss", F.lit(1e-300)) * F.col("s"))
    points = clip_features(flat.select("event_id", "label", "noise", "channel", "t", "v"))
    # a label and its noise are told apart by doubling labels
    points = points.select(F.col("event_id").alias("id"), (2 * F.col("label") + F.col("noise")).alias("label"), "f")
    pairs = firings.select("label").distinct().select((2 * F.col("label")).alias("k1"), (2 * F.col("label") + 1).alias("k2"))
    return pair_overlap(points, pairs, k=k, most=most, num_features=num_features, fewest=fewest).select(F.expr("cast(k1 div 2 AS int)").alias("label"), F.col("overlap").alias("noise_overlap"))


def isolation_metrics(series: DataFrame, firings: DataFrame, clip_size: int, *, length: int, most: int = 500) -> DataFrame:
    """label, peak_amp, peak_noise, peak_snr, noise_overlap, isolation, overlap_cluster. Peaks and the templates that choose
    pairs come from all events; only the two measures by nearest neighbours from up to `most` of each label."""
    from tidewave.operators.metrics import isolation, pair_overlap, pairs_to_compare, peak_metrics

    rank = Window.partitionBy("label").orderBy(*drawn_order("event_id"))
    some = firings.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most)
    clips = checkpointed(extract_clips(series, some.select("event_id", "time", "label"), clip_size))
    stats = event_statistics(series, firings, clip_size)
    pairs = pairs_to_compare(templates(series, firings, clip_size)).select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()
    points = clip_features(clips).select(F.col("event_id").alias("id"), "label", "f")
    alone = isolation(pair_overlap(points, pairs, most=most, num_features=10, fewest=100), firings)
    return peak_metrics(stats).join(noise_overlap(series, firings, clip_size, length=length, most=most), "label", "left").join(alone, "label", "left")
