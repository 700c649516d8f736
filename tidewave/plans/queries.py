"""Queries over the views of plans.views, and the SQL that each is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.operators import chunks as ch
from tidewave.operators import clustering as cl
from tidewave.operators import events as ev
from tidewave.operators import matching as mt
from tidewave.operators import metrics as me
from tidewave.operators import neighbours as nb
from tidewave.operators import sorting as so
from tidewave.operators import synthesis as sy
from tidewave.operators import templates as tp
from tidewave.operators import timeseries as ts
from tidewave.operators import segments as sg
from tidewave.operators.joins import with_previous
from tidewave.plans.storage import checkpointed, shared_folder
from tidewave.plans.views import MINUTES, WEEK, chunked_timeseries, clips, firings, firings2, geom, sql, timeseries
from tidewave.sources import arrays as ar

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*views: str, oracle: str | None = None):  # type: ignore[no-untyped-def]
    """Registers a function as the query of its name; the oracle's SQL may use the named views."""

    def register(f):  # type: ignore[no-untyped-def]
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


CLUSTER_SQL = """SELECT label, count(*) AS num_events, CAST(min(time) AS DOUBLE) AS t1_sec, CAST(max(time) AS DOUBLE) AS t2_sec, CAST(max(time) - min(time) AS DOUBLE) AS dur_sec,
  round(CASE WHEN max(time) > min(time) THEN count(*) / CAST(max(time) - min(time) AS DOUBLE) ELSE 0.0 END, 6) AS firing_rate FROM firings GROUP BY label"""


@query("firings", oracle=CLUSTER_SQL)
def cluster_metrics(spark, d):
    return rounded(me.cluster_metrics(firings(spark, d)), "firing_rate")


@query("firings", oracle="SELECT label, count(*) AS num_events, CAST(min(time) AS DOUBLE) AS tmin_sec, CAST(max(time) AS DOUBLE) AS tmax_sec, CAST(max(time) - min(time) AS DOUBLE) AS dur_sec FROM firings GROUP BY label")
def view_metrics(spark, d):
    return me.view_metrics(firings(spark, d))


CORRELOGRAM_SQL = """WITH a AS (SELECT label, time, event_id FROM firings), p AS (
  SELECT a.label AS k1, b.label AS k2, CAST(floor((b.time - a.time + 3600) / 300.0) AS INT) AS bin, count(*) AS n FROM a JOIN a b
  ON b.time >= a.time - 3600 AND b.time < a.time + 3600 AND a.event_id <> b.event_id {on} GROUP BY ALL)
SELECT k1, k2, CAST(bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT label AS k1 FROM a) JOIN (SELECT DISTINCT label AS k2 FROM a) ON {grid} CROSS JOIN range(24) r(bin) LEFT JOIN p USING (k1, k2, bin)"""


@query("firings", oracle=CORRELOGRAM_SQL.format(on="", grid="true"))
def cross_correlograms(spark, d):
    return me.cross_correlograms(firings(spark, d), 3600, 300)


@query("firings", oracle=CORRELOGRAM_SQL.format(on="AND a.label = b.label", grid="k1 = k2"))
def auto_correlograms(spark, d):
    return me.cross_correlograms(firings(spark, d), 3600, 300, auto=True)


@query("firings", oracle="SELECT * FROM firings WHERE time BETWEEN 86400 AND 864000 AND label IN (1, 2, 3, 5) AND label <> 3")
def extract_firings(spark, d):
    rows = firings(spark, d)
    tags = rows.select("label").distinct().select("label", F.when(F.col("label") % 3 == 0, F.array(F.lit("mua"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return ev.extract_firings(rows, 86_400, 864_000, [1, 2, 3, 5], tags, ["mua", "rejected"])


@query("firings", oracle="SELECT event_id, channel, time + 1000 AS time, label, amplitude FROM firings")
def apply_timestamp_offset(spark, d):
    return ev.apply_timestamp_offset(firings(spark, d), 1000)


@query("firings", oracle="SELECT event_id, 2 AS channel, time, label, amplitude FROM firings")
def create_firings(spark, d):
    rows = firings(spark, d)
    return ev.create_firings(rows.select("event_id", "time"), rows.select("event_id", "label"), rows.select("event_id", "amplitude"), 2)


@query("firings", oracle="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM firings WHERE label IN (1, 2, 3, 4))
SELECT event_id, channel, time, label, amplitude FROM r WHERE n <= 100 OR (i * 100 + n - 1) // n < ((i + 1) * 100 + n - 1) // n""")
def subsample_firings(spark, d):
    return ev.subsample_firings(firings(spark, d), [1, 2, 3, 4], 100)


@query("firings", "firings2", oracle="""SELECT 0 AS source, event_id, channel, time, label FROM firings UNION ALL
SELECT 1, event_id, channel, time, CAST(label + (SELECT max(label) FROM firings) AS INT) FROM firings2""")
def combine_firings(spark, d):
    return ev.combine_firings([firings(spark, d), firings2(spark, d)])


@query("firings", "firings2", oracle="SELECT event_id, channel, time, label, 0 AS source FROM firings UNION ALL SELECT event_id, channel, time + 2592000, label, 1 FROM firings2")
def concat_firings(spark, d):
    return ev.concat_firings([firings(spark, d).drop("amplitude"), firings2(spark, d)], [2_592_000, 2_592_000])


@query("firings", "firings2", oracle="SELECT event_id, time, 0 AS source FROM firings UNION ALL SELECT event_id, time, 1 FROM firings2")
def concat_event_times(spark, d):
    return ev.concat_event_times([firings(spark, d), firings2(spark, d)])


@query("firings", oracle=f"""WITH s AS (SELECT CAST(i AS INT) AS session, i * {WEEK} AS s0 FROM range(5) r(i))
SELECT event_id, channel, label, amplitude, CAST(greatest(0, least(4, time // {WEEK})) AS INT) AS session, time - greatest(0, least(4, time // {WEEK})) * {WEEK} AS time FROM firings""")
def split_firings(spark, d):
    sessions = spark.range(5).select(F.col("id").cast("int").alias("session"), F.lit(WEEK).cast("long").alias("length"))
    return ev.split_firings(firings(spark, d), sessions)


@query("firings", "firings2", oracle="""WITH m AS (SELECT 0 AS s, label, count(*) * 1.0 AS n, CAST(min(time) AS DOUBLE) AS t FROM firings GROUP BY label
  UNION ALL SELECT 1, label, count(*) * 1.0, NULL FROM firings2 GROUP BY label), l AS (SELECT s, label, 'num_events' AS name, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT s, label, 'tmin_sec', t FROM m WHERE s = 0)
SELECT label, name, arg_max(value, s) AS value FROM l GROUP BY label, name""")
def combine_cluster_metrics(spark, d):
    a = me.metrics_long(me.view_metrics(firings(spark, d)).select("label", "num_events", "tmin_sec"))
    b = me.metrics_long(me.view_metrics(firings2(spark, d)).select("label", "num_events"))
    return me.combine_cluster_metrics([a, b])


def curation_metrics(spark, d):
    """Metrics with some failing clusters and some bursting ones."""
    m = me.cluster_metrics(firings(spark, d))
    return m.select("label", F.when(F.col("label") == 7, 0.01).otherwise(0.5).alias("firing_rate"), F.when(F.col("label") == 6, 0.9).otherwise(0.99).alias("isolation"), F.lit(0.01).alias("noise_overlap"), F.lit(3.0).alias("peak_snr"), F.when(F.col("label").isin(3, 4), F.col("label") - 1).otherwise(0).alias("bursting_parent"))


MAP_SQL = "SELECT label AS old_label, CAST(CASE WHEN label IN (6, 7) THEN 0 WHEN label IN (3, 4) THEN label - 1 ELSE label END AS INT) AS new_label FROM (SELECT DISTINCT label FROM firings)"


@query("firings", oracle=MAP_SQL)
def create_label_map(spark, d):
    return ev.create_label_map(curation_metrics(spark, d))


@query("firings", oracle=f"""WITH RECURSIVE m AS ({MAP_SQL}), c AS (SELECT old_label AS a, new_label AS b, 0 AS n FROM m UNION ALL SELECT c.a, m.new_label, n + 1 FROM c JOIN m ON c.b = m.old_label WHERE m.old_label <> m.new_label),
  f AS (SELECT a, arg_max(b, n) AS b FROM c GROUP BY a) SELECT event_id, channel, time, b AS label, amplitude FROM firings JOIN f ON label = a WHERE b <> 0""")
def apply_label_map(spark, d):
    return ev.apply_label_map(firings(spark, d), ev.create_label_map(curation_metrics(spark, d)))


CLIP = 20
EVENTS_SQL = "ev AS (SELECT event_id, label, time // 60 AS m FROM firings)"
TEMPLATE_SQL = f"""{EVENTS_SQL}, n AS (SELECT label, count(*) AS n FROM ev GROUP BY label),
  s AS (SELECT label, channel, o, sum(v * w) AS s FROM (SELECT label, m, o, m + o - 9 AS t, count(*) AS w FROM ev CROSS JOIN range(20) x(o) GROUP BY ALL) e JOIN timeseries USING (t) GROUP BY ALL),
  tmpl AS MATERIALIZED (SELECT n.label, CAST(c AS INT) AS channel, CAST(b.o AS INT) AS t, coalesce(s, 0.0) / n AS v FROM n CROSS JOIN range(1, 6) a(c) CROSS JOIN range({CLIP}) b(o) LEFT JOIN s ON s.label = n.label AND s.channel = c AND s.o = b.o)"""


def minute_events(spark, d):
    """Events by the minute, as samples of the timeseries view."""
    return firings(spark, d).withColumn("time", F.expr("time div 60"))


def minute_templates(spark, d):
    return ch.chunk_templates(chunked_timeseries(spark, d), minute_events(spark, d), CLIP)


@query("firings", "timeseries", oracle=f"WITH {TEMPLATE_SQL} SELECT label, channel, t, round(v, 8) AS v FROM tmpl")
def compute_templates(spark, d):
    return rounded(minute_templates(spark, d), "v", places=8)


@query("firings", "timeseries", oracle=f"""WITH {TEMPLATE_SQL}, p AS (SELECT label, arg_max(channel, (abs(v), -channel, -t)) AS c, max(abs(v)) AS a FROM tmpl GROUP BY label),
  r AS (SELECT label, CAST(row_number() OVER (ORDER BY CASE WHEN a = 0 THEN 1 ELSE 0 END, c, a DESC, label) AS INT) AS new FROM p)
SELECT event_id, channel, time // 60 AS time, new AS label, amplitude FROM firings JOIN r USING (label)""")
def reorder_labels(spark, d):
    return ev.reorder_labels(minute_events(spark, d), minute_templates(spark, d))


@query("firings", "timeseries", oracle=f"""WITH ev AS (SELECT event_id, time // 60 AS m FROM firings)
SELECT event_id, CAST(c AS INT) AS channel, CAST(o AS INT) AS t, coalesce(v, 0.0) AS v FROM ev CROSS JOIN range(2, 4) a(c) CROSS JOIN range({CLIP}) b(o) LEFT JOIN timeseries x ON x.channel = c AND x.t = m + o - 9""")
def extract_clips(spark, d):
    return ch.clip_rows(ch.chunk_clips(chunked_timeseries(spark, d), minute_events(spark, d).drop("label"), CLIP, channels=[2, 3]))


@query("firings", "timeseries", oracle=f"""WITH ev AS (SELECT event_id, time // 60 AS m FROM firings)
SELECT event_id, CAST(c AS INT) AS channel, CAST(o AS INT) AS t, coalesce(v, 0.0) AS v FROM ev CROSS JOIN range(1, 6) a(c) CROSS JOIN range({CLIP}) b(o) LEFT JOIN timeseries x ON x.channel = c AND x.t = m + o - 9""")
def extract_all_clips(spark, d):
    return ch.clip_rows(ch.chunk_clips(chunked_timeseries(spark, d), minute_events(spark, d).drop("label"), CLIP))


STATS_SQL = "st AS (SELECT label, channel, t, CASE WHEN count(*) >= 2 THEN avg(v) ELSE 0.0 END AS m, CASE WHEN count(*) >= 2 THEN stddev_pop(v) ELSE 0.0 END AS s FROM clips GROUP BY label, channel, t)"


@query("clips", oracle=f"WITH {STATS_SQL} SELECT label, channel, t, round(m, 6) AS mean, round(s, 6) AS stdev FROM st")
def template_statistics(spark, d):
    return rounded(tp.clip_statistics(clips(spark, d)), "mean", "stdev")


@query("clips", oracle=f"WITH {STATS_SQL} SELECT label, round(max(abs(m)), 6) AS peak_amp, round(max(abs(s)), 6) AS peak_noise, round(CASE WHEN max(s) > 0 THEN max(abs(m)) / max(abs(s)) ELSE 0.0 END, 6) AS peak_snr FROM st GROUP BY label")
def peak_snr(spark, d):
    return rounded(me.peak_metrics(tp.clip_statistics(clips(spark, d))), "peak_amp", "peak_noise", "peak_snr")


@query("firings", "timeseries", oracle=f"""WITH r AS (SELECT label, time // 60 AS m, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM firings),
  ev AS (SELECT label, m FROM r WHERE n <= 200 OR (i * 200 + n - 1) // n < ((i + 1) * 200 + n - 1) // n), n AS (SELECT label, count(*) AS n FROM ev GROUP BY label),
  s AS (SELECT label, channel, o, sum(v) AS s FROM (SELECT label, o, m + o - 9 AS t FROM ev CROSS JOIN range(20) x(o)) e JOIN timeseries USING (t) GROUP BY ALL),
  tm AS (SELECT n.label, CAST(c AS INT) AS channel, CAST(b.o AS INT) AS t, coalesce(s, 0.0) / n AS v FROM n CROSS JOIN range(1, 6) a(c) CROSS JOIN range({CLIP}) b(o) LEFT JOIN s ON s.label = n.label AND s.channel = c AND s.o = b.o)
SELECT label, channel, t, round(v - avg(v) OVER (PARTITION BY label, channel), 8) AS v FROM tm""")
def view_templates(spark, d):
    return rounded(tp.view_templates(timeseries(spark, d), minute_events(spark, d), CLIP, max_events=200), "v", places=8)


@query("firings", "timeseries", oracle="""WITH x AS (SELECT t, arg_max(v, (abs(v), -channel)) AS v FROM timeseries GROUP BY t)
SELECT event_id, coalesce(v, 0.0) AS amplitude FROM firings LEFT JOIN x ON t = time // 60""")
def compute_amplitudes(spark, d):
    return tp.amplitudes(timeseries(spark, d), minute_events(spark, d))


@query("firings", "timeseries", oracle=f"""WITH {TEMPLATE_SQL}, p AS (SELECT label, arg_max(channel, (abs(v), -t, -channel)) AS c, arg_max(t, (abs(v), -t, -channel)) AS o FROM tmpl GROUP BY label)
SELECT event_id, coalesce(x.v, 0.0) AS amplitude FROM (SELECT event_id, c AS channel, m + o - 9 AS t FROM ev JOIN p USING (label)) e LEFT JOIN timeseries x USING (channel, t)""")
def peak_amplitudes(spark, d):
    return tp.peak_amplitudes(timeseries(spark, d), minute_events(spark, d), minute_templates(spark, d), CLIP)


@query("clips", oracle="""WITH m AS (SELECT label, channel, t, avg(v) AS m FROM clips WHERE label IN (1, 2, 3) GROUP BY ALL),
  w AS (SELECT a.label AS k1, b.label AS k2, channel, t, b.m - a.m AS d FROM m a JOIN m b USING (channel, t) WHERE a.label < b.label), nn AS (SELECT k1, k2, sum(d * d) AS dd FROM w GROUP BY ALL)
SELECT k1, k2, clip_id, label, round(sum(d * v) / any_value(dd), 6) AS score FROM clips JOIN w USING (channel, t) JOIN nn USING (k1, k2) WHERE label IN (k1, k2) GROUP BY k1, k2, clip_id, label""")
def discrimination(spark, d):
    return rounded(tp.discrimination(clips(spark, d), [1, 2, 3]), "score")


@query("timeseries", oracle="""WITH s AS (SELECT channel, avg(v) AS m, stddev_samp(v) AS s FROM timeseries GROUP BY channel)
SELECT channel, t, round((v - m) / s, 6) AS v FROM timeseries JOIN s USING (channel)""")
def normalize_channels(spark, d):
    return rounded(ts.normalize_channels(timeseries(spark, d)), "v")


_P = [3**i for i in range(1, 11)]


@query("timeseries", oracle="WITH f AS (SELECT CAST(unnest([" + ", ".join(map(str, _P)) + f"""]) AS BIGINT) AS factor), g AS (SELECT factor, channel, t // factor AS t, min(v) AS lo, max(v) AS hi, count(*) AS n FROM timeseries, f GROUP BY ALL)
SELECT factor, stat, channel, t, CASE WHEN stat = 'min' THEN CASE WHEN n < factor THEN least(lo, 0) ELSE lo END ELSE CASE WHEN n < factor THEN greatest(hi, 0) ELSE hi END END AS v FROM g, (VALUES ('min'), ('max')) s(stat)""")
def multiscale_timeseries(spark, d):
    return ts.multiscale(timeseries(spark, d), MINUTES)


@query("timeseries", oracle="""WITH nm AS (SELECT channel, t // 60 AS i, sqrt(sum(v * v)) AS nn FROM timeseries WHERE t // 60 < 720 GROUP BY ALL), s AS (SELECT channel, avg(nn) AS m, stddev_samp(nn) AS s FROM nm GROUP BY channel),
  b AS (SELECT DISTINCT i + d AS i FROM nm JOIN s USING (channel) CROSS JOIN (VALUES (-1), (0), (1)) x(d) WHERE nn > m + 3.0 * s)
SELECT channel, t, CASE WHEN b.i IS NOT NULL OR t // 60 >= 720 THEN 0.0 ELSE v END AS v FROM timeseries LEFT JOIN b ON b.i = t // 60""")
def mask_out_artifacts(spark, d):
    return ts.mask_out_artifacts(timeseries(spark, d), MINUTES, interval=60, threshold=3.0)


@query("timeseries", oracle="SELECT CASE WHEN channel = 3 THEN 1 ELSE 2 END AS channel, t - 1000 AS t, v FROM timeseries WHERE channel IN (3, 1) AND t BETWEEN 1000 AND 5000")
def extract_timeseries(spark, d):
    return ts.extract_timeseries(timeseries(spark, d), [3, 1], 1000, 5000)


@query("timeseries", oracle="SELECT channel, t, v FROM timeseries UNION ALL SELECT channel, t + 43200, -v FROM timeseries")
def concat_timeseries(spark, d):
    x = timeseries(spark, d)
    return ts.concat_timeseries([x, x.withColumn("v", -F.col("v"))], [MINUTES, MINUTES])


@query("timeseries", oracle="SELECT channel, t, v FROM timeseries UNION ALL SELECT channel, t + 43200, v * 2 FROM timeseries")
def concat_all_timeseries(spark, d):
    x = timeseries(spark, d)
    return ts.concat_timeseries([x, x.withColumn("v", F.col("v") * 2)], [MINUTES, MINUTES])


@query("geom", oracle="SELECT CASE channel WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS channel, x, y FROM geom WHERE channel IN (4, 2, 5)")
def extract_geom(spark, d):
    return ts.extract_geom(geom(spark, d), [4, 2, 5])


@query("timeseries", oracle="SELECT a.channel AS m1, b.channel AS m2, round(sum(a.v * b.v) / (43200 - 1), 6) AS w FROM timeseries a JOIN timeseries b USING (t) GROUP BY ALL")
def covariance_matrix(spark, d):
    return rounded(ch.chunk_covariance(chunked_timeseries(spark, d)), "w")


@query("timeseries", oracle="SELECT channel, t, CAST(trunc(v / 0.25 + 0.5) AS INT) AS v FROM timeseries")
def quantize_timeseries(spark, d):
    return ts.quantize(timeseries(spark, d), 0.25)


CANDIDATES_SQL = "st AS (SELECT channel, avg(v) AS m, stddev_samp(v) AS s FROM timeseries GROUP BY channel), cand AS (SELECT channel, t, abs(v - m) AS v FROM timeseries JOIN st USING (channel) WHERE abs(v - m) > 2.0 * s)"


@query("timeseries", oracle=f"WITH {CANDIDATES_SQL} SELECT channel, t, round(v, 6) AS v FROM cand")
def threshold_candidates(spark, d):
    return rounded(ts.threshold_candidates(timeseries(spark, d), threshold=2.0), "v")


@query("timeseries", oracle=f"""WITH {CANDIDATES_SQL}, l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY channel ORDER BY t) > 30 THEN 1 ELSE 0 END AS g FROM cand)
SELECT channel, t, round(v, 6) AS v, CAST(sum(g) OVER (PARTITION BY channel ORDER BY t ROWS UNBOUNDED PRECEDING) AS INT) AS session FROM l""")
def sessions(spark, d):
    return rounded(ts.sessions(ts.threshold_candidates(timeseries(spark, d), threshold=2.0), 30), "v")


@query("timeseries", oracle=f"""WITH RECURSIVE {CANDIDATES_SQL}, l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY channel ORDER BY t) > 30 THEN 1 ELSE 0 END AS g FROM cand),
  n AS (SELECT channel, t, v, sum(g) OVER (PARTITION BY channel ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM l),
  s AS MATERIALIZED (SELECT channel, session, list(t ORDER BY t) AS tl, list(v ORDER BY t) AS vl FROM n GROUP BY ALL),
  r AS (SELECT channel, session, tl, vl, 1::BIGINT AS i, 0::BIGINT AS best, []::BIGINT[] AS keep FROM s UNION ALL
    SELECT channel, session, tl, vl, i + 1, CASE WHEN b = 0 OR vl[i] > vl[b] THEN i ELSE b END, CASE WHEN b = 0 OR vl[i] > vl[b] THEN list_append(list_filter(keep, lambda k: k <> b), i) ELSE keep END
    FROM (SELECT *, CASE WHEN best > 0 AND tl[best] < tl[i] - 30 THEN coalesce(list_max(list_transform(list_filter(range(best + 1, i), lambda j: tl[j] >= tl[i] - 30), lambda j: {{'v': vl[j], 'j': j}})).j, 0) ELSE best END AS b FROM r WHERE i <= len(tl)))
SELECT channel, tl[k] AS t, round(vl[k], 6) AS v FROM (SELECT channel, tl, vl, unnest(keep) AS k FROM r WHERE i > len(tl))""")
def detect_events(spark, d):
    return rounded(ts.detect_events(timeseries(spark, d), threshold=2.0, interval=30), "v")


PAIR_SQL = "m AS (SELECT label, channel, t, avg(v) AS v FROM clips GROUP BY ALL), pr AS (SELECT a.label AS k1, b.label AS k2, sqrt(sum((a.v - b.v) ** 2)) AS distance, corr(a.v, b.v) AS correlation FROM m a JOIN m b USING (channel, t) WHERE a.label <> b.label GROUP BY ALL)"


def clip_templates(spark, d):
    return clips(spark, d).groupBy("label", "channel", "t").agg(F.avg("v").alias("v"))


@query("clips", oracle=f"WITH {PAIR_SQL} SELECT k1, k2, round(distance, 6) AS distance, round(correlation, 6) AS correlation FROM pr")
def template_correlations(spark, d):
    return rounded(me.template_correlations(clip_templates(spark, d)), "distance", "correlation")


@query("clips", oracle=f"WITH {PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY distance, k2) AS r FROM pr) SELECT k1, k2, round(distance, 6) AS distance FROM r WHERE r <= 3 OR (correlation >= 0.8 AND r <= 10)")
def pairs_to_compare(spark, d):
    return rounded(me.pairs_to_compare(clip_templates(spark, d)), "distance")


@query("firings", "timeseries", oracle=f"""WITH {TEMPLATE_SQL}, pk AS (SELECT label, max(abs(v)) AS p FROM tmpl GROUP BY label),
  pr AS (SELECT a.label AS k1, b.label AS k2 FROM tmpl a JOIN tmpl b USING (channel, t) WHERE a.label <> b.label GROUP BY ALL HAVING corr(a.v, b.v) >= 0.1),
  ok AS (SELECT k1, k2 FROM pr JOIN pk x ON x.label = k1 JOIN pk y ON y.label = k2 WHERE y.p >= x.p),
  c AS (SELECT k1, k2, count(*) FILTER (b.m < a.m) AS l, count(*) FILTER (b.m > a.m) AS r FROM ok JOIN ev a ON a.label = k1 JOIN ev b ON b.label = k2 AND b.m BETWEEN a.m - 60 AND a.m + 60 GROUP BY ALL),
  bp AS (SELECT k1, max(k2) AS p FROM c WHERE (l - 2 * r) / sqrt(greatest(15.0, 2.0 * r)) > -31 GROUP BY k1) SELECT label, CAST(coalesce(bp.p, 0) AS INT) AS bursting_parent FROM pk LEFT JOIN bp ON k1 = label""")
def bursting_parents(spark, d):
    return me.bursting_parents(minute_events(spark, d), minute_templates(spark, d), window=60, min_correlation=0.1, threshold=-31)


NEAR_SQL = "pr AS (SELECT a.event_id AS e1, a.label AS k1, a.time AS t1, b.event_id AS e2, b.label AS k2, b.time AS t2 FROM firings a JOIN firings2 b ON b.time BETWEEN a.time - 30 AND a.time + 30)"


@query("firings", "firings2", oracle=f"WITH {NEAR_SQL} SELECT k1, k2, count(DISTINCT e1) AS n12, count(DISTINCT e2) AS n21 FROM pr GROUP BY k1, k2")
def match_counts(spark, d):
    return mt.match_counts(firings(spark, d), firings2(spark, d), 30)


@query("firings", "firings2", oracle=f"""WITH {NEAR_SQL}, c AS (SELECT k1, k2, count(DISTINCT e1) AS a, count(DISTINCT e2) AS b FROM pr GROUP BY ALL),
  n1 AS (SELECT label, count(*) AS n FROM firings GROUP BY 1), n2 AS (SELECT label, count(*) AS n FROM firings2 GROUP BY 1),
  s AS (SELECT k1, k2, least(a / n1.n, b / n2.n) AS sc FROM c JOIN n1 ON n1.label = k1 JOIN n2 ON n2.label = k2), q AS (SELECT pr.*, sc, abs(t2 - t1) AS g FROM pr JOIN s USING (k1, k2)),
  r AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY sc DESC, g, t2, e2) AS r1, row_number() OVER (PARTITION BY e2 ORDER BY sc DESC, g, t1, e1) AS r2 FROM q) SELECT e1, k1, t1, e2, k2, t2 FROM r WHERE r1 = 1 AND r2 = 1""")
def first_matches(spark, d):
    return mt.match_events(firings(spark, d), firings2(spark, d), 30, most_passes=1)


def matching_sql(passes):
    """The passes of the matching one after another, and the confusion matrix c that follows."""
    parts = [f"""{NEAR_SQL}, cc AS (SELECT k1, k2, count(DISTINCT e1) AS a, count(DISTINCT e2) AS b FROM pr GROUP BY ALL),
  n1 AS (SELECT label, count(*) AS n FROM firings GROUP BY 1), n2 AS (SELECT label, count(*) AS n FROM firings2 GROUP BY 1),
  s AS (SELECT k1, k2, least(a / n1.n, b / n2.n) AS sc FROM cc JOIN n1 ON n1.label = k1 JOIN n2 ON n2.label = k2), q0 AS MATERIALIZED (SELECT pr.*, sc, abs(t2 - t1) AS g FROM pr JOIN s USING (k1, k2))"""]
    for i in range(passes):
        parts.append(f"""m{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY sc DESC, g, t2, e2) AS r1, row_number() OVER (PARTITION BY e2 ORDER BY sc DESC, g, t1, e1) AS r2 FROM q{i}) WHERE r1 = 1 AND r2 = 1)""")
        parts.append(f"q{i + 1} AS MATERIALIZED (SELECT * FROM q{i} WHERE e1 NOT IN (SELECT e1 FROM m{i}) AND e2 NOT IN (SELECT e2 FROM m{i}))")
    parts.append("mm AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT e1, k1, e2, k2 FROM m{i}" for i in range(passes)) + ")")
    parts.append("""c AS MATERIALIZED (SELECT k1, k2, count(*) AS n FROM (SELECT k1, k2 FROM mm UNION ALL SELECT label, 0 FROM firings WHERE event_id NOT IN (SELECT e1 FROM mm) UNION ALL SELECT 0, label FROM firings2 WHERE event_id NOT IN (SELECT e2 FROM mm)) GROUP BY ALL)""")
    return ", ".join(parts)


@query("firings", "firings2", oracle=f"WITH {matching_sql(10)} SELECT CAST(k1 AS INT) AS k1, CAST(k2 AS INT) AS k2, n FROM c")
def confusion_matrix(spark, d):
    a, b = firings(spark, d), firings2(spark, d)
    return mt.confusion_matrix(mt.match_events(a, b, 30), a, b)


#: Of all one-to-one namings of the second table's labels, the one with most events that agree.
BEST_NAMING_SQL = """g AS MATERIALIZED (SELECT a.k AS k1, b.k AS k2, coalesce(n, 0) AS n FROM (SELECT DISTINCT k1 AS k FROM c WHERE k1 > 0) a CROSS JOIN (SELECT DISTINCT k2 AS k FROM c WHERE k2 > 0) b LEFT JOIN c ON c.k1 = a.k AND c.k2 = b.k),
  p AS (SELECT []::INT[] AS names, 0::BIGINT AS total, 0 AS i UNION ALL SELECT list_append(names, k1), total + g.n, i + 1 FROM p JOIN g ON g.k2 = i + 1 AND NOT list_contains(names, k1)),
  best AS (SELECT arg_max(names, total) AS names FROM p WHERE i = 8)"""


@query("firings", "firings2", oracle=f"WITH RECURSIVE {matching_sql(10)}, {BEST_NAMING_SQL} SELECT CAST(k1 AS INT) AS k1, CAST(CASE WHEN k2 = 0 THEN 0 ELSE names[k2] END AS INT) AS k2, n FROM c, best")
def relabelled_confusion(spark, d):
    a, b = firings(spark, d), firings2(spark, d)
    c = mt.confusion_matrix(mt.match_events(a, b, 30), a, b)
    return c.join(F.broadcast(mt.best_relabelling(c)), "k2", "left").select("k1", F.coalesce("new_k2", "k2").alias("k2"), "n")


LABEL_CONFUSION_SQL = "c AS (SELECT coalesce(a.label, 0) AS k1, coalesce(b.label, 0) AS k2, count(*) AS n FROM firings a FULL JOIN firings2 b USING (event_id) GROUP BY ALL)"


def label_confusion(spark, d):
    """Confusion by identity of events, which both tables share."""
    a, b = firings(spark, d).select("event_id", F.col("label").alias("k1")), firings2(spark, d).select("event_id", F.col("label").alias("k2"))
    return a.join(b, "event_id", "full").groupBy(F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2")).agg(F.count("*").alias("n"))


ACCURACY_SQL = f"{LABEL_CONFUSION_SQL}, x AS (SELECT *, n / (greatest(sum(n) OVER (PARTITION BY k1), 1) + greatest(sum(n) OVER (PARTITION BY k2), 1) - n) AS a FROM c), acc AS (SELECT k1, max(a) AS accuracy FROM x WHERE k1 > 0 AND k2 > 0 GROUP BY k1)"


@query("firings", "firings2", oracle=f"WITH {ACCURACY_SQL} SELECT k1, round(accuracy, 6) AS accuracy FROM acc")
def compute_accuracies(spark, d):
    return rounded(mt.compute_accuracies(label_confusion(spark, d)), "accuracy")


@query("firings", "firings2", oracle=f"WITH {ACCURACY_SQL} SELECT level, count(*) FILTER (accuracy >= level) AS units FROM acc, (SELECT unnest([0.99, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5]::DOUBLE[]) AS level) GROUP BY level")
def accuracy_counts(spark, d):
    return mt.accuracy_counts(mt.compute_accuracies(label_confusion(spark, d)))


@query("firings", "firings2", oracle="""WITH pr AS (SELECT a.event_id AS e1, a.label AS k1, b.event_id AS e2, b.label AS k2 FROM firings a JOIN firings2 b ON b.time BETWEEN a.time - 10 AND a.time + 10),
  c AS (SELECT k1, k2, least(count(DISTINCT e1), count(DISTINCT e2)) AS n FROM pr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY n DESC, k2) AS r1, row_number() OVER (PARTITION BY k2 ORDER BY n DESC, k1) AS r2 FROM c),
  n1 AS (SELECT label, count(*) AS n FROM firings GROUP BY 1), n2 AS (SELECT label, count(*) AS n FROM firings2 GROUP BY 1),
  k AS (SELECT k1, k2, r.n FROM r JOIN n1 ON n1.label = k1 JOIN n2 ON n2.label = k2 WHERE r1 = 1 AND r2 = 1 AND r.n >= 0.7 * n1.n AND r.n >= 0.7 * n2.n)
SELECT label, CAST(coalesce(k1, (SELECT max(label) FROM firings) + row_number() OVER (PARTITION BY k1 IS NULL ORDER BY label)) AS INT) AS linked_label, coalesce(k.n, 0) / n2.n AS score FROM n2 LEFT JOIN k ON k2 = label""")
def link_labels(spark, d):
    return mt.link_labels(firings(spark, d), firings2(spark, d))


@query("firings", "firings2", oracle="""WITH a AS (SELECT event_id AS e1, label AS k1, time AS t1, lag(time) OVER (ORDER BY time, event_id) AS p1 FROM firings),
  b AS (SELECT event_id AS e2, label AS k2, time AS t2 FROM firings2), pr AS (SELECT *, max((t2, e2)) FILTER (t2 < t1) OVER (PARTITION BY e1) AS last FROM a JOIN b ON t2 BETWEEN t1 - 30 AND t1 + 30)
SELECT k1, k2, count(*) AS n FROM pr WHERE p1 IS NULL OR t2 > p1 + 30 OR t2 >= t1 OR (t2, e2) = last GROUP BY k1, k2""")
def loose_confusion(spark, d):
    return mt.loose_confusion(firings(spark, d), firings2(spark, d), 30)


@query("geom", oracle="SELECT a.channel AS m, b.channel AS channel FROM geom a JOIN geom b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4.0")
def neighbourhoods(spark, d):
    return so.neighbourhoods(geom(spark, d), 2.0)


@query("timeseries", oracle="SELECT a AS channel, t, round(sum(v * (CASE WHEN a = channel THEN 1.0 ELSE -0.2 END)), 6) AS v FROM timeseries, (SELECT unnest([1, 2, 3, 4, 5])::INT AS a) GROUP BY a, t")
def apply_matrix(spark, d):
    w = spark.createDataFrame([(a, b, 1.0 if a == b else -0.2) for a in range(1, 6) for b in range(1, 6)], "m1 int, m2 int, w double")
    return rounded(ts.apply_matrix(timeseries(spark, d), w), "v")


@query("clips", oracle="""WITH m AS (SELECT label, channel, t, avg(v) AS v FROM clips GROUP BY ALL), p AS (SELECT label, channel, arg_max(v, (abs(v), -t)) AS p FROM m GROUP BY ALL), c AS (SELECT DISTINCT label, CAST(label % 4 + 1 AS INT) AS m FROM m),
  x AS (SELECT a.label AS k1, b.label AS k2, p11.p AS p11, p12.p AS p12, p21.p AS p21, p22.p AS p22 FROM c a JOIN c b ON a.m <> b.m JOIN p p11 ON p11.label = a.label AND p11.channel = a.m JOIN p p12 ON p12.label = a.label AND p12.channel = b.m
  JOIN p p21 ON p21.label = b.label AND p21.channel = a.m JOIN p p22 ON p22.label = b.label AND p22.channel = b.m)
SELECT k1, k2 FROM x WHERE p11 * p12 > 0 AND least(abs(p11), abs(p12)) > 0.3 * greatest(abs(p11), abs(p12)) AND p21 * p22 > 0 AND least(abs(p21), abs(p22)) > 0.3 * greatest(abs(p21), abs(p22))
  AND p11 * p21 > 0 AND least(abs(p11), abs(p21)) > 0.3 * greatest(abs(p11), abs(p21)) AND p12 * p22 > 0 AND least(abs(p12), abs(p22)) > 0.3 * greatest(abs(p12), abs(p22))""")
def merge_candidates(spark, d):
    means = clip_templates(spark, d)
    return so.merge_candidates(means, means.select("label", (F.col("label") % 4 + 1).cast("int").alias("m")).distinct())


@query("clips", oracle=f"""WITH {PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY distance, k2) AS r FROM pr), q AS (SELECT k1, k2 FROM r WHERE (r <= 3 OR (correlation >= 0.8 AND r <= 10)) AND k1 < k2),
  pt AS MATERIALIZED (SELECT clip_id AS id, label, f, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(clip_id AS VARCHAR)), clip_id) AS r FROM (SELECT clip_id, label, list(v ORDER BY channel, t) AS f FROM clips GROUP BY ALL)), n AS (SELECT label, least(count(*), 500) AS n FROM pt GROUP BY label),
  mb AS MATERIALIZED (SELECT k1, k2, pt.label, id, f FROM q JOIN n x ON x.label = k1 JOIN n y ON y.label = k2 JOIN pt ON pt.label IN (k1, k2) WHERE r <= least(x.n, y.n)),
  dd AS (SELECT k1, k2, a.id, a.label <> b.label AS other, row_number() OVER (PARTITION BY k1, k2, a.id ORDER BY list_distance(a.f, b.f), b.id) AS r FROM mb a JOIN mb b USING (k1, k2) WHERE a.id <> b.id)
SELECT k1, k2, round(avg(CASE WHEN other THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM dd WHERE r <= 5 GROUP BY k1, k2""")
def pair_overlap(spark, d):
    points = so.clip_features(clips(spark, d)).select(F.col("clip_id").alias("id"), "label", "f")
    pairs = me.pairs_to_compare(clip_templates(spark, d)).where("k1 < k2")
    return rounded(me.pair_overlap(points, pairs), "overlap")


@query()
def bandpass_filter(spark, d):
    return rounded(ch.unchunked(ch.chunk_bandpass(chunked_timeseries(spark, d, 10_000), 1.0, 0.01, 0.2, 0.05, padding=1_000)), "v")


#: The filter as a sum over a chunk's samples around the circle. The error function is integrated by Simpson's rule.
BAND_SQL = """WITH RECURSIVE hours AS (SELECT CAST(c AS INT) AS channel, m AS t, coalesce(s, 0.0) AS v FROM range(1, 6) a(c), range(720) b(m) LEFT JOIN (SELECT channel, time // 3600 AS tt, CAST(sum(CAST(amplitude AS DECIMAL(18,2))) AS DOUBLE) AS s FROM firings GROUP BY 1, 2) x ON x.channel = c AND x.tt = m),
  arg AS (SELECT j, u, least(greatest(CASE WHEN u = 0 THEN 3 * (j / 360.0 - 0.02) / 0.02 ELSE (j / 360.0 - 0.2) / 0.1 END, -6.0), 6.0)::DOUBLE AS x FROM range(0, 181) r(j), range(2) q(u)),
  er AS (SELECT j, u, 2 / sqrt(pi()) * x / 60000 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(x * i / 20000) * (x * i / 20000))) AS e FROM arg, range(0, 20001) s(i) GROUP BY j, u, x),
  g AS (SELECT a.j, CASE WHEN a.j = 0 THEN 0.0 ELSE sqrt(greatest(1 + a.e, 0) / 2 * greatest(1 - b.e, 0) / 2) END AS g FROM er a JOIN er b ON a.j = b.j AND a.u = 0 AND b.u = 1),
  h AS MATERIALIZED (SELECT d, sum(CASE WHEN j IN (0, 180) THEN 1 ELSE 2 END * g * cos(2 * pi() * ((j * d) % 360) / 360)) / 360 AS h FROM g, range(360) r(d) GROUP BY d),
  x AS MATERIALIZED (SELECT channel, k, i, v FROM range(3) a(k), range(360) b(i) JOIN hours ON t = k * 240 + i - 60)
SELECT channel, k * 240 + o.i - 60 AS t, round(sum(v * h), 5) AS v FROM x JOIN range(60, 300) o(i) ON true JOIN h ON d = (o.i - x.i + 360) % 360 GROUP BY channel, k, o.i"""


@query("firings", oracle=BAND_SQL)
def bandpass_hours(spark, d):
    """The hourly series in three chunks, each filtered with sixty samples on either side."""
    sums = firings(spark, d).groupBy("channel", F.expr("time div 3600").alias("t")).agg(F.sum(F.col("amplitude").cast("decimal(18,2)")).cast("double").alias("v"))
    hours = ch.chunked(sums, 720, size=240, channels=[1, 2, 3, 4, 5])
    return rounded(ch.unchunked(ch.chunk_bandpass(hours, 1.0, 0.02, 0.2, 0.1, padding=60)), "v", places=5)


@query("firings", "firings2", oracle="SELECT event_id, time, source, row_number() OVER (ORDER BY time, source, event_id) - 1 AS position FROM (SELECT event_id, time, 0 AS source FROM firings UNION ALL SELECT event_id, time, 1 FROM firings2)")
def in_time_order(spark, d):
    return ev.in_time_order(ev.concat_event_times([firings(spark, d), firings2(spark, d)])).select("event_id", "time", "source", "position")


@query()
def whiten(spark, d):
    return rounded(ch.unchunked(ch.chunk_whiten(chunked_timeseries(spark, d))), "v")


@query()
def fit_stage(spark, d):
    return so.fit_stage(timeseries(spark, d), minute_events(spark, d), minute_templates(spark, d), CLIP)


@query()
def sort_events(spark, d):
    return so.sort_events(ch.chunk_whiten(chunked_timeseries(spark, d)), geom(spark, d), clip_size=20, detect_threshold=3.0, detect_interval=30)


@query()
def isolation_metrics(spark, d):
    return so.isolation_metrics(timeseries(spark, d), minute_events(spark, d), CLIP, length=MINUTES)


@query()
def synthesize_timeseries(spark, d):
    waves = sy.random_waveforms(spark, channels=5, size=60, units=8, upsample=3)
    events = firings(spark, d).select("event_id", "channel", F.col("time").cast("double").alias("time"), "label")
    return rounded(sy.synthesize_timeseries(spark, waves, events, channels=5, length=60 * MINUTES, size=60, upsample=3), "v")


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("timeseries", oracle="SELECT t, channel, v FROM timeseries UNION ALL SELECT t + 43200, channel, v FROM timeseries")
def array_files(spark, d):
    """The series as array files, and again after them, read back."""
    folder = new_folder(spark, "arrays")
    ar.write_array(timeseries(spark, d), folder, 5, "float64", partitions=4)
    ar.write_array(timeseries(spark, d), folder, 5, "float64", append=True, partitions=4)
    return ar.read_array(spark, folder)


@query("timeseries", oracle="SELECT t, channel, v FROM timeseries WHERE t >= 20000 AND t < 20100")
def array_range(spark, d):
    """A range of t, which alone is read."""
    folder = new_folder(spark, "arrays")
    ar.write_array(timeseries(spark, d), folder, 5, "float64", partitions=4)
    return ar.read_array(spark, folder, chunk=1000).where("t >= 20000 AND t < 20100")


@query("firings", oracle="SELECT label, name, value FROM (SELECT label, CAST(count(*) AS DOUBLE) AS num_events, CAST(min(time) AS DOUBLE) AS tmin_sec, CAST(max(time) AS DOUBLE) AS tmax_sec, CAST(max(time) - min(time) AS DOUBLE) AS dur_sec FROM firings GROUP BY label) UNPIVOT (value FOR name IN (num_events, tmin_sec, tmax_sec, dur_sec))")
def metric_documents(spark, d):
    """Metrics written as a JSON document and read back."""
    folder = new_folder(spark, "metrics")
    ar.write_metrics(me.metrics_long(me.view_metrics(firings(spark, d))), folder)
    return ar.read_metrics(spark, folder)


@query("geom", oracle="SELECT channel, x, y FROM geom")
def geom_files(spark, d):
    """Coordinates written as lines of text and read back."""
    folder = new_folder(spark, "geom")
    ar.write_csv_array(geom(spark, d).select(F.col("channel").alias("row"), F.array("x", "y").alias("values")), folder)
    return ar.read_geom(spark, folder)


@query("clips", oracle="SELECT clip_id, a AS channel, t, round(sum(v * (CASE WHEN a = channel THEN 1.0 ELSE -0.25 END)), 6) AS v FROM clips, (SELECT unnest([1, 2, 3, 4])::INT AS a) GROUP BY ALL")
def whiten_clips(spark, d):
    w = spark.createDataFrame([(a, b, 1.0 if a == b else -0.25) for a in range(1, 5) for b in range(1, 5)], "m1 int, m2 int, w double")
    return rounded(ts.whiten_clips(clips(spark, d), w), "v")


@query("timeseries", oracle="SELECT a AS m1, b AS m2, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS w FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS a), (SELECT unnest([1, 2, 3, 4, 5])::INT AS b)")
def whitened_covariance(spark, d):
    """Whitened channels have unit variance and no correlation, up to the grid of the values."""
    out = ch.chunk_covariance(ch.chunk_whiten(chunked_timeseries(spark, d)))
    return out.select("m1", "m2", F.abs(F.round("w", 3)).alias("w"))


@query("timeseries", oracle="SELECT a AS m1, b AS m2, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS w FROM (SELECT unnest([1, 2])::INT AS a), (SELECT unnest([1, 2])::INT AS b)")
def whitened_subset(spark, d):
    """The same for channels 4 and 2."""
    x = timeseries(spark, d)
    part = ts.extract_timeseries(x, [4, 2])
    out = ts.covariance(ts.apply_matrix(part, ts.whitening_matrix(x, MINUTES, channels=[4, 2])), MINUTES)
    return out.select("m1", "m2", F.abs(F.round("w", 6)).alias("w"))


@query("firings", oracle="SELECT event_id, channel, time, label, amplitude, is_last FROM (SELECT *, false AS is_last, row_number() OVER (PARTITION BY label ORDER BY time, event_id) AS r FROM firings UNION ALL SELECT *, true, row_number() OVER (PARTITION BY label ORDER BY time DESC, event_id) FROM firings) WHERE r <= 50")
def edge_events(spark, d):
    rows = firings(spark, d)
    return sg.edge_events(rows, 50, False).withColumn("is_last", F.lit(False)).unionByName(sg.edge_events(rows, 50, True).withColumn("is_last", F.lit(True)))


@query("firings", oracle="SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM firings) WHERE r <= 20")
def drawn_events(spark, d):
    """Some events of each label, drawn without regard to anything but their id."""
    rank = Window.partitionBy("label").orderBy(*me.drawn_order("event_id"))
    return firings(spark, d).withColumn("r", F.row_number().over(rank)).where("r <= 20").select("event_id", "label")


@query("firings", "firings2", oracle=f"""WITH a AS (SELECT * FROM firings WHERE time < {3 * WEEK}), b AS (SELECT * FROM firings2 WHERE time >= {WEEK}), oa AS (SELECT * FROM a WHERE time BETWEEN {WEEK} AND {3 * WEEK}), ob AS (SELECT * FROM b WHERE time BETWEEN {WEEK} AND {3 * WEEK}),
  pr AS (SELECT x.event_id AS e1, x.label AS k1, y.event_id AS e2, y.label AS k2 FROM oa x JOIN ob y ON y.time BETWEEN x.time - 10 AND x.time + 10),
  c AS (SELECT k1, k2, least(count(DISTINCT e1), count(DISTINCT e2)) AS n FROM pr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY n DESC, k2) AS r1, row_number() OVER (PARTITION BY k2 ORDER BY n DESC, k1) AS r2 FROM c),
  n1 AS (SELECT label, count(*) AS n FROM oa GROUP BY 1), n2 AS (SELECT label, count(*) AS n FROM ob GROUP BY 1),
  k AS (SELECT k1, k2 FROM r JOIN n1 ON n1.label = k1 JOIN n2 ON n2.label = k2 WHERE r1 = 1 AND r2 = 1 AND r.n >= 0.89 * n1.n AND r.n >= 0.89 * n2.n), f AS (SELECT label, min((time, event_id)) AS f FROM b GROUP BY label),
  nm AS (SELECT label, CAST(coalesce(k1, (SELECT max(label) FROM a) + row_number() OVER (PARTITION BY k1 IS NULL ORDER BY f)) AS INT) AS new FROM f LEFT JOIN k ON k2 = label)
SELECT event_id, channel, time, new AS label, time > {3 * WEEK} AS fresh FROM b JOIN nm USING (label)""")
def link_segments(spark, d):
    before, after = firings(spark, d).where(f"time < {3 * WEEK}"), firings2(spark, d).where(f"time >= {WEEK}")
    return mt.link_segments(before, after, t1_prev=0, t2_prev=3 * WEEK, t1=WEEK, t2=10 * WEEK, threshold=0.89)


@query("clips", oracle=f"""WITH m AS (SELECT label, channel, t, avg(v) AS v FROM clips GROUP BY ALL), b AS (SELECT label AS k2, channel, t, v, d FROM m, range(-5, 6) r(d)),
  x AS (SELECT label AS k1, k2, d, sum(m.v * b.v) AS s12 FROM m JOIN b ON b.channel = m.channel AND m.t = b.t - d GROUP BY ALL), n1 AS (SELECT label AS k1, sum(v * v) AS s11 FROM m GROUP BY ALL), n2 AS (SELECT k2, d, sum(v * v) AS s22 FROM b WHERE t - d BETWEEN 0 AND 15 GROUP BY ALL),
  r AS (SELECT k1, k2, d, s12 / sqrt(s11 * s22) AS r FROM x JOIN n1 USING (k1) JOIN n2 USING (k2, d))
SELECT k1, k2, round(max(r), 6) AS correlation, CAST(arg_max(d, r) AS INT) AS lag FROM r GROUP BY k1, k2""")
def sliding_correlations(spark, d):
    means = clip_templates(spark, d)
    return rounded(tp.sliding_correlations(means, means, 5), "correlation")


@query("clips", oracle="SELECT clip_id, label, channel, CAST((t + 3) % 16 AS INT) AS t, v FROM clips")
def shift_clips(spark, d):
    return tp.shift_clips(clips(spark, d), 3, 16)


@query("clips", oracle="SELECT clip_id, label, round(sum(v * v), 6) AS energy FROM clips GROUP BY clip_id, label")
def principal_energy(spark, d):
    """Along all axes the features of a clip have the clip's energy."""
    out = tp.principal_features(clips(spark, d), 64)
    return out.select("clip_id", "label", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


#: A symmetric matrix times itself, and again, until what is left is the projection on its leading axis.
SQUARED_SQL = """p AS (SELECT k, c, 0 AS n FROM mat UNION ALL SELECT k, list_transform(s, lambda a: list_transform(a, lambda x: x / top)), n + 1 FROM
  (SELECT k, n, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) AS top FROM (SELECT k, n, list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b))) AS s FROM p WHERE n < 18)))"""


@query("clips", oracle=f"""WITH RECURSIVE f AS MATERIALIZED (SELECT clip_id, label, list(v ORDER BY channel, t) AS f FROM clips GROUP BY ALL),
  x AS (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(f[i] * f[j]) AS s FROM f, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL) GROUP BY i), mat AS (SELECT 0 AS k, list(r ORDER BY i) AS c FROM x), {SQUARED_SQL}
SELECT clip_id, label, round(list_dot_product(f, list_transform(c, lambda r: list_dot_product(r, f))), 5) AS energy FROM f, p WHERE n = 18""")
def leading_energy(spark, d):
    """The energy of each clip along the leading axis of all."""
    out = tp.principal_features(clips(spark, d), 1)
    return out.select("clip_id", "label", F.round(F.col("features")[0] * F.col("features")[0], 5).alias("energy"))


@query("clips", oracle=f"""WITH RECURSIVE f AS MATERIALIZED (SELECT clip_id, channel AS k, list(v ORDER BY t) AS f FROM clips GROUP BY ALL),
  x AS (SELECT k, i, list(s ORDER BY j) AS r FROM (SELECT k, i, j, sum(f[i] * f[j]) AS s FROM f, range(1, 17) a(i), range(1, 17) b(j) GROUP BY ALL) GROUP BY ALL), mat AS (SELECT k, list(r ORDER BY i) AS c FROM x GROUP BY k), {SQUARED_SQL},
  e AS (SELECT clip_id, k, list_dot_product(f, list_transform(c, lambda r: list_dot_product(r, f))) AS e FROM f JOIN p USING (k) WHERE n = 18)
SELECT clip_id, list_transform(list(e ORDER BY k), lambda x: round(x, 5))[1] AS first_energy, round(sum(e), 5) AS energy FROM e GROUP BY clip_id""")
def channel_energy(spark, d):
    """Each channel's clips reduced to one feature by the channel's own leading axis."""
    own = clips(spark, d).groupBy(F.col("clip_id").alias("event_id"), F.lit(1).alias("m"), "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("clip"))  # one clip
    squares = F.transform("f", lambda x: x * x)
    out = cl.channel_features(checkpointed(own), 1).select(F.col("event_id").alias("clip_id"), squares.alias("e"))
    return rounded(out.select("clip_id", F.col("e")[0].alias("first_energy"), F.aggregate("e", F.lit(0.0), lambda s, x: s + x).alias("energy")), "first_energy", "energy", places=5)


@query("firings", oracle="""WITH u AS (SELECT event_id, CASE WHEN event_id % 50 < 25 THEN 1 ELSE 2 END AS m, CASE WHEN event_id % 50 = 7 THEN 3 ELSE label % 3 END AS unit FROM firings)
SELECT event_id, m, min(event_id) OVER (PARTITION BY m, unit) AS first_event FROM u""")
def cluster_all(spark, d):
    """Events of three common units and a rare one, as points around the units' middles by digests of their ids: clusters of
    all of them, each named by its first event."""
    unit = F.when(F.expr("event_id % 50 = 7"), 3).otherwise(F.col("label") % 3)
    middles = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((0, 0, 0, 0), (15, 0, 0, 4), (0, 15, 5, 0), (-14, -12, 9, 3))])
    digit = lambda i, j: F.pmod(F.xxhash64("event_id", F.lit(i), F.lit(j)), F.lit(1000)) / 1000.0
    near = lambda i: 1.7 * (digit(i, 0) + digit(i, 1) + digit(i, 2) + digit(i, 3) - 2)
    f = F.array(*[middles[unit][i] + near(i) for i in range(4)])
    points = checkpointed(firings(spark, d).select("event_id", F.when(F.expr("event_id % 50 < 25"), 1).otherwise(2).alias("m"), f.alias("f")))
    labels = checkpointed(cl.cluster_all(points)[0])
    names = labels.groupBy("m", "label").agg(F.min("event_id").alias("first_event"))
    return labels.join(F.broadcast(names), ["m", "label"]).select("event_id", "m", "first_event")  # one row a cluster


@query("clips", oracle="""WITH a AS MATERIALIZED (SELECT clip_id, label, list(v ORDER BY channel, t) AS f FROM clips GROUP BY ALL), b AS MATERIALIZED (SELECT clip_id, label, list(v ORDER BY channel, t DESC) AS f FROM clips GROUP BY ALL),
  n AS (SELECT b.clip_id, b.label AS k2, arg_min(a.label, (list_distance(a.f, b.f), a.label)) AS k1 FROM a, b GROUP BY ALL), c AS (SELECT k1, k2, count(*) AS n FROM n GROUP BY ALL)
SELECT k1, k2, round(n / sum(n) OVER (PARTITION BY k2), 6) AS share FROM c""")
def label_votes(spark, d):
    """Whose clips are nearest to those of each label when these are turned round in time."""
    x = clips(spark, d).withColumnRenamed("clip_id", "event_id")
    return rounded(sg.label_votes(x, x.withColumn("t", 15 - F.col("t"))), "share")


@query("clips", oracle="""WITH a AS MATERIALIZED (SELECT clip_id, label, list(v ORDER BY channel, t) AS f FROM clips GROUP BY ALL),
  d AS (SELECT a.clip_id, b.clip_id AS near_id, b.label AS near_label, list_distance(a.f, b.f) AS d FROM a JOIN a b ON a.clip_id <> b.clip_id AND a.clip_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY d, near_id) AS r FROM d) SELECT clip_id, CAST(r AS INT) AS rank, near_id, near_label, round(d, 6) AS distance FROM r WHERE r <= 3""")
def nearest_clips(spark, d):
    """The three nearest of all other clips, for the clips whose id is divisible by 50."""
    x = so.clip_features(clips(spark, d)).select(F.col("clip_id").alias("id"), "label", "f")
    out = nb.nearest(x, x.where("id % 50 = 0").select(F.col("id").alias("qid"), "f", F.col("id").alias("but")), 3, leaf_rows=500)
    return rounded(out.select(F.col("qid").alias("clip_id"), "rank", F.col("id").alias("near_id"), F.col("label").alias("near_label"), "distance"), "distance")


@query("firings", "timeseries", oracle=f"""WITH ev AS (SELECT label, time // 60 AS m, count(*) AS w FROM firings GROUP BY ALL), n AS (SELECT label, sum(w) AS n FROM ev GROUP BY label),
  x AS MATERIALIZED (SELECT label, channel, o, v, w FROM (SELECT label, o, w, m + o - 9 AS t FROM ev CROSS JOIN range({CLIP}) r(o)) e JOIN timeseries USING (t)), s AS (SELECT label, channel, o, sum(v * w) / any_value(n) AS mean FROM x JOIN n USING (label) GROUP BY ALL),
  q AS (SELECT label, channel, o, sum((v - mean) ** 2 * w) AS ss, sum(w) AS inside FROM x JOIN s USING (label, channel, o) GROUP BY ALL), z AS (SELECT label, mean, sqrt((ss + (n - inside) * mean * mean) / n) AS stdev FROM s JOIN q USING (label, channel, o) JOIN n USING (label))
SELECT label, round(max(abs(mean)), 6) AS peak_amp, round(max(stdev), 6) AS peak_noise, round(max(abs(mean)) / max(stdev), 6) AS peak_snr FROM z GROUP BY label""")
def event_peaks(spark, d):
    """Peaks over the clips of all events, of which none is made."""
    return rounded(me.peak_metrics(tp.event_statistics(timeseries(spark, d), minute_events(spark, d), CLIP)), "peak_amp", "peak_noise", "peak_snr")


@query("clips", oracle="""WITH m AS (SELECT label, CAST(label % 4 + 1 AS INT) AS m, channel, t, avg(v) AS v FROM clips GROUP BY ALL),
  p AS (SELECT label, m, max(abs(v)) AS top, max(abs(v)) FILTER (channel = m) AS own, arg_max(t, (abs(v), -t)) FILTER (channel = m) AS o FROM m GROUP BY ALL)
SELECT m, label, CAST(row_number() OVER (PARTITION BY m ORDER BY label) AS INT) AS new_label FROM p WHERE own >= 0.5 * top AND abs(o - 7) <= 6""")
def consolidate(spark, d):
    means = clip_templates(spark, d).withColumn("m", (F.col("label") % 4 + 1).cast("int"))
    return so.consolidate(means, 16, 0.5, 6)


@query("firings", "clips", oracle="""WITH w AS (SELECT label, channel, t, avg(v) AS v FROM clips GROUP BY ALL), e AS (SELECT channel, time // 60 + t - 8 AS t, sum(v) AS s FROM (SELECT label, time FROM firings) JOIN w USING (label) GROUP BY ALL)
SELECT CAST(c AS INT) AS channel, m AS t, round(coalesce(s, 0.0), 6) AS v FROM range(1, 5) a(c), range(43200) b(m) LEFT JOIN e ON e.channel = c AND e.t = m""")
def superposed_waveforms(spark, d):
    """A recording without noise: each event's waveform where it is."""
    waves = clip_templates(spark, d)
    return rounded(sy.synthesize_timeseries(spark, waves, minute_events(spark, d), channels=4, length=MINUTES, size=16, upsample=1, noise=0.0), "v")


@query("firings", oracle="SELECT DISTINCT label, 0::BIGINT AS violations FROM firings")
def refractory_violations(spark, d):
    """No event that is left follows another of its label within a minute."""
    kept = sy.enforce_refractory(firings(spark, d), 60)
    near = with_previous(kept, ["label"], "time", "event_id", 60, "before")
    return near.groupBy("label").agg(F.count_if(F.col("time") - F.col("before") < 60).alias("violations"))


@query("timeseries", oracle="SELECT t, channel, CASE WHEN t % 1000 < 700 THEN v ELSE 0.0 END AS v FROM timeseries")
def array_places(spark, d):
    """Ranges of the series, in no order, written to their places of one array file; between them it stays zero."""
    path = f"{new_folder(spark, 'places')}/series.mda"
    some = timeseries(spark, d).where("t % 1000 < 700").repartition(7)
    ar.write_ranges(some, path, 5, MINUTES, "float64")
    return ar.read_array(spark, path)


@query("timeseries", oracle="SELECT channel, t, round(v, 6) AS v FROM timeseries")
def chunk_files(spark, d):
    """The series written as array files, which are read as chunks."""
    folder = new_folder(spark, "arrays")
    ar.write_array(timeseries(spark, d), folder, 5, "float64", partitions=3)
    return rounded(ch.unchunked(ch.read_chunks(spark, folder, 5000)), "v")


@query("clips", oracle="SELECT row_number() OVER (ORDER BY clip_id) AS row, f[1] AS first, CAST(len(f) AS INT) AS n, round(list_sum(f), 6) AS total FROM (SELECT clip_id, list(v ORDER BY channel, t) AS f FROM clips GROUP BY clip_id)")
def text_arrays(spark, d):
    """Clips written as lines of text and read back in ranges of bytes."""
    folder = new_folder(spark, "lines")
    ar.write_csv_array(so.clip_features(clips(spark, d)).select(F.col("clip_id").alias("row"), F.col("f").alias("values")), folder)
    back = ar.read_csv_array(spark, folder)
    return rounded(back.select("row", F.col("values")[0].alias("first"), F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")
