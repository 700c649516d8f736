"""The library's logical tables seen over a general event table and an embedding table, for queries and benchmarks.

firings: event_id, channel (1 ..), time (seconds), label (1 ..), amplitude. timeseries: channel, t, v on a dense grid.
clips: clip_id, t, channel, v, label. geom: channel, x, y. Each has the same definition in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators.chunks import Chunked, chunked

TYPES = ["click", "error", "purchase", "signup", "view"]
MINUTES = 43_200
WEEK = 604_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in TYPES])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.array_position(kinds, F.col("event_type")).cast("int").alias("channel"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("time"),
        ((F.col("user_id") % 8).cast("int") + 1).alias("label"),
        F.col("value").alias("amplitude"),
    )


def firings2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second sorter might say of the same events."""
    moved = F.when(F.col("event_id") % 10 == 0, F.col("label") % 8 + 1).otherwise(F.col("label")).cast("int")
    return firings(spark, sf_dir).where("event_id % 13 <> 0").select("event_id", "channel", (F.col("time") + F.col("event_id") % 7 - 3).alias("time"), moved.alias("label"))


def timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(len(TYPES) * MINUTES).select((F.col("id") % len(TYPES) + 1).cast("int").alias("channel"), F.expr(f"id div {len(TYPES)}").alias("t"))
    sums = firings(spark, sf_dir).groupBy("channel", F.expr("time div 60").alias("t")).agg(F.sum(F.col("amplitude").cast("decimal(18,2)")).cast("double").alias("s"))
    return grid.join(sums.hint("merge"), ["channel", "t"], "left").select("channel", "t", F.coalesce("s", F.lit(0.0)).alias("v"))


def chunked_timeseries(spark: SparkSession, sf_dir: str, size: int = 4096) -> Chunked:
    """The timeseries in chunks, made from its events without a row for each of its samples."""
    sums = firings(spark, sf_dir).groupBy("channel", F.expr("time div 60").alias("t")).agg(F.sum(F.col("amplitude").cast("decimal(18,2)")).cast("double").alias("v"))
    return chunked(sums, MINUTES, size=size, channels=list(range(1, len(TYPES) + 1)))


def geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of the events, side by side, and a little apart by how many events they have."""
    n = firings(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"))
    return n.select("channel", (F.col("channel") - 1).cast("double").alias("x"), (F.col("n") % 3).cast("double").alias("y"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), (F.col("label") + 1).cast("int").alias("label"), F.posexplode("embedding").alias("i", "e"))
    return each.select("clip_id", F.expr("i div 4").cast("int").alias("t"), (F.col("i") % 4 + 1).cast("int").alias("channel"), F.col("e").cast("double").alias("v"), "label")


#: The same views in SQL, each built on those before it.
SQL = {
    "firings": """SELECT event_id, CAST(list_position(['click','error','purchase','signup','view'], event_type) AS INT) AS channel,
      CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000.0) AS BIGINT) AS time, CAST(user_id % 8 AS INT) + 1 AS label, value AS amplitude FROM events""",
    "firings2": """SELECT event_id, channel, time + event_id % 7 - 3 AS time, CAST(CASE WHEN event_id % 10 = 0 THEN label % 8 + 1 ELSE label END AS INT) AS label
      FROM firings WHERE event_id % 13 <> 0""",
    "timeseries": """SELECT CAST(c AS INT) AS channel, m AS t, coalesce(s, 0.0) AS v FROM range(1, 6) a(c), range(43200) b(m) LEFT JOIN
      (SELECT channel, time // 60 AS tt, CAST(sum(CAST(amplitude AS DECIMAL(18,2))) AS DOUBLE) AS s FROM firings GROUP BY 1, 2) x ON x.channel = c AND x.tt = m""",
    "geom": "SELECT channel, CAST(channel - 1 AS DOUBLE) AS x, CAST(count(*) % 3 AS DOUBLE) AS y FROM firings GROUP BY channel",
    "clips": """SELECT vec_id AS clip_id, CAST(i // 4 AS INT) AS t, CAST(i % 4 + 1 AS INT) AS channel, CAST(embedding[i + 1] AS DOUBLE) AS v, label + 1 AS label
      FROM embeddings, range(64) r(i)""",
}


def sql(query: str, *views: str) -> str:
    """A query after definitions of the views that it uses."""
    needs = {"firings2": ["firings"], "timeseries": ["firings"], "geom": ["firings"]}
    names = [v for v in SQL if v in {*views, *(n for v in views for n in needs.get(v, []))}]
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in names)
    query = query.strip()
    if query[:4].upper() == "WITH":
        recursive = query[4:].lstrip()[:9].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {query[4:].lstrip()[9 if recursive else 0:]}"
    return f"WITH {head} {query}"
