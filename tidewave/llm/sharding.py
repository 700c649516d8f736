"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.llm.common import table, written


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, partitions: int | None = None) -> DataFrame:
    """Deals all rows of docs (doc_id, text, ...) into contiguous shards 0 .. shards - 1 of nearly equal bytes.

    Rows are ordered by (doc_id, crc32 of the text, size). Each range of that order gives one total of bytes and
    rows; prefix sums over the totals, of which there are as many as partitions, give where each range begins in
    the whole, and a running sum within the range places each row. A row whose middle byte lies in the k-th of
    `shards` equal cuts of all bytes goes to shard k, so a shard differs from the mean by one row at most.

    A null text has no bytes and crc32 0. A null doc_id comes first. Rows that repeat are placed one after
    another. They can't be told apart, so a hot doc_id is spread over several ranges. More shards than rows leave
    shards empty; an empty table gives no rows. Other columns of docs are ignored.

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot (place within the shard), grown_shard (null).
    """
    spark = docs.sparkSession
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["doc_id", "text_crc32", "size"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # the last key only spreads rows that are equal in all others
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, *key, "tie").withColumn("part", F.spark_partition_id())
    dealt = written(dealt.drop("tie"), "shard-rows")  # what is in which range must be the same for both passes

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("part_bytes").over(Window.partitionBy(F.lit(1))).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*key)
    placed = (
        dealt.withColumn("row", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(starts), "part")  # one row a partition
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"twice_middle * {shards} div (2 * all_bytes)")).cast("int"))
    )
    # a shard begins within some range: its slots go on from the rows that it has in earlier ranges
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("rows"), F.min("row").alias("first_row"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "shard", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first_row")).alias("shift"))
    return placed.join(F.broadcast(counts), ["part", "shard"]).select(  # partitions + shards rows at most
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))

#: The same with a table-driven crc32 and sums over one order of all rows.
OP1_SQL = """
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d),
x AS (SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INT) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM b, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM x),
s AS (SELECT *, CAST(least(39, (2 * upto - size) * 40 // (2 * total)) AS INT) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""
