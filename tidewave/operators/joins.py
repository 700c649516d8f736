"""Range joins, which Spark would otherwise plan as nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.plans.storage import checkpointed


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df with _i, the place of each row (from 0) among those with its value of `by`, in an order that must be total, and _n,
    their number. No task sees more than a range of the order, however many rows a value has: places go on from
    the totals of the ranges before."""
    dealt = df.repartitionByRange(by, *order)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(by, "_part").agg(F.count("*").alias("_rows"))  # partitions and values
    of = Window.partitionBy(by)
    before = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(of).alias("_n"))
    inside = Window.partitionBy(by, "_part").orderBy(*order)
    return dealt.withColumn("_r", F.row_number().over(inside)).join(totals, [by, "_part"]).withColumn("_i", F.col("_r") - 1 + F.col("_before")).drop("_part", "_r", "_before")


def band_join(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, before: float, after: float, how: str = "inner", on: Column | None = None, hint: str | None = "shuffle_hash") -> DataFrame:
    """Rows of left and right with right_time - left_time between -before and after, both included, and `on` where
    given. Column names of the two sides must differ.

    Time is cut into buckets as wide as the band. A right row belongs to its own bucket; a left row is repeated for each
    bucket that its band reaches, two or at most three, so that the join has an equal key and finds each pair once.
    """
    width = float(max(before + after, 1e-9))
    bucket = lambda c: F.floor(c / F.lit(width))
    reach = F.explode_outer if how in ("left", "left_outer") else F.explode
    l = left.withColumn("_bucket", reach(F.sequence(bucket(F.col(left_time) - F.lit(before)), bucket(F.col(left_time) + F.lit(after)))))  # noqa: E741
    r = right.withColumn("_bucket_r", bucket(F.col(right_time)))
    test = (F.col("_bucket") == F.col("_bucket_r")) & (F.col(right_time) - F.col(left_time) >= F.lit(-before)) & (F.col(right_time) - F.col(left_time) <= F.lit(after))
    if on is not None:
        test = test & on
    return l.join(r.hint(hint) if hint else r, test, how).drop("_bucket", "_bucket_r")


def running_total(totals: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """totals (one row a source, of which there are few) with the sum of value over the rows before."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def with_previous(df: DataFrame, by: list[str], time: str, tie: str, reach: float, name: str, value: str | None = None) -> DataFrame:
    """df with `name`, the time (or value) of the row before it among those with its values of `by` (ordered by time and tie),
    or null where none lies within `reach`. Time is cut into buckets, of which each also sees the rows up to reach before
    it, so that no task sees all rows of a value."""
    width = 64 * max(float(reach), 1e-9)
    own = F.floor(F.col(time) / F.lit(width))
    also = F.when(F.floor((F.col(time) + F.lit(reach)) / F.lit(width)) > own, own + 1)
    near = df.withColumn("_home", own).withColumn("_bucket", F.explode(F.array_compact(F.array(own, also))))
    before = F.lag(F.struct(F.col(time).alias("t"), F.col(value or time).alias("x"))).over(Window.partitionBy(*by, "_bucket").orderBy(time, tie))
    out = near.withColumn("_before", before).where(F.col("_bucket") == F.col("_home")).drop("_bucket", "_home")
    return out.withColumn(name, F.when(F.col(time) - F.col("_before.t") <= F.lit(reach), F.col("_before.x"))).drop("_before")


def join_counted(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = 1_000_000) -> DataFrame:  # type: ignore[no-untyped-def]
    """left joined with right, which is broadcast if it has `most` rows at most. For tables of a row a label or so, whose size
    Spark doesn't know, so that a label's events need not come to one task."""
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)
