"""Streams give what the same rows give as a table."""

from pyspark.sql import functions as F

from tidewave.streaming.rates import firing_rates


def test_rates_of_a_stream(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 3).cast("int").alias("label"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = firing_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(spark.table("rates")) == get(firing_rates(rows))
