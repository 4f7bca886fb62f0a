"""The streaming extension equals the batch answer."""

from pyspark.sql import functions as F

from quillon.streaming import windowed


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    ask = lambda df: windowed(df, "ts", "week", "1 day", {"kind": F.col("event_type")}, {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = ask(stream).writeStream.outputMode("complete").format("memory").queryName("weeks").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = sorted(map(tuple, ask(batch).collect()))
    assert sorted(map(tuple, spark.table("weeks").collect())) == want and want
    assert {r[0].weekday() for r in want} == {0}
