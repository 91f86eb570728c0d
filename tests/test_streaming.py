from pyspark.sql import functions as F

from threadloom.streaming import tracks


def test_speeds_keep_the_last_position(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 2, 6.0, 8.0), (2, 5, 1.0, 1.0)], "individual long, frame long, x double, y double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tracks.speeds(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("speeds").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("speeds").collect()] == [(1, 2, 5.0)]


def test_hourly_states(spark, tmp_path):
    rows = spark.range(10).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1200)).alias("ts"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = tracks.hourly_states(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 3, 3, 3]
