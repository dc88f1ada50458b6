from pyspark.sql import functions as F

from verdigris.streaming import events, sessions

from compare import SMALL


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tmp_path / "in"
    batch.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(folder))
    stream = events.windowed(events.event_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, 10), "1 hour", late="2 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.sql("select * from hours").collect()}
    want = {(r.start, r.event_type): r.n for r in events.windowed(batch, "1 hour").collect()}
    assert got == want


def test_inherited(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "M"), (1, 1, "user", "b", None), (2, 0, "user", "c", None)], "conv_id int, turn int, role string, text string, major string")
    assert [r.major for r in sessions.inherited(rows, ["major"]).orderBy("conv_id", "turn").collect()] == ["M", "M", None]
