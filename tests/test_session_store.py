from pyspark.sql import functions as F

from verdigris.streaming import session_store as S

from compare import SMALL


def turns(spark, path):
    t = spark.read.parquet(path)
    return t.withColumn("mode", F.when(F.col("turn") % 3 == 0, F.col("role"))).withColumn("topic", F.when(F.col("turn") % 2 == 1, F.element_at(F.split("text", " "), 1)))


def test_two_micro_batches_equal_the_table(spark, tmp_path):
    whole = turns(spark, f"{SMALL}/conversations.parquet")
    folder = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else empty batches follow for as long as states may run out
    whole.where("turn < 3").coalesce(1).write.parquet(str(folder))
    stream = S.stream_contexts(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 100).parquet(str(folder)), "conv_id", "turn", "text", ["mode", "topic"])

    def run():
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)

    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    whole.where("turn >= 3").coalesce(1).write.mode("append").parquet(str(folder))
    run()  # the states outlive the query
    as_tuple = lambda r: (r.conv_id, r.turn, r.mode, r.topic, tuple(r.recent), r.seen)
    got = sorted(map(as_tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    want = sorted(map(as_tuple, S.batch_contexts(whole, "conv_id", "turn", "text", ["mode", "topic"]).collect()), key=repr)
    assert got == want and 0 < first < len(got)
    for name in ("stateStore.providerClass", "noDataMicroBatches.enabled"):
        spark.conf.unset(f"spark.sql.streaming.{name}")
