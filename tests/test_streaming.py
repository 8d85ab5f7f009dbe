from helixframe.streaming.coverage import windowed_coverage

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = windowed_coverage(stream).writeStream.outputMode("complete").format("memory").queryName("cov").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("cov").collect())) == sorted(map(tuple, windowed_coverage(batch).collect()))
