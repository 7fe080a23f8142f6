"""A stream of evidence rows gives the edges of a batch."""

import datetime as dt


def test_windowed_edges(spark, tmp_path):
    from tessera.streaming import windowed_edges

    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t + dt.timedelta(minutes=7 * i), f"n{i % 3}", f"n{i % 4}", "type" if i % 2 else "call", 1.0 + i % 2) for i in range(60)]
    batch = spark.createDataFrame(rows, "ts timestamp, source string, target string, dependency_type string, weight double")
    batch.write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, windowed_edges(batch).collect()))
    stream = windowed_edges(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("edges").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM edges").collect())) == want and want
