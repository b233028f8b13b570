from datetime import datetime

from tessel.streaming import feed


def test_feed(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    batches = [[("a", at(1), "x"), ("b", at(1), "y")], [("a", at(2), "x"), ("b", at(3), "z"), ("a", at(0), "old")], [("b", at(4), None)]]
    seen = []
    ddl = "path string, ts timestamp, hash string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        q = feed.follow(feed.hash_changes(stream), lambda df: seen.extend((r["path"], r["status"]) for r in df.collect()), f"{tmp_path}/check")
        q.awaitTermination(120)
        assert q.exception() is None, i
    assert sorted(seen) == [("a", "new"), ("b", "changed"), ("b", "deleted"), ("b", "new")]


def test_windows(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    spark.createDataFrame([("v", at(1, 5)), ("v", at(1, 50)), ("v", at(2, 1))], "event_type string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_type string, ts timestamp").parquet(f"{tmp_path}/in")
    q = feed.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
