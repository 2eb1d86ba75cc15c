"""Sessions of a stream."""

from datetime import datetime, timedelta

from quorumlake.streaming import streams

START = datetime(2026, 1, 1)


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    kind = "k string, ts timestamp"
    for seconds in ([("a", 0), ("b", 3), ("a", 10), ("a", 400)], [("a", 405), ("c", 9000)], [("a", 1), ("c", 9001)]):
        spark.createDataFrame([(k, START + timedelta(seconds=s)) for k, s in seconds], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = streams.event_stream(spark, f"{tmp_path}/in", kind, 1)
    seen = []
    counted = streams.session_counts(events, "ts", ["k"], "60 seconds", "30 seconds")
    query = counted.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    query.awaitTermination(300)
    at = lambda s: START + timedelta(seconds=s)
    # the row that came an hour and a half late is left out
    assert sorted(seen) == [(at(0), at(70), "a", 2), (at(3), at(63), "b", 1), (at(400), at(465), "a", 2)]
