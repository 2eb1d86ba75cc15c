"""Operators without SQL against plain Python, and edge cases."""

import heapq

from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators import intervals, ledger, merge, packing
from quorumlake.sources import readers
from quorumlake.streaming import streams


def test_shards_are_greedy(spark):
    rows = [("a", i, float((i * 37) % 11)) for i in range(40)]
    got = {r["k"]: r["shard"] for r in packing.assign_shards(spark.createDataFrame(rows, "g string, k long, w double"), "g", "k", "w", 3).collect()}
    heap, want = [(0.0, 0, s) for s in range(3)], {}
    for _, k, w in sorted(rows, key=lambda r: (-r[2], r[1])):
        load, n, s = heapq.heappop(heap)
        want[k] = s
        heapq.heappush(heap, (load + w, n + 1, s))
    assert got == want


def test_packs_keep_order_and_ceiling(spark):
    rows = [("a", i, n) for i, n in enumerate([5, 5, 1, 30, 2, 9, 1])]
    got = packing.pack_in_order(spark.createDataFrame(rows, "g string, k long, n long"), "g", ["k"], "n", 10).orderBy("k").collect()
    assert [r["pack"] for r in got] == [0, 0, 1, 2, 3, 4, 4]


def test_greedy_matches(spark):
    rows = [("a", 1, 1, 0.9), ("a", 1, 2, 0.8), ("a", 2, 1, 0.85), ("a", 2, 2, 0.1)]
    got = packing.greedy_matches(spark.createDataFrame(rows, "g string, l long, r long, s double"), "g", "l", "r", "s")
    assert {(r["l"], r["r"]) for r in got.collect()} == {(1, 1), (2, 2)}


def test_token_bucket(spark):
    rows = [("a", 0.0, 1, 6.0), ("a", 1.0, 2, 6.0), ("a", 4.0, 3, 6.0)]
    got = ledger.token_bucket(spark.createDataFrame(rows, "g string, at double, o long, c double"), ["g"], F.col("at"), "o", F.col("c"), 10.0, 1.0).first()
    assert (got["admitted"], got["refused"], got["level"]) == (2, 1, 2.0)


def test_ambiguous_keys_match_nothing(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a long, b string")
    right = spark.createDataFrame([(1, "q", "one"), (9, "y", "two"), (8, "x", "three"), (7, "x", "four")], "a long, b string, v string")
    got = {r["a"]: (r["v"], r["by"]) for r in merge.attach_by_priority(left, right, [["a"], ["b"]], "v").collect()}
    assert got == {1: ("one", 1), 2: ("two", 2), 3: (None, None)}


def test_empty_intervals(spark):
    none = spark.createDataFrame([], "g long, a double, b double")
    assert intervals.covered(none, ["g"], "a", "b").count() == 0


def test_cues(spark):
    vtt = "WEBVTT\n\n00:01.500 --> 00:02.000\nhello\nthere\n\n1:00:00.000 --> 1:00:01.000 align:left\nbye"
    got = spark.createDataFrame([(1, vtt), (2, None), (3, "")], "k long, t string")
    rows = readers.timed_texts(got, "k", "t").orderBy("seq").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(1.5, 2.0, "hello\nthere"), (3600.0, 3601.0, "bye")]


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>").select(tx.cosine(F.col("a"), F.col("b")), tx.cosine(F.col("a"), F.col("c"))).first()
    assert abs(row[0] - 0.5**0.5) < 1e-12 and row[1] == -1


def test_record_store_and_logs(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"schema_version": 2, "episodes": {"u1": {"title": "a"}, "u2": {"title": null}}}')
    schema = spark.createDataFrame([], "title string").schema
    assert {r["uid"] for r in readers.record_store(spark, str(tmp_path / "s.json"), schema).collect()} == {"u1", "u2"}
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-02", "n": 1}\nbroken\n{"ts": "2023-01-01", "n": 2}\n')
    assert [r["n"] for r in readers.event_log(spark, str(tmp_path / "log.jsonl"), "ts string, n long", "2024").collect()] == [1]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>a</title><guid>1</guid></item><item><title>b</title><guid>2</guid></item></channel></rss>")
    assert readers.feed_items(spark, str(tmp_path / "f.xml"), "title string, guid string").count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 3, False), (1, 4, True)], "k long, o long, bad boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streams.event_stream(spark, str(tmp_path / "in"), "k long, o long, bad boolean")
    query = streams.failure_streaks(events, "k", "o", "bad").writeStream.format("memory").queryName("streaks").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["k"], r["fails"], r["seen"]) for r in spark.sql("SELECT * FROM streaks").collect()} == {(1, 3, 3), (2, 0, 1)}


def test_windows_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, 'x' AS kind FROM range(30)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streams.event_stream(spark, str(tmp_path / "in"), "ts timestamp, kind string")
    query = streams.windowed_counts(events, "ts", ["kind"], "10 minutes", "10 minutes", "0 minutes").writeStream.format("memory").queryName("counts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r["n"] for r in spark.sql("SELECT * FROM counts ORDER BY start").collect()] == [10, 10]
