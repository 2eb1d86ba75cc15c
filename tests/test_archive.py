"""Operators of the archive by hand-made values."""

import datetime

from pyspark.sql import functions as F

from quorumlake.functions import quotes
from quorumlake.operators import bodies, limits, normalize, rank, status, timeline, workqueue


def values(spark, texts, fn):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k").select(fn(F.col("t"))).collect()]


def test_all_records_are_counted_once(spark, tmp_path):
    """Records of all line numbers, also those of several rows: of these the one published first, whatever their order."""
    from quorumlake.plans import archive

    day = lambda d: datetime.datetime(2020, 1, d)
    rows = [(1, 4, 3, 1, 60.0, 2e6, "N", day(1)), (1, 8, 6, 3, 60.0, 4e6, "N", day(2)), (1, 5, 6, 3, 60.0, 8e6, "N", day(3)), (2, 4, 3, 1, 60.0, 1e6, "N", day(5)), (2, 4, 3, 1, 60.0, 1e6, "N", day(5)), (2, 4, 3, 1, 60.0, 9e6, "N", day(5)), (3, 9, 6, 7, 60.0, 1e6, "A", day(4)), (None, 11, 3, 2, 60.0, 1e6, "R", day(4))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
    told = []
    for n, own in enumerate((rows, rows[::-1])):
        spark.createDataFrame(own, schema).repartition(3).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        told.append(archive.source_status(spark, f"{tmp_path}/{n}").first().asDict())
    assert told[0] == told[1]
    assert {k: told[0][k] for k in ("episodes", "hosted", "served", "stale", "pending", "gb_stored", "last_published")} == {"episodes": 5, "hosted": 3, "served": 2, "stale": 1, "pending": 1, "gb_stored": 7.0, "last_published": "2020-01-05"}


def test_names_of_bodies(spark):
    assert values(spark, ["City Council on 2026-05-19 4:00 PM", "ZONING COMMISSION", "Evening City Council - Regular Session", "Special"], bodies.canonical_body) == ["City Council", "Zoning Commission", "City Council", "Special"]
    assert values(spark, ["City Council on 2026-05-19 4:00 PM - May 19, 2026", "Board of Adjustment - May 20, 2026", "City Council Worksession 5-26-26 - May 26, 2026", " - "], bodies.titled_body) == ["City Council", "Board of Adjustment", "City Council Worksession", None]


def test_selectors(spark):
    names = ["Purchasing Bids 7-16-2015", "City Council", "City Council City Council City Council City Council", "Joint City Council", "City Council Retreat", None]
    hit = lambda *a, **k: values(spark, names, lambda c: bodies.matches(c, *a, **k))
    assert hit(("purchasing bid*",)) == [True, False, False, False, False, False]
    assert hit(("city councils",)) == [False, True, True, True, True, False]
    assert hit((), ("City Councils",)) == [False, True, True, False, False, False]
    assert hit() == [False] * 6


def test_dates_in_titles(spark):
    got = values(spark, ["Council, May 19, 2026", "May 1, 2026 and May 2 2026", "February 31, 2026", "5-19-26"], bodies.title_date)
    assert got == [datetime.date(2026, 5, 19), None, None, None]


def test_spoken_text(spark):
    got = values(spark, ["[music]\nMAYOR SMITH: Good evening.\nROLL CALL\n00:01:02 So moved", "[applause] 00:10", "ROLL CALL", None], bodies.spoken_text)
    assert got == ["Good evening. So moved", "", "ROLL CALL", ""]


def test_backoff_and_lines(spark):
    assert values(spark, ["0", "1", "2", "5", "90"], lambda c: normalize.capped_backoff(F.lit(60.0), 600, c.cast("int"))) == [0, 60, 120, 600, 600]
    assert values(spark, ["1"], lambda c: normalize.capped_backoff(F.lit(900.0), 600, c.cast("int"))) == [600]
    assert values(spark, ["a\na", "a\n A \na  \n\nb", None], normalize.repeated_line_ratio) == [0.0, 0.5, 0.0]


def test_states(spark):
    rows = [("u", "legacy", None, "hls", False), ("u", "x", None, "hls", False), ("u", "w", None, "hls", False), (None, None, None, "direct", False), ("", None, "deferred", "direct", True), (None, None, "dead", "hls", False), (None, None, "404", "hls", False), (None, None, None, "hls", False), (None, None, None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, url string, spec string, error string, kind string, host boolean").orderBy("k")
    got = [r[0] for r in df.select(status.state_of(F.col("url"), F.col("spec"), F.lit("w"), F.col("error"), F.col("kind"), F.col("host"))).collect()]
    assert got == ["served", "stale", "served", "linked_video", "deferred", "dead", "transient_error", "pending", "linked_video"]


def test_staleness(spark):
    day = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)
    rows = [("weekly", day(7 * i)) for i in range(5)] + [("few", day(i)) for i in range(3)] + [("monthly", day(30 * i - 90)) for i in range(4)]
    got = {r["f"]: r["stale"] for r in rank.cadence(spark.createDataFrame(rows, "f string, at timestamp"), ["f"], "at", "2026-03-20").collect()}
    assert got == {"weekly": True, "few": False, "monthly": False}


def test_logs(spark):
    log = "[a] silence_start: 0\n[a] silence_end: 2.347 | silence_duration: 2.347\nsilence_end: 9\nsilence_start: 12.5\nsilence_end: 14\n"
    got = timeline.marked_intervals(spark.createDataFrame([(1, log), (2, None)], "k long, t string"), "k", "t", "silence_start", "silence_end").orderBy("seq").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0.0, 2.347), (12.5, 14.0)]
    still = spark.createDataFrame([(1, "freeze_start: 3 freeze_end: 2 freeze_start: 5 freeze_end: 8 freeze_start: 9", 11.0), (2, "freeze_start: 9", None)], "k long, t string, d double")
    assert [(r["start"], r["end"]) for r in timeline.freeze_intervals(still, "k", "t", "d").orderBy("k", "seq").collect()] == [(5.0, 8.0), (9.0, 11.0)]


def test_quotes(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 4.0, "We must   act"), (1, 1, 4.0, 6.0, ""), (1, 2, 6.0, 9.0, "now, on HOUSING."), (1, 3, 9.0, 12.0, "we must act")], "k long, seq long, start double, end double, text string")
    spoken = ["We", "must", "act", "now,", "on", "housing.", "We", "must", "act"]
    words = spark.createDataFrame([(1, i, w, float(i), i + 0.5) for i, w in enumerate(spoken)], "k long, seq long, text string, start double, end double")
    asked = spark.createDataFrame([(1, 1, "act NOW, on"), (1, 2, "not there"), (1, 3, "we must act"), (1, 4, "")], "k long, quote_id long, quote string")
    got = {r["quote_id"]: tuple(r)[2:] for r in quotes.quote_timing(asked, segments, words, ["k"]).collect()}
    assert got == {1: (2.0, 4.5, "words"), 3: (0.0, 2.5, "words")}
    spans = {r["seq"]: r["span_start"] for r in quotes.title_spans(spark.createDataFrame([(1, "Intro. Parks plan; roads; Parks plan again")], "k long, text string"), spark.createDataFrame([(1, 0, "Roads"), (1, 1, "Parks  plan"), (1, 2, "absent")], "k long, seq long, title string"), ["k"]).collect()}
    assert spans == {0: 20, 1: 27, 2: None}
    assert values(spark, ["x y Roads then", "none"], lambda c: quotes.without_preamble(c, F.array(F.lit("roads"), F.lit("then")))) == ["Roads then", "none"]


def test_payment_pauses(spark):
    sunday = datetime.date(2026, 5, 31)
    rows = spark.createDataFrame([(s, sunday) for s in (0, 1, 2, 3, 9)], "s int, d date").orderBy("s")
    got = [r[0].isoformat() for r in rows.select(limits.payment_backoff(F.col("s"), F.col("d"))).collect()]
    assert got == ["2026-06-01", "2026-06-01", "2026-06-08", "2026-06-09", "2026-06-09"]


def test_runs_and_chapters(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate([0, 1, 3, 255, 254, 0])], "k long, i long, h long")
    assert [r["run"] for r in timeline.runs_of_same(df, ["k"], ["i"], "h", 2).orderBy("i").collect()] == [1, 1, 1, 2, 2, 3]
    chapters = F.array(F.struct(F.lit(9.0).alias("start"), F.lit("b").alias("title")), F.struct(F.lit(1.5).alias("start"), F.lit("a").alias("title")))
    assert spark.range(1).select(workqueue.chapters_json(chapters)).first()[0] == '{"version":"1.2.0","chapters":[{"startTime":1.5,"title":"a"},{"startTime":9.0,"title":"b"}]}'
