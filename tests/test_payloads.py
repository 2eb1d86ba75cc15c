"""Payloads, records and judgments by hand-made values."""

import hashlib
import json

from pyspark.sql import functions as F

from quorumlake.operators import judging
from quorumlake.sources import payloads


def one(spark, payload):
    return spark.createDataFrame([(1, payload), (2, "{broken"), (3, None)], "k long, p string")


def test_events(spark):
    event = {"id": 7, "eventName": "Council", "startDateTime": "2026-05-19T16:00:00Z", "categoryId": 26, "categoryName": " City Council ", "hasMedia": True, "mediaSourcePathMp4": "https://cdn/x.mp4", "publishedFiles": [{"type": "Agenda", "url": "https://a"}]}
    p = one(spark, json.dumps({"value": [event, {**event, "id": 8, "mediaSourcePathMp4": "stream/x"}, {**event, "id": 9, "hasMedia": False}, {**event, "id": 10, "categoryId": 3}, {**event, "id": 11, "startDateTime": "soon"}]}))
    assert [(r["guid"], r["body"], r["links"]) for r in payloads.event_episodes(p, "k", "p", 26).collect()] == [("7", "City Council", {"agenda": "https://a"})]
    assert payloads.event_agendas(p, "k", "p", 26).count() == 3


def test_marks(spark):
    player = [[{"text": "Agenda:1", "time": "30", "title": "A<br />one &amp; two"}, {"text": "Agenda:2", "time": 30, "title": "later"}, {"text": "Rollcall:", "time": 5, "title": "x"}, {"text": "Agenda:3", "time": "x", "title": "y"}, {"text": "Agenda:4", "time": 9, "title": "first"}]]
    got = payloads.player_chapters(one(spark, json.dumps(player)), "k", "p").orderBy("start").collect()
    assert [(r["start"], r["title"]) for r in got] == [(9, "first"), (30, "A one & two")]
    media = {"eventBookmarks": [{"markerTimeStart": 0, "markerTitle": "label"}, {"markerTimeStart": 12, "markerTitle": "", "markerName": "named"}, {"markerTimeStart": 12, "markerTitle": "again"}], "closedCaptionUrl": " https://c "}
    df = one(spark, json.dumps(media))
    assert [(r["start"], r["title"]) for r in payloads.bookmarks(df, "k", "p").collect()] == [(12, "named")]
    assert [r[0] for r in df.orderBy("k").select(payloads.transcript_url(F.col("p"))).collect()] == ["https://c", None, None]
    page = '<a class="playerControl" data-ts="40" data-end-ts="60" data-title="Budget &amp; tax"> <a class="playerControl" data-ts="x" data-title="no"> <a data-ts="1" data-title="other">'
    assert [tuple(r) for r in payloads.page_chapters(one(spark, page), "k", "p").collect()] == [(1, 40, 60, "Budget & tax")]


def test_archive_and_calendar(spark):
    row = {"dateTime": "2026-05-19 16:00:00", "title": "Council", "documentList": [{"templateName": "Agenda Packet", "templateId": "5"}, {"templateName": "Agenda", "templateId": "6"}, {"templateName": "Agenda", "templateId": "7"}, {"templateName": "Photo", "templateId": "8"}]}
    for payload in ([row, {**row, "title": ""}], {"data": [row]}, {"items": [row]}):
        got = payloads.archived_meetings(one(spark, json.dumps(payload)), "k", "p", "https://x/").collect()
        assert [r["links"] for r in got] == [{"agenda_packet": "https://x/Portal/Meeting?compiledId=5", "agenda": "https://x/Portal/Meeting?compiledId=6"}]
    rows = spark.createDataFrame([("u", "Board", None, "2026-05-19T10:00:00+00:00", None, "", None), ("", "Board", None, "2026-05-19", None, None, None), ("v", "Board", "t", "nonsense", None, None, None)], "uid string, body string, title string, published string, links map<string,string>, video_guid string, video_url string")
    assert [(r["uid"], r["title"], r["links"], r["video_guid"]) for r in payloads.calendar_rows(rows).collect()] == [("u", "Board Meeting", {}, None)]


def test_words(spark):
    side = {"segments": [{"words": [{"w": " a ", "s": 0, "e": 0.5}, {"w": "", "s": 1, "e": 2}, {"w": "b", "s": 1}]}, {"words": None}, {"words": [{"w": "c", "s": 2, "e": 3.5}]}]}
    words = payloads.word_rows(one(spark, json.dumps(side)), "k", "p")
    assert [tuple(r)[1:] for r in words.orderBy("seq").collect()] == [(0, "a", 0.0, 0.5), (1, "c", 2.0, 3.5)]
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "x"), (9, 4, 2.0, 3.0, "y")], "k long, seq long, start double, end double, text string")
    assert {(r["k"], r["unit"], r["text"], r["basis"]) for r in payloads.locator_units(words, cues, "k", 2).collect()} == {(1, 0, "a c", "words"), (9, 0, "y", "cues")}


def test_records_there_and_back(spark):
    old = {"uid": "u1", "provider_guid": "g", "title": "T", "published": "2026-05-19T10:00:00Z", "body": "B", "duration": 61.5, "audio": {"url": "https://a", "attempts": 2}}
    new = {**old, "uid": "u2", "schema_version": 2, "sources": [{"id": "s0", "duration": 70.0}], "chapters": [{"start": 1.0, "title": "c"}], "transcript": {"key": "t", "synced": True}, "links": {"agenda": "https://x"}}
    df = spark.createDataFrame([(json.dumps(old),), (json.dumps(new),), ("{broken",), ("{}",)], "p string")
    flat = payloads.decoded_records(df, "p")
    rows = {r["uid"]: r for r in flat.collect()}
    assert set(rows) == {"u1", "u2"} and rows["u1"]["duration_source"] == 61.5 and rows["u2"]["duration_source"] == 70.0 and rows["u1"]["chapters_basis"] == "source:s0" and rows["u1"]["media_kind"] == "direct"
    back = payloads.encoded_records(flat)
    assert {r["uid"]: r for r in payloads.decoded_records(back, "record").collect()} == rows
    assert "transcript" not in json.loads(back.where("uid = 'u1'").first()["record"])


def test_feed_problems(spark):
    good = "<?xml version='1.0'?><rss><channel><title>t</title><link>l</link><description>d</description><item><title>a</title><guid>1</guid><pubDate>x</pubDate></item></channel></rss>"
    df = spark.createDataFrame([(1, good), (2, good.replace("<guid>1</guid>", "")), (3, "<html/>")], "k long, x string")
    got = {}
    for r in payloads.feed_problems(df, "k", "x").collect():
        got.setdefault(r["k"], set()).add(r["problem"])
    assert got == {2: {"items without guid"}, 3: {"no rss", "no channel", "no items"}}


def test_judges(spark):
    rows = [("s", "m", "q", "t", "sibling", "routine", True, True), ("s", "m", "q_s", "t", "sibling", "stability", False, True), ("s", "n", "q", "t", "adjudicator", "routine", True, False)]
    df = spark.createDataFrame(rows, "subject string, model string, question string, tier string, role string, sample string, said boolean, quote_valid boolean")
    assert {r["model"]: (round(r["noise"], 6), r["n"]) for r in judging.judge_noise(df).collect()} == {"m": (round(1 / 3, 6), 3), "n": (1.0, 1)}
    seen = spark.createDataFrame([("a", "sibling", "2026-01-01"), ("b", "sibling", "2026-02-20"), ("c", "audit", "2026-02-25"), ("b", "sibling", "2026-02-26")], "model string, role string, judged_at string")
    assert [r[0] for r in judging.newest_judge(seen, "2026-03-01").collect()] == ["b"] and judging.newest_judge(seen, "2026-04-01").count() == 0
    said = spark.createDataFrame([("t", "s", "q", "audit", True, "2026-02-20"), ("t", "s", "q", "adjudicator", True, "2026-02-01"), ("t", "s", "q", "adjudicator", False, "2026-02-02"), ("t", "s2", "q", "audit", True, "2025-01-01")], "task string, subject string, question string, role string, said boolean, judged_at string")
    assert [tuple(r) for r in judging.disagreements(said, "2026-02-01").collect()] == [("t", 1)]


def test_hash_samples(spark):
    keys = [f"sample-{i}" for i in range(20)]
    got = {r["k"]: r for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", judging.sample_window(F.col("k"), F.lit(100.5), 30).alias("w"), judging.is_swapped(F.col("k")).alias("x")).collect()}
    for k in keys:
        h = int(hashlib.sha1(k.encode()).hexdigest(), 16)
        assert (got[k]["w"]["start"], got[k]["w"]["end"], got[k]["x"]) == (h % 71, h % 71 + 30, bool(h % 2))
    names = ["litellm:gemini/flash", "gemini/flash", "a/b:c"]
    assert [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(judging.logical_model(F.col("n"), {"gemini/flash": "flash"})).collect()] == ["flash", "flash", "a/b:c"]


def test_links_to_chapters(spark):
    links = spark.createDataFrame([(1, 1, "Backup PD20-25", "https://x/1"), (1, 2, "PD20-2 map", "https://x/2"), (1, 3, "the  Budget Hearing file", "https://x/3"), (1, 4, None, "https://x/4")], "k long, link_id long, label string, url string")
    chapters = spark.createDataFrame([(1, 0, "Zoning Case PD20-25"), (1, 1, "Zoning Case PD20-2"), (1, 2, "Budget hearing")], "k long, chapter long, title string")
    got = {r["link_id"]: r["chapter"] for r in judging.chapter_of_links(links, chapters, ["k"], r"[A-Z]{1,4}\d{2}-\d+").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None}
    pairs = spark.createDataFrame([(0, "Approve the minutes", "2. approve the minutes!"), (1, "abc", "abd"), (2, None, "x")], "i int, a string, b string").orderBy("i")
    assert [round(r[0], 4) for r in pairs.select(judging.title_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6667, 0.0]
    assert [round(r[0], 4) for r in pairs.select(judging.text_similarity(F.col("a"), F.col("b"), 0.9, 50)).collect()] == [0.9048, 0.6667, 0.0]


def test_turns_and_phrases(spark):
    gold = spark.createDataFrame([(1, 0.0, 10.0, "A"), (1, 10.0, 20.0, "B")], "k long, start double, end double, speaker string")
    said = spark.createDataFrame([(1, 0.5, 12.0, "x"), (1, 12.0, 20.0, "y")], "k long, start double, end double, cluster string")
    mapping = spark.createDataFrame([(1, "x", "A"), (1, "y", "B")], "k long, cluster string, speaker string")
    r = judging.turn_metrics(gold, said, mapping, ["k"], 1.0).first()
    assert (round(r["accuracy"], 6), r["boundary_recall"]) == (round(17.5 / 19.5, 6), 0.5)
    docs = spark.createDataFrame([(1, "Bike lane and BIKE  lanes, bike lane", "no parking")], "k long, agenda string, spoken string")
    got = {tuple(x)[1:] for x in judging.phrase_audit(docs, "k", ["agenda", "spoken"], [("bikes", ["bike lane"], ["parking"])]).select("k", "tag", "kind", "phrase", "field", "n").collect()}
    assert got == {("bikes", "include", "bike lane", "agenda", 2), ("bikes", "exclude", "parking", "spoken", 1)}
    parts = judging.chapter_texts(spark.createDataFrame([(1, 0, 0.0, "a"), (1, 1, 5.0, "b"), (1, 2, 9.0, "c")], "k long, seq long, start double, text string"), spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, None)], "k long, chapter long, start double, end double"), ["k"])
    assert {r["chapter"]: r["text"] for r in parts.collect()} == {0: "a", 1: "b c"}
    assert {tuple(r) for r in judging.unique_matches(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("d", "w")], "l string, r string"), "l", "r").collect()} == {("a", "x")}
    assert judging.upper_median(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (1, None)], "k long, v double"), ["k"], "v").first()["median"] == 3.0
