"""Minutes, slides, rosters and route health by values made by hand."""

from pyspark.sql import functions as F

from quorumlake.operators import audit, limits, minutes, normalize, timeline
from quorumlake.sources.readers import dated_archive_links, page_outlines


def roster(spark, text):
    rows = minutes.roster_rows(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text").orderBy("line", "pos").collect()
    return [(r["name"], r["section"]) for r in rows]


def test_rosters(spark):
    for junk in ("Present: a quorum of the Council was established at 6:02 p.m.", "Present: 7", "Members Present: Jane Doe Bob Chair Ann Lee", "MEMBERS PRESENT: J4ne D0e, ., B", "Present: Yes.  Absent: None", "Others Present: Random Citizen", "ALSO PRESENT: City Manager, City Attorney", "", None):
        assert roster(spark, junk) == [], junk
    assert roster(spark, "PRESENT: Mayor Gerard Hudspeth, Council Member Vicki Byrd, Mayor Pro Tem Brian Beck") == [("Gerard Hudspeth", None), ("Vicki Byrd", None), ("Brian Beck", None)]
    assert roster(spark, "MEMBERS PRESENT: Jane Doe\nCity Staff Present: Matt Bodine\nStaff Members Present: Sam Staffer") == [("Jane Doe", "members"), ("Matt Bodine", "staff"), ("Sam Staffer", "staff")]
    assert roster(spark, "Also Present: Interim Assistant City Manager Jane Doe") == [("Jane Doe", "staff")]
    assert roster(spark, "Present: Mark Manager") == [("Mark Manager", None)]


def test_votes(spark):
    text = "3. Budget\nPresent: Alice Smith, Bob Jones\nVote: Yes: Alice Smith, Carol Outsider; No: Bob Jones\r\nItem 4a) Parks\nAlice Smith - yes\nMotion: Alice Smith - abstained"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    said = minutes.vote_rows(df, "k", "text").collect()
    assert {(r["agenda_item"], r["member"], r["value"]) for r in said} == {("Budget", "Alice Smith", "yes"), ("Budget", "Carol Outsider", "yes"), ("Budget", "Bob Jones", "no"), ("Parks", "Alice Smith", "abstain")}
    known = minutes.roster_rows(df, "k", "text").select("k", "name")
    assert {(r["member"], r["value"]) for r in minutes.vote_rows(df, "k", "text", known).collect()} == {("Alice Smith", "yes"), ("Bob Jones", "no"), ("Alice Smith", "abstain")}


def test_first_meeting_is_never_disjoint(spark):
    rows = [("f", 1, "2026-01-01", "ok@2", ["Ann  Lee"]), ("f", 2, "2026-01-02", "ok@2", ["ANN LEE", "Bo"]), ("f", 3, "2026-01-03", "ok@2", ["Cy"]), ("f", 4, "2026-01-04", "ok", ["cy"]), ("g", 5, "2026-01-01", "ok", ["Ann Lee"]), ("g", 6, None, "empty", None), ("g", 7, "2026-01-01", None, ["Z"])]
    df = spark.createDataFrame(rows, "feed string, uid int, day string, status string, members array<string>")
    got = audit.doubtful_rosters(df, ["feed"], "uid", "day", "status", "members", "2026-01-05 00:00:00").collect()
    assert [(r["feed"], r["disjoint"], r["empty"], r["considered"]) for r in got] == [("f", 1, 0, 4)]


def test_slides_keep_their_own_hash(spark):
    rows = [("e", "s", 0.0, 10.0, 0), ("e", "s", 20.0, 30.0, 63), ("e", "s", 40.0, 50.0, 63 << 6), ("e", "s", 90.0, 95.0, 63 << 6), ("e", "t", 96.0, 99.0, 63 << 6)]
    df = spark.createDataFrame(rows, "k string, src string, a double, b double, h long")
    got = timeline.selected_slides(df, ["k"], "src", "a", "b", "h", recurring=6).orderBy("source", "start").collect()
    # the second and third are both near the first one's hash, though not near each other
    assert [(r["source"], r["start"], r["end"], r["hash"]) for r in got] == [("s", 0.0, 50.0, 0), ("s", 90.0, 95.0, 63 << 6), ("t", 96.0, 99.0, 63 << 6)]
    often = timeline.selected_slides(df, ["k"], "src", "a", "b", "h", recurring=4)
    assert [(r["start"], r["end"]) for r in often.collect()] == [(20.0, 30.0)]


def test_half_open_probe(spark):
    rows = [("r", 0, 0, "timeout"), ("r", 30, 10, "timeout"), ("r", 70, 65, "timeout"), ("r", 80, 20, "defect"), ("s", 5, 5, "timeout"), ("s", 6, 6, "success"), ("s", 7, 7, "capacity"), ("u", 1, 1, "other")]
    df = spark.createDataFrame(rows, "route string, at long, began long, what string")
    got = {r["route"]: (r["rung"], r["until"], r["class"], r["timeout"], r["capacity"], r["defect"]) for r in limits.health_ladder(df, ["route"], "at", "began", "what", {"timeout": 1, "capacity": 2, "defect": 3}, [60, 300, 900, 3600]).collect()}
    assert got == {"r": (2, 370, "timeout", 3, 0, 1), "s": (0, 0, "", 0, 1, 0), "u": (0, 0, "", 0, 0, 0)}


def test_pages(spark):
    html = '<h1>City <b>Council</b></h1><nav><h2>Menu</h2></nav><a class="x Agenda" href="/a">Item One</a><h3>item  one</h3><h2>No</h2><h3>Parks &amp; Trees</h3><a href="Archive.aspx?ADID=5">Minutes <i>May 05, 2026</i></a><a href="/Archive.aspx?x=1&amp;ADID=6">Agenda 5-6-2026</a><a href="?ADID=7">undated</a><a href="/b">May 5, 2026</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "k int, html string")
    assert [(r["level"], r["title"]) for r in page_outlines(df, "k", "html").orderBy("k", "seq").collect()] == [(1, "City Council"), (2, "Item One"), (3, "Parks & Trees")]
    links = dated_archive_links(df, "k", "html", "https://town.org/dir/list.aspx?q=1").orderBy("seq").collect()
    assert [(r["title"], str(r["day"]), r["url"]) for r in links] == [("Minutes May 05, 2026", "2026-05-05", "https://town.org/dir/Archive.aspx?ADID=5"), ("Agenda 5-6-2026", "2026-05-06", "https://town.org/Archive.aspx?x=1&ADID=6")]


def test_feed_hash_sees_each_change(spark):
    df = spark.createDataFrame([("f", "b", "x"), ("f", "a", None)], "k string, uid string, t string")
    mark = lambda d: normalize.feed_hash(d, ["k"], "uid", ["t"], "1").first()["mark"]
    assert mark(df) == mark(df.orderBy("uid")) != mark(df.withColumn("t", F.coalesce("t", F.lit("")))) != mark(df.limit(1))
