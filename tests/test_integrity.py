"""Findings, backlog verdicts and judging summaries by hand-made values."""

from pyspark.sql import functions as F

from quorumlake.operators import integrity, lanes, verdicts


def test_timeline_findings(spark):
    recordings = spark.createDataFrame([("good", 20.0), ("bad", 20.0), ("none", 5.0), ("unknown", None)], "uid string, served double")
    seg = "uid string, i int, kind string, source_id string, served_start double, served_end double, source_start double, source_end double"
    segments = spark.createDataFrame([("good", 0, "source", "a", 0.0, 10.05, 5.0, 15.0), ("good", 1, "insert", None, 10.0, 20.0, None, None), ("bad", 0, "source", "a", 1.0, 8.0, -1.0, 6.0), ("bad", 1, "source", "a", 7.0, 12.0, 6.0, 99.0), ("bad", 2, "source", "z", 15.0, 18.0, 6.0, 99.0), ("unknown", 0, "source", "a", 0.0, 3.0, 0.0, 3.0)], seg)
    sources = spark.createDataFrame([("good", "a", 30.0), ("bad", "a", 30.0), ("bad", "z", None)], "uid string, source_id string, duration double")
    chapters = spark.createDataFrame([("good", 0, 20.05), ("bad", 0, 21.0), ("bad", 1, -0.5), ("unknown", 0, 900.0)], "uid string, i int, start double")
    got = {tuple(r) for r in integrity.timeline_findings(recordings, segments, sources, chapters).select("uid", "code", "at", "severity").collect()}
    error = lambda code, at: ("bad", f"timeline-{code}", at, "error")
    assert got == {error("gap-start", 0), error("overlap", 1), error("gap", 2), error("duration-mismatch", None), error("short-coverage", None), error("source-underrun", 0), error("source-overrun", 1), ("none", "timeline-empty", None, "error"), ("bad", "timeline-chapter-out-of-range", 0, "warn"), ("bad", "timeline-chapter-out-of-range", 1, "warn")}


def test_backlogs(spark):
    day = lambda v, backlogs, ran, ready=0, limited=0: [(v, f"2026-01-{i + 1:02d}", b, ran, ready, limited) for i, b in enumerate(backlogs)]
    rows = [*day("few", [5, 5], 1), *day("grows", [10, 20, 30, 40], 1, 0, 20), *day("ready", [10, 20, 30, 40], 1, 3, 20), *day("drains", [40, 30, 20, 10], 1), *day("flat", [100, 100, 100, 100], 2, 0, 10), *day("idle", [0, 0, 0, 0], 0)]
    df = spark.createDataFrame(rows, "verb string, day string, backlog long, ran long, ready long, limited long")
    got = {r["verb"]: tuple(r)[1:] for r in integrity.backlog_verdicts(df, ["verb"], 3, 1.0, 0.05, 14.0, F.lit(True)).collect()}
    assert got["few"] == (2, 5, None, None, "insufficient_data", None, None, False, None)
    assert got["grows"] == (4, 40, 10.0, 25.0, "growing", 1.0, 40.0, True, "raise_ingress_quota") and got["ready"][-2:] == (False, None)
    assert got["drains"] == (4, 10, -10.0, 25.0, "shrinking", 1.0, 10.0, False, None) and got["flat"] == (4, 100, 0.0, 100.0, "flat", 2.0, 50.0, True, "add_route_capacity")
    assert got["idle"][-4:] == (0.0, None, False, None)


JUDGED = "seq long, subject string, task string, question string, tier string, role string, model string, sample string, kind string, said boolean, quote_valid boolean"


def test_judging(spark):
    rows = [
        (1, "s", "t", "q", "T1", "anchor", "A", "routine", "validate", True, None), (2, "s", "t", "q", "T1", "sibling", "A2", "routine", "validate", False, True), (3, "s", "t", "q", "T1", "sibling", "B", "routine", "validate", True, False),
        (4, "s", "t", "q", "T1", "sibling", "C", "routine", "validate", False, None), (5, "s", "t", "q_s", "T1", "sibling", "B", "stability", "validate", False, True), (6, "s", "t", "q", "T2", "anchor", "A", "escalation", "validate", None, None),
        (7, "p", "t", "q", "T1", "adjudicator", "D", "routine", "validate", True, False), (8, "p", "t", "q", "T1", "adjudicator", "D", "routine", "validate", False, True), (9, "x", "t", "q", "T1", "anchor", "A", "routine", "rate", True, None),
    ]
    df = spark.createDataFrame(rows, JUDGED)
    families = spark.createDataFrame([("A", "f"), ("A2", "f")], "model string, family string")
    assert [tuple(r) for r in verdicts.agreement(df, families).collect()] == [("A", "t", "q", "T1", 1, 1, 1.0)]
    assert {(r["role"], r["model"]): tuple(r)[2:] for r in verdicts.quote_counts(df).collect()} == {("sibling", "A2"): (1, 0, 0), ("sibling", "B"): (1, 1, 0), ("sibling", "C"): (0, 0, 1), ("adjudicator", "D"): (1, 1, 0)}
    assert [tuple(r) for r in verdicts.escalation(df, "T1").collect()] == [("A", 1, 2)]
    assert [tuple(r) for r in verdicts.stability(df).collect()] == [("B", 1, 1)]
    truths = spark.createDataFrame([("p", False)], "subject string, truth boolean")
    assert {r["model"]: tuple(r)[1:] for r in verdicts.probe_results(df.where("subject = 'p'"), truths).collect()} == {"D": (2, 1, 1, 1)}


def test_lanes(spark):
    rows = [("c", "live", True, 3, 2), ("c", "live2", True, 1, 2), ("c", "a", False, 2, 4), ("c", "b", False, 1, 1), ("c", "idle", False, 0, 9), ("d", "none", False, 0, 1)]
    df = spark.createDataFrame(rows, "k string, lane string, live boolean, ratio int, units int")
    got = {r["lane"]: tuple(r)[5:] for r in lanes.reservations(df, ["k"], 10, 200.0, 50.0, 2.0, 1.0, 3).collect()}
    # live: 7 and 2 jobs at 5 rows; 105 rows are left for weights 2 x 9 and 1 x 3, so 5 jobs a ratio
    assert got == {"live": (7, 14, 63, 21), "live2": (2, 4, 63, 6), "a": (10, 40, 63, 30), "b": (5, 5, 63, 15), "idle": (0, 0, 63, 30), "none": (None, None, None, None)}
