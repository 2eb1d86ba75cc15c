"""Verdicts about recordings: hand-made cases, and the stream against the batch form and a plain fold."""

import random
from datetime import datetime, timedelta


from quorumlake.operators import availability
from quorumlake.streaming import media

LOG = "k string, at timestamp, n int, kind string, fingerprint string, profile string, state string, reason string"
START = datetime(2026, 1, 1)


def log(cases):
    """Rows of a log from {key: [(kind, fingerprint, state, reason)]}, missing ones null."""
    return [(k, START + timedelta(hours=i), i, *(*r, None, None, None)[:2], f"p{i}" if i % 3 == 0 else None, *(*r, None, None, None)[2:4]) for k, rows in cases.items() for i, r in enumerate(rows)]


CASES = {
    "one silent": [("silent", "f")],
    "two silent": [("silent", "f"), ("silent", "f")],
    "transport alone": [("transport_failed",)],
    "good, then transport": [("playable", "f"), ("transport_failed", "g"), ("playable", "f")],
    "silent, transport": [("silent", "f"), ("transport_failed",)],
    "silent across transport": [("silent", "f"), ("transport_failed",), ("silent", "f")],
    "new bytes": [("silent", "old"), ("silent", "old"), ("silent", "new")],
    "recovers": [("silent", "f"), ("playable", "f")],
    "stays recovered at": [("silent", "f"), ("playable", "f"), ("playable", "f")],
    "new bytes don't recover": [("silent", "f"), ("playable", "g")],
    "dead": [("dead", "f")],
    "absent": [("missing", "f")],
    "override wins": [("silent",), ("silent",), ("override", None, "available", "seen"), ("silent",)],
    "override of nothing": [("override", None, "invalid", "bad")],
    "clear of nothing": [("override",)],
    "bad override": [("override", None, "bogus", "x")],
    "override cleared": [("dead", "f"), ("override", None, "available", "x"), ("override", None, None, "y")],
    "override lost": [("silent", "a"), ("silent", "a"), ("override", None, "available", "good"), ("silent", "b")],
    "withheld by call recovers": [("playable", "f"), ("override", None, "missing", "x"), ("playable", "f")],
    "two partial": [("partial", "f"), ("partial", "f"), ("playable", "f")],
    "partial and silent": [("partial", "f"), ("silent", "f"), ("partial", "f")],
    "unknown kind": [("odd", "f"), ("silent", "f")],
}
WANT = {
    "one silent": ("suspected_empty", True, 1, 0), "two silent": ("confirmed_empty", True, 2, 0), "good, then transport": ("available", False, 0, 0),
    "silent, transport": ("suspected_empty", True, 1, 0), "silent across transport": ("confirmed_empty", True, 2, 0), "new bytes": ("suspected_empty", True, 1, 0), "recovers": ("recovered", False, 0, 0),
    "stays recovered at": ("available", False, 0, 0), "new bytes don't recover": ("available", False, 0, 0), "dead": ("invalid", True, 0, 0), "absent": ("missing", True, 0, 0), "override wins": ("confirmed_empty", False, 3, 0),
    "override of nothing": ("available", True, 0, 0), "override cleared": ("invalid", True, 0, 0), "override lost": ("suspected_empty", True, 1, 0), "withheld by call recovers": ("recovered", True, 0, 0),
    "two partial": ("available", False, 0, 0), "partial and silent": ("suspected_partial", False, 0, 1), "unknown kind": ("suspected_empty", True, 1, 0),
}


def test_verdicts_by_hand(spark):
    got = {r["k"]: r for r in availability.latest_verdicts(spark.createDataFrame(log(CASES), LOG), ["k"], "at", ["n"]).collect()}
    assert {k: (r["state"], r["withheld"], r["silent_confirmations"], r["partial_confirmations"]) for k, r in got.items()} == WANT
    assert got["override lost"]["override"] is None and got["override lost"]["override_reason"] == "" and got["override wins"]["override_reason"] == "seen"
    assert got["good, then transport"]["last_check"] == START + timedelta(hours=2) and got["good, then transport"]["fingerprint"] == "f"
    assert got["stays recovered at"]["recovered_at"] == START + timedelta(hours=1) and got["new bytes don't recover"]["recovered_at"] is None


def random_log(seed, keys=40, length=25):
    rng = random.Random(seed)
    kinds = [*availability.CONTENT, availability.TRANSPORT, availability.OVERRIDE]
    one = lambda: (rng.choice(kinds), rng.choice([None, "", "f", "f", "g"]), rng.choice([None, "available", "missing", "bogus", "confirmed_partial"]), rng.choice([None, "r"]))
    return log({f"k{i}": [one() for _ in range(rng.randrange(0, length))] for i in range(keys)})


FIELDS = ("state", "silent", "partial", "fingerprint", "profile", "override", "override_reason", "recovered_at", "last_check")
COLUMNS = ("state", "silent_confirmations", "partial_confirmations", *FIELDS[3:])


def test_windows_equal_a_fold(spark):
    """After each row, not only after the last."""
    rows, want, held = random_log(3), {}, {}
    for r in rows:
        row = dict(zip(("k", "at", "n", "kind", "fingerprint", "profile", "state", "reason"), r))
        held[row["k"]] = media.after(held.get(row["k"]), row)
        if held[row["k"]] and (row["kind"] != "override" or row["state"] is None or row["state"] in availability.SETTABLE):
            want[row["k"], row["n"]] = tuple(held[row["k"]][c] for c in FIELDS)
    got = {(r["k"], r["n"]): tuple(r[c] for c in COLUMNS) for r in availability.verdicts(spark.createDataFrame(rows, LOG), ["k"], "at", ["n"]).collect()}
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(8)
    frame = spark.createDataFrame(rows, LOG)
    for i in range(3):
        frame.where(f"n % 25 >= {i * 8} and n < {i * 8 + 8 if i < 2 else 99}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        stream = media.verdict_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", ["n"])
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, i: seen.append({r["k"]: r for r in df.collect()})).trigger(availableNow=True).start()
        query.awaitTermination(300)
    finally:
        spark.conf.set(store, before)
    assert len(seen) == 3
    got = {k: r for batch in seen for k, r in batch.items()}
    want = {r["k"]: r for r in availability.latest_verdicts(frame, ["k"], "at", ["n"]).collect()}
    columns = ("effective", "withheld", *COLUMNS[:-1])
    assert {k: tuple(r[c] for c in columns) for k, r in got.items()} == {k: tuple(r[c] for c in columns) for k, r in want.items()}
