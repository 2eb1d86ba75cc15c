"""Replayed budgets against a plain fold; cells, priorities and followed tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quorumlake.operators import budget, cells
from quorumlake.streaming import changes

LOG = "route string, n int, owner string, kind string, at timestamp, requests long, tokens long"


def random_log(seed, routes=4, length=120):
    rng, rows = random.Random(seed), []
    for r in range(routes):
        at = datetime(2026, 1, 1, 23, 50)
        for i in range(length):
            at += timedelta(seconds=rng.choice([0, 1, 7, 40, 200]))
            kind = rng.choice(["reserve", "settle", "reserve", "settle", "ask"])
            rows.append((f"r{r}", i, f"o{rng.randrange(6)}", kind, at, None if kind == "settle" and rng.random() < 0.2 else rng.randrange(0, 4), None if kind == "settle" and rng.random() < 0.2 else rng.randrange(0, 900)))
    return rows


def fold(rows, limits, per_minute):
    out, state = {}, {}
    for route, n, owner, kind, at, requests, tokens in rows:
        s = state.setdefault(route, {"open": {}, "ready": None, "minute": None, "day": None, "used": {}})
        for window, key in (("minute", at.replace(second=0)), ("day", at.date())):
            if s[window] != key:
                s[window] = key
                s["used"] |= {f"requests_{window}": 0, f"tokens_{window}": 0}
        used, now = s["used"], at.timestamp()
        if kind == "reserve":
            if owner in s["open"]:
                continue
            for w in ("minute", "day"):
                used[f"requests_{w}"] += requests
                used[f"tokens_{w}"] += tokens
            before, base = s["ready"], now if s["ready"] is None else max(now, s["ready"])
            s["ready"] = base + tokens * 60 / per_minute
            s["open"][owner] = {"requests": requests, "tokens": tokens, "minute": s["minute"], "day": s["day"], "base": base, "after": s["ready"], "count": s.setdefault("count", 0) + 1}
            s["count"] += 1
        elif kind == "settle":
            if owner not in s["open"]:
                continue
            o = s["open"].pop(owner)
            for w in ("minute", "day"):
                if requests is not None and o[w] == s[w]:
                    used[f"requests_{w}"] = max(0, used[f"requests_{w}"] + requests - o["requests"])
                if tokens is not None and (w == "day" or o[w] == s[w]):
                    used[f"tokens_{w}"] = max(0, used[f"tokens_{w}"] + tokens - o["tokens"])
            if tokens is not None and o["count"] == s["count"]:
                s["ready"] = o["base"] + tokens * 60 / per_minute
        fits = None
        if kind == "ask":
            fits = all(used[k] + (requests if k.startswith("requests") else tokens) <= v for k, v in limits.items()) and (s["ready"] is None or round(s["ready"], 6) <= now)
        out[route, n] = (*(used[f"{a}_{w}"] for w in ("minute", "day") for a in ("requests", "tokens")), None if s["ready"] is None else round(s["ready"], 3), fits)
    return out


def test_replay_equals_a_fold(spark):
    limits = {"requests_minute": 5, "tokens_day": 9000}
    for seed in (1, 2):
        rows = random_log(seed)
        log = spark.createDataFrame(rows, LOG)
        windows = {"minute": F.date_trunc("minute", "at"), "day": F.to_date("at")}
        got = budget.replay(log, ["route"], ["n"], windows, ["minute"], limits, 6000.0).collect()
        found = {(r["route"], r["n"]): (r["used_requests_minute"], r["used_tokens_minute"], r["used_requests_day"], r["used_tokens_day"], None if r["ready_at"] is None else round(r["ready_at"], 3), r["fits"]) for r in got}
        want = fold(rows, limits, 6000.0)
        assert found.keys() == want.keys() and {r["fits"] for r in got} == {True, False, None}
        assert found == want


CELL = "k string, count long, last_status int, last_seen int, last_sent int, last_output int, max_output int"
EVENT = "k string, n int, seen int, status int, sent int, output int"


def test_failures_keep_the_last_known_value(spark):
    stored = spark.createDataFrame([("a", 2, 500, 10, 7, 3, 9), ("c", 1, 1, 1, None, None, None)], CELL)
    events = spark.createDataFrame([("a", 1, 11, 429, None, 4), ("a", 2, 12, None, 0, None), ("b", 1, 5, 404, 8, None), ("d", 1, 5, 1, 8, 0), ("d", 2, 6, 1, None, -1)], EVENT)
    got = {r["k"]: tuple(r)[1:] for r in cells.failure_cells(stored, events, ["k"], "n").collect()}
    assert got == {"a": (4, None, 12, 7, 4, 9), "b": (1, 404, 5, 8, None, None), "c": (1, 1, 1, None, None, None), "d": (2, 1, 6, 8, 0, 0)}


def test_samples_are_capped_in_order(spark):
    kind = "k string, calls long, most int, xs array<int>"
    stored = spark.createDataFrame([("a", 2, 5, [1, 2]), ("b", 1, 1, [])], kind)
    fresh = spark.createDataFrame([("a", 1, 9, [5, 6], 2), ("a", 1, None, [3, 4], 1), ("c", 1, 2, [1, 2, 3, 4, 5, 6], 1)], f"{kind}, n int")
    got = {r["k"]: tuple(r)[1:] for r in cells.usage_cells(stored, fresh, ["k"], "n", ["calls"], ["most"], ["xs"], 5).collect()}
    assert got == {"a": (4, 9, [1, 2, 3, 4, 5]), "b": (1, 1, []), "c": (1, 2, [1, 2, 3, 4, 5])}


def test_index_follows_priorities(spark):
    job = "job string, priority int, created int, models array<string>"
    before = spark.createDataFrame([("a", 1, 5, ["x", "y"]), ("b", 1, 5, None), ("c", 1, 5, ["x"])], job)
    after = spark.createDataFrame([("a", 2, 5, ["x", "y"]), ("b", 3, 5, None), ("c", 1, 5, ["x"])], job)
    index = spark.createDataFrame([("a", "x", 1, 5), ("a", "y", 7, 5), ("a", "z", 1, 5), ("a", "y", 1, 6), ("b", "q", 9, 9), ("c", "x", 4, 5), ("e", "x", 4, 5)], "job string, model string, priority int, created int")
    got = sorted(tuple(r) for r in cells.synced_priorities(index, before, after).collect())
    assert got == [("a", "x", 2, 5), ("a", "y", 1, 6), ("a", "y", 7, 5), ("a", "z", 1, 5), ("b", "q", 3, 9), ("c", "x", 4, 5), ("e", "x", 4, 5)]


def test_a_batch_is_applied_once(spark, tmp_path):
    total = "k string, kinds long"
    tables = changes.FollowedTables(spark, f"file://{tmp_path}/tables", {"cells": CELL, "totals": total})

    def step(now, batch):
        fresh = cells.failure_cells(now["cells"], batch, ["k"], "n")
        return {"cells": fresh, "totals": fresh.groupBy(F.substring("k", 1, 1).alias("k")).agg(F.count("*").alias("kinds"))}

    rows = [("a1", 1, 5, 500, 3, None), ("a2", 2, 6, None, None, 4), ("b1", 3, 7, 1, 1, 1), ("a1", 4, 8, 429, None, 2), ("b1", 5, 9, 2, None, None)]
    for i in range(0, 5, 2):
        spark.createDataFrame(rows[i : i + 2], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables.follow(stream, step, f"{tmp_path}/state").awaitTermination(300)
    whole = cells.failure_cells(spark.createDataFrame([], CELL), spark.createDataFrame(rows, EVENT), ["k"], "n")
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, tables.table("cells").collect())) == want and {tuple(r) for r in tables.table("totals").collect()} == {("a", 2), ("b", 1)}
    last = tables.applied()
    assert last == 2 and not tables.apply(spark.createDataFrame(rows, EVENT), last, step) and not tables.apply(spark.createDataFrame(rows, EVENT), 0, step)
    assert sorted(map(str, tables.table("cells").collect())) == want
    assert tables.apply(spark.createDataFrame([("c1", 9, 9, 9, 9, 9)], EVENT), last + 1, step) and tables.table("cells").count() == 4
