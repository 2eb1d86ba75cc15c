"""Canonical JSON against Python's, and stable ids."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quorumlake.functions import canonical
from quorumlake.operators import identity
from quorumlake.sources.scratch import written

KIND = "z string, a struct<b:array<double>, Ba:map<string,long>, n:struct<t:string,f:boolean>>, m map<string,array<string>>, i int, `é` double"


def random_text(rng):
    return "".join(rng.choice('ab "\\/\n\r\t\b\f\x00\x1f\x7fé中\U0001f600 ') for _ in range(rng.randrange(0, 9)))


def random_number(rng):
    return rng.choice([0.0, -0.0, 1.0, 0.1, 1e16, 1e15, 123456789.25, 1e-4, 1e-5, -2.5e-7, 3.0e20, 1e100, 12345678.0, 0.00123, -1e7, float("nan"), float("inf"), rng.uniform(-1e9, 1e9), rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 22)])


def test_json_is_that_of_python(spark):
    rng = random.Random(1)
    none = lambda v: None if rng.random() < 0.15 else v
    rows = []
    for _ in range(300):
        a = ([none(random_number(rng)) for _ in range(rng.randrange(0, 4))], {random_text(rng): none(rng.randrange(-5, 10**12)) for _ in range(rng.randrange(0, 4))}, none((none(random_text(rng)), none(rng.random() < 0.5))))
        rows.append((none(random_text(rng)), none(a), none({random_text(rng): [none(random_text(rng))] for _ in range(2)}), none(rng.randrange(100)), none(random_number(rng))))
    df = spark.createDataFrame(rows, KIND)
    whole = F.struct(*df.columns)
    got = df.select(canonical.canonical_json(whole, df.schema).alias("tight"), canonical.canonical_json(whole, df.schema, (", ", ": ")).alias("wide")).collect()
    for (z, a, m, i, e), r in zip(rows, got):
        inner = None if a is None else {"b": a[0], "Ba": a[1], "n": None if a[2] is None else {"t": a[2][0], "f": a[2][1]}}
        value = {"z": z, "a": inner, "m": m, "i": i, "é": e}
        assert r["tight"] == json.dumps(value, sort_keys=True, separators=(",", ":")) and r["wide"] == json.dumps(value, sort_keys=True)


def test_keys_of_sources_and_chapters(spark):
    rows = [(None, "granicus", {"url": "https://é", "body": "Council", "id": "7"}, "e1"), ("pinned", "x", {}, None), ("", "x", {}, "")]
    df = spark.createDataFrame(rows, "pinned string, provider string, source map<string,string>, entity string")
    own = canonical.source_key(F.col("pinned"), F.col("provider"), F.col("source"), df.schema["source"].dataType, ("body", "body_any"))
    got = df.select(own.alias("key"), canonical.family_key(F.col("entity"), F.col("provider"), own).alias("family")).collect()
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:12]
    assert [r["key"] for r in got] == [sha("granicus|" + json.dumps({"id": "7", "url": "https://é"}, sort_keys=True)), "pinned", sha("x|{}")]
    assert [r["family"] for r in got] == [sha("granicus|entity:e1"), "pinned", sha("x|{}")]
    one = spark.createDataFrame([(3, 12.5, " Budget ")], "i int, s double, t string").select(canonical.chapter_id(F.col("i"), F.col("s"), F.col("t"))).first()[0]
    assert one == "ch-" + sha(json.dumps({"index": 3, "start": 12.5, "title": "Budget"}, sort_keys=True, separators=(",", ":")))


def uids(spark, records, stored, overrides):
    r = spark.createDataFrame(records, "guid string, body string, day string, at int")
    pair = "guid string, uid string"
    rows = identity.assign_uids(r, spark.createDataFrame(stored, pair), spark.createDataFrame(overrides, pair), ["body", "day"], "guid", ["at"], written).collect()
    assert len(rows) == len(records)
    return {x["guid"]: (x["uid"], x["how"]) for x in rows}


def uid(body, day, seq):
    return hashlib.sha1(f"{body}|{day}|{seq}".encode()).hexdigest()[:16]


def test_uids_stay_and_dont_collide(spark):
    records = [("g1", "a", "d", 5), ("g2", "a", "d", 3), ("g3", "b", "d", 1), ("g4", None, None, 1)]
    first = uids(spark, records, [], [])
    assert first == {"g1": (uid("a", "d", 1), "fresh"), "g2": (uid("a", "d", 0), "fresh"), "g3": (uid("b", "d", 0), "fresh"), "g4": (uid("", "", 0), "fresh")}
    stored = [(g, u) for g, (u, _) in first.items()]
    later = uids(spark, [("g0", "a", "d", 0), ("g9", "a", "d", 9), *records], stored, [])
    assert {g: later[g][0] for g in first} == {g: u for g, (u, _) in first.items()} and all(later[g][1] == "stored" for g in first)
    assert (later["g0"], later["g9"]) == ((uid("a", "d", 2), "fresh"), (uid("a", "d", 3), "fresh"))
    bound = uids(spark, [("new", "c", "d", 1), ("h", "a", "d", 1), *records], [(g, u) for g, u in stored if g != "g2"], [("new", "my-id"), ("g3", uid("a", "d", 0))])
    assert bound["new"] == ("my-id", "override") and bound["g3"] == (uid("a", "d", 0), "override") and bound["g1"] == (uid("a", "d", 1), "stored")
    assert {bound["g2"][0], bound["h"][0]} == {uid("a", "d", 2), uid("a", "d", 3)}
    clash = uids(spark, records, stored, [("g3", uid("a", "d", 1)), ("g4", "same"), ("g2", "same")])
    assert all(clash[g] == (None, "conflict") for g in ("g2", "g3", "g4")) and clash["g1"] == (uid("a", "d", 1), "stored")


def test_many_taken_numbers_take_rounds(spark):
    taken = [(f"old{i}", uid("a", "d", i)) for i in range(40)]
    got = uids(spark, [("x", "a", "d", 1), ("y", "a", "d", 0)], taken, [])
    assert got == {"y": (uid("a", "d", 40), "fresh"), "x": (uid("a", "d", 41), "fresh")}
