"""Queries of minutes, audit rules, samples, censuses, capacity, slides and route health, with the SQL that DuckDB runs for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.operators import audit, limits, minutes, normalize, timeline
from quorumlake.plans.catalog import QUERIES, SQL, query
from quorumlake.sources.readers import table
from quorumlake.sources.scratch import spread

__all__ = ["QUERIES", "SQL"]

# ---- minutes -------------------------------------------------------------------------------------------------------

MINUTES = r"""'Members Present: Mayor Pro Tem ' || p_name || ', 7th; Town Clerk' || chr(10) || 'Guests Present: ' || p_name || chr(10) || 'Also Present: Interim City Manager ' || upper(p_name) || chr(10) || 'Absent: None'"""


@query("""SELECT p_partkey, p_name AS name, 'present' AS status, 'members' AS section, 0 AS line FROM part UNION ALL SELECT p_partkey, upper(p_name), 'present', 'staff', 2 FROM part""")
def roster_rows(spark, sf):
    return minutes.roster_rows(table(spark, sf, "part").select("p_partkey", F.expr(MINUTES.replace("chr(10)", "char(10)")).alias("text")), "p_partkey", "text").select("p_partkey", "name", "status", "section", "line")


VOTES = r"""CASE WHEN p_size % 2 = 0 THEN 'Item ' || p_size || '. Budget ' || p_size || chr(10) ELSE '' END || 'talk of the day' || chr(10) || 'Vote: Yes: ' || p_name || ', Carol Outsider; No: Bob Jones' || chr(10) || 'Motion: Bob Jones - abstained' || chr(10) || 'Bob Jones - yes'"""


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'Budget ' || p_size END AS item, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS d FROM part)
SELECT p_partkey, 1 + d AS line, item, p_name AS member, 'yes' AS value FROM p UNION ALL SELECT p_partkey, 1 + d, item, 'BOB JONES', 'no' FROM p UNION ALL SELECT p_partkey, 2 + d, item, 'BOB JONES', 'abstain' FROM p""")
def vote_rows(spark, sf):
    part = table(spark, sf, "part")
    part = spread(part.select("p_partkey", "p_name", "p_size"), part.count(), "p_partkey")
    texts = part.select("p_partkey", F.expr(VOTES.replace("chr(10)", "char(10)")).alias("text"))
    roster = part.select("p_partkey", F.explode(F.array("p_name", F.lit("BOB JONES"))).alias("name"))
    return minutes.vote_rows(texts, "p_partkey", "text", roster).select("p_partkey", "line", F.col("agenda_item").alias("item"), "member", "value")


# ---- audit ---------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'drift' ELSE 'empty' END AS kind FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey HAVING (count(o_orderkey) = 0 AND c_custkey % 3 <> 0) OR (count(o_orderkey) BETWEEN 1 AND 7 AND c_custkey % 5 < 4)""")
def empty_feeds(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    k = F.col("c_custkey")
    feeds = table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.when(k % 3 == 0, 4).alias("materialized"), F.when(k % 5 == 4, 8).alias("archived"))
    return audit.empty_feeds(feeds, 8).select("c_custkey", "kind")


@query("""WITH r AS (SELECT l_suppkey AS feed, l_orderkey * 10 + l_linenumber AS uid, l_returnflag = 'R' AND l_linenumber >= 3 AS hit, l_linenumber AS tries FROM lineitem WHERE l_linestatus = 'F' OR l_shipdate >= '1998-01-01'),
t AS (SELECT *, row_number() OVER (PARTITION BY feed, hit ORDER BY uid) AS k FROM r)
SELECT feed, count(*) FILTER (WHERE hit) AS affected, count(*) FILTER (WHERE tries > 0) AS assessed, string_agg(uid::VARCHAR, ',' ORDER BY uid) FILTER (WHERE hit AND k <= 20) AS uids FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE hit) > 0""")
def rejected_agendas(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("status"), F.col("l_linenumber").alias("tries"), F.when(F.col("l_linestatus") != "F", F.col("l_shipdate")).alias("seen"))
    return audit.rejected_agendas(rows, ["feed"], "uid", "status", "tries", "seen", "1998-04-01 00:00:00").withColumn("uids", F.array_join(F.transform("uids", lambda u: u.cast("string")), ","))


@query("""WITH m AS (SELECT o_custkey AS feed, o_orderkey AS uid, o_orderdate AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'empty' ELSE 'ok' END AS s FROM orders WHERE o_orderkey % 9 <> 0),
e AS (SELECT feed, count(*) FILTER (WHERE s = 'empty' AND day >= '1997-01-01') AS empty, count(*) FILTER (WHERE day >= '1997-01-01') AS considered FROM m GROUP BY 1),
n AS (SELECT DISTINCT feed, uid, day, l_suppkey % 12 AS person FROM m JOIN lineitem ON l_orderkey = uid WHERE s = 'ok'), v AS (SELECT DISTINCT feed, uid, day FROM n),
d AS (SELECT feed, count(*) AS disjoint FROM v WHERE EXISTS (SELECT 1 FROM n o WHERE o.feed = v.feed AND (o.day, o.uid) < (v.day, v.uid)) AND NOT EXISTS (SELECT 1 FROM n o, n x WHERE o.feed = v.feed AND (o.day, o.uid) < (v.day, v.uid) AND x.feed = v.feed AND x.uid = v.uid AND x.person = o.person) GROUP BY 1)
SELECT feed, empty, considered, coalesce(disjoint, 0) AS disjoint FROM e LEFT JOIN d USING (feed) WHERE coalesce(disjoint, 0) > 0 OR (empty >= 3 AND empty >= 0.5 * considered)""")
def doubtful_rosters(spark, sf):
    people = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("Person  "), F.col("l_suppkey") % 12)).alias("members"))
    m = table(spark, sf, "orders").join(people, "o_orderkey", "left")
    status = F.when(F.col("o_orderkey") % 9 == 0, None).when(F.col("o_orderkey") % 4 == 0, "empty@2").otherwise("ok@2")
    rows = m.select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("uid"), F.col("o_orderdate").alias("day"), status.alias("status"), "members")
    return audit.doubtful_rosters(rows, ["feed"], "uid", "day", "status", "members", "1998-12-31 00:00:00", days=729)


SAMPLES_SQL = """s AS (SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_suppkey AS source, least(l_discount * 10, l_tax * 12.5) AS low, greatest(l_discount * 10, l_tax * 12.5) AS high, l_partkey % 3 = 0 AS second_layer, l_returnflag = 'R' AND l_partkey % 5 = 0 AS gold, l_returnflag <> 'R' AS free FROM lineitem)"""


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, c AS (SELECT * FROM s WHERE free), h AS (SELECT source, count(*) FILTER (WHERE gold) AS n FROM s GROUP BY 1),
g(k, ids, m) AS (SELECT 0, []::BIGINT[], (SELECT map(list(source), list(n)) FROM h) UNION ALL
SELECT k + 1, list_append(ids, b.sample_id), map_from_entries(list_transform(map_entries(m), lambda e: struct_pack(key := e.key, value := CASE WHEN e.key = b.source THEN e.value + 1 ELSE e.value END)))
FROM g, LATERAL (SELECT sample_id, source FROM c WHERE NOT list_contains(g.ids, sample_id) ORDER BY NOT second_layer, CASE WHEN g.k < 9 THEN round(-low, 1) ELSE round(high, 1) END, g.m[source], CASE WHEN g.k < 9 THEN -low ELSE high END, sample_id LIMIT 1) b WHERE k < 15)
SELECT unnest(ids) AS sample_id, CASE WHEN unnest(range(1, 16)) <= 9 THEN 'gold_coverage_good' ELSE 'gold_coverage_bad' END AS reason FROM g WHERE k = 15""")
def coverage_samples(spark, sf):
    d, t = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.col("l_suppkey").alias("source"), F.least(d, t).alias("low"), F.greatest(d, t).alias("high"), (F.col("l_partkey") % 3 == 0).alias("second_layer"), ((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0)).alias("gold"), (F.col("l_returnflag") != "R").alias("free"))
    return audit.coverage_samples(rows, 9, 6)


@query("""WITH e AS (SELECT event_type AS purpose, ts::DATE AS day, ts, CASE WHEN event_id % 4 > 0 AND day(ts) % 3 > 0 THEN event_id % 3 || '/' || CASE WHEN day(ts) % 7 = 0 AND event_id % 4 = 1 THEN 4 ELSE 3 END END AS shard, user_id % 50 AS n, user_id % 9 AS used FROM events),
l AS (SELECT purpose, day, shard, arg_max(n, ts) AS n, sum(used) AS used FROM e GROUP BY ALL), f AS (SELECT purpose, day, n AS backlog, used AS ran FROM l WHERE shard IS NULL),
p AS (SELECT purpose, day, sum(n) AS backlog, sum(used) AS ran FROM l WHERE shard IS NOT NULL GROUP BY ALL HAVING count(DISTINCT string_split(shard, '/')[2]) = 1 AND count(*) = max(string_split(shard, '/')[2]::INT)),
a AS (SELECT * FROM f UNION ALL SELECT * FROM p ANTI JOIN f USING (purpose, day)) SELECT purpose, day::VARCHAR AS day, backlog::BIGINT AS backlog, ran::BIGINT AS ran FROM a QUALIFY row_number() OVER (PARTITION BY purpose ORDER BY day DESC) <= 14""")
def purpose_points(spark, sf):
    k, d = F.col("event_id") % 4, F.dayofmonth("ts")
    shard = F.when((k > 0) & (d % 3 > 0), F.concat_ws("/", (F.col("event_id") % 3).cast("string"), F.when((d % 7 == 0) & (k == 1), "4").otherwise("3")))
    states = F.create_map(F.lit("ready"), F.col("user_id") % 50, F.lit("blocked"), F.lit(1).cast("long"))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("purpose"), F.to_date("ts").alias("day"), "ts", shard.alias("shard"), states.alias("states"), (F.col("user_id") % 9).alias("used"))
    return audit.purpose_points(rows, ["purpose"], "day", "ts", "shard", "states", "used", days=14).withColumn("day", F.col("day").cast("string"))


@query("""WITH s AS (SELECT p_partkey, p_size + 1 AS feeds, p_partkey % 9 + 1 AS seconds, CASE WHEN p_partkey % 4 > 0 THEN 25 END AS cap FROM part), t AS (SELECT *, greatest(1, floor(5 * 3600 * 0.75 / (seconds * 60))::BIGINT) AS tb FROM s), u AS (SELECT *, least(tb, coalesce(cap, tb)) AS per_run FROM t)
SELECT p_partkey, round(feeds * 0.5 * 40 * 0.0864::DOUBLE, 6) AS storage_gb, per_run, floor(per_run * 4)::BIGINT AS per_day, round(greatest(0, feeds * 0.5 * 40 * 0.0864::DOUBLE - 10) * 0.006, 6) AS monthly_cost, per_run * 4 >= feeds * 2 / 7 AS keeps_up, round(floor(feeds * 0.5 * 30)::DOUBLE / (per_run * 4), 6) AS backfill_days, coalesce(cap < tb, FALSE) AS capped FROM u""")
def capacity(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 1).alias("feeds"), F.lit(40).alias("archive_items"), F.lit(30).alias("full_items"), F.lit(96).alias("kbps"), F.lit(2.0).alias("hours"), F.lit(0.5).alias("host_share"), ((k % 9 + 1) * 60).alias("seconds_each"), F.lit(6.0).alias("cycle_hours"), F.lit(5.0).alias("budget_hours"), F.lit(0.75).alias("safety"), F.when(k % 4 > 0, F.lit(25).cast("long")).alias("most_per_run"), F.lit(2.0).alias("per_week"))
    return audit.capacity(rows).select("p_partkey", F.round("storage_gb", 6).alias("storage_gb"), "per_run", "per_day", F.round("monthly_cost", 6).alias("monthly_cost"), "keeps_up", F.round("backfill_days", 6).alias("backfill_days"), "capped")


# ---- slides, route health, hashes ----------------------------------------------------------------------------------

SLIDES_SQL = """s AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS source, l_partkey * 10.0::DOUBLE AS a, l_partkey * 10.0::DOUBLE + l_quantity AS b, (l_orderkey % 4) * 1023 AS h FROM lineitem), c AS (SELECT * FROM s WHERE h <> 2046 OR k % 2 = 0)"""


@query(f"""WITH RECURSIVE {SLIDES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY k, source ORDER BY a, b, h) AS n FROM c),
w(k, source, n, i, a, b, h) AS (SELECT k, source, n, 1, a, b, h FROM o WHERE n = 1 UNION ALL
SELECT o.k, o.source, o.n, CASE WHEN o.a - w.b <= 30 AND bit_count(xor(w.h, o.h)) <= 6 THEN w.i ELSE w.i + 1 END, CASE WHEN o.a - w.b <= 30 AND bit_count(xor(w.h, o.h)) <= 6 THEN w.a ELSE o.a END, o.b, CASE WHEN o.a - w.b <= 30 AND bit_count(xor(w.h, o.h)) <= 6 THEN w.h ELSE o.h END FROM w JOIN o ON o.k = w.k AND o.source = w.source AND o.n = w.n + 1),
z AS (SELECT DISTINCT ON (k, source, i) k, source, a, b, h FROM w ORDER BY k, source, i, n DESC)
SELECT k, source, a, b, h FROM z QUALIFY row_number() OVER (PARTITION BY k ORDER BY source, a, b, h) <= 60""")
def selected_slides(spark, sf):
    """With a number of repetitions that no picture reaches; those that recur are a test's."""
    a = F.col("l_partkey") * 10.0
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("source"), a.alias("a"), (a + F.col("l_quantity")).alias("b"), ((F.col("l_orderkey") % 4) * 1023).alias("h")).where("h <> 2046 OR k % 2 = 0")
    return timeline.selected_slides(rows, ["k"], "source", "a", "b", "h", recurring=1 << 40).select("k", "source", F.col("start").alias("a"), F.col("end").alias("b"), F.col("hash").alias("h"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS route, floor(epoch(ts))::BIGINT AS t0, floor(epoch(ts))::BIGINT - (event_id % 5) * 3000 AS began, ['success', 'timeout', 'capacity', 'defect', 'other'][event_id % 11 % 5 + 1] AS cls, event_id FROM events),
l AS (SELECT route, max(t0 * 100000 + began - t0 + 50000) FILTER (WHERE cls = 'success') AS last FROM e GROUP BY 1), f AS (SELECT route, t0, began, cls, row_number() OVER (PARTITION BY route ORDER BY t0, began, cls) AS n FROM e JOIN l USING (route) WHERE cls IN ('timeout', 'capacity', 'defect') AND (last IS NULL OR t0 * 100000 + began - t0 + 50000 > last)),
w AS (SELECT route, 0::BIGINT AS n, 0::BIGINT AS rung, 0::BIGINT AS until, '' AS class, 0::BIGINT AS timeout, 0::BIGINT AS capacity, 0::BIGINT AS defect FROM l UNION ALL
SELECT route, n, CASE WHEN up THEN least(rung + 1, 4) ELSE rung END, CASE WHEN up THEN t0 + [60, 300, 900, 3600][least(rung + 1, 4)] * 100 ELSE until END, CASE WHEN up THEN cls ELSE class END, t, c, d FROM (SELECT *, CASE WHEN rung > 0 THEN began >= until ELSE (cls = 'timeout' AND t >= 1) OR (cls = 'capacity' AND c >= 2) OR (cls = 'defect' AND d >= 3) END AS up
FROM (SELECT w.route, f.n, f.t0, f.began, f.cls, rung, until, class, timeout + (f.cls = 'timeout')::BIGINT AS t, capacity + (f.cls = 'capacity')::BIGINT AS c, defect + (f.cls = 'defect')::BIGINT AS d FROM w JOIN f ON f.route = w.route AND f.n = w.n + 1) x) y)
SELECT route, rung, until, class, timeout, capacity, defect FROM w QUALIFY row_number() OVER (PARTITION BY route ORDER BY n DESC) = 1""")
def health_ladder(spark, sf):
    at, began = F.unix_seconds(F.col("ts").cast("timestamp")), (F.col("event_id") % 5) * 3000
    cls = F.element_at(F.array(*[F.lit(c) for c in ("success", "timeout", "capacity", "defect", "other")]), (F.col("event_id") % 11 % 5 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("route"), at.alias("at"), (at - began).alias("began"), cls.alias("cls"))
    return limits.health_ladder(rows, ["route"], "at", "began", "cls", {"timeout": 1, "capacity": 2, "defect": 3}, [6000, 30000, 90000, 360000])


@query(r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 6 END AS score FROM orders""")
def agenda_scores(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, None).when(k == 1, "AGENDA\n items of the day").when(k == 2, "first\n IV. Budget").otherwise(F.concat(F.lit("Agenda\n2. "), F.repeat(F.lit("budget "), 90)))
    return table(spark, sf, "orders").select("o_orderkey", normalize.agenda_score(text, k >= 2).alias("score"))


@query("""SELECT o_custkey, sha256('v1,' || string_agg(sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), ',' ORDER BY o_orderkey::VARCHAR)) AS mark FROM orders GROUP BY 1""")
def feed_hash(spark, sf):
    return normalize.feed_hash(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus"], "v1")
