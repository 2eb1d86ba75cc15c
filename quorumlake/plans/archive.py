"""Queries of the archive's own operators (bodies, status, work rows, timelines, limits, people, tags), with the SQL that DuckDB runs for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import quotes
from quorumlake.operators import bodies, judging, limits, people, status, timeline, workqueue
from quorumlake.plans.catalog import QUERIES, SQL, query
from quorumlake.sources.readers import table
from quorumlake.sources.scratch import spread

__all__ = ["QUERIES", "SQL"]

# ---- bodies --------------------------------------------------------------------------------------------------------

LABEL = {0: "'Special ' || p_name || ' - Regular Session'", 1: "upper(p_name)", 2: "p_name || ' joint called on 2026-05-19 4:00 PM'", 3: "'Evening'"}
LABELS_SQL = "SELECT p_partkey, CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in LABEL.items()) + " END AS label, p_name FROM part"
WORD = "(?:evening|afternoon|morning|special|regular|joint|called)"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr("CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in LABEL.items()) + " END").alias("label"), "p_name")


@query(rf"""WITH a AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(label, '\s+on\s+\d{{4}}-\d{{2}}-\d{{2}}.*$', ''), '\s*[-:]\s*[^-:]+$', '')) AS b FROM ({LABELS_SQL})),
c AS (SELECT p_partkey, b, regexp_replace(regexp_replace(b, '^(?:,*{WORD},*(?:\s+|$))+', '', 'i'), '(?:(?:^|\s+),*{WORD},*)+$', '', 'i') AS c FROM a), d AS (SELECT p_partkey, CASE WHEN c = '' THEN b ELSE c END AS x FROM c)
SELECT p_partkey, CASE WHEN upper(x) = x THEN array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE x END AS body FROM d""")
def canonical_body(spark, sf):
    return labels(spark, sf).select("p_partkey", bodies.canonical_body(F.col("label")).alias("body"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 'Board ' || o_custkey END AS body FROM orders""")
def titled_body(spark, sf):
    day, name = F.date_format("o_orderdate", "MMMM d, yyyy"), F.concat(F.lit("Board "), F.col("o_custkey"))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(name, F.lit(" on 2026-05-19 4:00 PM - "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(name, F.lit(" 5-26-26 - "), day)).otherwise(F.concat(F.lit(" - "), day))
    return table(spark, sf, "orders").select("o_orderkey", bodies.titled_body(title).alias("body"))


@query("SELECT p_partkey, regexp_full_match(p_name, 'small .*') OR regexp_full_match(p_name, '.* ring') OR contains(p_name, 'green') OR p_name = 'large bolt' OR p_partkey = 7 AS hit FROM part")
def body_selectors(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    kept = bodies.filter_by_body(part.withColumn("guid", F.col("p_partkey").cast("string")), "p_name", "guid", ("Small *", "* Ring", "GREEN"), ("Large Bolts",), ("7",))
    return part.join(kept.select("p_partkey", F.lit(True).alias("hit")), "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 'ring') AND NOT regexp_full_match(p_name, 'red.*')")
def excluded_bodies(spark, sf):
    return bodies.without_excluded(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ("Rings", "red*")).select("p_partkey")


@query("""SELECT p_name AS key, count(*) AS n, min(p_name) AS example FROM part WHERE NOT contains(p_name, 'ring') AND NOT starts_with(p_name, 'small') AND p_partkey <> 5 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size < 2)) GROUP BY 1""")
def unexpected_bodies(spark, sf):
    part = table(spark, sf, "part").withColumn("guid", F.col("p_partkey").cast("string"))
    keys = lambda where: part.where(where).select(bodies.body_key(F.col("p_name")).alias("key"))
    return bodies.unexpected_bodies(part, "p_name", "guid", ({"selectors": ("ring",)}, {"selectors": ("small*",), "included": ("5",)}), keys("p_size > 45"), keys("p_size < 2"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def title_dates(spark, sf):
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Board, "), day, F.lit(" and "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit(" to January 1 1900"))).otherwise("Board 5-6-24")
    return table(spark, sf, "orders").select("o_orderkey", bodies.title_date(title).cast("string").alias("day"))


# ---- status --------------------------------------------------------------------------------------------------------

RECORD = """l_orderkey, l_linenumber, l_suppkey AS feed, CASE WHEN l_returnflag = 'N' THEN 'http://h/a' WHEN l_returnflag = 'A' THEN '' END AS url,
CASE WHEN l_linenumber = 1 THEN 'legacy' WHEN l_linenumber = 3 THEN 'old' WHEN l_linenumber > 3 THEN 'new' END AS spec, 'new' AS wanted,
CASE l_partkey % 5 WHEN 0 THEN 'deferred' WHEN 1 THEN 'dead' WHEN 2 THEN 'timeout' END AS error, CASE l_suppkey % 3 WHEN 0 THEN 'hls' WHEN 1 THEN 'direct' END AS kind,
l_suppkey % 2 = 0 AS host_direct, l_shipdate AS published, CASE WHEN l_partkey % 4 = 0 THEN l_quantity * 60 END AS served_seconds, CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 61 END AS source_seconds,
CASE WHEN l_partkey % 7 <> 0 THEN CAST(floor(l_extendedprice * 1000) AS BIGINT) END AS bytes, l_partkey % 2 = 0 AS synced, CASE WHEN l_partkey % 3 = 1 THEN 'k' END AS transcript_key"""
STATE_SQL = """CASE WHEN coalesce(url, '') <> '' THEN CASE WHEN spec IS NULL OR spec = 'legacy' OR spec = wanted THEN 'served' ELSE 'stale' END WHEN coalesce(kind, 'direct') = 'direct' AND NOT host_direct THEN 'linked_video'
WHEN error IN ('deferred', 'dead') THEN error WHEN error IS NOT NULL THEN 'transient_error' ELSE 'pending' END"""
RECORDS_SQL = f"""r AS (SELECT {RECORD} FROM lineitem), q AS (SELECT *, {STATE_SQL} AS state FROM r), m AS (SELECT *, state IN ('served', 'stale') AS host,
coalesce(CASE WHEN state IN ('served', 'stale') THEN served_seconds END, source_seconds, 0) AS d FROM q), t AS (SELECT *, CASE WHEN d = 0 AND coalesce(bytes, 0) > 0 THEN bytes * 8 / 64000.0 ELSE d END AS sec FROM m)"""
MEASURES_SQL = """count(*) AS episodes, count(*) FILTER (WHERE host) AS hosted, """ + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in status.STATES) + """,
round(coalesce(sum(sec / 3600) FILTER (WHERE host), 0), 2) AS hours_hosted, round(coalesce(sum(sec / 3600) FILTER (WHERE state = 'linked_video'), 0), 2) AS hours_linked, round(coalesce(sum(bytes / 1e9) FILTER (WHERE host), 0), 4) AS gb_stored,
count(*) FILTER (WHERE host AND bytes IS NULL) = 0 AS gb_exact, max(published)::DATE::VARCHAR AS last_published, count(*) FILTER (WHERE synced) AS tx_synced, count(*) FILTER (WHERE NOT synced AND transcript_key IS NOT NULL) AS tx_text, count(*) FILTER (WHERE NOT synced AND transcript_key IS NULL) AS tx_none"""
FEEDS_SQL = f"""{RECORDS_SQL}, f AS (SELECT feed, {MEASURES_SQL} FROM t GROUP BY 1), g AS (SELECT *, CASE WHEN dead > 0 OR transient_error > 0 THEN 'error' WHEN deferred > 0 OR stale > 0 OR pending > 0 THEN 'warn' ELSE 'ok' END AS health FROM f)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(*RECORD_PARTS)
    return rows.withColumn("state", status.state_of(*[F.col(c) for c in ("url", "spec", "wanted", "error", "kind", "host_direct")]))


def _parts(text: str) -> list[str]:
    """The expressions of a select list, cut at commas outside brackets and CASE."""
    out, depth, own = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]


RECORD_PARTS = _parts(RECORD)


@query(f"WITH {RECORDS_SQL} SELECT l_orderkey, l_linenumber, feed, state, count(*) AS n FROM t GROUP BY ALL")
def record_states(spark, sf):
    return records(spark, sf).groupBy("l_orderkey", "l_linenumber", "feed", "state").agg(F.count("*").alias("n"))


@query(f"WITH {FEEDS_SQL} SELECT * FROM g")
def feed_status(spark, sf):
    return status.feed_rows(records(spark, sf), ["feed"], 64)


@query(f"WITH {RECORDS_SQL}, u AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM t ORDER BY l_orderkey, l_linenumber, {', '.join(f'{c} NULLS FIRST' for c in status.MEASURED)}) SELECT {MEASURES_SQL} FROM u")
def source_status(spark, sf):
    """Each record counted once, though several feeds hold it."""
    return status.source_actuals(records(spark, sf), ["l_orderkey", "l_linenumber"], 64, table(spark, sf, "lineitem").count())


@query(f"""WITH {FEEDS_SQL} SELECT s_nationkey AS city, count(*) AS feeds, string_agg(DISTINCT 'p' || feed % 3, ', ' ORDER BY 'p' || feed % 3) AS provider, {", ".join(f"round(sum({c}), {4 if c == 'gb_stored' else 2}) AS {c}" if c in ("hours_hosted", "hours_linked", "gb_stored") else f"sum({c})::BIGINT AS {c}" for c in status.SUMS)},
bool_and(gb_exact) AS gb_exact, max(last_published) AS last_published, {", ".join(f"count(*) FILTER (WHERE health = '{h}') AS health_{h}" for h in ("ok", "warn", "error"))} FROM g JOIN supplier ON feed = s_suppkey GROUP BY 1""")
def city_status(spark, sf):
    feeds = status.feed_rows(records(spark, sf), ["feed"], 64)
    place = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("feed"), F.col("s_nationkey").alias("city"))
    return status.city_rows(feeds.join(place, "feed").withColumn("provider", F.concat(F.lit("p"), F.col("feed") % 3)), "city", "provider")


@query("""WITH e AS (SELECT user_id AS run, event_type AS stage, count(*) AS ran, sum(value) AS seconds FROM events GROUP BY ALL), k AS (SELECT user_id % 7 AS k, event_type AS stage, 'r' || event_id % 3 AS reason, count(*) AS v FROM events GROUP BY ALL),
j AS (SELECT k, stage, string_agg(reason || '=' || v, ',' ORDER BY reason) AS reasons FROM k GROUP BY ALL)
SELECT run % 7 AS k, e.stage, sum(ran)::BIGINT AS ran, round(sum(seconds), 4) AS seconds, any_value(reasons) AS reasons FROM e JOIN j ON j.k = run % 7 AND j.stage = e.stage GROUP BY run % 7, e.stage""")
def stage_totals(spark, sf):
    e = table(spark, sf, "events").withColumn("reason", F.concat(F.lit("r"), F.col("event_id") % 3))
    parts = e.groupBy("user_id", "event_type", "reason").agg(F.count("*").alias("v"), F.sum("value").alias("s"))
    stage = parts.groupBy("user_id", "event_type").agg(F.struct(F.sum("v").alias("ran"), F.sum("s").alias("seconds"), F.map_from_entries(F.collect_list(F.struct("reason", "v"))).alias("reasons")).alias("own"))
    runs = stage.groupBy((F.col("user_id") % 7).alias("k"), "user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "own"))).alias("stages"))
    spelled = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return status.stage_totals(runs, ["k"], "stages", ("ran", "seconds"), ("reasons",)).select("k", "stage", "ran", F.round("seconds", 4).alias("seconds"), spelled.alias("reasons"))


@query("""WITH e AS (SELECT CASE WHEN user_id % 5 > 0 THEN user_id END AS run, event_id, event_type, value FROM events)
SELECT run, round(sum(value), 4) AS value, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS shards FROM e GROUP BY run, CASE WHEN run IS NULL THEN event_id END""")
def merged_runs(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("run"), "event_id", "event_type", "value")
    return status.merged_runs(e, ["run"], "event_id", "event_id", ["value"]).withColumn("value", F.round("value", 4))


@query("""SELECT event_type, count(v) AS count, count(*) FILTER (WHERE v < 0.5) AS low, count(*) FILTER (WHERE v >= 0.5 AND v < 0.9) AS medium, count(*) FILTER (WHERE v >= 0.9) AS high, round(min(v), 3) AS min, round(avg(v), 3) AS avg FROM (SELECT event_type, least(value / 40, 1.0) AS v FROM events) GROUP BY 1""")
def confidence_summary(spark, sf):
    return status.confidence_summary(table(spark, sf, "events").select("event_type", F.least(F.col("value") / 40, F.lit(1.0)).alias("v")), ["event_type"], "v")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS s FROM orders GROUP BY 1) SELECT count(*) AS feeds, count(*) FILTER (WHERE n > s) AS truncated, sum(n - s)::BIGINT AS hidden FROM a""")
def truncated_feeds(spark, sf):
    o = table(spark, sf, "orders")
    count = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return status.truncated_feeds(count(o.where("o_orderstatus = 'O'")), count(o), "o_custkey")


@query(f"WITH {RECORDS_SQL} SELECT error, count(*) AS n FROM t WHERE error IS NOT NULL GROUP BY 1")
def audio_failures(spark, sf):
    return status.failure_counts(records(spark, sf), "error")


@query("""WITH r AS (SELECT ts, event_id, props->>'k' AS k FROM events ORDER BY ts DESC, event_id LIMIT 500) SELECT 'p' || (k::INT % 10) AS provider, count(*) AS runs FROM r WHERE k::INT % 2 = 1 GROUP BY 1 HAVING count(*) >= 45""")
def erring_providers(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    runs = table(spark, sf, "events").select("ts", "event_id", F.create_map(F.concat(F.lit("p"), k % 10), k % 2).alias("errors"))
    return status.erring_providers(runs, "ts", "errors", 500, 45, ["event_id"])


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey % 8 AS least, c_custkey % 20 AS archived, c_custkey % 3 AS materialized FROM customer), n AS (SELECT k, least, archived, materialized, count(o_custkey) AS n FROM f LEFT JOIN orders ON o_custkey = k GROUP BY ALL)
SELECT k, n, CASE WHEN n = 0 THEN 'drift' ELSE 'empty' END AS code FROM n WHERE (n = 0 AND materialized = 0) OR (n > 0 AND n < least AND archived < least)""")
def too_few_rows(spark, sf):
    feeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 8).alias("least"), (F.col("c_custkey") % 20).alias("archived"), (F.col("c_custkey") % 3).alias("materialized"))
    return status.too_few(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), feeds, "k", "least", "archived", "materialized")


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) > 60)) > 0) AS with_parts FROM documents")
def search_coverage(spark, sf):
    return status.coverage(table(spark, sf, "documents").select(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 60).alias("parts")), "parts")


@query("""SELECT user_id % 9 AS backend, count(*) AS samples, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'click') AS n_click, round(avg(value), 5) AS mean_seconds, max(value) AS most_seconds, arg_max(event_type, event_id) AS latest FROM events GROUP BY 1""")
def backend_summary(spark, sf):
    return status.newest_per_backend(table(spark, sf, "events").withColumn("backend", F.col("user_id") % 9), "backend", "event_type", ["error", "click"], "value", ["event_id"]).withColumn("mean_seconds", F.round("mean_seconds", 5))


@query("""SELECT event_type, count(*) AS n, count(ts) AS timed, round(min(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 4) AS newest_hours, round(max(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 4) AS oldest_hours FROM events GROUP BY 1""")
def refresh_ages(spark, sf):
    return status.ages(table(spark, sf, "events"), ["event_type"], "ts", "2024-02-01").withColumns({c: F.round(c, 4) for c in ("newest_hours", "oldest_hours")})


# ---- queue counters ------------------------------------------------------------------------------------------------

JOBS_SQL = "j AS (SELECT event_id AS id, event_type AS purpose, CASE user_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'leased' WHEN 2 THEN 'done' ELSE 'failed' END AS state, user_id % 6 AS route, ts, value FROM events)"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in ("queued", "leased", "done", "failed")]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("purpose"), state.alias("state"), (F.col("user_id") % 6).alias("route"), "ts", "value")


@query(f"WITH {JOBS_SQL} SELECT purpose, count(*) AS calls, round(sum(value), 3) AS cost FROM j WHERE ts::DATE >= '2024-01-10' GROUP BY 1")
def calls_by_purpose(spark, sf):
    return jobs(spark, sf).where(F.to_date("ts") >= "2024-01-10").groupBy("purpose").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 3).alias("cost"))


@query(f"WITH {JOBS_SQL} SELECT purpose, count(*) AS pending FROM j WHERE state IN ('queued', 'leased') GROUP BY 1")
def pending_by_purpose(spark, sf):
    return jobs(spark, sf).where(F.col("state").isin("queued", "leased")).groupBy("purpose").agg(F.count("*").alias("pending"))


@query(f"WITH {JOBS_SQL} SELECT state, count(*) AS n FROM j GROUP BY 1")
def jobs_by_state(spark, sf):
    return jobs(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS_SQL} SELECT epoch_us(min(ts)) AS oldest FROM j WHERE state = 'queued'")
def oldest_queued(spark, sf):
    return jobs(spark, sf).where("state = 'queued'").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("oldest"))


@query(f"WITH {JOBS_SQL}, m AS (SELECT id, 'm' || m AS model FROM j, generate_series(0, 2) g(m) WHERE id % 3 >= m) SELECT model, count(*) AS n FROM j JOIN m USING (id) WHERE state = 'queued' GROUP BY 1 ORDER BY n DESC, model LIMIT 2")
def queued_by_model(spark, sf):
    j = jobs(spark, sf)
    models = j.select("id", F.explode(F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda m: F.concat(F.lit("m"), m))).alias("model"))
    return j.where("state = 'queued'").join(models, "id").groupBy("model").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "model").limit(2)


@query(f"WITH {JOBS_SQL} SELECT route, count(*) AS leases FROM j WHERE state = 'leased' AND ts > '2024-01-20' GROUP BY 1")
def leases_per_route(spark, sf):
    return jobs(spark, sf).where("state = 'leased' and ts > '2024-01-20'").groupBy("route").agg(F.count("*").alias("leases"))


@query(f"WITH {JOBS_SQL} SELECT count(*) AS n FROM (SELECT 1 FROM j WHERE state = 'queued' LIMIT 100)")
def bounded_count(spark, sf):
    """A count that stops at 100: the limit is the feature."""
    return jobs(spark, sf).where("state = 'queued'").limit(100).agg(F.count("*").alias("n"))


@query(f"""WITH {JOBS_SQL} SELECT route, sum(value) FILTER (WHERE state = 'queued') + count(*) FILTER (WHERE state = 'queued' AND value IS NULL) * 0 + 5.0 * count(*) FILTER (WHERE state = 'failed') AS work_seconds, count(*) FILTER (WHERE state = 'queued') AS pending FROM j GROUP BY 1""".replace("sum(value)", "round(coalesce(sum(value)", 1).replace(" FILTER (WHERE state = 'queued') + count", " FILTER (WHERE state = 'queued'), 0), 3) + count", 1))
def pending_work(spark, sf):
    made = workqueue.pending_work(jobs(spark, sf), ["route"], F.col("state") == "queued", F.col("value"), 7200.0, F.col("state") == "failed", 5.0)
    return made.withColumn("work_seconds", F.round("work_seconds", 3))


# ---- work rows -----------------------------------------------------------------------------------------------------

WORK_SQL = """w AS (SELECT o_orderkey AS k, o_custkey AS city, o_orderdate AS published, CASE o_orderstatus WHEN 'O' THEN 'feed_visible' WHEN 'P' THEN 'recent_archive' ELSE 'deep_archive' END AS bucket, CASE WHEN o_orderkey % 2 = 0 THEN 'transcript' ELSE 'audio' END AS work_class, o_totalprice / 50000 AS hours FROM orders)"""


def work(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("o_orderstatus") == "O", "feed_visible").when(F.col("o_orderstatus") == "P", "recent_archive").otherwise("deep_archive")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("city"), F.col("o_orderdate").alias("published"), bucket.alias("bucket"), F.when(F.col("o_orderkey") % 2 == 0, "transcript").otherwise("audio").alias("work_class"), (F.col("o_totalprice") / 50000).alias("hours"))


@query(f"""WITH {WORK_SQL} SELECT k, row_number() OVER (ORDER BY CASE bucket WHEN 'feed_visible' THEN 0 WHEN 'recent_archive' THEN 1 ELSE 2 END, CASE WHEN work_class = 'transcript' AND hours > 4 THEN 0 ELSE 1 END, CASE city WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END,
CASE WHEN published >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY THEN 0 ELSE 1 END, CASE WHEN published >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY THEN -epoch_us(published) ELSE 0 END, k)::INT AS position FROM w""")
def policy_order(spark, sf):
    keys = [workqueue.feed_visible_first(F.col("bucket")), workqueue.long_first(F.col("work_class"), F.col("hours"), 4.0, ("transcript",)), workqueue.city_order(F.col("city").cast("string"), ["3", "1"]), workqueue.recency(F.col("published"), "1998-06-01", within_days=90)]
    return workqueue.positions(work(spark, sf), [], keys, "k").select("k", "position")


@query(f"""WITH {WORK_SQL} SELECT k, row_number() OVER (PARTITION BY city ORDER BY CASE WHEN published >= TIMESTAMP '1998-06-01' - INTERVAL 365 DAY THEN 0 ELSE 1 END, CASE bucket WHEN 'deep_archive' THEN 0 ELSE 1 END, bucket, published, k)::INT AS position FROM w""")
def policy_order_by_city(spark, sf):
    keys = [workqueue.recent_first(F.col("published"), "1998-06-01", 365), workqueue.body_order(F.col("bucket"), ["Deep Archive"]), workqueue.recency(F.col("published"), "1998-06-01", "asc")]
    return workqueue.positions(work(spark, sf).withColumn("bucket", F.replace("bucket", F.lit("_"), F.lit(" "))), ["city"], keys, "k").select("k", "position")


@query("""WITH m AS (SELECT o_orderkey AS k, 'audio' AS work_class, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS state FROM orders UNION ALL SELECT o_orderkey, 'transcript', CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'pending' END FROM orders WHERE o_totalprice > 100000)
SELECT k, work_class, CASE WHEN state <> 'done' AND k IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > '1998-06-01' AND l_linenumber = 1) AND work_class = 'audio' THEN 'running' ELSE state END AS state FROM m""")
def work_manifest(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    made = workqueue.manifest(rows, {"audio": F.lit(True), "transcript": F.col("o_totalprice") > 100000}, {"audio": F.col("o_orderstatus") == "F", "transcript": F.col("k") % 3 == 0}).select("k", "work_class", "state")
    leases = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.lit("audio").alias("work_class"), F.col("l_shipdate").alias("expires_at"))
    return workqueue.overlay_leases(made, leases, ["k", "work_class"], "1998-06-01")


@query("""SELECT o_orderkey AS k, o_orderstatus AS state, CASE WHEN o_orderstatus <> 'done' AND o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN o_orderkey % 5 ELSE 0 END::BIGINT AS attempts FROM orders""")
def overlay_state(spark, sf):
    o = table(spark, sf, "orders")
    items = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "done").otherwise(F.col("o_orderstatus")).alias("state"), F.lit(0).cast("long").alias("attempts"))
    held = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("attempts"))
    return workqueue.overlay_state(items, held, ["k"], ["attempts"]).withColumn("state", F.when(F.col("state") == "done", "F").otherwise(F.col("state")))


@query("""SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 - ('0x' || left(md5(o_custkey::VARCHAR), 8))::BIGINT - 3) % n + n) % n AS position FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def rotated_candidates(spark, sf):
    return workqueue.rotated(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], F.col("o_custkey"), 3).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 1 AND o_orderstatus = 'O'")
def shard_members(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    plan = o.select("k", (F.col("k") % 3).alias("shard"), F.explode(F.array(F.lit("audio"), F.lit("text"))).alias("lane"))
    return workqueue.shard_of(plan, "audio", 1, o.where("o_orderstatus = 'O'"), "k")


@query("""WITH s AS (SELECT user_id, event_type = 'error' AS err, count(*) FILTER (WHERE event_id % 7 = 0) AS ready, count(*) FILTER (WHERE event_id % 7 = 1) AS queued, count(*) FILTER (WHERE event_id % 7 = 2) AS limited, count(*) FILTER (WHERE event_id % 7 = 3) AS blocked, count(*) FILTER (WHERE event_id % 11 = 4) AS done, count(*) FILTER (WHERE event_id % 11 = 5) AS waiting, count(*) FILTER (WHERE event_id % 11 = 6) AS failed, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, err, CASE WHEN n % 13 = 0 THEN 'unknown' WHEN ready + queued + limited = 0 THEN CASE WHEN blocked > 0 THEN 'a' ELSE 'idle' END WHEN limited > 0 AND limited >= greatest(ready, queued, 0) THEN 'e' WHEN ready > queued THEN CASE WHEN blocked > ready + queued + limited THEN 'a' ELSE 'b' END
WHEN failed > greatest(waiting, done) THEN 'c' WHEN done > waiting THEN 'd' ELSE 'c' END AS class FROM s""")
def lane_classes(spark, sf):
    at = lambda m, r: F.count_if(F.col("event_id") % m == r)
    s = table(spark, sf, "events").groupBy("user_id", (F.col("event_type") == "error").alias("err")).agg(at(7, 0).alias("ready"), at(7, 1).alias("queued"), at(7, 2).alias("limited"), at(7, 3).alias("blocked"), at(11, 4).alias("done"), at(11, 5).alias("waiting"), at(11, 6).alias("failed"), F.count("*").alias("n"))
    zero = F.lit(0)
    states = {"ready": F.col("ready"), "queued": F.col("queued"), "limited": F.col("limited"), "stopped": zero, "blocked": F.col("blocked"), "held": zero, "errored": zero}
    held = {"waiting": F.col("waiting"), "done": F.col("done"), "failed": F.col("failed"), "unobserved": zero}
    return s.select("user_id", "err", workqueue.lane_class(states, held, F.col("n") % 13, F.lit(False)).alias("class"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'h' || page_id WHEN 2 THEN url END AS audio, CASE page_id % 4 WHEN 2 THEN 'v' || page_id END AS video FROM pages")
def enclosures(spark, sf):
    k = F.col("page_id")
    args = (k % 4 == 0, F.when(k % 4 == 2, "direct").otherwise("hls"), F.when(k % 4 == 1, F.concat(F.lit("h"), k)), F.col("url"), F.concat(F.lit("v"), k))
    return table(spark, sf, "pages").select("page_id", workqueue.enclosure(*args, audio=True).alias("audio"), workqueue.enclosure(*args, audio=False).alias("video"))


@query("""SELECT page_id, 'agenda=' || url || ',minutes=HTTP://m' || CASE WHEN page_id % 2 = 0 THEN ',zoom=https://z' ELSE '' END AS links FROM pages WHERE regexp_matches(lower(url), '^https?://') UNION ALL
SELECT page_id, 'minutes=HTTP://m' || CASE WHEN page_id % 2 = 0 THEN ',zoom=https://z' ELSE '' END FROM pages WHERE url IS NULL OR NOT regexp_matches(lower(url), '^https?://')""")
def ordered_links(spark, sf):
    links = F.create_map(F.lit("zoom"), F.when(F.col("page_id") % 2 == 0, "https://z").otherwise("javascript:x"), F.lit("minutes"), F.lit("HTTP://m"), F.lit("agenda"), F.coalesce("url", F.lit("")))
    made = workqueue.ordered_links(links, ("agenda", "minutes"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(made, lambda x: F.concat_ws("=", x["kind"], x["url"])), ",").alias("links"))


# ---- timelines -----------------------------------------------------------------------------------------------------

SEGMENTS_SQL = """s AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id % 5 + 1)::DOUBLE AS len, CASE WHEN event_id % 6 = 0 THEN 'insert' ELSE 'source' END AS kind FROM events),
g AS (SELECT k, i, kind, sum(len) OVER w - len AS served_start, sum(len) OVER w AS served_end, CASE WHEN kind = 'source' THEN 'a' END AS source_id, CASE WHEN kind = 'source' THEN i * 10.0 END AS source_start, CASE WHEN kind = 'source' THEN i * 10 + len END AS source_end FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """An edit list for each user, made of the events."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("i")
    s = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("i"), (F.col("event_id") % 5 + 1).cast("double").alias("len"), F.when(F.col("event_id") % 6 == 0, "insert").otherwise("source").alias("kind"))
    end, own = F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("kind") == "source"
    return s.select("k", "i", "kind", (end - F.col("len")).alias("served_start"), end.alias("served_end"), F.when(own, "a").alias("source_id"), F.when(own, F.col("i") * 10.0).alias("source_start"), F.when(own, F.col("i") * 10 + F.col("len")).alias("source_end"))


@query(f"""WITH {SEGMENTS_SQL}, p AS (SELECT DISTINCT k, x::DOUBLE AS t FROM g, generate_series(0, 60, 3) v(x)), l AS (SELECT *, served_start = max(served_start) OVER (PARTITION BY k) AS last FROM g)
SELECT p.k, p.t, l.source_id, l.source_start + p.t - l.served_start AS source_t FROM p LEFT JOIN l ON l.k = p.k AND kind = 'source' AND p.t >= served_start AND (p.t < served_end OR (last AND p.t = served_end))""")
def served_to_source(spark, sf):
    g = segments(spark, sf)
    return timeline.to_source(g.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(3))).alias("t")).withColumn("t", F.col("t").cast("double")), g, ["k"], "t")


@query(f"""WITH {SEGMENTS_SQL}, p AS (SELECT DISTINCT k, 'a' AS source_id, x::DOUBLE AS t FROM g, generate_series(5, 95, 3) v(x)), l AS (SELECT *, source_start = max(source_start) OVER (PARTITION BY k) AS last FROM g WHERE kind = 'source')
SELECT p.k, p.source_id, p.t, min(CASE WHEN p.t >= source_start AND (p.t < source_end OR (last AND p.t = source_end)) THEN served_start + p.t - source_start END) AS served_t,
arg_max(served_end, source_start) FILTER (WHERE source_start <= p.t) AS before_t, arg_min(served_start, source_start) FILTER (WHERE source_start > p.t) AS after_t FROM p LEFT JOIN l ON l.k = p.k GROUP BY ALL""")
def source_to_served(spark, sf):
    g = segments(spark, sf)
    points = g.select("k").distinct().select("k", F.lit("a").alias("source_id"), F.explode(F.sequence(F.lit(5), F.lit(95), F.lit(3))).alias("t")).withColumn("t", F.col("t").cast("double"))
    return timeline.to_served(points, g, ["k"], "t")


@query(f"""WITH {SEGMENTS_SQL}, c AS (SELECT *, greatest(served_start, 4.5) AS a, least(served_end, 17.25) AS b FROM g WHERE greatest(served_start, 4.5) < least(served_end, 17.25))
SELECT k, coalesce(sum(b - a) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served_start, sum(b - a) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS served_end, kind, source_id, a + source_start - served_start AS source_start, b + source_start - served_start AS source_end FROM c""".replace("FROM c", "FROM (SELECT k, i, kind, source_id, source_start, a, b, c.served_start FROM c) c"))
def clipped_timeline(spark, sf):
    return timeline.clipped(segments(spark, sf).drop("i"), ["k"], F.lit(4.5), F.lit(17.25))


@query(f"""WITH {SEGMENTS_SQL}, p AS (SELECT k, i AS item, i * 10 + 1.0 AS a, i * 10 + 4.0 AS b FROM s), l AS (SELECT *, source_start = max(source_start) OVER (PARTITION BY k) AS last FROM g WHERE kind = 'source'),
m AS (SELECT p.k, p.item, min(CASE WHEN a >= source_start AND (a < source_end OR (last AND a = source_end)) THEN served_start + a - source_start END) AS x, arg_min(served_start, source_start) FILTER (WHERE source_start > a) AS nx,
min(CASE WHEN b >= source_start AND (b < source_end OR (last AND b = source_end)) THEN served_start + b - source_start END) AS y, arg_max(served_end, source_start) FILTER (WHERE source_start <= b) AS py FROM p JOIN l ON p.k = l.k GROUP BY ALL)
SELECT k, 'a' AS source_id, item, coalesce(x, nx) AS start, coalesce(y, py, 999.0) AS "end" FROM m WHERE coalesce(x, nx) IS NOT NULL""")
def remapped_items(spark, sf):
    g = segments(spark, sf)
    items = g.select("k", F.lit("a").alias("source_id"), F.col("i").alias("item"), (F.col("i") * 10 + 1.0).alias("start"), (F.col("i") * 10 + 4.0).alias("end"))
    return timeline.remapped(items, g, ["k"], F.lit(999.0), snap=True)


@query("""WITH x AS (SELECT user_id AS k, event_id, (event_id % 997)::DOUBLE AS a, (event_id % 997 + value / 4)::DOUBLE AS b FROM events), c AS (SELECT k, a, b FROM x WHERE b - a >= CASE WHEN a <= 0.001 OR b >= 999.999 THEN 1.0 ELSE 10.0 END),
r AS (SELECT k, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, a AS t FROM c UNION ALL SELECT k, max(b), 1000.0 FROM c GROUP BY 1), n AS (SELECT * FROM r WHERE t > f + 0.001)
SELECT k, f AS source_start, t AS source_end, round(coalesce(sum(t - f) OVER (PARTITION BY k ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) AS served_start, round(sum(t - f) OVER (PARTITION BY k ORDER BY f ROWS UNBOUNDED PRECEDING), 5) AS served_end FROM n""")
def keep_spans(spark, sf):
    quiet = table(spark, sf, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 997).cast("double").alias("start"), (F.col("event_id") % 997 + F.col("value") / 4).alias("end"))
    lengths = quiet.select("k").distinct().withColumn("duration", F.lit(1000.0))
    return timeline.keep_spans(quiet, lengths, ["k"]).withColumns({c: F.round(c, 5) for c in ("served_start", "served_end")})


@query("SELECT event_id FROM events WHERE NOT (value < 10 AND value < user_id % 20) AND NOT value > 60 - 10")
def edge_trim(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("start"))
    return timeline.without_edges(e, F.lit(60.0), 10.0, (F.col("user_id") % 20).cast("double")).select("event_id")


@query("SELECT event_id FROM events WHERE value + 5 >= 20 AND value <= 30")
def units_within(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("start"), (F.col("value") + 5).alias("end"))
    return timeline.units_within(e, F.lit(20.0), F.lit(30.0)).select("event_id")


@query("""WITH h AS (SELECT p_brand AS g, p_partkey AS k, xor(('0x' || left(md5(p_brand || p_size % 4), 12))::BIGINT, 1::BIGINT << (p_partkey % 40)::INT) AS h FROM part) SELECT a.g, a.k, count(*) AS n FROM h a JOIN h b ON a.g = b.g AND a.k <> b.k AND bit_count(xor(a.h, b.h)) <= 3 GROUP BY ALL HAVING count(*) >= 2""")
def recurring_pictures(spark, sf):
    shift = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p_partkey") % 40).cast("int"))
    h = F.conv(F.left(F.md5(F.concat("p_brand", (F.col("p_size") % 4).cast("string"))), F.lit(12)), 16, 10).cast("long").bitwiseXOR(shift)
    return timeline.recurring_hashes(table(spark, sf, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), h.alias("h")), ["g"], "k", "h", 3, 2)


# ---- limits --------------------------------------------------------------------------------------------------------

OBSERVED_SQL = "o AS (SELECT event_type AS scope, 'u' || user_id % 40 AS run, CASE event_id % 3 WHEN 0 THEN 'throughput' ELSE 'header' END AS source, value::BIGINT AS value, ts AS observed_at FROM events)"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("scope"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("run"), F.when(F.col("event_id") % 3 == 0, "throughput").otherwise("header").alias("source"), F.round("value").cast("long").alias("value"), F.col("ts").alias("observed_at"))


KEPT_SQL = f"""{OBSERVED_SQL.replace("value::BIGINT", "round(value)::BIGINT")}, b AS (SELECT scope, run, source, max({{'v': value, 't': observed_at}}) AS m FROM o WHERE observed_at <= '2024-01-25' AND observed_at >= TIMESTAMP '2024-01-25' - INTERVAL 20 DAY GROUP BY scope, run, source), c AS (SELECT scope, run, source, m.v AS value, m.t AS observed_at FROM b),
x AS (SELECT scope, run, max(observed_at) AS t FROM c GROUP BY scope, run), l AS (SELECT scope, run, row_number() OVER (PARTITION BY scope ORDER BY t DESC, run DESC) AS r FROM x), kept AS (SELECT c.* FROM c JOIN l USING (scope, run) WHERE r <= 6)"""


@query(f"WITH {KEPT_SQL} SELECT scope, run, source, value, epoch_us(observed_at) AS at FROM kept")
def limit_history(spark, sf):
    seen = observations(spark, sf)
    half = F.col("value") % 2 == 0
    return limits.kept_observations(seen.where(half), seen.where(~half), ["scope"], "2024-01-25", 20).select("scope", "run", "source", "value", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"))


@query(f"""WITH {KEPT_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY observed_at DESC, run DESC) AS back, CASE scope WHEN 'click' THEN 20 WHEN 'error' THEN 500 WHEN 'view' THEN 85 ELSE 100 END AS c FROM kept WHERE source = 'header')
SELECT scope, CASE WHEN max(value) * 5 > any_value(c) * 6 THEN 'offer_increase' WHEN count(*) >= 3 AND max(value) * 5 < any_value(c) * 4 AND bool_and(back > 3 OR value * 5 < c * 4) THEN 'tighten' ELSE 'unchanged' END AS action FROM h GROUP BY 1""")
def limit_changes(spark, sf):
    kept = limits.kept_observations(observations(spark, sf), observations(spark, sf).where("false"), ["scope"], "2024-01-25", 20).where("source = 'header'")
    told = kept.withColumn("configured", F.when(F.col("scope") == "click", 20).when(F.col("scope") == "error", 500).when(F.col("scope") == "view", 85).otherwise(100))
    return limits.limit_changes(told, ["scope"], ["scope"], ("header",), "configured").select("scope", "action")


@query("""WITH v AS (SELECT user_id, value / 20 AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events WHERE value / 20 BETWEEN 0.25 AND 4), q AS (SELECT user_id, count(*) AS n, quantile_disc(r, 0.75) AS p75, quantile_disc(r, 0.95) AS p95, quantile_disc(r, 0.99) AS p99 FROM v WHERE b <= 48 GROUP BY 1)
SELECT user_id, n, round(p75, 6) AS p75, round(p95, 6) AS p95, round(p99, 6) AS p99, round(CASE WHEN n < 40 THEN 1.1 ELSE least(4, greatest(0.25, greatest(0, 1 - n / 64) * 1.1 + (1 - greatest(0, 1 - n / 64)) * greatest(p95 * 1.2, p99))) END, 6) AS reserve FROM q""")
def calibration_ratios(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 20).alias("r"))
    made = limits.calibration(e, ["user_id"], "r", ["event_id"], 48, 40, 64, 1.1, (0.25, 4.0), 1.2)
    return made.withColumns({c: F.round(c, 6) for c in ("p75", "p95", "p99", "reserve")})


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS s, o_orderdate::DATE AS d FROM orders), a AS (SELECT *, d + 1 AS one, d + (CASE WHEN (8 - dayofweek(d)) % 7 = 0 THEN 7 ELSE (8 - dayofweek(d)) % 7 END)::INT AS mon FROM d), b AS (SELECT *, greatest(CASE WHEN mon = one THEN mon + 7 ELSE mon END, one + 1) AS two FROM a)
SELECT o_orderkey, (CASE WHEN s <= 1 THEN one WHEN s = 2 THEN two ELSE greatest((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE, two + 1) END)::VARCHAR AS until FROM b""")
def payment_backoff(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", limits.payment_backoff(F.col("o_orderkey") % 5, F.to_date("o_orderdate")).cast("string").alias("until"))


@query("SELECT event_id, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day, epoch_us(date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 30 HOUR) AS midnight FROM events")
def zoned_days(spark, sf):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", limits.zoned_day(at, "America/Chicago").alias("day"), F.unix_micros(limits.next_midnight(at, "America/Chicago")).alias("midnight"))


@query("SELECT l_orderkey, l_linenumber, greatest(0.0, l_quantity, l_discount * 500, CASE WHEN l_tax > 0.04 THEN l_tax * 600 END) AS at, count(*) AS n FROM lineitem GROUP BY ALL")
def earliest_start(spark, sf):
    made = limits.earliest_start(F.lit(0.0), {"minute": F.col("l_quantity"), "day": F.col("l_discount") * 500, "cost": F.when(F.col("l_tax") > 0.04, F.col("l_tax") * 600)})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", made["at"].alias("at")).groupBy("l_orderkey", "l_linenumber", "at").agg(F.count("*").alias("n"))


LEDGER_SQL = "x AS (SELECT event_type AS route, ts::DATE AS day, user_id AS owner, sum(value) FILTER (WHERE event_id % 3 > 0) AS r, sum(value) FILTER (WHERE event_id % 3 = 0) AS s FROM events GROUP BY ALL), b AS (SELECT route, day, sum(coalesce(s, 0)) AS used, sum(CASE WHEN s IS NULL THEN coalesce(r, 0) ELSE 0 END) AS reserved, count(*) FILTER (WHERE s IS NULL) AS open FROM x GROUP BY ALL)"


def ledger_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("route"), F.col("user_id").alias("owner"), F.when(F.col("event_id") % 3 > 0, "reserve").otherwise("settle").alias("kind"), "value", "ts")
    return limits.settled_ledger(e, ["route"], "owner", "kind", "value", "ts", [F.to_date("ts").alias("day")])


@query(f"WITH {LEDGER_SQL} SELECT route, day::VARCHAR AS day, round(used, 4) AS used, round(reserved, 4) AS reserved, open FROM b")
def budget_ledger(spark, sf):
    return ledger_of(spark, sf).select("route", F.col("day").cast("string").alias("day"), F.round("used", 4).alias("used"), F.round("reserved", 4).alias("reserved"), "open")


@query(f"WITH {LEDGER_SQL} SELECT c_custkey, route, c_acctbal / 10 + used + reserved <= 2000 AS fits FROM customer, b WHERE day = '2024-01-10' AND c_custkey % 5 = CASE route WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END")
def within_budget(spark, sf):
    held = ledger_of(spark, sf).where("day = '2024-01-10'").select("route", F.col("used").alias("cost_used"), F.col("reserved").alias("cost_reserved"), F.lit(2000.0).alias("cost_limit"))
    place = F.expr("CASE route WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END")
    asks = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 10).alias("ask"), (F.col("c_custkey") % 5).alias("p")).join(held.select("route", place.alias("p")), "p").select("c_custkey", "ask", "route")
    return limits.within_budget(held, ["route"], asks, {"cost": "ask"}).select("c_custkey", "route", "fits")


@query("""WITH i AS (SELECT user_id, event_id, (event_type IN ('error', 'view'))::INT AS bad, sum(1 - (event_type IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events), s AS (SELECT event_id, sum(bad) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i)
SELECT event_id, streak, CASE WHEN streak < 2 THEN 0 WHEN streak = 2 THEN 60 WHEN streak = 3 THEN 300 ELSE 3600 END AS pause FROM s""")
def route_ladder(spark, sf):
    made = limits.route_ladder(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type").isin("error", "view"), 2, [60, 300, 3600])
    return made.select("event_id", "streak", "pause")


@query("WITH r AS (SELECT l_returnflag || l_linestatus AS model, sum(greatest(l_quantity - l_tax * 600, 0)) AS x FROM lineitem GROUP BY 1) SELECT model, round(x, 4) AS left, rank() OVER (ORDER BY x DESC, model)::INT AS place FROM r")
def models_by_capacity(spark, sf):
    r = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), "l_quantity", (F.col("l_tax") * 600).alias("used"))
    return limits.by_capacity(r, "model", "l_quantity", "used").withColumn("left", F.round("left", 4))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < '2024-01-10' ORDER BY ts, event_id LIMIT 1000)")
def retention_prune(spark, sf):
    return limits.pruned(table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-01-10", ["event_id"], 1000).select("event_id")


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 100) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def empty_groups(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return limits.empty_groups(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", 20, 100)


# ---- people and tags -----------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey % 9 AS body, 'clerk ' || o_custkey AS k, min(o_orderdate) AS f, max(o_orderdate) AS l, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'staff' ELSE 'member' END, o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS sec FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), r AS (SELECT c_custkey % 9 AS body, 'clerk ' || c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(s.body, r.body) AS body, coalesce(s.k, r.k) AS name_key, CASE WHEN r.k IS NOT NULL THEN '1990-01-01' ELSE f::DATE::VARCHAR END AS first_seen, coalesce(l::DATE::VARCHAR, '1990-01-01') AS last_seen, CASE WHEN r.k IS NOT NULL THEN 'active' ELSE 'probable' END AS status FROM s FULL JOIN r ON s.k = r.k""")
def observed_attendance(spark, sf):
    key = lambda c: F.concat(F.lit("clerk "), F.col(c))
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    registry = table(spark, sf, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") % 9).alias("body"), key("c_custkey").alias("name_key"), key("c_custkey").alias("name"), start.alias("first_seen"), start.alias("last_seen"), F.lit(None).cast("string").alias("section"), F.lit("active").alias("status"))
    seen = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select((F.col("o_custkey") % 9).alias("body"), F.concat(F.lit(" CLERK  "), F.col("o_custkey")).alias("name"), F.col("o_orderdate").alias("seen_at"), F.when(F.col("o_orderstatus") == "O", "staff").when(F.col("o_orderstatus") == "F", "member").alias("section"))
    return people.observed(registry, seen, ["body"]).select("body", "name_key", F.to_date("first_seen").cast("string").alias("first_seen"), F.to_date("last_seen").cast("string").alias("last_seen"), "status")


@query("SELECT o_orderkey, CASE WHEN epoch_us(TIMESTAMP '1998-08-01') - epoch_us(o_orderdate) > 365 * 86400000000 THEN 'review_only' WHEN o_custkey % 3 > 0 THEN 'active' ELSE 'probable' END AS status FROM orders")
def membership_status(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", people.membership(F.col("o_orderdate"), "1998-08-01", 365, F.col("o_custkey") % 3).alias("status"))


@query("SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2) ON c_custkey = o_custkey WHERE c_custkey % 3 = 0")
def qualified_profiles(spark, sf):
    who = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("probable").alias("status"))
    refs = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("recipe"), F.col("o_orderpriority").alias("meeting"))
    return people.qualified(who, refs, "c_custkey", "O", 2)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_custkey % 4 < 2")
def body_members(spark, sf):
    who = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.element_at(F.array(*[F.lit(x) for x in ("active", "probable", "review_only", "left")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"))
    return people.members(who, F.col("c_nationkey") == 3).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def roster_people(spark, sf):
    s = table(spark, sf, "supplier")
    registry = s.select("s_suppkey", F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), F.col("s_suppkey"))).alias("aliases"))
    roster = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("  "), F.upper("s_name")).alias("name")).unionByName(s.where("s_suppkey % 5 = 0").select(F.concat(F.lit("Alias  "), F.col("s_suppkey")).alias("name")))
    return people.roster_ids(registry, roster, "s_suppkey")


@query("SELECT p_brand AS cluster, p_name AS name_key, min(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END) AS name, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS signals, count(*) AS n FROM part GROUP BY ALL")
def fused_proposals(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("spoken"), "p_type")
    return people.fused(p, "cluster", "spoken", "p_type").withColumn("signals", F.array_join("signals", "|"))


@query("""WITH r AS (SELECT l_suppkey % 20 AS body, l_orderkey AS m, l_partkey AS p FROM lineitem), f AS (SELECT body, p, min(m) AS f FROM r GROUP BY ALL), e AS (SELECT body, m, bool_or(f < m) AS known FROM r JOIN f USING (body, p) GROUP BY ALL)
SELECT body, m FROM e WHERE NOT known AND m > (SELECT min(m) FROM r WHERE r.body = e.body)""")
def rosters_without_known(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("body"), F.col("l_orderkey").alias("m"), F.col("l_orderkey").alias("at"), F.col("l_partkey").alias("p"))
    return people.without_common_members(r, ["body"], "m", "at", "p")


@query("""WITH a AS (SELECT o_orderkey AS k, 't' || o_custkey % 3 AS id FROM orders), b AS (SELECT o_orderkey AS k, 't' || o_custkey % 2 AS id FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.id, b.id) AS id, CASE WHEN a.k IS NULL THEN 'llm' ELSE 'rule' END AS source, CASE WHEN a.k IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN b.k IS NULL THEN 'r' WHEN a.k IS NULL THEN 'x,r' ELSE 'r,x' END AS evidence FROM a FULL JOIN b ON a.k = b.k AND a.id = b.id""")
def merged_tags(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    tag = lambda df, m, source, confidence, evidence: df.select("k", F.concat(F.lit("t"), F.col("o_custkey") % m).alias("id"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.array(*[F.lit(e) for e in evidence]).alias("evidence"))
    made = people.merged_tags(tag(o, 3, "rule", 1.0, ["r"]), tag(o.where("k % 3 > 0"), 2, "llm", 0.5, ["x", "r"]), ["k"])
    return made.withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH t AS (SELECT l_orderkey AS k, 't' || l_partkey % 4 AS id, l_linenumber AS chapter, CASE WHEN l_suppkey % 5 = 0 THEN 'rule' ELSE 'llm' END AS source, l_discount AS c FROM lineitem)
SELECT k, id, CASE WHEN bool_or(source = 'rule') THEN 'rule' ELSE 'llm' END AS source, CASE WHEN bool_or(source = 'rule') THEN 1.0 ELSE max(c) END AS confidence, count(DISTINCT chapter) AS chapters, CASE id WHEN 't2' THEN 0 WHEN 't0' THEN 1 WHEN 't1' THEN 2 END AS ordinal FROM t GROUP BY ALL""")
def rolled_up_tags(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("t"), F.col("l_partkey") % 4).alias("id"), F.when(F.col("l_suppkey") % 5 == 0, "rule").otherwise("llm").alias("source"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("chapter"))
    taxonomy = spark.createDataFrame([("t2", 0), ("t0", 1), ("t1", 2)], "id string, ordinal int")
    return people.rolled_up(t, ["k"], taxonomy)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'shadow' WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'admitted' ELSE 'admitted_text_only' END ELSE 'shadow' END AS admission, o_orderkey % 4 = 2 AS display, CASE o_orderkey % 4 WHEN 2 THEN 'manual-good' WHEN 3 THEN 'manual-only' ELSE 'manual' END AS reason FROM orders")
def admissions(spark, sf):
    word = F.element_at(F.array(F.lit("reject"), F.lit("BORDERLINE"), F.lit("good"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", people.admission(word, F.col("o_custkey") % 2 == 0).alias("a")).select("o_orderkey", "a.*")


@query("SELECT l_orderkey, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def best_quotes(spark, sf):
    q = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("score"), "l_linenumber", (F.col("l_returnflag") == "N").alias("display"))
    return people.best_quote(q, ["l_orderkey"], "score", ["l_linenumber"]).select("l_orderkey", "score")


@query("SELECT l_partkey AS member, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def disputed_members(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("member"), F.col("l_suppkey").cast("string").alias("grp"))
    return people.disputed(m, "grp", "member").withColumn("groups", F.array_join("groups", ","))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders o WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey) AND o_custkey % 10 = 0)")
def selected_records(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    first = o.groupBy("o_custkey").agg(F.min("k").alias("first"))
    groups = o.where("o_custkey % 10 = 0").join(first, "o_custkey").select(F.col("o_custkey").alias("group"), "k", (F.col("k") == F.col("first")).alias("preferred"))
    return people.selected(o.select("k"), groups, "k")


@query("""WITH r AS (SELECT o_custkey % 50 AS e, o_orderkey % 97 AS u, o_orderstatus = 'F' AS ok, o_orderdate AS t, o_orderkey AS s FROM orders), p AS (SELECT e, u, count(*) AS n, count(*) FILTER (WHERE ok) AS k, max(s) FILTER (WHERE ok) AS sole, max(t) AS m FROM r GROUP BY e, u)
SELECT p.e, p.u, CASE WHEN k = 1 THEN sole WHEN (SELECT count(*) FROM r WHERE r.e = p.e AND r.u = p.u AND r.t = p.m) = 1 THEN (SELECT min(s) FROM r WHERE r.e = p.e AND r.u = p.u AND r.t = p.m) END AS keep FROM p WHERE n > 1""")
def canonical_copies(spark, sf):
    r = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("e"), (F.col("o_orderkey") % 97).alias("u"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("s"))
    return people.canonical_copies(r, "e", "u", "ok", "at", "s")


# ---- quotes and scores ---------------------------------------------------------------------------------------------

TALK_SQL = "c AS (SELECT conv_id AS k, turn AS seq, turn * 10.0::DOUBLE AS s, turn * 10 + 9.0::DOUBLE AS e, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS x FROM conversations)"


def talk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("seq"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10 + 9.0).alias("end"), "text")


@query(f"""WITH {TALK_SQL}, w AS (SELECT k, string_agg(x, ' ' ORDER BY seq) AS w FROM c WHERE x <> '' GROUP BY 1), p AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) - length(x) AS a FROM c WHERE x <> ''),
q AS (SELECT DISTINCT k, seq AS quote_id, right(x, 30) AS q FROM c WHERE length(x) > 30), f AS (SELECT q.*, strpos(w, q) AS f FROM q JOIN w USING (k))
SELECT f.k, f.quote_id, arg_min(s, a) AS start, arg_max(e, a) AS "end" FROM f JOIN p ON p.k = f.k AND f <= a + length(x) - 1 AND f + length(q) - 1 >= a - 1 GROUP BY ALL""")
def transcript_regions(spark, sf):
    t = talk(spark, sf)
    asked = t.withColumn("x", quotes.plain(F.col("text"))).where(F.length("x") > 30).select("k", F.col("seq").alias("quote_id"), F.substring("x", -30, 30).alias("quote")).dropDuplicates(["k", "quote_id"])
    return quotes.transcript_region(asked, t, ["k"]).select("k", "quote_id", "start", "end")


@query("""WITH w AS (SELECT l_quantity AS s, l_quantity + l_discount * 100 AS e, l_orderkey, l_linenumber FROM lineitem), a AS (SELECT *, greatest(0, s - 2) AS a0, least(60, e + 2) AS b0 FROM w), b AS (SELECT *, CASE WHEN 8 - (b0 - a0) > 0 THEN greatest(0, a0 - (8 - (b0 - a0)) / 2) ELSE a0 END AS a1 FROM a),
c AS (SELECT *, CASE WHEN 8 - (b0 - a0) > 0 THEN least(60, a1 + 8) ELSE b0 END AS b2 FROM b), d AS (SELECT *, CASE WHEN 8 - (b0 - a0) > 0 THEN greatest(0, b2 - 8) ELSE a1 END AS a2 FROM c)
SELECT l_orderkey, l_linenumber, round(CASE WHEN b2 - a2 >= 8 AND b2 - a2 <= 12 THEN a2 END, 6) AS a, round(CASE WHEN b2 - a2 >= 8 AND b2 - a2 <= 12 THEN b2 END, 6) AS b, count(*) AS n FROM d GROUP BY ALL""")
def clip_windows(spark, sf):
    w = quotes.clip_window(F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount") * 100, F.lit(0.0), F.lit(60.0), 2.0, 8.0, 12.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(w["start"], 6).alias("a"), F.round(w["end"], 6).alias("b")).groupBy("l_orderkey", "l_linenumber", "a", "b").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id AS k, value AS s, value + 8 AS e, event_type AS who FROM events WHERE event_id % 4 = 1), q AS (SELECT user_id AS k, event_id AS quote_id, value AS s, value + 3 AS e FROM events WHERE event_id % 4 = 0)
SELECT q.k, q.quote_id, CASE WHEN count(t.k) = 1 THEN any_value(who) END AS speaker FROM q LEFT JOIN t ON t.k = q.k AND t.s <= q.s AND t.e >= q.e GROUP BY ALL""")
def quote_speakers(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("user_id"))
    turns = e.where("event_id % 4 = 1").select("k", F.col("value").alias("start"), (F.col("value") + 8).alias("end"), F.lit(False).alias("overlap"), F.col("event_type").alias("speaker"), F.lit("confirmed").alias("status"))
    asked = e.where("event_id % 4 = 0").select("k", F.col("event_id").alias("quote_id"), F.col("value").alias("start"), (F.col("value") + 3).alias("end"))
    return quotes.quote_attribution(asked, turns, ["k"]).select("k", "quote_id", "speaker")


@query("""WITH u AS (SELECT conv_id AS k, turn, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')), ' ') AS w FROM conversations), g AS (SELECT k, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM u), c AS (SELECT k, turn, gram, 1 + ln(count(*)) AS tf FROM g GROUP BY k, turn, gram),
n AS (SELECT k, count(*) AS n FROM u GROUP BY 1), d AS (SELECT k, gram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM c JOIN n USING (k) GROUP BY k, gram), v AS (SELECT k, turn, gram, tf * idf AS w FROM c JOIN d USING (k, gram)), m AS (SELECT k, turn, sqrt(sum(w * w)) AS m FROM v GROUP BY k, turn)
SELECT a.k, a.turn AS item, b.turn AS unit, round(sum(a.w * b.w) / (any_value(p.m) * any_value(q.m)), 5) AS score FROM v a JOIN v b ON a.k = b.k AND a.gram = b.gram AND a.turn = 0 JOIN m p ON p.k = a.k AND p.turn = a.turn JOIN m q ON q.k = b.k AND q.turn = b.turn GROUP BY a.k, a.turn, b.turn""")
def tfidf_rows(spark, sf):
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")), " ")
    u = table(spark, sf, "conversations").select(F.col("conv_id").alias("k"), "turn", words.alias("words"))
    return quotes.tfidf_scores(u.where("turn = 0").withColumnRenamed("turn", "item"), u.withColumnRenamed("turn", "unit"), ["k"]).withColumn("score", F.round("score", 5))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS u, max(l_discount) AS s, max(l_tax) AS t FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, u) AS x, row_number() OVER (PARTITION BY k ORDER BY t DESC, u) AS y FROM a)
SELECT DISTINCT k, unnest(range(greatest(u - 1, 0), u + 2)) AS u FROM r WHERE x = 1 OR y = 1""")
def ranked_neighbours(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("u"), "l_discount", "l_tax")
    a = spread(rows, rows.count(), "k").groupBy("k", "u").agg(F.max("l_discount").alias("s"), F.max("l_tax").alias("t"))
    return quotes.with_neighbours([a.select("k", "u", "s"), a.select("k", "u", F.col("t").alias("s"))], ["k"], "u", "s", 1, 1).select("k", F.col("u").cast("long").alias("u"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 7 AS s FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k, o_orderkey % 5 AS s FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'AND' AS how, k, (a.s + b.s)::BIGINT AS s FROM a JOIN b USING (k) UNION ALL SELECT 'OR', k, (coalesce(a.s, 0) + coalesce(b.s, 0))::BIGINT FROM a FULL JOIN b USING (k) UNION ALL SELECT 'AND_NOT', k, s::BIGINT FROM a WHERE k NOT IN (SELECT k FROM b)""")
def combined_results(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    sets = [o.where("k % 2 = 0").withColumn("s", F.col("k") % 7), o.where("k % 3 = 0").withColumn("s", F.col("k") % 5)]
    out = [quotes.combined(sets, how, "k", "s").select(F.lit(how).alias("how"), "k", F.col("s").cast("long").alias("s")) for how in ("AND", "OR", "AND_NOT")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT o_orderkey, least(o_custkey % 7, floor((o_orderkey % 40) * (o_custkey % 7 + 1) / 40))::INT AS chapter FROM orders")
def chapter_by_page(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", quotes.share_of_pages(F.col("o_orderkey") % 40, F.lit(40), F.col("o_custkey") % 7 + 1).alias("chapter"))


@query("SELECT p_partkey, contains(' ' || p_name || ' ', ' ring ') AS hit FROM part")
def title_matches(spark, sf):
    return table(spark, sf, "part").select("p_partkey", quotes.title_matches(F.concat(F.lit("1. "), F.upper("p_name"), F.lit("!")), F.lit("Ring")).alias("hit"))


# ---- judgments -----------------------------------------------------------------------------------------------------

JUDGED_SQL = """j AS (SELECT o_orderkey // 8 AS subject, 'm' || o_custkey % 5 AS model, 'q' || o_orderkey % 2 || CASE WHEN o_orderkey % 3 = 0 THEN '_s' ELSE '' END AS question, 't' AS tier, CASE (o_orderkey // 2) % 4 WHEN 0 THEN 'sibling' WHEN 1 THEN 'adjudicator' WHEN 2 THEN 'audit' ELSE 'anchor' END AS role,
CASE WHEN o_orderkey % 3 = 0 THEN 'stability' ELSE 'routine' END AS sample, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice > 150000 END AS said, o_orderstatus <> 'P' AS quote_valid, o_orderdate::DATE::VARCHAR AS judged_at, 'k' || (o_orderkey // 8) % 3 AS task FROM orders)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(k / 2) % len(names) + 1).cast("int"))
    return table(spark, sf, "orders").select(F.floor(k / 8).alias("subject"), F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("model"), F.concat(F.lit("q"), k % 2, F.when(k % 3 == 0, "_s").otherwise("")).alias("question"), F.lit("t").alias("tier"), pick("sibling", "adjudicator", "audit", "anchor").alias("role"),
        F.when(k % 3 == 0, "stability").otherwise("routine").alias("sample"), F.when(k % 11 > 0, F.col("o_totalprice") > 150000).alias("said"), (F.col("o_orderstatus") != "P").alias("quote_valid"), F.to_date("o_orderdate").cast("string").alias("judged_at"), F.concat(F.lit("k"), F.floor(k / 8) % 3).alias("task"), "o_orderkey")


@query(f"""WITH {JUDGED_SQL}, a AS (SELECT model, NOT quote_valid AS bad FROM j WHERE role IN ('sibling', 'adjudicator')), f AS (SELECT subject, model, question, tier, any_value(said) AS first, count(*) AS c FROM j WHERE sample = 'routine' GROUP BY ALL),
b AS (SELECT s.model, s.said <> f.first AS bad FROM j s JOIN f ON s.subject = f.subject AND s.model = f.model AND regexp_replace(s.question, '_s$', '') = f.question AND f.c = 1 WHERE s.sample = 'stability' AND s.said IS NOT NULL AND f.first IS NOT NULL)
SELECT model, round(avg(bad::INT), 6) AS noise, count(*) AS n FROM (FROM a UNION ALL FROM b) GROUP BY 1""")
def judge_noise(spark, sf):
    """First answers that are given twice are left out, as either could be the first."""
    j = judged(spark, sf)
    twice = j.where("sample = 'routine'").groupBy("subject", "model", "question", "tier").agg(F.count("*").alias("c")).where("c > 1").drop("c").withColumn("twice", F.lit(True))
    once = j.join(twice, ["subject", "model", "question", "tier"], "left").withColumn("sample", F.when(F.col("twice"), "repeated").otherwise(F.col("sample")))
    return judging.judge_noise(once).withColumn("noise", F.round("noise", 6))


@query(f"""WITH {JUDGED_SQL}, a AS (SELECT task, subject, question, arg_min(said, judged_at) AS a, count(*) AS n FROM j WHERE role = 'audit' AND said IS NOT NULL AND judged_at >= '1995-01-01' GROUP BY ALL), b AS (SELECT task, subject, question, arg_max(said, judged_at) AS b FROM j WHERE role = 'adjudicator' AND said IS NOT NULL GROUP BY ALL)
SELECT task, count(*) AS n FROM a JOIN b USING (task, subject, question) WHERE a <> b GROUP BY 1""")
def judge_disagreements(spark, sf):
    return judging.disagreements(judged(spark, sf).withColumn("subject", F.col("subject")), "1995-01-01")


@query(f"""WITH {JUDGED_SQL} SELECT model FROM (SELECT model, min(judged_at || '-' || subject) AS t FROM j WHERE role <> 'audit' AND model <> 'm0' GROUP BY 1 ORDER BY t DESC LIMIT 1)""")
def newest_judge(spark, sf):
    """With the subject in the time's place, which has no ties."""
    j = judged(spark, sf).where("model <> 'm0'").withColumn("own_t", F.concat_ws("-", "judged_at", "subject"))
    first = j.where("role <> 'audit'").groupBy("model").agg(F.min("own_t").alias("t"))
    placed = first.withColumn("judged_at", F.date_add(F.lit("2026-01-01").cast("date"), F.row_number().over(_by("t"))).cast("string"))
    return judging.newest_judge(placed.withColumn("role", F.lit("sibling")), "2026-01-08")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


@query("""SELECT o_orderpriority AS task, 'decision' AS kind, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, 'flag', f, count(*) FROM (SELECT o_orderpriority, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['late'] WHEN 1 THEN ['late', 'early'] ELSE [] END) AS f FROM orders) GROUP BY ALL""")
def evidence_summary(spark, sf):
    k = F.col("o_orderkey") % 3
    flags = F.when(k == 0, F.array(F.lit("late"))).when(k == 1, F.array(F.lit("late"), F.lit("early"))).otherwise(F.array().cast("array<string>"))
    return judging.evidence_summary(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), "o_orderstatus", flags.alias("flags")), ["task"], "o_orderstatus", "flags")


@query("""WITH t AS (SELECT l_suppkey AS route, round(l_discount - l_tax, 4) AS m, CASE l_partkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'other' ELSE 'tie' END AS w FROM lineitem), a AS (SELECT route, count(*) FILTER (WHERE w = 'one') AS wins, count(*) FILTER (WHERE w = 'other') AS losses, avg(m) AS mm FROM t GROUP BY 1)
SELECT route, wins, losses, round(mm, 6) AS mean_margin, CASE WHEN wins - losses >= 8 THEN 'keep' WHEN wins - losses <= -8 THEN 'switch' WHEN mm >= 0.0123 THEN 'keep' WHEN mm <= -0.0123 THEN 'switch' ELSE 'undecided' END AS decision FROM a""")
def quality_routes(spark, sf):
    margin = judging.signed_margin(F.create_map(F.lit("aligned"), F.col("l_discount"), F.lit("challenger"), F.col("l_tax")), "aligned", "challenger")
    k = F.col("l_partkey") % 3
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("route"), margin.alias("m"), F.when(k == 0, "one").when(k == 1, "other").otherwise("tie").alias("w"))
    return judging.routing(rows, ["route"], "m", "w", 8, 0.0123).withColumn("mean_margin", F.round("mean_margin", 6))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS a, l_extendedprice AS b FROM lineitem) SELECT a, b FROM p WHERE a IN (SELECT a FROM p GROUP BY 1 HAVING count(*) = 1) AND b IN (SELECT b FROM p GROUP BY 1 HAVING count(*) = 1)""")
def unique_matches(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_extendedprice").alias("b"))
    return judging.unique_matches(p, "a", "b")


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY 1")
def upper_medians(spark, sf):
    return judging.upper_median(table(spark, sf, "events"), ["event_type"], "value")


@query("""SELECT c_custkey, instr('13579bdf', right(sha1(c_name), 1)) > 0 AS swapped FROM customer""")
def blind_order(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", judging.is_swapped(F.col("c_name")).alias("swapped"))


@query(f"""WITH {TALK_SQL}, h AS (SELECT DISTINCT k, x AS chapter, x * 25.0 AS a, CASE WHEN x < 2 THEN x * 25.0 + 25 END AS b FROM c, generate_series(0, 2) g(x)) SELECT c.k, chapter, md5(string_agg(coalesce(t.text, ''), ' ' ORDER BY seq)) AS mark
FROM c JOIN conversations t ON t.conv_id = c.k AND t.turn = c.seq JOIN h ON h.k = c.k AND s >= a AND (b IS NULL OR s < b) GROUP BY ALL""".replace("x AS chapter, x * 25.0 AS a, CASE WHEN x < 2 THEN x * 25.0 + 25 END AS b FROM c, generate_series(0, 2) g(x)", "g AS chapter, g * 25.0 AS a, CASE WHEN g < 2 THEN g * 25.0 + 25 END AS b FROM c, generate_series(0, 2) v(g)"))
def chapter_texts(spark, sf):
    t = talk(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    starts = t.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("chapter"))
    marks = starts.select("k", "chapter", (F.col("chapter") * 25.0).alias("start"), F.when(F.col("chapter") < 2, F.col("chapter") * 25.0 + 25).alias("end"))
    return judging.chapter_texts(t, marks, ["k"]).select("k", "chapter", F.md5("text").alias("mark"))
