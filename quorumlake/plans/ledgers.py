"""Queries of budgets, cells, derived tables, canonical keys and stable ids, with the SQL that DuckDB runs for them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.functions import canonical, quotes
from quorumlake.operators import bodies, budget, cells, identity, lanes, normalize
from quorumlake.plans.catalog import query
from quorumlake.plans.search import QUERIES, SQL
from quorumlake.sources.readers import table
from quorumlake.sources.scratch import written

__all__ = ["QUERIES", "SQL"]


def _used(axis: str, window: str) -> str:
    name = f"{axis}_{window}"
    return f"s_{name} - least(0, min(s_{name}) OVER (PARTITION BY route, {window} ORDER BY n ROWS UNBOUNDED PRECEDING))"


def _moved(axis: str, window: str, same: str) -> str:
    return f"sum(CASE WHEN kind = 'reserve' THEN coalesce({axis}, 0) WHEN kind = 'settle' AND {same} THEN coalesce({axis} - {axis}0, 0) ELSE 0 END) OVER (PARTITION BY route, {window} ORDER BY n ROWS UNBOUNDED PRECEDING) AS s_{axis}_{window}"


@query(f"""WITH e AS (SELECT user_id % 20 AS route, event_id AS n, 'o' || (event_id % 7) AS owner, ['reserve', 'settle', 'ask', 'settle', 'reserve'][event_id * 3 % 11 % 5 + 1] AS kind, ts AS moment, event_id % 4 AS requests, CASE WHEN event_id % 9 <> 1 THEN event_id * 13 % 500 END AS tokens FROM events),
c AS (SELECT *, lag(kind) OVER (PARTITION BY route, owner ORDER BY n) AS last FROM e WHERE kind <> 'ask'), g AS (SELECT *, lag(requests) OVER w AS requests0, lag(tokens) OVER w AS tokens0, lag(moment) OVER w AS at0 FROM c WHERE (kind = 'reserve') = (last IS DISTINCT FROM 'reserve') WINDOW w AS (PARTITION BY route, owner ORDER BY n)),
a AS (SELECT *, moment::DATE AS day, date_trunc('month', moment) AS month FROM (SELECT * FROM g UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM e WHERE kind = 'ask')),
s AS (SELECT *, {_moved("requests", "day", "moment::DATE = at0::DATE")}, {_moved("tokens", "day", "moment::DATE = at0::DATE")}, {_moved("requests", "month", "date_trunc('month', moment) = date_trunc('month', at0)")}, {_moved("tokens", "month", "TRUE")} FROM a),
u AS (SELECT route, n, kind, requests, tokens, {_used("requests", "day")} AS rd, {_used("tokens", "day")} AS td, {_used("requests", "month")} AS rm, {_used("tokens", "month")} AS tm FROM s)
SELECT route, n, rd::BIGINT AS used_requests_day, td::BIGINT AS used_tokens_day, rm::BIGINT AS used_requests_month, tm::BIGINT AS used_tokens_month, CASE WHEN kind = 'ask' THEN rd + coalesce(requests, 0) <= 4 AND tm + coalesce(tokens, 0) <= 6000 END AS fits FROM u""")
def budget_replay(spark, sf):
    """Events as reservations, settlements and asks of twenty routes, by day and month."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("reserve", "settle", "ask", "settle", "reserve")]), (k * 3 % 11 % 5 + 1).cast("int"))
    log = table(spark, sf, "events").select((F.col("user_id") % 20).alias("route"), k.alias("n"), F.concat(F.lit("o"), k % 7).alias("owner"), kind.alias("kind"), F.col("ts").alias("at"), (k % 4).alias("requests"), F.when(k % 9 != 1, k * 13 % 500).alias("tokens"))
    windows = {"day": F.to_date("at"), "month": F.date_trunc("month", "at")}
    told = budget.replay(log, ["route"], ["n"], windows, ["day"], {"requests_day": 4, "tokens_month": 6000})
    return told.select("route", "n", "used_requests_day", "used_tokens_day", "used_requests_month", "used_tokens_month", "fits")


@query("""WITH e AS (SELECT user_id % 50 AS k, event_id AS n, CASE WHEN event_id % 5 > 0 THEN event_id % 600 END AS status, CASE WHEN event_id % 3 > 0 THEN event_id % 9 - 2 END AS sent, CASE WHEN event_id % 4 > 1 THEN event_id % 700 END AS output FROM events)
SELECT k, count(*) AS count, (list(status ORDER BY n DESC))[1]::INT AS last_status, max(n) AS last_seen, (list(sent ORDER BY n DESC) FILTER (WHERE sent > 0))[1] AS last_sent, (list(output ORDER BY n DESC) FILTER (WHERE output >= 0))[1] AS last_output, CASE WHEN count(*) > 1 THEN coalesce(max(output), 0) ELSE max(output) END AS max_output FROM e GROUP BY k""")
def failure_cells(spark, sf):
    """Two thirds of the events folded into cells, and then the last third into those."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("k"), k.alias("n"), k.alias("seen"), F.when(k % 5 > 0, k % 600).cast("int").alias("status"), F.when(k % 3 > 0, k % 9 - 2).alias("sent"), F.when(k % 4 > 1, k % 700).alias("output"))
    late = e.agg(F.max("n") * 2 / 3).first()[0] or 0
    none = spark.createDataFrame([], "k long, count long, last_status int, last_seen long, last_sent long, last_output long, max_output long")
    return cells.failure_cells(cells.failure_cells(none, e.where(F.col("n") <= late), ["k"], "n"), e.where(F.col("n") > late), ["k"], "n")


@query("""SELECT event_type, count(*) AS calls, max(value) AS most, list(event_id ORDER BY event_id)[:7] AS samples FROM events GROUP BY event_type""")
def usage_cells(spark, sf):
    """Events as cells of one call each; a kind's first seven are its samples."""
    e = table(spark, sf, "events")
    fresh = e.select("event_type", F.col("event_id").alias("n"), F.lit(1).cast("long").alias("calls"), F.col("value").alias("most"), F.array("event_id").alias("samples"))
    half = e.agg(F.max("event_id") / 2).first()[0] or 0
    none = fresh.drop("n").limit(0)
    first = cells.usage_cells(none, fresh.where(F.col("n") <= half), ["event_type"], "n", ["calls"], ["most"], ["samples"], 7)
    return cells.usage_cells(first, fresh.where(F.col("n") > half), ["event_type"], "n", ["calls"], ["most"], ["samples"], 7)


@query("""WITH b AS (SELECT o_orderkey AS job, o_orderkey % 5 AS priority, o_orderdate AS created, CASE WHEN o_orderkey % 4 > 0 THEN ['A', 'R'] END AS models FROM orders)
SELECT l_orderkey AS job, l_linenumber AS line, l_returnflag AS model, CASE WHEN job % 3 = 0 AND job % 5 <> 3 AND (models IS NULL OR (list_contains(models, l_returnflag) AND own = b.priority AND since = b.created)) THEN 3 ELSE own END AS priority
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 9 ELSE l_orderkey % 5 END AS own, CASE WHEN l_linenumber = 4 THEN DATE '1990-01-01' ELSE o_orderdate END AS since FROM lineitem JOIN orders ON o_orderkey = l_orderkey) JOIN b ON job = l_orderkey""")
def synced_priorities(spark, sf):
    """Order lines as an index of jobs; every third order's priority becomes 3."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    before = orders.select(k.alias("job"), (k % 5).alias("priority"), F.col("o_orderdate").alias("created"), F.when(k % 4 > 0, F.array(F.lit("A"), F.lit("R"))).alias("models"))
    after = before.withColumn("priority", F.when(F.col("job") % 3 == 0, F.lit(3)).otherwise(F.col("priority")))
    line = F.col("l_linenumber")
    index = table(spark, sf, "lineitem").join(orders.select(k.alias("l_orderkey"), "o_orderdate"), "l_orderkey").select(F.col("l_orderkey").alias("job"), line.alias("line"), F.col("l_returnflag").alias("model"), F.when(line % 3 == 0, F.lit(9)).otherwise(F.col("l_orderkey") % 5).alias("priority"), F.when(line == 4, F.lit("1990-01-01").cast(orders.schema["o_orderdate"].dataType)).otherwise(F.col("o_orderdate")).alias("created"))
    return cells.synced_priorities(index, before, after).drop("created")


@query("""SELECT o_orderkey, 'ch-' || left(sha1('{"index":' || o_orderkey || ',"start":' || o_totalprice::DOUBLE || ',"title":"' || trim(o_orderpriority) || '"}'), 12) AS id FROM orders""")
def chapter_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", canonical.chapter_id(F.col("o_orderkey"), F.col("o_totalprice"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("id"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'pinned-' || c_custkey ELSE left(sha1('p' || c_nationkey || '|{"name": "' || c_name || '", "url": "https://caf\\u00e9/' || c_custkey || '"}'), 12) END AS key, c_nationkey FROM customer)
SELECT c_custkey, key, CASE WHEN c_custkey % 3 = 0 THEN left(sha1('p' || c_nationkey || '|entity:' || c_nationkey), 12) ELSE key END AS family FROM s""")
def source_keys(spark, sf):
    c = table(spark, sf, "customer")
    source = F.create_map(F.lit("url"), F.concat(F.lit("https://café/"), F.col("c_custkey")), F.lit("body"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    provider = F.concat(F.lit("p"), F.col("c_nationkey"))
    key = canonical.source_key(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("pinned-"), F.col("c_custkey"))), provider, source, T.MapType(T.StringType(), T.StringType()), ("body", "body_any", "body_exact", "body_includes"))
    told = c.select("c_custkey", provider.alias("provider"), key.alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).alias("entity"))
    return told.select("c_custkey", "key", canonical.family_key(F.col("entity"), F.col("provider"), F.col("key")).alias("family"))


@query("""SELECT o_custkey, left(sha1('[' || string_agg('{"at":"' || o_orderdate || '","kind":"keep","n":' || o_orderkey || '}', ',' ORDER BY o_orderkey) || ']'), 12) AS digest FROM orders GROUP BY 1""")
def timeline_digests(spark, sf):
    """Each customer's orders as an edit list."""
    row = F.struct(F.col("o_orderkey").alias("n"), F.col("o_orderdate").cast("string").alias("at"), F.lit("keep").alias("kind"))
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    return lists.select("o_custkey", canonical.digest(F.col("segments"), lists.schema["segments"].dataType).alias("digest"))


@query("""WITH r AS (SELECT o_custkey AS body, o_orderkey AS guid, o_orderkey % 97 = 0 AS bound, o_orderkey % 3 = 0 AS old FROM orders), s AS (SELECT body, guid, bound, row_number() OVER (PARTITION BY body ORDER BY guid) - 1 AS seq FROM r WHERE old),
t AS (SELECT body, seq FROM s WHERE NOT bound), f AS (SELECT body, guid, row_number() OVER (PARTITION BY body ORDER BY guid) AS place FROM r WHERE NOT old AND NOT bound),
n AS (SELECT body, unnest(range(count(*))) AS seq FROM r GROUP BY body), u AS (SELECT n.body, n.seq, row_number() OVER (PARTITION BY n.body ORDER BY n.seq) AS place FROM n ANTI JOIN t ON n.body = t.body AND n.seq = t.seq)
SELECT guid::VARCHAR AS guid, 'bound-' || guid AS uid, 'override' AS how FROM r WHERE bound UNION ALL SELECT guid::VARCHAR, left(sha1(body || '|' || seq), 16), 'stored' FROM s WHERE NOT bound
UNION ALL SELECT guid::VARCHAR, left(sha1(f.body || '|' || seq), 16), 'fresh' FROM f JOIN u ON f.body = u.body AND f.place = u.place""")
def stable_uids(spark, sf):
    """Orders as records: a third had their ids before, some are bound by overrides, the rest take free numbers."""
    k = F.col("o_orderkey")
    records = table(spark, sf, "orders").select(F.col("o_custkey").alias("body"), k.cast("string").alias("guid"), k.alias("at"))
    none = spark.createDataFrame([], "guid string, uid string")
    before = written(identity.assign_uids(records.where("at % 3 = 0"), none, none, ["body"], "guid", ["at"], written).select("guid", "uid"), "uids")
    bound = records.where("at % 97 = 0").select("guid", F.concat(F.lit("bound-"), F.col("guid")).alias("uid"))
    return identity.assign_uids(records, before, bound, ["body"], "guid", ["at"], written).select("guid", "uid", "how")


@query("""WITH l AS (SELECT s_nationkey AS k, s_suppkey AS lane, s_suppkey % 3 = 0 AS live, s_suppkey % 4 AS ratio, s_suppkey % 5 + 1 AS units, (s_suppkey % 5 + 1) * 2.5::DOUBLE + 1.5 AS cost FROM supplier), v AS (SELECT *, CASE WHEN live THEN floor(round(40 * ratio::DOUBLE / nullif(sum(ratio) FILTER (WHERE live) OVER (PARTITION BY k), 0), 9)) END AS lj FROM l),
f AS (SELECT *, 900 - coalesce(sum(lj * cost) OVER (PARTITION BY k), 0) AS rest, sum(ratio * cost) FILTER (WHERE NOT live) OVER (PARTITION BY k) AS weight FROM v), j AS (SELECT *, CASE WHEN live THEN lj WHEN rest > 0 AND weight > 0 THEN floor(round(ratio * (rest / weight), 9)) END::BIGINT AS jobs FROM f)
SELECT lane, jobs AS reserved_jobs, jobs * units AS reserved_units, (sum(jobs * units) OVER (PARTITION BY k))::BIGINT AS daily_units, 2 * CASE WHEN jobs > 0 THEN jobs WHEN jobs = 0 THEN max(jobs) OVER (PARTITION BY k) END AS max_queued FROM j""")
def lane_reservations(spark, sf):
    """A nation's suppliers as lanes."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), k.alias("lane"), (k % 3 == 0).alias("live"), (k % 4).alias("ratio"), (k % 5 + 1).alias("units"))
    return lanes.reservations(rows, ["k"], 40, 1000.0, 100.0, 2.5, 1.5, 2).select("lane", "reserved_jobs", "reserved_units", "daily_units", "max_queued")


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'The meeting was CANCELLED. ' || left(text, 900) WHEN 1 THEN 'Please wait  ' || left(text, 300) WHEN 2 THEN 'unable to load ' || text WHEN 3 THEN 'Not currently' || chr(10) || 'published ' || text WHEN 4 THEN '%PDF-1.4 ' || text WHEN 5 THEN 'agenda_' || doc_id || '.pdf' ELSE text END AS t, doc_id % 5 AS score FROM documents),
n AS (SELECT doc_id, score, trim(regexp_replace(coalesce(t, ''), '[\s\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS s FROM d), l AS (SELECT *, lower(s) AS w, length(s) AS n FROM n)
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN contains(w, 'not currently published') THEN 'unpublished-placeholder'
WHEN regexp_matches(s, '^%PDF-[0-9]') OR (regexp_matches(w, '(documentviewer\.php|\bloading(\.\.\.|…)?\b|please wait|javascript (is )?required|an error occurred|unable to load)') AND (contains(w, 'documentviewer.php') OR n <= 500 OR score = 0)) OR (n <= 180 AND regexp_matches(w, '[a-z0-9]') AND (regexp_matches(w, '^https?://') OR regexp_matches(s, '^[\p{L}\p{N}_./-]+$'))) THEN 'viewer-placeholder'
WHEN n <= 1000 AND regexp_matches(w, '\b(cancel(led|ed)?|no meeting|meeting (is )?(postponed|rescheduled)|meeting notice|meeting has been canceled)\b') THEN 'short-notice' ELSE 'complete' END AS class FROM l""")
def agenda_classes(spark, sf):
    """Documents, some as notices, viewers' shells, raw files and file names."""
    k, text = F.col("doc_id"), F.col("text")
    made = F.when(k % 8 == 0, F.concat(F.lit("The meeting was CANCELLED. "), F.left(text, F.lit(900)))).when(k % 8 == 1, F.concat(F.lit("Please wait  "), F.left(text, F.lit(300)))).when(k % 8 == 2, F.concat(F.lit("unable to load "), text))
    made = made.when(k % 8 == 3, F.concat(F.lit("Not currently\npublished "), text)).when(k % 8 == 4, F.concat(F.lit("%PDF-1.4 "), text)).when(k % 8 == 5, F.concat(F.lit("agenda_"), k, F.lit(".pdf"))).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", normalize.agenda_class(made, k % 5).alias("class"))


@query(r"""WITH t AS (SELECT conv_id AS k, turn, replace(lower(coalesce(text, '')), 'ß', 'ss') || ' hb' || (turn % 3) AS w FROM conversations), u AS (SELECT k, turn AS unit, unnest(list_distinct(regexp_extract_all(w, '[a-z0-9]+'))) AS t FROM t), i AS (SELECT k, turn AS item, unnest(list_distinct(regexp_extract_all(w || ' unheard', '[a-z0-9]+'))) AS t FROM t WHERE turn = 0),
x AS (SELECT unnest(string_split('a an and are at be by for from in into is it of on or that the this to with', ' ')) AS t), n AS (SELECT k, count(*) AS n FROM t GROUP BY k), f AS (SELECT k, t, count(*) AS df FROM u GROUP BY k, t),
q AS (SELECT i.k, item, i.t, (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) * CASE WHEN regexp_full_match(i.t, '[a-z]{1,8}[0-9]+[a-z0-9]*') THEN 3 ELSE 1 END AS w FROM i JOIN n USING (k) LEFT JOIN f ON f.k = i.k AND f.t = i.t WHERE i.t NOT IN (SELECT t FROM x))
SELECT q.k, q.item, u.unit, round(sum(q.w) / any_value(s.s), 5) AS score FROM q JOIN u ON u.k = q.k AND u.t = q.t JOIN (SELECT k, item, sum(w) AS s FROM q GROUP BY k, item) s ON s.k = q.k AND s.item = q.item GROUP BY q.k, q.item, u.unit""")
def lexical_scores(spark, sf):
    """Each conversation's first turn asked for in all its turns, with a formal identifier in each and a word that none has."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" HB"), F.col("turn") % 3)
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("k"), "turn", text.alias("text"))
    items = t.where("turn = 0").select("k", F.col("turn").alias("item"), F.concat("text", F.lit(" unheard")).alias("text"))
    return quotes.lexical_scores(items, t.withColumnRenamed("turn", "unit"), ["k"]).withColumn("score", F.round("score", 5))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) || ' So moved: aye' AS said FROM conversations""")
def spoken_texts(spark, sf):
    """Turns with a speaker, a time and an annotation before them, and a heading between them and the last words."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    text = F.concat(F.lit("[music] 01:02:03\nMAYOR O'NEIL: "), flat, F.lit("\r\nTHE AGENDA\n[applause\n 1:05 So moved: aye"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.replace(bodies.spoken_text(text), F.lit(" [applause"), F.lit("")).alias("said"))
