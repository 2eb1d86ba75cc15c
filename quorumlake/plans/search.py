"""Queries over a search index that is kept up to date, with the SQL that DuckDB runs for them over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import nearest
from quorumlake.operators import availability, searchindex
from quorumlake.plans.catalog import query
from quorumlake.plans.upkeep import QUERIES, SQL
from quorumlake.sources.readers import table
from quorumlake.sources.scratch import fresh_folder, written

__all__ = ["QUERIES", "SQL"]

FIELDS = ["title", "body", "lang"]
BOOSTS = {"title": 3.0, "lang": 0.5}
#: The SQL of the documents that are left after the second build, of their terms, and of the queries' terms.
INDEXED = r"""d AS (SELECT doc_id, substr(text, 1, 60) AS title, text AS body, lang FROM documents WHERE source IS DISTINCT FROM (SELECT max(source) FROM documents)),
f AS (SELECT doc_id, 'title' AS field, title AS v FROM d WHERE title IS NOT NULL UNION ALL SELECT doc_id, 'body', body FROM d WHERE body IS NOT NULL UNION ALL SELECT doc_id, 'lang', lang FROM d WHERE lang IS NOT NULL),
t AS (SELECT doc_id, field, len(list_distinct(string_split_regex(v, '[\n\r\p{Z}\p{P}]+'))) AS n, list_filter(list_transform(string_split_regex(v, '[\n\r\p{Z}\p{P}]+'), lambda x: lower(x)), lambda x: x <> '') AS w FROM f),
p AS (SELECT doc_id, field, n, term, count(*) AS tf FROM (SELECT doc_id, field, n, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (SELECT item_id, asked, count(*) AS times FROM (SELECT item_id, unnest(list_filter(list_transform(string_split_regex(text, '[\n\r\p{Z}\p{P}]+'), lambda x: lower(x)), lambda x: x <> '')) AS asked FROM benchmark) GROUP BY ALL),
m AS (SELECT field, sum(n) / count(*) AS mean, CASE field WHEN 'title' THEN 3.0 WHEN 'lang' THEN 0.5 ELSE 1.0 END AS boost FROM t GROUP BY 1),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT doc_id, term, sum(boost * ln(1 + ((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * n / mean)))) AS raw FROM p JOIN df USING (field, term) JOIN m USING (field) GROUP BY ALL)"""
#: DuckDB counts edits in bytes: letters of two bytes take the place of capitals, which lower-case terms don't have.
NEAR = """a AS (SELECT DISTINCT asked, least(6, floor(length(asked) * 0.2 + 0.5)) AS k FROM q), v AS (SELECT DISTINCT term FROM p),
x AS (SELECT asked, term, CASE WHEN asked = term THEN 1.0 WHEN starts_with(term, asked) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(asked))) ELSE 0.45 * length(term) / (length(term) + levenshtein(translate(asked, 'èéêäóöüñßíç', 'ABCDEFGHIJK'), translate(term, 'èéêäóöüñßíç', 'ABCDEFGHIJK'))) END AS weight
FROM a JOIN v ON starts_with(term, asked) OR (abs(length(term) - length(asked)) <= k AND levenshtein(translate(asked, 'èéêäóöüñßíç', 'ABCDEFGHIJK'), translate(term, 'èéêäóöüñßíç', 'ABCDEFGHIJK')) <= k))"""


def indexed(spark, sf: str) -> searchindex.SearchIndex:
    """An index of the documents in shards by source, built from other texts of the first source and all of the last one, then brought up to date."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"), "lang")
    first, last = docs.agg(F.min("source"), F.max("source")).first()
    index = searchindex.SearchIndex(spark, fresh_folder(spark, "index"), "doc_id", "source", FIELDS)
    index.build(docs.withColumn("body", F.when(F.col("source") == first, F.reverse("body")).otherwise(F.col("body"))))
    index.build(docs.where(~F.col("source").eqNullSafe(F.lit(last))))
    return index


@query(f"""WITH {INDEXED}, {NEAR}, y AS (SELECT doc_id, asked, sum(raw * weight) AS raw FROM s JOIN x USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(sum(raw * times) * count(*), 2) AS score, count(*) AS matched FROM y JOIN q USING (asked) GROUP BY ALL""")
def index_search(spark, sf):
    """All documents with a term that equals, continues or is near to one of a benchmark item."""
    found = indexed(spark, sf).search(table(spark, sf, "benchmark"), "item_id", "text", BOOSTS)
    return found.withColumn("score", F.round("score", 2))


@query(f"""WITH {INDEXED}, y AS (SELECT item_id, doc_id, sum(raw * times) * count(*) AS score, count(*) AS matched FROM s JOIN q ON s.term = q.asked GROUP BY ALL)
SELECT item_id, doc_id, round(score, 2) AS score, matched FROM y WHERE matched = (SELECT count(*) FROM q WHERE q.item_id = y.item_id)""")
def index_search_all_terms(spark, sf):
    """The documents that have all terms of a benchmark item just as they are."""
    found = indexed(spark, sf).search(table(spark, sf, "benchmark"), "item_id", "text", BOOSTS, fuzzy=0, prefix=False, combine="AND")
    return found.withColumn("score", F.round("score", 2))


@query("""WITH l AS (SELECT max(source) AS last, min(source) AS first FROM documents)
SELECT source AS shard, CASE WHEN source = any_value(last) THEN 'removed' WHEN source = any_value(first) AND bool_or(text <> reverse(text)) THEN 'changed' ELSE 'kept' END AS change, CASE WHEN source IS DISTINCT FROM any_value(last) THEN count(*) END AS docs,
CASE WHEN source = any_value(last) THEN NULL WHEN source = any_value(first) AND bool_or(text <> reverse(text)) THEN 2 ELSE 1 END AS written FROM documents, l GROUP BY source""")
def index_changes(spark, sf):
    """What the second build of the index did with each shard, and the build that wrote it."""
    index = indexed(spark, sf)
    told = spark.read.parquet(f"{index.folder}/changes/build=2").select("shard", "change")
    now = index.manifest().select(F.col("shard").alias("own_shard"), "docs", "written")
    return told.join(now, F.col("shard").eqNullSafe(F.col("own_shard")), "left").drop("own_shard")


@query(r"""WITH s AS (SELECT conv_id, turn, round(turn * 7.25, 3)::DOUBLE AS start, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))[:12000] AS t FROM conversations), c AS (SELECT *, coalesce(sum(length(t)) OVER w, 0) AS before FROM s WHERE t <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, start, t[:200000 - before] AS text, 'c' || (turn // 3 * 3) AS chapter_id FROM c WHERE before < 200000""")
def index_segments(spark, sf):
    """The turns of conversations as transcript segments, in chapters of three turns."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 7.25).alias("start"), "text")
    chapters = turns.where("seq % 3 = 0").select("conv_id", F.concat(F.lit("c"), F.col("seq")).alias("chapter_id"), "start")
    return searchindex.search_segments(turns, "conv_id", chapters).withColumnRenamed("seq", "turn")


@query(r"""SELECT o_orderkey AS uid, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%B %-d, %Y') AS date_label, year(o_orderdate) AS year, st AS media_availability_state, st IN ('missing', 'confirmed_empty') AS is_withheld, o_orderpriority[:4] AS title
FROM (SELECT *, CASE WHEN o_orderkey % 7 = 1 THEN 'available' ELSE coalesce(CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'confirmed_empty' WHEN 2 THEN 'recovered' END, 'unknown') END AS st FROM orders) WHERE o_orderstatus <> 'P'""")
def index_records(spark, sf):
    """Orders as records: some suppressed, some with a state of their own or an operator's."""
    k = F.col("o_orderkey")
    state = F.when(k % 5 == 0, "missing").when(k % 5 == 1, "confirmed_empty").when(k % 5 == 2, "recovered")
    rows = table(spark, sf, "orders").select(k.alias("uid"), (F.col("o_orderstatus") == "P").alias("suppressed"), F.col("o_orderdate").cast("timestamp").alias("published"), state.alias("state"), F.when(k % 7 == 1, "available").alias("override"), F.concat(F.lit(" \n"), F.col("o_orderpriority"), F.lit("\t ")).alias("title"))
    return searchindex.search_documents(rows, {"title": 4})


KINDS = ["silent", "playable", "silent", "transport_failed", "partial", "dead", "silent", "override", "playable", "missing", "partial"]
CALLS = ["available", "missing", "bogus", None, "confirmed_partial"]


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS k, ts, {KINDS}[(event_id * 7 % 11)::INT + 1] AS kind, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'g' ELSE 'f' END AS fp, {str(CALLS).replace("None", "NULL")}[(event_id % 5)::INT + 1] AS call, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT k, 0::BIGINT AS n, NULL::VARCHAR AS state, 0 AS silent, 0 AS partial, NULL::VARCHAR AS fp, NULL::VARCHAR AS override, NULL::TIMESTAMP AS recovered_at, NULL::TIMESTAMP AS last_check FROM e UNION ALL
SELECT k, n, CASE WHEN kind = 'override' THEN coalesce(state, CASE WHEN sets THEN 'available' END) WHEN kind = 'transport_failed' THEN state WHEN kind = 'silent' THEN CASE WHEN silent0 >= 1 THEN 'confirmed_empty' ELSE 'suspected_empty' END WHEN kind = 'partial' THEN CASE WHEN partial0 >= 1 THEN 'confirmed_partial' ELSE 'suspected_partial' END
 WHEN kind = 'dead' THEN 'invalid' WHEN kind = 'missing' THEN 'missing' WHEN ends THEN 'recovered' ELSE 'available' END,
 CASE WHEN NOT content THEN silent WHEN kind = 'silent' THEN silent0 + 1 ELSE 0 END, CASE WHEN NOT content THEN partial WHEN kind = 'partial' THEN partial0 + 1 ELSE 0 END, CASE WHEN content THEN coalesce(nfp, fp) ELSE fp END,
 CASE WHEN kind = 'override' AND sets THEN call WHEN kind = 'override' AND call IS NULL AND state IS NOT NULL THEN NULL WHEN content AND fresh THEN NULL ELSE override END, CASE WHEN content AND ends THEN ts WHEN content AND fresh THEN NULL ELSE recovered_at END,
 CASE WHEN kind = 'override' THEN CASE WHEN sets OR (call IS NULL AND state IS NOT NULL) THEN ts ELSE last_check END WHEN kind = 'transport_failed' AND state IS NULL THEN NULL ELSE ts END
 FROM (SELECT *, CASE WHEN fresh THEN 0 ELSE silent END AS silent0, CASE WHEN fresh THEN 0 ELSE partial END AS partial0, kind = 'playable' AND NOT fresh AND coalesce(override, state, '') IN ('suspected_empty', 'confirmed_empty', 'missing', 'invalid') AS ends FROM (
 SELECT s.k, e.n, e.ts, e.kind, e.fp AS nfp, e.call, s.state, s.silent, s.partial, s.fp, s.override, s.recovered_at, s.last_check, e.kind NOT IN ('override', 'transport_failed') AS content, coalesce(e.call <> 'bogus', FALSE) AS sets, coalesce(e.kind NOT IN ('override', 'transport_failed') AND e.fp <> s.fp, FALSE) AS fresh
 FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1)))
SELECT k, state, coalesce(override, state) AS effective, silent AS silent_confirmations, partial AS partial_confirmations, fp AS fingerprint, override, recovered_at, last_check FROM s WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1""")
def media_verdicts(spark, sf):
    """Each user's events as observations of a recording."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    k = F.col("event_id")
    log = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", pick(KINDS, k * 7 % 11).alias("kind"), F.when(k % 6 == 1, "g").when(k % 6 != 0, "f").alias("fingerprint"), F.lit("p").alias("profile"), pick(CALLS, k % 5).alias("state"), F.lit("r").alias("reason"))
    told = availability.latest_verdicts(log, ["k"], "at", ["event_id"])
    return told.select("k", "state", "effective", "silent_confirmations", "partial_confirmations", "fingerprint", "override", "recovered_at", "last_check")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, b.label AS person, b.vec_id AS ref, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, first(person ORDER BY round(s, 5) DESC, ref) AS person, first(ref ORDER BY round(s, 5) DESC, ref) AS ref, max(round(s, 5)) AS score FROM p GROUP BY vec_id""")
def profile_matches_every(spark, sf):
    """All rows against all other rows, by blocks around pivots."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    best = nearest.best_matches(e, e, written)
    people = e.select(F.col("id").alias("ref"), F.col("label").alias("person"))
    return best.join(people, "ref").select(F.col("id").alias("vec_id"), "person", "ref", "score")
