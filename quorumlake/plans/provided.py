"""Queries of parsers, stores and judges over payloads that Spark makes from the tables, with the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import quotes, text
from quorumlake.operators import align, integrity, judging, packing, stats, timeline, verdicts, workqueue
from quorumlake.plans.catalog import query
from quorumlake.plans.ledgers import QUERIES, SQL
from quorumlake.sources import payloads, readers
from quorumlake.sources.readers import table
from quorumlake.sources.scratch import fresh_folder, spread

__all__ = ["QUERIES", "SQL"]


def listed(df, by: str, row, name: str = "own_list"):
    """Each group's rows as an array, in order."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias(name))


def event_payloads(spark, sf):
    """A customer's orders as a provider's events."""
    k, url = F.col("o_orderkey"), F.lit("https://files/")
    files = F.array(F.struct(F.lit("Agenda").alias("type"), F.concat(url, F.col("o_orderkey")).alias("url")), F.struct(F.lit("AGENDA").alias("type"), F.lit("https://second").alias("url")), F.struct(F.lit("Minutes").alias("type"), F.when(k % 2 == 0, F.lit("ftp://x")).otherwise(F.lit("http://minutes")).alias("url")))
    row = F.struct(
        k.cast("string").alias("id"), F.when(k % 7 != 0, F.concat(F.lit("Meeting "), k)).alias("eventName"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z")).alias("startDateTime"), (k % 3).alias("categoryId"),
        F.when(k % 4 != 0, F.lit(" Council ")).otherwise("").alias("categoryName"), F.lit("Board").alias("meetingTypeName"), (k % 2 == 0).alias("hasMedia"), F.when(k % 5 == 0, "rtmp://x").otherwise(F.concat(F.lit(" https://v/"), k)).alias("mediaSourcePathMp4"), F.when(k % 6 != 1, files).alias("publishedFiles"),
    )
    return listed(table(spark, sf, "orders"), "o_custkey", row, "value").select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.to_json("value")).otherwise(F.to_json(F.struct("value"))).alias("payload"))


AGENDA = "CASE WHEN o_orderkey % 6 <> 1 THEN 'https://files/' || o_orderkey END AS agenda, CASE WHEN o_orderkey % 6 <> 1 AND o_orderkey % 2 = 1 THEN 'http://minutes' END AS minutes"


@query(f"""SELECT o_custkey, o_orderkey::VARCHAR AS guid, CASE WHEN o_orderkey % 7 = 0 THEN 'Untitled meeting' ELSE 'Meeting ' || o_orderkey END AS title, o_orderdate::DATE::VARCHAR AS day, 'https://v/' || o_orderkey AS video_url, CASE WHEN o_orderkey % 4 = 0 THEN 'Board' ELSE 'Council' END AS body, {AGENDA} FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 3 = 1""")
def provider_episodes(spark, sf):
    rows = payloads.event_episodes(event_payloads(spark, sf), "o_custkey", "payload", 1)
    return rows.select("o_custkey", "guid", "title", F.date_format("published", "yyyy-MM-dd").alias("day"), "video_url", "body", F.col("links")["agenda"].alias("agenda"), F.col("links")["minutes"].alias("minutes"))


@query(f"""SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'Board' ELSE 'Council' END AS body, {AGENDA} FROM orders WHERE o_orderkey % 6 <> 1""")
def provider_agendas(spark, sf):
    rows = payloads.event_agendas(event_payloads(spark, sf), "o_custkey", "payload")
    return rows.select("o_custkey", F.date_format("published", "yyyy-MM-dd").alias("day"), "body", F.col("links")["agenda"].alias("agenda"), F.col("links")["minutes"].alias("minutes"))


@query("""SELECT o_custkey, 'Meeting ' || o_orderkey AS title, o_orderdate::DATE::VARCHAR AS day, 'https://p/Portal/Meeting?compiledId=a' || o_orderkey AS agenda, CASE WHEN o_orderkey % 2 = 0 THEN 'https://p/Portal/Meeting?compiledId=p' || o_orderkey END AS packet FROM orders WHERE o_orderkey % 9 > 0""")
def archived_meetings(spark, sf):
    k = F.col("o_orderkey")
    doc = lambda name, mark: F.struct(F.lit(name).alias("templateName"), F.concat(F.lit(mark), k).alias("templateId"), F.lit("1").alias("compileOutputType"))
    files = F.when(k % 2 == 0, F.array(doc("Photo", "x"), doc("Agenda Packet", "p"), doc("Agenda", "a"), doc("AGENDA", "b"))).otherwise(F.array(doc("agenda html", "a")))
    row = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("dateTime"), F.when(k % 9 > 0, F.concat(F.lit(" Meeting "), k)).otherwise("").alias("title"), files.alias("documentList"))
    lists = listed(table(spark, sf, "orders"), "o_custkey", row, "data").select("o_custkey", F.to_json(F.struct("data")).alias("payload"))
    rows = payloads.archived_meetings(lists, "o_custkey", "payload", "https://p/")
    return rows.select("o_custkey", "title", F.date_format("published", "yyyy-MM-dd").alias("day"), F.col("links")["agenda"].alias("agenda"), F.col("links")["agenda_packet"].alias("packet"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, (l_partkey % 5) * 10 AS start, 'Item & ' || l_linenumber AS title FROM lineitem WHERE l_linenumber % 3 > 0)
SELECT l_orderkey, start::INT AS start, arg_min(title, l_linenumber) AS title FROM m GROUP BY 1, 2""")
def player_chapters(spark, sf):
    n = F.col("l_linenumber")
    row = F.struct(n.alias("n"), F.concat(F.when(n % 3 > 0, "Agenda:").otherwise("Rollcall:"), n).alias("text"), (F.col("l_partkey") % 5 * 10).cast("string").alias("time"), F.concat(F.lit("Item<br />&amp; "), n).alias("title"))
    lists = listed(table(spark, sf, "lineitem"), "l_orderkey", row)
    text = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("["), F.to_json("own_list"), F.lit("]"))).otherwise(F.to_json("own_list"))
    return payloads.player_chapters(lists.select("l_orderkey", text.alias("payload")), "l_orderkey", "payload")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS start, CASE WHEN l_linenumber % 2 = 0 THEN 'named ' ELSE 'titled ' END || l_linenumber AS title FROM lineitem)
SELECT l_orderkey, start::INT AS start, arg_min(title, l_linenumber) AS title FROM m WHERE start > 0 GROUP BY 1, 2""")
def bookmark_chapters(spark, sf):
    n = F.col("l_linenumber")
    row = F.struct(n.alias("n"), (F.col("l_partkey") % 4).alias("markerTimeStart"), F.when(n % 2 == 1, F.concat(F.lit("titled "), n)).otherwise("").alias("markerTitle"), F.concat(F.lit("named "), n).alias("markerName"))
    lists = listed(table(spark, sf, "lineitem"), "l_orderkey", row, "eventBookmarks").select("l_orderkey", F.to_json(F.struct("eventBookmarks")).alias("payload"))
    return payloads.bookmarks(lists, "l_orderkey", "payload")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://t/' || c_custkey WHEN 1 THEN 'https://c/' || c_custkey END AS url FROM customer""")
def transcript_urls(spark, sf):
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(F.when(k % 3 == 0, F.concat(F.lit(" https://t/"), k)).otherwise(" ").alias("transcriptionUrl"), F.when(k % 3 < 2, F.concat(F.lit("https://c/"), k)).alias("closedCaptionUrl")))
    return table(spark, sf, "customer").select("c_custkey", payloads.transcript_url(payload).alias("url"))


@query("""SELECT l_orderkey, (l_partkey % 6 * 5)::INT AS start, arg_min(CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 6 * 5 + 4)::INT ELSE -1 END, l_linenumber) AS "end", arg_min('Budget & tax ' || l_linenumber, l_linenumber) AS title FROM lineitem WHERE l_linenumber % 4 > 0 GROUP BY 1, 2""")
def page_chapters(spark, sf):
    n, at = F.col("l_linenumber"), F.col("l_partkey") % 6 * 5
    tag = F.concat(F.lit('<a class="x '), F.when(n % 4 > 0, "playerControl").otherwise("other"), F.lit('" data-ts="'), at, F.lit('" data-end-ts="'), F.when(n % 2 == 0, (at + 4).cast("string")).otherwise("soon"), F.lit('" data-title="Budget &amp; tax '), n, F.lit('">go</a>'))
    pages = listed(table(spark, sf, "lineitem"), "l_orderkey", F.struct(n.alias("n"), tag.alias("tag"))).select("l_orderkey", F.array_join("own_list.tag", "\n").alias("html"))
    return payloads.page_chapters(pages, "l_orderkey", "html").withColumn("end", F.coalesce("end", F.lit(-1)))


WORDS_SQL = r"""w AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), 1) AS i FROM conversations),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS seq, w AS text, turn * 100 + i * 0.5::DOUBLE AS start, turn * 100 + i * 0.5::DOUBLE + 0.25 AS "end" FROM w WHERE w <> '')"""


def sidecars(spark, sf):
    """A conversation's turns as the segments of a words sidecar; a word has half a second."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    at = lambda i: F.col("turn") * 100 + (i + 1) * 0.5
    segment = F.struct("turn", F.transform(words, lambda w, i: F.struct(F.concat(F.lit(" "), w).alias("w"), at(i).alias("s"), (at(i) + 0.25).alias("e"))).alias("words"))
    return listed(table(spark, sf, "conversations"), "conv_id", segment, "segments").select("conv_id", F.to_json(F.struct("segments")).alias("payload"))


@query(f"""WITH {WORDS_SQL} SELECT * FROM s""")
def sidecar_words(spark, sf):
    return payloads.word_rows(sidecars(spark, sf), "conv_id", "payload").withColumn("seq", F.col("seq").cast("long"))


@query(f"""WITH {WORDS_SQL} SELECT conv_id, (seq // 12)::INT AS unit, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY seq) AS text, 'words' AS basis FROM s WHERE conv_id % 3 > 0 GROUP BY 1, 2
UNION ALL SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT, turn * 100, turn * 100 + 50, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 'cues' FROM conversations WHERE conv_id % 3 = 0 OR conv_id NOT IN (SELECT conv_id FROM s)""")
def located_units(spark, sf):
    """Units of twelve words; a third of the conversations have cues alone."""
    words = payloads.word_rows(sidecars(spark, sf).where("conv_id % 3 > 0"), "conv_id", "payload")
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    cues = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 100.0).alias("start"), (F.col("turn") * 100.0 + 50).alias("end"), flat.alias("text"))
    return payloads.locator_units(words, cues, "conv_id", 12)


@query(r"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seq, turn * 61 + 0.5::DOUBLE AS start, turn * 61 + 60::DOUBLE AS "end", trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations""")
def caption_rows(spark, sf):
    """A conversation's turns as the cues of a WebVTT text, and of an SRT text for each second one."""
    clock = lambda s, dot: F.format_string(f"%02d:%02d:%02d{dot}%03d", F.floor(s / 3600), F.floor(s / 60) % 60, F.floor(s) % 60, F.floor(s * 1000) % 1000)
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    cue = lambda dot: F.concat(F.col("turn") + 1, F.lit("\n"), clock(F.col("turn") * 61 + 0.5, dot), F.lit(" --> "), clock(F.col("turn") * 61 + 60.0, dot), F.lit("\n"), flat)
    turns = listed(table(spark, sf, "conversations"), "conv_id", F.struct("turn", F.when(F.col("conv_id") % 2 == 0, cue(".")).otherwise(cue(",")).alias("c")))
    return readers.timed_texts(turns.select("conv_id", F.concat(F.when(F.col("conv_id") % 2 == 0, "WEBVTT\n\n").otherwise(""), F.array_join("own_list.c", "\n\n"), F.lit("\n")).alias("text")), "conv_id", "text")


MARKS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS seq, event_id * 2 + 0.5::DOUBLE AS start, {} AS \"end\" FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AND user_id % 2 = 0 AS cut FROM events)"


def mark_logs(spark, sf, name: str):
    """A user's events as lines of a filter's log; an even user's last mark is never closed."""
    e = table(spark, sf, "events")
    row = F.struct("event_id", F.concat(F.lit(f"[x] {name}_start: "), F.col("event_id") * 2 + 0.5, F.lit("\n")).alias("a"), F.concat(F.lit(f"[x] {name}_end: "), F.col("event_id") * 2 + 1.25, F.lit(" | more\n")).alias("b"))
    lists = listed(e, "user_id", row)
    line = F.transform("own_list", lambda x, i: F.concat(x["a"], F.when((i == F.size("own_list") - 1) & (F.col("user_id") % 2 == 0), "").otherwise(x["b"])))
    return lists.select("user_id", F.array_join(line, "").alias("log"), F.lit(1e9).alias("duration"))


@query(MARKS.format("CASE WHEN NOT cut THEN event_id * 2 + 1.25::DOUBLE END"))
def silence_marks(spark, sf):
    return timeline.marked_intervals(mark_logs(spark, sf, "silence"), "user_id", "log", "silence_start", "silence_end")


@query(MARKS.format("CASE WHEN NOT cut THEN event_id * 2 + 1.25::DOUBLE ELSE 1e9 END"))
def freeze_marks(spark, sf):
    return timeline.freeze_intervals(mark_logs(spark, sf, "freeze"), "user_id", "log", "duration")


def flat_records(spark, sf):
    """Orders as flat records: with and without links, audio, chapters and transcripts."""
    k, text = F.col("o_orderkey"), lambda c: F.lit(None).cast(c)
    return table(spark, sf, "orders").select(
        k.cast("string").alias("uid"), F.concat(F.lit("g"), k).alias("guid"), F.concat(F.lit('A "title" \\ '), k).alias("title"), F.col("o_orderdate").cast("timestamp").alias("published"), F.col("o_orderpriority").alias("body"), F.lit("direct").alias("media_kind"), F.lit("https://v").alias("video_url"),
        F.when(k % 3 == 0, F.create_map(F.lit("agenda"), F.concat(F.lit("https://a/"), k))).otherwise(F.create_map().cast("map<string,string>")).alias("links"), F.when(k % 4 == 0, F.lit("https://s")).alias("audio_url"), text("string").alias("audio_key"), text("string").alias("audio_spec_hash"), (k % 2).cast("int").alias("attempts"), text("string").alias("error"), F.when(k % 4 == 0, k * 7).alias("audio_bytes"),
        text("double").alias("duration_served"), F.when(k % 5 > 0, F.col("o_totalprice").cast("double")).alias("duration_source"), F.when(k % 3 == 1, F.array(F.struct(F.lit(1.5).alias("start"), F.lit("c").alias("title")))).otherwise(F.array().cast("array<struct<start:double,title:string>>")).alias("chapters"), F.lit("source:s0").alias("chapters_basis"), F.when(k % 2 == 0, F.lit("t")).alias("transcript_key"), (k % 6 == 0).alias("synced"),
    )


#: Records of all priorities for each file of every priority.
RECORDS_IN_FILE = 50_000


@query("""SELECT o_orderkey::VARCHAR AS uid, 'A "title" \\ ' || o_orderkey AS title, o_orderdate::DATE::VARCHAR AS day, o_orderpriority AS body, CASE WHEN o_orderkey % 3 = 0 THEN 'https://a/' || o_orderkey END AS agenda, CASE WHEN o_orderkey % 4 = 0 THEN 'https://s' END AS audio_url, (o_orderkey % 2)::INT AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 7 END AS audio_bytes,
CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::DOUBLE END AS duration_source, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END::INT AS chapters, CASE WHEN o_orderkey % 2 = 0 THEN 't' END AS transcript_key, o_orderkey % 6 = 0 AS synced FROM orders""")
def stored_records(spark, sf):
    """Records written as a store's JSON files, by priority and some thousands in each, and read again."""
    orders = table(spark, sf, "orders")
    encoded = payloads.encoded_records(flat_records(spark, sf)).join(orders.select(F.col("o_orderkey").cast("string").alias("uid"), "o_orderpriority"), "uid")
    entry = F.concat(F.to_json(F.struct(F.col("uid").alias("u"))), F.lit(""))
    told = encoded.select("o_orderpriority", F.pmod(F.xxhash64("uid"), F.lit(-(-orders.count() // RECORDS_IN_FILE))).alias("part"), F.concat(F.regexp_extract(entry, r'^\{"u":(.*)\}$', 1), F.lit(":"), F.col("record")).alias("entry"))
    files = told.groupBy("o_orderpriority", "part").agg(F.concat(F.lit('{"schema_version":2,"episodes":{'), F.array_join(F.collect_list("entry"), ","), F.lit("}}")).alias("value"))
    folder = fresh_folder(spark, "store")
    files.write.partitionBy("o_orderpriority", "part").text(folder)
    kind = spark.createDataFrame([], payloads.RECORD_FIELDS.replace("uid string, ", "", 1)).schema
    read = readers.record_store(spark, f"{folder}/*/*/*.txt", kind)
    r = payloads.decoded_records(read.select(F.to_json(F.struct("*")).alias("p")), "p")
    return r.select("uid", "title", F.date_format("published", "yyyy-MM-dd").alias("day"), "body", F.col("links")["agenda"].alias("agenda"), "audio_url", "attempts", "audio_bytes", "duration_source", F.size("chapters").alias("chapters"), "transcript_key", "synced")


@query("""SELECT c_custkey::VARCHAR AS uid, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' Meeting' ELSE c_name END AS title, '2026-05-19' AS day, CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_custkey END AS video_guid FROM customer WHERE c_custkey % 7 > 0""")
def calendar_rows(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.cast("string").alias("uid"), F.col("c_mktsegment").alias("body"), F.when(k % 3 > 0, F.col("c_name")).alias("title"), F.when(k % 7 == 0, "soon").otherwise("2026-05-19T16:00:00Z").alias("published"), F.lit(None).cast("map<string,string>").alias("links"), F.when(k % 2 == 0, F.concat(F.lit("v"), k)).otherwise("").alias("video_guid"), F.lit("").alias("video_url"))
    return payloads.calendar_rows(rows).select("uid", "title", F.date_format("published", "yyyy-MM-dd").alias("day"), "video_guid")


@query("""SELECT c_custkey, p AS problem FROM (SELECT c_custkey, unnest([CASE WHEN c_custkey % 4 = 1 THEN 'items without guid' END, CASE WHEN c_custkey % 5 = 1 THEN 'channel without link' END, CASE WHEN c_custkey % 6 = 1 THEN 'no rss' END]) AS p FROM customer) WHERE p IS NOT NULL""")
def feed_problems(spark, sf):
    k = F.col("c_custkey")
    item = F.concat(F.lit("<item><title>a</title>"), F.when(k % 4 != 1, "<guid>1</guid>").otherwise(""), F.lit("<pubDate>x</pubDate></item>"))
    xml = F.concat(F.when(k % 6 != 1, "<rss>").otherwise("<feed>"), F.lit("<channel><title>t</title>"), F.when(k % 5 != 1, "<link>l</link>").otherwise(""), F.lit("<description>d</description>"), item, item, F.lit("</channel></rss>"))
    return payloads.feed_problems(table(spark, sf, "customer").select("c_custkey", xml.alias("xml")), "c_custkey", "xml")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey AS guid, 'Order <' || o_orderkey || '> & more' AS title, 'https://m/' || o_orderkey || '?a=1&b="2"' AS url, strftime(o_orderdate, '%Y-%m-%d') AS day FROM r WHERE n <= 200""")
def feed_rows_read(spark, sf):
    """Sixteen feeds of their customers' newest orders, written as files and read again."""
    k = F.col("o_orderkey")
    feeds = readers.rendered_feed(table(spark, sf, "orders").withColumns({"o_orderdate": F.col("o_orderdate").cast("timestamp"), "feed": F.col("o_custkey") % 16}), "feed", F.concat(F.lit("Order <"), k, F.lit("> & more")), "o_orderkey", "o_orderdate", F.concat(F.lit("https://m/"), k, F.lit('?a=1&b="2"')), "video/mp4", 200)
    folder = fresh_folder(spark, "feeds")
    feeds.select("feed", F.concat(F.lit("<rss><channel>"), "xml", F.lit("</channel></rss>")).alias("value")).repartition("feed").write.partitionBy("feed").text(folder)
    items = readers.feed_items(spark, f"{folder}/*/*.txt", "title string, guid struct<_VALUE:string>, pubDate string, enclosure struct<_url:string>")
    day = F.to_date(F.to_timestamp(F.substring("pubDate", 6, 20), "dd MMM yyyy HH:mm:ss"))
    return items.select(F.col("guid._VALUE").cast("long").alias("guid"), "title", F.col("enclosure._url").alias("url"), F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("""SELECT event_id, user_id, CASE WHEN user_id % 3 = 0 THEN 'second' ELSE 'first' END AS run FROM events""")
def saved_partitions(spark, sf):
    """Events saved by user; a third of the users are saved again, and only their rows change."""
    e, folder = table(spark, sf, "events").select("event_id", "user_id"), fresh_folder(spark, "saved")
    readers.save_records(e.withColumn("run", F.lit("first")), folder, "user_id")
    readers.save_records(e.where("user_id % 3 = 0").withColumn("run", F.lit("second")), folder, "user_id")
    return readers.saved_records(spark, folder).select("event_id", "user_id", "run")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'flash' WHEN 1 THEN 'flash' WHEN 2 THEN 'a/b:' || o_orderkey ELSE 'm' || o_orderkey END AS model FROM orders""")
def logical_models(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "litellm:gemini/flash").when(k % 4 == 1, "gemini/flash").when(k % 4 == 2, F.concat(F.lit("a/b:"), k)).otherwise(F.concat(F.lit("m"), k))
    return table(spark, sf, "orders").select("o_orderkey", judging.logical_model(name, {"gemini/flash": "flash"}).alias("model"))


@query("""WITH RECURSIVE p AS (SELECT user_id % 40 AS g, event_type AS l, event_id % 13 AS r, max(event_id * 37 % 1009) AS s FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, l, r) AS n FROM p),
w AS (SELECT g, 0::BIGINT AS n, []::VARCHAR[] AS ls, []::BIGINT[] AS rs, NULL::VARCHAR AS l, NULL::BIGINT AS r, 0::BIGINT AS s, FALSE AS kept FROM (SELECT DISTINCT g FROM o) UNION ALL
SELECT g, n + 1, CASE WHEN free THEN list_append(ls, ol) ELSE ls END, CASE WHEN free THEN list_append(rs, r2) ELSE rs END, ol, r2, s2, free FROM (SELECT w.g, w.n, ls, rs, o.l AS ol, o.r AS r2, o.s AS s2, NOT list_contains(ls, o.l) AND NOT list_contains(rs, o.r) AS free FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1))
SELECT g, l, r, s FROM w WHERE kept""")
def greedy_matches(spark, sf):
    """One-to-one pairs of kinds and remainders in each group of users, best first."""
    e = table(spark, sf, "events").select((F.col("user_id") % 40).alias("g"), F.col("event_type").alias("l"), (F.col("event_id") % 13).alias("r"), (F.col("event_id") * 37 % 1009).alias("s"))
    return packing.greedy_matches(e.groupBy("g", "l", "r").agg(F.max("s").alias("s")), "g", "l", "r", "s")


@query(r"""WITH t AS (SELECT conv_id AS k, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM conversations WHERE turn = 0) SELECT k, 'zz1 zz2 zz3' AS quote_id, 100.0::DOUBLE AS word_start, 101.25::DOUBLE AS word_end FROM t""")
def word_regions(spark, sf):
    """Three words that are said once in each conversation, among all its words."""
    turns = table(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("k"))
    words = payloads.word_rows(sidecars(spark, sf), "conv_id", "payload").select(F.col("conv_id").alias("k"), (F.col("seq") + 3).alias("seq"), "text", (F.col("start") + 1000).alias("start"), (F.col("end") + 1000).alias("end"))
    said = turns.select("k", F.posexplode(F.array(*[F.lit(w) for w in ("Zz1,", "zz2", "ZZ3!")])).alias("seq", "text")).select("k", "seq", "text", (100 + F.col("seq") * 0.5).alias("start"), (100.25 + F.col("seq") * 0.5).alias("end"))
    asked = turns.select("k", F.lit("zz1 zz2 zz3").alias("quote_id"), F.lit("zz1 zz2 zz3").alias("quote"), F.lit(None).cast("double").alias("near_start"), F.lit(None).cast("double").alias("near_end"))
    return quotes.word_region(asked, words.unionByName(said), ["k"]).select("k", "quote_id", "word_start", "word_end")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS source, l_partkey * 10.0::DOUBLE AS a, l_partkey * 10.0::DOUBLE + l_quantity AS b, (l_orderkey % 24) * 1048583 AS h FROM lineitem), d AS (SELECT k, h, count(*) AS n FROM s GROUP BY k, h),
t AS (SELECT x.k, x.h FROM d x JOIN d y ON x.k = y.k AND bit_count(xor(x.h, y.h)) <= 6 GROUP BY x.k, x.h HAVING sum(y.n) >= 320), c AS (SELECT s.* FROM s ANTI JOIN t ON s.k = t.k AND s.h = t.h), o AS (SELECT *, row_number() OVER (PARTITION BY k, source ORDER BY a, b, h) AS n FROM c),
w(k, source, n, i, a, b, h) AS (SELECT k, source, n, 1, a, b, h FROM o WHERE n = 1 UNION ALL SELECT k, source, n, CASE WHEN near THEN i ELSE i + 1 END, CASE WHEN near THEN wa ELSE a END, b, CASE WHEN near THEN wh ELSE h END
FROM (SELECT o.*, w.i, w.a AS wa, w.h AS wh, o.a - w.b <= 30 AND bit_count(xor(w.h, o.h)) <= 6 AS near FROM w JOIN o ON o.k = w.k AND o.source = w.source AND o.n = w.n + 1)), z AS (SELECT DISTINCT ON (k, source, i) k, source, a, b, h FROM w ORDER BY k, source, i, n DESC)
SELECT k, source, a, b, h FROM z QUALIFY row_number() OVER (PARTITION BY k ORDER BY source, a, b, h) <= 60""")
def recurring_slides(spark, sf):
    """A supplier's lines as pictures, without those that are near to 320 or more of the supplier's."""
    a = F.col("l_partkey") * 10.0
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("source"), a.alias("a"), (a + F.col("l_quantity")).alias("b"), (F.col("l_orderkey") % 24 * 1048583).alias("h"))
    return timeline.selected_slides(rows, ["k"], "source", "a", "b", "h", recurring=320).select("k", "source", F.col("start").alias("a"), F.col("end").alias("b"), F.col("hash").alias("h"))


@query(r"""SELECT conv_id, seq, CASE WHEN seq % 3 < 2 THEN position('part ' || (seq - seq // 3) IN t) END::INT AS span_start FROM (SELECT conv_id, 'zz' || string_agg('part ' || g || ' of it', ' ' ORDER BY g) AS t FROM conversations, generate_series(0, 5) x(g) WHERE turn = 0 GROUP BY conv_id), generate_series(0, 8) y(seq)""")
def title_places(spark, sf):
    """The places of titles in order; every third isn't in the text."""
    talks = table(spark, sf, "conversations").where("turn = 0").select("conv_id").distinct()
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("Part  "), i, F.lit(" of it"))), " ")
    seq = F.col("seq")
    titles = talks.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("seq")).withColumn("title", F.when(seq % 3 < 2, F.concat(F.lit("PART "), seq - F.floor(seq / 3))).otherwise("not there"))
    return quotes.title_spans(talks.withColumn("text", F.concat(F.lit("zz"), text)), titles, ["conv_id"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Second item: ' || o_orderpriority || ' THE FIRST' ELSE 'hello ' || o_orderpriority END AS text FROM orders""")
def without_preambles(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("hello "), F.when(k % 2 == 0, F.concat(F.lit("Second item: "), "o_orderpriority", F.lit(" THE FIRST"))).otherwise(F.col("o_orderpriority")))
    titles = F.array(F.lit("the first"), F.lit("SECOND ITEM"), F.lit("unheard of"))
    return table(spark, sf, "orders").select("o_orderkey", quotes.without_preamble(text, titles).alias("text"))


@query("""WITH t AS (SELECT doc_id, unnest(['agenda', 'spoken']) AS field, unnest([lower(text), reverse(lower(text))]) AS x FROM documents), p(tag, kind, phrase) AS (VALUES ('a', 'include', 'the'), ('a', 'include', 'und'), ('a', 'exclude', 'of'), ('b', 'include', 'la'))
SELECT doc_id, tag, kind, phrase, field, len(regexp_extract_all(' ' || regexp_replace(x, '[^a-z0-9_\\x{80}-\\x{10FFFF}]+', '  ', 'g') || ' ', ' ' || phrase || ' '))::INT AS n FROM t, p WHERE regexp_matches(' ' || regexp_replace(x, '[^a-z0-9_\\x{80}-\\x{10FFFF}]+', '  ', 'g') || ' ', ' ' || phrase || ' ')""")
def phrase_audit(spark, sf):
    """How often each phrase of two tags is in each document and in its mirror image."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("agenda"), F.reverse("text").alias("spoken"))
    return judging.phrase_audit(docs, "doc_id", ["agenda", "spoken"], [("a", ["the", "und"], ["of"]), ("b", ["la"], [])]).select("doc_id", "tag", "kind", "phrase", "field", "n")


@query("""SELECT l_orderkey, l_linenumber AS link_id, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::BIGINT AS chapter FROM lineitem""")
def links_of_chapters(spark, sf):
    """Links that name a case of one of two chapters, or its title, or nothing."""
    n = F.col("l_linenumber")
    label = F.when(n % 3 == 0, "The  Budget Hearing file").when(n % 3 == 1, F.concat(F.lit("Backup PD20-"), F.col("l_orderkey"))).otherwise("map")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    links = spread(lines, lines.count(), "l_orderkey").select("l_orderkey", n.alias("link_id"), label.alias("label"), F.lit("https://x").alias("url"))
    keys = links.select("l_orderkey").distinct()
    chapters = keys.select("l_orderkey", F.lit(0).cast("long").alias("chapter"), F.concat(F.lit("Zoning Case PD20-"), F.col("l_orderkey")).alias("title")).unionByName(keys.select("l_orderkey", F.lit(1).cast("long").alias("chapter"), F.lit("Budget hearing").alias("title")))
    return judging.chapter_of_links(links, chapters, ["l_orderkey"], r"[A-Z]{1,4}\d{2}-\d+").select("l_orderkey", "link_id", "chapter")


@query()
def aligned_turns(spark, sf):
    """The words of each turn beside those of the turn before it, as an alignment puts them together."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", align.plain_words(F.col("text")).alias("words"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("before"))
    return align.aligned_words(turns.join(before, ["conv_id", "turn"]), ["conv_id", "turn"], "words", "before")


@query()
def bootstrap_users(spark, sf):
    """The mean value of each kind of event, with an interval over users drawn as often as there are."""
    return stats.bootstrap_fixed(table(spark, sf, "events"), ["event_type"], "user_id", "value", 200, "a")


@query("""WITH s AS (SELECT l_orderkey AS uid, row_number() OVER w AS i, row_number() OVER w AS n, l_quantity::DOUBLE AS len, sum(l_quantity::DOUBLE) OVER w AS e, l_partkey % 50 AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, e - len + CASE WHEN x = 1 THEN 2 WHEN x = 2 AND n > 1 THEN -2 ELSE 0 END AS a FROM s), p AS (SELECT *, lag(e) OVER (PARTITION BY uid ORDER BY i) AS before FROM g), t AS (SELECT uid, sum(e - a) AS total, max(e) AS last, max(e) + CASE WHEN uid % 9 = 0 THEN 5 ELSE 0 END AS served FROM g GROUP BY uid)
SELECT uid, CASE WHEN a < coalesce(before, 0) - 0.1 THEN 'timeline-overlap' WHEN before IS NULL THEN 'timeline-gap-start' ELSE 'timeline-gap' END AS code, i AS "at", 'error' AS severity FROM p WHERE a < coalesce(before, 0) - 0.1 OR a > coalesce(before, 0) + 0.1
UNION ALL SELECT uid, 'timeline-duration-mismatch', NULL, 'error' FROM t WHERE abs(total - served) >= 1 UNION ALL SELECT uid, 'timeline-short-coverage', NULL, 'error' FROM t WHERE abs(last - served) >= 1
UNION ALL SELECT uid, 'timeline-source-overrun', i, 'error' FROM g WHERE x = 3 UNION ALL SELECT o_orderkey, 'timeline-empty', NULL, 'error' FROM orders WHERE o_orderkey NOT IN (SELECT uid FROM s) UNION ALL SELECT uid, 'timeline-chapter-out-of-range', 1, 'warn' FROM t WHERE uid % 4 = 0""")
def timeline_findings(spark, sf):
    """Order lines as edit lists, some with gaps, overlaps, wrong lengths, long sources or late chapters."""
    from pyspark.sql import Window

    w = Window.partitionBy("uid").orderBy("i")
    x = F.col("x")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), place.cast("long").alias("i"), F.col("l_quantity").cast("double").alias("len"), (F.col("l_partkey") % 50).alias("x"))
    s = lines.withColumns({"n": F.row_number().over(w), "served_end": F.sum("len").over(w)})
    s = s.withColumn("served_start", F.col("served_end") - F.col("len") + F.when(x == 1, 2).when((x == 2) & (F.col("n") > 1), -2).otherwise(0))
    segments = s.select("uid", "i", F.lit("source").alias("kind"), F.lit("a").alias("source_id"), "served_start", "served_end", F.lit(0.0).alias("source_start"), F.when(x == 3, 1000.5).otherwise(1000.05).alias("source_end"))
    ends = s.groupBy(F.col("uid").alias("own_uid")).agg(F.max("served_end").alias("last"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"))
    recordings = orders.join(ends, F.col("uid") == F.col("own_uid"), "left").select("uid", (F.col("last") + F.when(F.col("uid") % 9 == 0, 5).otherwise(0)).alias("served"))
    chapters = recordings.where("served is not null").select("uid", F.lit(1).cast("long").alias("i"), F.when(F.col("uid") % 4 == 0, F.col("served") + 1).otherwise(F.col("served")).alias("start"))
    return integrity.timeline_findings(recordings, segments, orders.select("uid", F.lit("a").alias("source_id"), F.lit(1000.0).alias("duration")), chapters)


@query("""SELECT DISTINCT key FROM (SELECT unnest([CASE WHEN o_orderkey % 3 > 0 THEN 'a' || o_custkey END, CASE WHEN o_orderkey % 4 = 0 THEN 't' || o_orderkey ELSE '' END]) AS key FROM orders) WHERE coalesce(key, '') <> ''""")
def referenced_keys(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(k % 3 > 0, F.concat(F.lit("a"), F.col("o_custkey"))).alias("audio_key"), F.when(k % 4 == 0, F.concat(F.lit("t"), k)).otherwise("").alias("transcript_key"))
    return integrity.referenced_keys(rows, ["audio_key", "transcript_key"])


@query("""WITH l AS (SELECT user_id, event_id, 'https://x/' || (event_id % 60) AS url, row_number() OVER (PARTITION BY user_id, event_id % 60 ORDER BY event_id) AS r FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM l WHERE r = 1)
SELECT user_id, event_id, url, event_id % 5 = 0 OR event_id % 7 = 0 AS minutes FROM f WHERE n <= 25""")
def document_links(spark, sf):
    """A user's events as links, the first 25 urls of each, and whether they lead to minutes."""
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.concat(F.lit("https://x/"), k % 60).alias("url"), F.when(k % 5 == 0, "minutes").otherwise("agenda").alias("kind"), F.when(k % 7 == 0, "Draft MINUTES of May").otherwise("minuteshare").alias("label"))
    kept = integrity.deduplicated_links(rows, ["user_id"], "event_id", "url", 25)
    return kept.select("user_id", "event_id", "url", integrity.is_minutes_link(F.col("kind"), F.col("label"), F.col("url")).alias("minutes"))


@query("""WITH d AS (SELECT user_id % 40 AS verb, ts::DATE AS day, count(*) AS ran, sum(event_id % 50) AS backlog, sum(event_id % 3) % 2 AS ready FROM events GROUP BY ALL), i AS (SELECT *, backlog // 2 + verb % 2 AS limited, row_number() OVER (PARTITION BY verb ORDER BY day) AS i FROM d),
t AS (SELECT verb, count(*) AS days, coalesce(regr_slope(backlog, i), 0) AS slope, avg(backlog) AS mean, avg(ran) AS ran, max_by(backlog, day) AS last, max_by(ready, day) AS ready, max_by(limited, day) AS limited FROM i GROUP BY verb),
v AS (SELECT *, CASE WHEN days < 6 THEN 'insufficient_data' WHEN slope >= greatest(0.4, 0.01 * mean) THEN 'growing' WHEN slope <= -greatest(0.4, 0.01 * mean) THEN 'shrinking' ELSE 'flat' END AS trend, CASE WHEN days >= 6 AND ran > 0 THEN last / ran END AS drain FROM t),
h AS (SELECT *, days >= 6 AND CASE WHEN verb % 3 > 0 THEN last > 0 AND coalesce(drain > 20, TRUE) AND trend <> 'shrinking' ELSE trend = 'growing' END AND ready = 0 AS held FROM v)
SELECT verb, days, last::BIGINT AS backlog, trend, round(drain, 2) AS drain_days, held AS constrained, CASE WHEN held AND last > 0 THEN CASE WHEN limited / last >= 0.5 THEN 'raise_ingress_quota' ELSE 'add_route_capacity' END END AS action FROM h""")
def backlog_verdicts(spark, sf):
    """Forty groups of users as verbs with a backlog a day."""
    k = F.col("event_id")
    days = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("verb"), F.to_date("ts").alias("day")).agg(F.count("*").alias("ran"), F.sum(k % 50).alias("backlog"), (F.sum(k % 3) % 2).alias("ready"))
    days = days.withColumn("limited", F.floor(F.col("backlog") / 2) + F.col("verb") % 2)
    told = integrity.backlog_verdicts(days, ["verb"], 6, 0.4, 0.01, 20.0, F.col("verb") % 3 > 0)
    return told.select("verb", "days", "backlog", "trend", "drain_days", "constrained", "action")


JUDGED = """j AS (SELECT event_id AS seq, user_id % 30 AS subject, 't' || (user_id % 2) AS task, 'q' || (event_id % 3) || CASE WHEN event_id % 5 = 4 THEN '_s' ELSE '' END AS question, CASE WHEN event_id % 4 = 0 THEN 'T2' ELSE 'T1' END AS tier, ['anchor', 'sibling', 'adjudicator'][event_id * 7 % 5 % 3 + 1] AS role, 'm' || (event_id % 7) AS model,
CASE WHEN event_id % 5 = 4 THEN 'stability' WHEN event_id % 11 = 0 THEN 'escalation' ELSE 'routine' END AS sample, CASE WHEN event_id % 6 > 0 THEN 'validate' ELSE 'rate' END AS kind, CASE WHEN event_id % 8 > 0 THEN event_id * 13 % 17 % 2 = 0 END AS said, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS quote_valid FROM events)"""


def judgments(spark, sf):
    k = F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    again = k % 5 == 4
    return table(spark, sf, "events").select(
        k.alias("seq"), (F.col("user_id") % 30).alias("subject"), F.concat(F.lit("t"), F.col("user_id") % 2).alias("task"), F.concat(F.lit("q"), k % 3, F.when(again, "_s").otherwise("")).alias("question"), F.when(k % 4 == 0, "T2").otherwise("T1").alias("tier"), pick(("anchor", "sibling", "adjudicator"), k * 7 % 5 % 3).alias("role"), F.concat(F.lit("m"), k % 7).alias("model"),
        F.when(again, "stability").when(k % 11 == 0, "escalation").otherwise("routine").alias("sample"), F.when(k % 6 > 0, "validate").otherwise("rate").alias("kind"), F.when(k % 8 > 0, k * 13 % 17 % 2 == 0).alias("said"), F.when(k % 9 == 1, False).when(k % 9 > 0, True).alias("quote_valid"),
    )


@query(f"""WITH {JUDGED} SELECT role, model, count(*) FILTER (WHERE quote_valid) AS valid, count(*) FILTER (WHERE NOT quote_valid) AS invalid, count(*) FILTER (WHERE quote_valid IS NULL) AS unchecked FROM j WHERE role <> 'anchor' GROUP BY ALL""")
def judged_quotes(spark, sf):
    return verdicts.quote_counts(judgments(spark, sf))


@query(f"""WITH {JUDGED}, v AS (SELECT subject, task, question, tier, role, model, arg_max(said, seq) AS said, min(seq) AS first FROM j WHERE kind = 'validate' AND said IS NOT NULL AND role <> 'adjudicator' GROUP BY ALL), f AS (SELECT *, CASE WHEN model IN ('m0', 'm1', 'm2') THEN 'f' ELSE model END AS family FROM v),
p AS (SELECT a.subject, a.task, a.question, a.tier, a.model, a.said AS x, arg_min(b.said, b.first) AS y FROM f a JOIN f b USING (subject, task, question, tier) WHERE a.role = 'anchor' AND b.role = 'sibling' AND a.family <> b.family GROUP BY ALL)
SELECT model, task, question, tier, count(*) FILTER (WHERE x = y) AS agree, count(*) AS pairs, round(count(*) FILTER (WHERE x = y) / count(*), 4) AS rate FROM p GROUP BY ALL""")
def judged_agreement(spark, sf):
    families = spark.createDataFrame([(f"m{i}", "f") for i in range(3)], "model string, family string")
    return verdicts.agreement(judgments(spark, sf), families)


@query(f"""WITH {JUDGED}, s AS (SELECT subject, model, bool_or(role = 'anchor' AND tier = 'T1') AS f, bool_or(sample = 'escalation') AS e FROM j GROUP BY ALL) SELECT model, count(*) FILTER (WHERE e) AS escalated, count(*) AS subjects FROM s WHERE f GROUP BY model""")
def judged_escalation(spark, sf):
    return verdicts.escalation(judgments(spark, sf), "T1")


@query(f"""WITH {JUDGED}, s AS (SELECT *, CASE WHEN subject % 2 = 0 THEN subject % 4 = 0 END AS truth, (role <> 'adjudicator' OR coalesce(quote_valid, TRUE)) AS usable FROM j)
SELECT model, count(*) AS asked, count(*) FILTER (WHERE usable AND truth IS NOT NULL AND said IS NOT NULL) AS scored, count(*) FILTER (WHERE usable AND truth = said) AS correct, count(*) FILTER (WHERE NOT quote_valid) AS unsupported FROM s GROUP BY model""")
def judged_probes(spark, sf):
    """All subjects as probes; the even ones have a known truth."""
    rows = judgments(spark, sf)
    truths = rows.select("subject").distinct().where("subject % 2 = 0").withColumn("truth", F.col("subject") % 4 == 0)
    return verdicts.probe_results(rows, truths)


@query(f"""WITH {JUDGED}, u AS (SELECT * FROM j WHERE (role <> 'adjudicator' OR coalesce(quote_valid, TRUE)) AND said IS NOT NULL), r AS (SELECT subject, task, model, question, tier, arg_max(said, seq) AS own FROM u WHERE sample = 'routine' GROUP BY ALL)
SELECT u.model, count(*) AS again, count(*) FILTER (WHERE u.said <> own) AS changed FROM u JOIN r ON u.subject = r.subject AND u.task = r.task AND u.model = r.model AND u.tier = r.tier AND regexp_replace(u.question, '_s$', '') = r.question WHERE u.sample = 'stability' GROUP BY u.model""")
def judged_stability(spark, sf):
    return verdicts.stability(judgments(spark, sf))


@query("""SELECT o_orderkey, 2.5::DOUBLE * coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END, 0) + 0.5 * (o_orderkey % 4) AS work FROM orders""")
def weighted_work(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", workqueue.weighted_work({"encode": (F.when(k % 3 > 0, k % 7), 2.5), "probe": (k % 4, 0.5)}).alias("work"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11)::DOUBLE END, avg(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11)::DOUBLE END) OVER ()) AS weight FROM orders""")
def imputed_weights(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 5 > 0, (k % 11).cast("double")).alias("known"))
    return stats.imputed_weight(rows, "known", "weight").select("o_orderkey", "weight")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def best_orders(spark, sf):
    """Each customer's dearest order, and of these the 25 dearest."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return text.best_rows(rows, ["o_custkey"], "o_totalprice", "o_orderkey", 25)
