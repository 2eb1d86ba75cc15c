"""Rows from providers' payloads: JSON events, archives, player marks, word timings, and HTML anchors. A payload is a string column; broken ones give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "id string, eventName string, eventDescription string, startDateTime string, categoryId long, categoryName string, meetingTypeName string, hasMedia boolean, mediaSourcePathMp4 string, publishedFiles array<struct<type:string,url:string>>"
MEETING = "dateTime string, meetingDate string, title string, meetingName string, documentList array<struct<templateName:string,templateId:string,compileOutputType:string>>"


def plain_title(text: Column) -> Column:
    """Without tags, the five named entities resolved, single spaces."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def listed(df: DataFrame, key: str, payload: str, row: str, *wrappers: str) -> DataFrame:
    """key, seq and the fields of the payload's objects: of a list, or of the list that an object holds under one of the names."""
    own = F.from_json(payload, f"array<struct<{row}>>")
    held = F.from_json(payload, ", ".join(f"`{w}` array<struct<{row}>>" for w in wrappers)) if wrappers else None
    rows = F.when(F.ltrim(payload).startswith("["), own) if held is not None else own
    for w in wrappers:
        rows = F.coalesce(rows, held[w])
    return df.select(key, F.posexplode(rows).alias("seq", "own")).where("own is not null").select(key, "seq", "own.*")


def _struct(fields: str) -> str:
    """DDL columns as the fields of a struct."""
    return ",".join(part.replace(" ", ":", 1) for part in fields.split(", "))


def first_of_kind(links: Column) -> Column:
    """(k, v) pairs as a map with the first of each kind; empty for null."""
    some = F.coalesce(links, F.array().cast("array<struct<k:string,v:string>>"))
    return F.map_from_entries(F.filter(some, lambda x, i: F.array_position(F.transform(some, lambda y: y["k"]), x["k"]) == i + 1))


def _events(df: DataFrame, key: str, payload: str, category: int | None) -> DataFrame:
    rows = listed(df, key, payload, _struct(EVENT), "value")
    at = F.try_to_timestamp("startDateTime")
    body = F.nullif(F.trim(F.coalesce(F.nullif("categoryName", F.lit("")), "meetingTypeName", F.lit(""))), F.lit(""))
    links = first_of_kind(F.transform(F.filter("publishedFiles", lambda f: f["type"].isNotNull() & f["url"].rlike("^https?://")), lambda f: F.struct(F.lower(f["type"]).alias("k"), f["url"].alias("v"))))
    made = rows.withColumns({"published": at, "body": body, "links": links})
    return made if category is None else made.where(F.col("categoryId") == category)


def event_episodes(df: DataFrame, key: str, payload: str, category: int | None = None) -> DataFrame:
    """Recorded meetings: events with media, an https video and a date. key, guid, title, published, video_url, body, links."""
    rows = _events(df, key, payload, category).withColumn("video_url", F.trim("mediaSourcePathMp4"))
    kept = rows.where(F.col("hasMedia") & F.col("video_url").rlike("^https://[^/]+") & F.col("published").isNotNull())
    return kept.select(key, F.col("id").alias("guid"), F.coalesce(F.nullif("eventName", F.lit("")), F.lit("Untitled meeting")).alias("title"), "published", "video_url", "body", "links")


def event_agendas(df: DataFrame, key: str, payload: str, category: int | None = None) -> DataFrame:
    """Dated events with a body and links, with media or without: key, body, published, links."""
    return _events(df, key, payload, category).where("published is not null and body is not null and cardinality(links) > 0").select(key, "body", "published", "links")


def archived_meetings(df: DataFrame, key: str, payload: str, portal: str) -> DataFrame:
    """Meetings of an archive with documents: key, title, published, links, the first document of each kind (agenda_packet, minutes or agenda)."""
    rows = listed(df, key, payload, _struct(MEETING), "data", "items")
    kind = lambda d: F.when(F.contains(F.lower(d["templateName"]), F.lit("packet")), "agenda_packet").when(F.contains(F.lower(d["templateName"]), F.lit("minute")), "minutes").when(F.contains(F.lower(d["templateName"]), F.lit("agenda")), "agenda")
    url = lambda d: F.concat(F.lit(portal.rstrip("/") + "/Portal/Meeting?compiledId="), d["templateId"])
    found = F.filter(F.transform(F.coalesce("documentList", F.array().cast("array<struct<templateName:string,templateId:string,compileOutputType:string>>")), lambda d: F.struct(kind(d).alias("k"), url(d).alias("v"))), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    made = rows.select(key, F.trim(F.coalesce("title", "meetingName", F.lit(""))).alias("title"), F.try_to_timestamp(F.coalesce("dateTime", "meetingDate")).alias("published"), first_of_kind(found).alias("links"))
    return made.where("title <> '' and published is not null and cardinality(links) > 0")


def first_per_start(marks: DataFrame, key: str) -> DataFrame:
    """Of marks (key, seq, start, title) with a title the first of each start."""
    kept = marks.where("start is not null and title <> ''")
    held = F.struct(*[c for c in kept.columns if c not in (key, "start", "seq")])
    return kept.groupBy(key, "start").agg(F.min_by(held, "seq").alias("own")).select(key, "start", "own.*")


def player_chapters(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Agenda headings of player data, a list or a list of one list: key, start, title."""
    text = F.regexp_replace(F.col(payload), r"^\s*\[\s*(\[.*\])\s*\]\s*$", "$1")
    rows = listed(df.withColumn("own_text", text), key, "own_text", "text:string,time:string,title:string").where("text like 'Agenda:%'")
    return first_per_start(rows.select(key, "seq", F.col("time").try_cast("int").alias("start"), plain_title(F.col("title")).alias("title")), key)


def bookmarks(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Titled marks after second 0: key, start, title."""
    rows = listed(df, key, payload, "markerTimeStart:string,markerTitle:string,markerName:string", "eventBookmarks")
    title = F.trim(F.coalesce(F.nullif("markerTitle", F.lit("")), "markerName", F.lit("")))
    return first_per_start(rows.select(key, "seq", F.col("markerTimeStart").try_cast("int").alias("start"), title.alias("title")).where("start > 0"), key)


def transcript_url(payload: Column) -> Column:
    """The transcript's address, else the captions'; null without either."""
    name = lambda n: F.nullif(F.trim(F.get_json_object(payload, f"$.{n}")), F.lit(""))
    return F.coalesce(name("transcriptionUrl"), name("closedCaptionUrl"))


def page_chapters(df: DataFrame, key: str, html: str) -> DataFrame:
    """Timed anchors of a video page: key, start, end, title."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"<a\b[^>]*\bplayerControl\b[^>]*>"), F.lit(0))
    each = df.select(key, F.posexplode(tags).alias("seq", "tag"))
    attr = lambda n: F.regexp_extract("tag", rf'\b{n}="([^"]*)"', 1)
    whole = lambda n: F.when(attr(n).rlike("^[0-9]+$"), attr(n).try_cast("int"))
    return first_per_start(each.select(key, "seq", whole("data-ts").alias("start"), whole("data-end-ts").alias("end"), plain_title(attr("data-title")).alias("title")), key)


def word_rows(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Timed words of a sidecar: key, seq, text, start, end."""
    parsed = F.from_json(payload, "segments array<struct<words:array<struct<w:string,s:double,e:double>>>>")
    words = F.flatten(F.filter(F.transform(parsed["segments"], lambda s: s["words"]), lambda w: w.isNotNull()))
    kept = F.filter(words, lambda w: (F.trim(F.coalesce(w["w"], F.lit(""))) != "") & w["s"].isNotNull() & w["e"].isNotNull())
    return df.select(key, F.posexplode(kept).alias("seq", "w")).select(key, "seq", F.trim("w.w").alias("text"), F.col("w.s").alias("start"), F.col("w.e").alias("end"))


def locator_units(words: DataFrame, cues: DataFrame, key: str, size: int) -> DataFrame:
    """Numbered units of ``size`` words, or the cues of transcripts without timed words: key, unit, start, end, text, basis."""
    units = words.groupBy(key, F.floor(F.col("seq") / size).cast("int").alias("unit")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text")).withColumn("basis", F.lit("words"))
    rest = cues.join(words.select(key).distinct(), key, "left_anti")
    numbered = rest.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1).alias("unit"), "start", "end", "text", F.lit("cues").alias("basis"))
    return units.unionByName(numbered)


def calendar_rows(df: DataFrame) -> DataFrame:
    """Calendar rows with an id, a body and a date that can be read; the title is made from the body where it is missing. df: uid, body, title, published (strings), links, video_guid, video_url."""
    kept = df.withColumn("published", F.try_to_timestamp("published")).where("coalesce(uid, '') <> '' and coalesce(body, '') <> '' and published is not null")
    return kept.withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), F.concat("body", F.lit(" Meeting"))), "links": F.coalesce("links", F.create_map().cast("map<string,string>")), "video_guid": F.nullif("video_guid", F.lit("")), "video_url": F.nullif("video_url", F.lit(""))})


RECORD_FIELDS = "uid string, provider_guid string, title string, published string, body string, media_kind string, video_url string, links map<string,string>, audio struct<url:string,key:string,spec_hash:string,attempts:int,error:string,bytes:bigint,duration_served:double>, duration double, chapters array<struct<start:double,title:string>>, chapters_basis string, transcript struct<key:string,synced:boolean>, sources array<struct<id:string,duration:double>>, schema_version int"


def decoded_records(df: DataFrame, payload: str) -> DataFrame:
    """Stored records as flat rows. Old versions lack sources and chapters_basis: their duration stands in and the basis is the first source's clock. Malformed records give no row."""
    r = F.from_json(payload, RECORD_FIELDS)
    held = df.withColumn("r", r).where("r.uid is not null")
    flat = {
        "uid": F.col("r.uid"), "guid": F.coalesce("r.provider_guid", F.lit("")), "title": F.coalesce("r.title", F.lit("")), "published": F.try_to_timestamp("r.published"), "body": F.col("r.body"),
        "media_kind": F.coalesce("r.media_kind", F.lit("direct")), "video_url": F.coalesce("r.video_url", F.lit("")), "links": F.coalesce("r.links", F.create_map().cast("map<string,string>")),
        "audio_url": F.col("r.audio.url"), "audio_key": F.col("r.audio.key"), "audio_spec_hash": F.col("r.audio.spec_hash"), "attempts": F.coalesce("r.audio.attempts", F.lit(0)), "error": F.col("r.audio.error"), "audio_bytes": F.col("r.audio.bytes"),
        "duration_served": F.col("r.audio.duration_served"), "duration_source": F.coalesce(F.get("r.sources", F.lit(0))["duration"], F.col("r.duration")),
        "chapters": F.coalesce("r.chapters", F.array().cast("array<struct<start:double,title:string>>")), "chapters_basis": F.coalesce("r.chapters_basis", F.lit("source:s0")), "transcript_key": F.col("r.transcript.key"), "synced": F.coalesce("r.transcript.synced", F.lit(False)),
    }
    return held.select(*[c.alias(n) for n, c in flat.items()])


def encoded_records(rows: DataFrame) -> DataFrame:
    """uid and record, the JSON of a flat row, without empty blocks: what ``decoded_records`` reads."""
    some = lambda c, empty: F.when(empty, None).otherwise(c)
    audio = F.struct(F.col("audio_url").alias("url"), F.col("audio_key").alias("key"), F.col("audio_spec_hash").alias("spec_hash"), F.nullif("attempts", F.lit(0)).alias("attempts"), "error", F.col("audio_bytes").alias("bytes"), "duration_served")
    blank = F.coalesce(*[F.col(c).cast("string") for c in ("audio_url", "audio_key", "audio_spec_hash", "error", "audio_bytes", "duration_served")], F.nullif("attempts", F.lit(0)).cast("string")).isNull()
    spoken = F.struct(F.col("transcript_key").alias("key"), "synced")
    record = F.struct(F.lit(2).alias("schema_version"), "uid", F.col("guid").alias("provider_guid"), "title", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published"), "body", "media_kind", "video_url", some(F.col("links"), F.cardinality("links") == 0).alias("links"), some(audio, blank).alias("audio"), F.when(F.col("duration_source").isNotNull(), F.array(F.struct(F.lit("s0").alias("id"), F.col("duration_source").alias("duration")))).alias("sources"), some(F.col("chapters"), F.size("chapters") == 0).alias("chapters"), "chapters_basis", some(spoken, F.col("transcript_key").isNull() & ~F.col("synced")).alias("transcript"))
    return rows.select("uid", F.to_json(record, {"ignoreNullFields": "true"}).alias("record"))


def feed_problems(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key and problem for feeds that aren't rss, lack a channel or its required parts, have no item, or have items without title, guid or date: counts of marks in the text, in place."""
    t = F.coalesce(F.col(xml), F.lit(""))
    head = F.regexp_extract(t, r"(?s)<channel\b[^>]*>(.*?)(?:<item\b|</channel>)", 1)
    items = F.regexp_extract_all(t, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    lacks = lambda tag: F.size(F.filter(items, lambda i: ~i.rlike(rf"<{tag}\b")))
    found = [F.when(~t.rlike(r"(?s)^\s*(?:<\?xml.*?\?>)?\s*<rss\b"), "no rss"), F.when(~t.rlike(r"<channel\b"), "no channel"), *[F.when(t.rlike(r"<channel\b") & ~head.rlike(rf"<{tag}\b"), f"channel without {tag}") for tag in ("title", "link", "description")], F.when(F.size(items) == 0, "no items"), *[F.when(lacks(tag) > 0, f"items without {tag}") for tag in ("title", "guid", "pubDate")]]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("problem"))
