"""Readers and writers: tables, record stores, feeds, event logs, timed texts and pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorumlake.functions.text import cues
from quorumlake.sources.scratch import exists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_store(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """uid and the record's fields, from files of one object {"schema_version", "episodes": {uid: record}} each."""
    schema = f"schema_version int, episodes map<string, {record.simpleString()}>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").select(F.explode("episodes").alias("uid", "r")).select("uid", "r.*")


def event_log(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """Events from JSON lines; broken lines are left out, as are events before since."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")
    return rows.where(F.col("ts") >= since) if since else rows


def feed_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of RSS files."""
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def timed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, start, end and text of the cues of WebVTT or SRT texts."""
    return df.select(key, F.posexplode(cues(F.col(text))).alias("seq", "c")).select(key, "seq", "c.*")


class _Page(HTMLParser):
    """The visible text and the links of a page."""

    HIDDEN = ("script", "style", "template", "noscript")

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(" ".join(data.split()))


def page_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, text and links of HTML pages; null pages give null."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page in b[html]:
                if page is None:
                    rows.append((None, None))
                    continue
                parser = _Page()
                parser.feed(page)
                parser.close()
                rows.append((" ".join(parser.parts), parser.links))
            yield pd.DataFrame({key: b[key], "text": [r[0] for r in rows], "links": [r[1] for r in rows]})

    return df.select(key, html).mapInPandas(of, f"{key} {dict(df.dtypes)[key]}, text string, links array<string>")


class _Outline(HTMLParser):
    """Headings, and links of the class agenda as headings of the second level, without hidden parts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.open, self.rows = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "nav", "footer", "noscript")
        classes = (dict(attrs).get("class") or "").lower().split()
        heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if not self.hidden and (heading or (tag == "a" and "agenda" in classes)):
            self.rows.append((int(tag[1]) if heading else 2, []))
            self.open.append((tag, self.rows[-1][1]))

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "nav", "footer", "noscript") and self.hidden > 0
        at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            for _, parts in self.open:
                parts.append(data)


def page_outlines(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, seq, level and title of the headings of HTML pages; a title under three characters, or one that the page has had in any case of letters, is left out. Null pages have none."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, page in zip(b[key], b[html], strict=True):
                parser, seen = _Outline(), set()
                parser.feed(page or "")
                parser.close()
                for level, parts in parser.rows:
                    title = " ".join(" ".join(parts).split())
                    if len(title) >= 3 and title.casefold() not in seen:
                        rows.append((k, len(seen), level, title))
                        seen.add(title.casefold())
            yield pd.DataFrame(rows, columns=[key, "seq", "level", "title"])

    return df.select(key, html).mapInPandas(of, f"{key} {dict(df.dtypes)[key]}, seq int, level int, title string")


def dated_archive_links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """key, seq, title, day and url of the links to archived documents (?ADID=number) whose titles hold a date: "May 5, 2026", else "5-5-2026". Links that begin with a slash or a file name are put behind the base."""
    link = r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*[?&](?:amp;)?ADID=\d+[^\"']*)[\"'][^>]*>(.*?)</a>"
    rows = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(link), F.lit(0))).alias("seq", "own_link"))
    title = F.trim(F.regexp_replace(_unescaped(F.regexp_replace(F.regexp_extract("own_link", link, 2), "<[^>]+>", " ")), r"\s+", " "))
    href = _unescaped(F.regexp_extract("own_link", link, 1))
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    rows = rows.withColumn("title", title).withColumn("own_href", href)
    long_date = F.regexp_replace(F.initcap(F.regexp_extract("title", rf"(?i)\b(?:{months})\s+\d{{1,2}},\s+\d{{4}}\b", 0)), r"\s+", " ")
    day = F.coalesce(F.try_to_timestamp(F.nullif(long_date, F.lit("")), F.lit("MMMM d, yyyy")), F.try_to_timestamp(F.nullif(F.regexp_extract("title", r"\b\d{1,2}-\d{1,2}-\d{4}\b", 0), F.lit("")), F.lit("M-d-yyyy"))).cast("date")
    site = F.regexp_extract(F.lit(base), r"^[a-zA-Z]+://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract(F.lit(base), r"^[^?#]*", 0), r"[^/]*$", "")
    url = F.when(F.col("own_href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("own_href")).when(F.col("own_href").startswith("/"), F.concat(site, F.col("own_href"))).otherwise(F.concat(folder, F.col("own_href")))
    return rows.select(key, "seq", "title", day.alias("day"), url.alias("url")).where("day IS NOT NULL")


def grid_rows(df: DataFrame, key: str, html: str, columns: list[str], row_class: str = "rg(?:Alt)?Row") -> DataFrame:
    """key, seq and, for each named column of an HTML grid, its text and link; of rows that several pages repeat, the first.

    The rows of a grid are those of a class; a column is the element whose id ends with its name. Null pages have none.
    """
    rows = F.regexp_extract_all(F.col(html), F.lit(rf'(?is)<tr\b[^>]*\bclass="[^"]*\b{row_class}\b[^"]*"[^>]*>(.*?)</tr>'), F.lit(1))
    seen = df.select(key, F.posexplode(rows).alias("seq", "_row"))
    first = seen.groupBy(F.sha2("_row", 256).alias("_id")).agg(F.min_by(F.struct(key, "seq", "_row"), F.struct(key, "seq")).alias("_r")).select("_r.*")
    for c in columns:
        tag = F.regexp_extract("_row", rf'(?is)(<[^>]*\bid="[^"]*_{c}"[^>]*>)', 1)
        inner = F.regexp_extract("_row", rf'(?is)<(\w+)\b[^>]*\bid="[^"]*_{c}"[^>]*>(.*?)</\1>', 2)
        text = F.trim(F.regexp_replace(_unescaped(F.regexp_replace(inner, "<[^>]+>", " ")), r"\s+", " "))
        link = _unescaped(F.regexp_extract(tag, r'(?is)\bhref="([^"]+)"', 1))
        first = first.withColumns({c: F.nullif(text, F.lit("")), f"{c}_link": F.nullif(link, F.lit(""))})
    return first.drop("_row")


def _unescaped(text: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def rendered_feed(df: DataFrame, by: str, title: Column, guid: str, published: str, url: Column, mime: str, most: int) -> DataFrame:
    """by, items and xml: the RSS items of each channel's newest rows, newest first; rows without a url are left out
    after the newest were taken. A channel without an item has no row."""
    newest = Window.partitionBy(by).orderBy(F.col(published).desc_nulls_last(), F.col(guid))
    date = F.concat(F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(
        F.lit("<item><title>"), _escaped(F.coalesce(title, F.lit(""))), F.lit('</title><guid isPermaLink="false">'), _escaped(F.col(guid).cast("string")), F.lit("</guid><pubDate>"),
        F.coalesce(date, F.lit("")), F.lit('</pubDate><enclosure url="'), _escaped(url), F.lit(f'" length="0" type="{mime}"/></item>'),
    )
    kept = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).select(by, "_n", item.alias("_item")).where("_item is not null")
    whole = kept.groupBy(by).agg(F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct("_n", "_item"))).alias("_all"))
    return whole.select(by, "items", F.array_join("_all._item", "\n").alias("xml"))


def save_records(df: DataFrame, path: str, by: str, parts: int = 64) -> None:
    """Replaces the rows of the keys that the frame has rows for, and of no others.

    Keys lie in so many folders by hash, however many keys there are; always give a path the same number. The folders of
    the frame's keys are written anew, each with the stored rows of its other keys; the rest isn't touched.
    """
    spark, placed = df.sparkSession, lambda rows: rows.withColumn("own_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    rows = placed(df)
    if exists(spark, path):
        keys = df.select(F.col(by).alias("own_key")).distinct()
        touched = [r["own_part"] for r in rows.select("own_part").distinct().collect()]  # at most parts numbers
        stored = spark.read.schema(rows.schema).parquet(path).where(F.col("own_part").isin(touched))
        rows = rows.unionByName(stored.join(keys, F.col(by).eqNullSafe(F.col("own_key")), "left_anti"))
    rows.repartition("own_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("own_part").parquet(path)


def saved_records(spark: SparkSession, path: str) -> DataFrame:
    """What save_records has put down."""
    return spark.read.parquet(path).drop("own_part")
