"""Findings about stored edit lists, references to stored objects, links of documents, and verdicts about backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds within which two places on a clock are the same.
TOLERANCE = 0.1


def timeline_findings(recordings: DataFrame, segments: DataFrame, sources: DataFrame, chapters: DataFrame, least: float = 1.0) -> DataFrame:
    """uid, code, severity and at, the number of the segment or chapter (null for the whole list).

    recordings: uid and served (its stored length, or null); those without a segment are timeline-empty. segments: uid, i,
    kind, source_id, served_start, served_end, source_start, source_end; the served ones must begin at 0 and lie end to end, and their sum
    and end must be the stored length within ``least`` seconds; source spans must lie in their sources (uid, source_id,
    duration). chapters: uid, i, start, on the served clock, must lie within the stored length.
    """
    told = recordings.select("uid", "served")
    rows = segments.join(told, "uid")
    w = Window.partitionBy("uid").orderBy("i")
    before, start = F.lag("served_end").over(w), F.col("served_start")
    found = lambda code, ok: F.when(ok, F.lit(code))
    first = F.col("own_before").isNull()
    placed = rows.withColumn("own_before", before)
    gap = found("timeline-overlap", start < F.coalesce("own_before", F.lit(0.0)) - TOLERANCE), found("timeline-gap", ~first & (start > F.col("own_before") + TOLERANCE)), found("timeline-gap-start", first & (start > TOLERANCE))
    codes = lambda *c: F.explode(F.array_compact(F.array(*c))).alias("code")
    out = placed.select("uid", codes(*gap), F.col("i").alias("at"))
    spans = rows.where("kind = 'source'").join(sources.where("duration is not null"), ["uid", "source_id"])
    out = out.unionByName(spans.select("uid", codes(found("timeline-source-underrun", F.col("source_start") < -TOLERANCE), found("timeline-source-overrun", F.col("source_end") > F.col("duration") + TOLERANCE)), F.col("i").alias("at")))
    whole = rows.groupBy("uid").agg(F.first("served").alias("served"), F.sum(F.col("served_end") - start).alias("own_sum"), F.max_by("served_end", "i").alias("own_end"))
    off, short = F.abs(F.col("own_sum") - F.col("served")) >= least, F.abs(F.col("own_end") - F.col("served")) >= least
    out = out.unionByName(whole.select("uid", codes(found("timeline-duration-mismatch", off), found("timeline-short-coverage", short)), F.lit(None).cast(segments.schema["i"].dataType).alias("at")))
    empty = told.join(segments.select("uid").distinct(), "uid", "left_anti")
    out = out.unionByName(empty.select("uid", F.lit("timeline-empty").alias("code"), F.lit(None).cast(segments.schema["i"].dataType).alias("at"))).withColumn("severity", F.lit("error"))
    late = chapters.join(told.where("served is not null"), "uid").where((F.col("start") < -TOLERANCE) | (F.col("start") > F.col("served") + TOLERANCE))
    return out.unionByName(late.select("uid", F.lit("timeline-chapter-out-of-range").alias("code"), F.col("i").cast(segments.schema["i"].dataType).alias("at"), F.lit("warn").alias("severity")))


def referenced_keys(records: DataFrame, keys: list[str]) -> DataFrame:
    """key: each object that any record refers to in any of these columns, once."""
    return records.select(F.explode(F.array_distinct(F.array(*keys))).alias("key")).where("coalesce(key, '') <> ''").distinct()


def deduplicated_links(links: DataFrame, by: list[str], order: str, url: str, most: int) -> DataFrame:
    """Of each document's links the first of each url, up to so many, in order."""
    first = links.withColumn("own_r", F.row_number().over(Window.partitionBy(*by, url).orderBy(order))).where("own_r = 1").drop("own_r")
    return first.withColumn("own_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("own_r") <= most).drop("own_r")


def is_minutes_link(kind: Column, label: Column, url: Column) -> Column:
    return F.coalesce(kind == "minutes", F.lit(False)) | F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(url, F.lit(""))).rlike(r"(?i)\bminutes?\b")


def backlog_verdicts(days: DataFrame, by: list[str], fewest: int, deadband: float, deadband_share: float, most_days: float, reliable: Column) -> DataFrame:
    """by, days, backlog (of the last day), slope, mean, trend, throughput, drain_days, constrained and action.

    days: by, day, backlog, ran, ready and limited. With fewer than ``fewest`` days nothing is judged. The slope over the
    days' numbers is a trend if it reaches the deadband, the greater of a number and a share of the mean. Where the throughput
    can be relied on, work is constrained if it wouldn't be drained in most_days and doesn't shrink; else if it grows; and never
    while some is ready. Then more ingress helps if at least half of it is limited by that, else more routes.
    """
    last = F.struct("day", "backlog", "ready", "limited")
    n = Window.partitionBy(*by).orderBy("day")
    told = days.withColumn("own_i", F.row_number().over(n)).groupBy(*by).agg(F.count("*").alias("days"), F.max(last).alias("own_last"), F.coalesce(F.regr_slope(F.col("backlog"), F.col("own_i")), F.lit(0.0)).alias("own_slope"), F.avg("backlog").alias("own_mean"), F.avg("ran").alias("own_ran"), F.first(reliable).alias("own_reliable"))
    some, backlog = F.col("days") >= fewest, F.col("own_last.backlog")
    band = F.greatest(F.lit(float(deadband)), deadband_share * F.col("own_mean"))
    trend = F.when(~some, "insufficient_data").when(F.col("own_slope") >= band, "growing").when(F.col("own_slope") <= -band, "shrinking").otherwise("flat")
    drain = F.when(some & (F.col("own_ran") > 0), backlog / F.col("own_ran"))
    told = told.withColumns({"trend": trend, "own_drain": drain})
    slow = (backlog > 0) & F.coalesce(F.col("own_drain") > most_days, F.lit(True)) & (F.col("trend") != "shrinking")
    held = some & F.when(F.col("own_reliable"), slow).otherwise(F.col("trend") == "growing") & (F.col("own_last.ready") == 0)
    action = F.when(held & (backlog > 0), F.when(F.col("own_last.limited") / backlog >= 0.5, "raise_ingress_quota").otherwise("add_route_capacity"))
    measured = lambda c, digits: F.when(some, F.round(c, digits))
    return told.select(*by, "days", backlog.alias("backlog"), measured(F.col("own_slope"), 2).alias("slope"), measured(F.col("own_mean"), 1).alias("mean"), "trend", measured(F.col("own_ran"), 1).alias("throughput"), F.round("own_drain", 2).alias("drain_days"), held.alias("constrained"), action.alias("action"))
