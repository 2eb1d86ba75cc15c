"""Work rows: what is to be done for each record, in the order of a policy, with leases laid over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.normalize import body_key, plain_key
from quorumlake.sources.scratch import written

# Ranks of the buckets that publishable work comes from.
BUCKETS = ("feed_visible", "recent_archive", "deep_archive")


def _age_days(ts: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 8.64e10


def _rank(value: Column, order: list[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in order]), value) if order else F.lit(0)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(order))


def recency(ts: Column, now: str, order: str = "desc", within_days: float | None = None) -> list[Column]:
    """By date, unknown dates last. With a horizon only dates within it count; all others tie."""
    seconds = F.unix_micros(ts.cast("timestamp"))
    signed = -seconds if order == "desc" else seconds
    if within_days is None:
        return [signed.asc_nulls_last()]
    near = F.coalesce(_age_days(ts, now) <= within_days, F.lit(False))
    return [F.when(near, 0).otherwise(1).asc(), F.when(near, signed).otherwise(0).asc()]


def recent_first(ts: Column, now: str, days: float) -> list[Column]:
    return [F.when(F.coalesce(_age_days(ts, now) <= days, F.lit(False)), 0).otherwise(1).asc()]


def city_order(city: Column, order: list[str]) -> list[Column]:
    """Named cities by their place; all others tie."""
    return [_rank(city, order).asc()]


def body_order(body: Column, order: list[str] | None = None) -> list[Column]:
    key = F.coalesce(body_key(body), F.lit(""))
    return [_rank(key, [plain_key(b) for b in order or []]).asc(), key.asc()]


def feed_visible_first(bucket: Column) -> list[Column]:
    return [F.least(_rank(bucket, list(BUCKETS)), F.lit(2)).asc()]


def long_first(work_class: Column, hours: Column, threshold: float, classes: tuple[str, ...]) -> list[Column]:
    """Work of some classes that is longer than the threshold first."""
    return [F.when(work_class.isin(list(classes)) & (hours > threshold), 0).otherwise(1).asc()]


def ordered(df: DataFrame, keys: list[list[Column]], ordinal: str) -> DataFrame:
    """The rows in the order of all keys, and then of their first place. An ordering of everything is a range shuffle."""
    return df.orderBy(*[c for k in keys for c in k], ordinal)


def positions(df: DataFrame, by: list[str], keys: list[list[Column]], ordinal: str, name: str = "position") -> DataFrame:
    """The place of each row in the order, within its group; without a group, among all rows.

    All rows are sorted by ranges and written once; a range's rows are numbered in it and begin after those of the ranges
    before it, of which one number each is told.
    """
    order = [c for k in keys for c in k]
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order, ordinal)))
    sorted_rows = written(df.orderBy(*order, ordinal).withColumn("own_range", F.spark_partition_id()).withColumn("own_id", F.monotonically_increasing_id()), "ordered")
    counts = sorted_rows.groupBy("own_range").agg(F.count("*").alias("own_n"), F.min("own_id").alias("own_first"))
    before = counts.withColumn("own_before", F.coalesce(F.sum("own_n").over(Window.orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("own_before") + F.col("own_id") - F.col("own_first") + 1
    return sorted_rows.join(F.broadcast(before), "own_range").select(*df.columns, place.cast("int").alias(name))


def manifest(records: DataFrame, artifacts: dict[str, Column], done: dict[str, Column]) -> DataFrame:
    """A row for each record and artifact that applies to it: work_class and state (done or pending). artifacts and done: conditions by class."""
    rows = F.array(*[F.when(a, F.struct(F.lit(k).alias("work_class"), F.when(F.coalesce(done[k], F.lit(False)), "done").otherwise("pending").alias("state"))) for k, a in artifacts.items()])
    return records.withColumn("own_work", F.explode(F.array_compact(rows))).select(*records.columns, "own_work.*")


def overlay_leases(items: DataFrame, leases: DataFrame, keys: list[str], now: str) -> DataFrame:
    """Rows that aren't done and have a lease that holds are running. leases: keys and expires_at."""
    live = leases.where(F.col("expires_at").cast("timestamp") > F.lit(now).cast("timestamp")).select(*keys).distinct().withColumn("own_live", F.lit(True))
    state = F.when(F.col("own_live") & (F.col("state") != "done"), "running").otherwise(F.col("state"))
    return items.join(live, keys, "left").withColumn("state", state).select(*items.columns)


def overlay_state(items: DataFrame, persisted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows that aren't done take the persisted columns of their key."""
    held = persisted.select(*keys, F.struct(*columns).alias("own_held")).dropDuplicates(keys)
    take = F.col("own_held").isNotNull() & (F.col("state") != "done")
    return items.join(held, keys, "left").withColumns({c: F.when(take, F.col("own_held")[c]).otherwise(F.col(c)) for c in columns}).select(*items.columns)


def rotated(df: DataFrame, by: list[str], order: list[Column], owner: Column, offset: int) -> DataFrame:
    """Each group's rows in an order that begins at a place that its owner and the offset give: position from 0."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    start = F.conv(F.left(F.md5(owner.cast("string")), F.lit(8)), 16, 10).cast("long") + offset
    return df.withColumn("position", F.pmod(place - start, n).cast("int"))


def shard_of(plan: DataFrame, lane: str, shard: int, expected: DataFrame, key: str) -> DataFrame:
    """The keys of a plan that one shard of a lane takes, of those that are expected. plan: lane, shard, key."""
    return plan.where((F.col("lane") == lane) & (F.col("shard") == shard)).select(key).join(expected.select(key).distinct(), key, "left_semi")


def lane_class(states: dict[str, Column], queue: dict[str, Column], observed: Column, partial: Column) -> Column:
    """What holds a lane up: a (input), b (producer), c (dispatcher), d (return path), e (budget or policy), idle or unknown. states: ready, queued, limited, stopped, blocked, held, errored; queue: waiting, done, failed, unobserved, null where it wasn't measured."""
    s = {k: F.coalesce(v, F.lit(0)) for k, v in states.items()}
    q = {k: F.coalesce(v, F.lit(0)) for k, v in queue.items()}
    backlog = s["ready"] + s["queued"] + s["limited"] + s["stopped"]
    return (
        F.when(F.coalesce(observed, F.lit(0)) == 0, "unknown")
        .when((backlog == 0) & ((s["errored"] > 0) | (s["held"] > 0)), "e")
        .when((backlog == 0) & (s["blocked"] > 0), "a")
        .when(backlog == 0, F.when(F.coalesce(partial, F.lit(False)), "unknown").otherwise("idle"))
        .when((s["limited"] > 0) & (s["limited"] >= F.greatest(s["ready"], s["queued"], s["stopped"])), "e")
        .when(s["ready"] + s["stopped"] > s["queued"], F.when(s["blocked"] > backlog, "a").otherwise("b"))
        .when(F.coalesce(*queue.values()).isNull(), "unknown")
        .when(q["unobserved"] >= F.greatest(q["waiting"], q["done"], F.lit(1)), "unknown")
        .when(q["failed"] > F.greatest(q["waiting"], q["done"]), "c")
        .when(q["done"] > q["waiting"], "d")
        .otherwise("c")
    )


def pending_work(df: DataFrame, by: list[str], pending: Column, seconds: Column, unknown_seconds: float, recheck: Column, recheck_seconds: float) -> DataFrame:
    """Seconds of work of a source: pending rows by their own duration or, where it is unknown, by the source's mean or else a fixed value; rows to be checked again cost a fixed value."""
    mean = F.avg(F.when(pending, seconds))
    return df.groupBy(*by).agg(
        (F.coalesce(F.sum(F.when(pending, seconds)), F.lit(0.0)) + F.count_if(pending & seconds.isNull()) * F.coalesce(mean, F.lit(unknown_seconds)) + F.count_if(recheck) * recheck_seconds).alias("work_seconds"),
        F.count_if(pending).alias("pending"),
    )


def weighted_work(groups: dict[str, tuple[Column, float]]) -> Column:
    """A linear combination of kinds of work: by name, an amount and its weight."""
    out = F.lit(0.0)
    for amount, weight in groups.values():
        out = out + F.coalesce(amount, F.lit(0)) * weight
    return out


def enclosure(withheld: Column, kind: Column, hosted: Column, direct: Column, video: Column, audio: bool) -> Column:
    """The enclosure of a feed of audio or video: none for withheld media; hosted audio before direct; video of direct media only."""
    is_direct = kind == "direct"
    own = F.when(F.coalesce(hosted, F.lit("")) != "", hosted).when(is_direct, direct) if audio else F.when(is_direct, video)
    return F.when(~F.coalesce(withheld, F.lit(False)), own)


def ordered_links(links: Column, known: tuple[str, ...]) -> Column:
    """A map's links over http in the order of known kinds, and then by kind, as (kind, url)."""
    kept = F.map_filter(links, lambda k, v: F.lower(v).rlike("^https?://"))
    place = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in known]), k), F.lit(0)), F.lit(len(known) + 1).cast("long"))
    ranked = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(place(e["key"]).alias("place"), e["key"].alias("kind"), e["value"].alias("url"))))
    return F.transform(ranked, lambda x: F.struct(x["kind"], x["url"]))


def chapters_json(chapters: Column, version: str = "1.2.0") -> Column:
    """A list of chapters (start, title) as JSON, in order of their starts."""
    return F.to_json(F.struct(F.lit(version).alias("version"), F.transform(F.array_sort(chapters), lambda c: F.struct(c["start"].alias("startTime"), c["title"].alias("title"))).alias("chapters")))
