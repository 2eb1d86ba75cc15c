"""Rules of the daily audit that judge a feed by its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _recent(ts: Column, now: str, days: int) -> Column:
    return ts >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))


def empty_feeds(feeds: DataFrame, least: int) -> DataFrame:
    """Feeds (n, and archived and materialized, which are null where no archive was compared) with kind: drift for no record, empty for fewer than the least number. What the archive holds excuses both."""
    drift = (F.col("n") == 0) & (F.coalesce("materialized", F.lit(0)) == 0)
    few = (F.col("n") > 0) & (F.col("n") < least) & (F.coalesce("archived", F.lit(0)) < least)
    return feeds.withColumn("kind", F.when(drift, "drift").when(few, "empty")).where("kind IS NOT NULL")


def rejected_agendas(df: DataFrame, by: list[str], uid: str, status: str, attempts: str, last_seen: str, now: str, least: int = 3, days: int = 90, most: int = 20) -> DataFrame:
    """Feeds with agendas that stay rejected after at least so many attempts: affected, assessed and the first uids as a report of at most so many.

    Only assessments last seen within the days count, and those without a time. Feeds without an affected record have no row.
    """
    tries = F.coalesce(attempts, F.lit(0))
    seen = df.where(F.col(last_seen).isNull() | _recent(F.col(last_seen).cast("timestamp"), now, days)).withColumn("own_hit", F.coalesce((F.col(status) == "rejected") & (tries >= least), F.lit(False)))
    ranked = seen.withColumn("own_rank", F.row_number().over(Window.partitionBy(*by, "own_hit").orderBy(uid)))
    counts = ranked.groupBy(*by).agg(F.count_if("own_hit").alias("affected"), F.count_if(tries > 0).alias("assessed"), F.array_sort(F.collect_list(F.when(F.col("own_hit") & (F.col("own_rank") <= most), F.col(uid)))).alias("uids"))
    return counts.where("affected > 0")


def doubtful_rosters(df: DataFrame, by: list[str], uid: str, published: str, status: str, members: str, now: str, least: int = 3, ratio: float = 0.5, days: int = 90) -> DataFrame:
    """Feeds whose rosters share nobody with any earlier meeting (disjoint), or whose recent minutes mostly have an empty one: disjoint, empty and considered.

    Rows without a status are no minutes; a status is read up to its "@". Members are an array of names. A meeting is disjoint if none of its members was named
    before it, so the first time of each name tells it and no set of names is carried along. Meetings of equal time go by uid. Feeds without a finding have no row.
    """
    outcome, recent = F.substring_index(status, "@", 1), _recent(F.col(published).cast("timestamp"), now, days)
    rows = df.where(F.coalesce(F.col(status), F.lit("")) != "").select(*by, F.struct(F.coalesce(F.col(published).cast("string"), F.lit("")).alias("p"), F.col(uid).alias("u")).alias("own_at"), outcome.alias("own_outcome"), F.coalesce(recent, F.lit(False)).alias("own_recent"), members)
    empty = rows.groupBy(*by).agg(F.count_if((F.col("own_outcome") == "empty") & F.col("own_recent")).alias("empty"), F.count_if("own_recent").alias("considered"))
    plain = F.array_distinct(F.filter(F.transform(members, lambda n: F.trim(F.regexp_replace(F.lower(n), r"\s+", " "))), lambda n: n != ""))
    named = rows.where("own_outcome <> 'empty'").select(*by, "own_at", F.explode(plain).alias("own_name"))
    known = named.withColumn("own_known", F.min("own_at").over(Window.partitionBy(*by, "own_name")) < F.col("own_at")).groupBy(*by, "own_at").agg(F.max("own_known").alias("own_known"))
    strange = known.withColumn("own_first", F.min("own_at").over(Window.partitionBy(*by))).groupBy(*by).agg(F.count_if(~F.col("own_known") & (F.col("own_at") > F.col("own_first"))).alias("disjoint"))
    both = empty.join(strange, by, "left").withColumn("disjoint", F.coalesce("disjoint", F.lit(0)))
    return both.where((F.col("disjoint") > 0) | ((F.col("empty") >= least) & (F.col("empty") >= ratio * F.col("considered"))))


def coverage_samples(df: DataFrame, good: int, bad: int) -> DataFrame:
    """The samples that a person should judge next, as a report of at most good + bad: sample_id and reason. df: sample_id, source, low and high (the smaller and larger of both scores), second_layer, gold (judged already), free (may be chosen).

    Each choice prefers samples of the second layer, then a tenth of the score (half up), then the source with the fewest judged or chosen so far, then the score itself.
    Within a source the choices go in one order, so that the number of a source's earlier choices is a rank, and the greedy choice is a sort by it. The good ones come
    first and count for the bad ones' sources. Rows without both scores aren't chosen.
    """
    gold = df.groupBy("source").agg(F.count_if("gold").alias("own_gold"))
    free = df.where(F.col("free") & F.col("low").isNotNull() & F.col("high").isNotNull()).select("sample_id", "source", "low", "high", (~F.coalesce("second_layer", F.lit(False))).alias("own_late"))

    def chosen(pool: DataFrame, score: Column, counts: DataFrame, n: int, reason: str) -> DataFrame:
        keyed = pool.withColumns({"own_score": score, "own_tenth": F.round(score, 1)})
        order = [F.col(c) for c in ("own_late", "own_tenth", "own_score", "sample_id")]
        ranked = keyed.withColumn("own_rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("own_rank") <= n)
        placed = ranked.join(counts, "source", "left").withColumn("own_count", F.coalesce("own_gold", F.lit(0)) + F.col("own_rank"))
        return placed.orderBy("own_late", "own_tenth", "own_count", "own_score", "sample_id").limit(n).select("sample_id", "source", F.lit(reason).alias("reason"))

    best = chosen(free, -F.col("low"), gold, good, "gold_coverage_good")
    taken = gold.withColumnRenamed("own_gold", "n").unionByName(best.groupBy("source").agg(F.count("*").alias("n"))).groupBy("source").agg(F.sum("n").alias("own_gold"))
    worst = chosen(free.join(best.select("sample_id"), "sample_id", "left_anti"), F.col("high"), taken, bad, "gold_coverage_bad")
    return best.unionByName(worst).select("sample_id", "reason")


def purpose_points(events: DataFrame, by: list[str], day: str, ts: str, shard: str, states: str, consumed: str, working: tuple[str, ...] = ("ready", "queued", "ingress_limited", "stopped"), days: int = 28) -> DataFrame:
    """The backlog of each of the last days: by, day, backlog and ran. events are complete snapshots of one unit; shard is "index/count", or null for a full census; states maps a state to its number.

    A day's newest full census counts, with what all full ones consumed; without one, each shard's newest snapshot, if all shards of one count were seen, with what all of them consumed. Other days are left out.
    """
    total = F.aggregate(F.array(*[F.coalesce(F.col(states)[s], F.lit(0)) for s in working]), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = events.select(*by, F.col(day).alias("day"), F.col(ts).alias("own_ts"), F.col(shard).alias("own_shard"), total.alias("own_n"), F.coalesce(consumed, F.lit(0)).alias("own_used"))
    each = rows.groupBy(*by, "day", "own_shard").agg(F.max_by("own_n", "own_ts").alias("own_n"), F.sum("own_used").alias("own_used"))
    index, count = F.split_part("own_shard", F.lit("/"), F.lit(1)).cast("int"), F.split_part("own_shard", F.lit("/"), F.lit(2)).cast("int")
    full = F.col("own_shard").isNull()
    seen = each.groupBy(*by, "day").agg(
        F.max(F.when(full, F.col("own_n"))).alias("own_full"), F.max(F.when(full, F.col("own_used"))).alias("own_full_used"), F.sum(F.when(~full, F.col("own_n"))).alias("own_parts"), F.sum(F.when(~full, F.col("own_used"))).alias("own_parts_used"),
        F.count(F.when(~full, index)).alias("own_seen"), F.min(count).alias("own_low"), F.max(count).alias("own_high"),
    )
    whole = F.col("own_full").isNotNull() | ((F.col("own_low") == F.col("own_high")) & (F.col("own_seen") == F.col("own_high")))
    points = seen.where(whole).select(*by, "day", F.coalesce("own_full", "own_parts").alias("backlog"), F.when(F.col("own_full").isNotNull(), F.col("own_full_used")).otherwise(F.col("own_parts_used")).alias("ran"))
    return points.withColumn("own_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("day")))).where(F.col("own_back") <= days).drop("own_back")


def capacity(df: DataFrame, free_gb: float = 10.0, price: float = 0.006) -> DataFrame:
    """What an archive of so many feeds needs, added to one row a scenario. df: feeds, archive_items, full_items, kbps, hours, host_share, seconds_each, cycle_hours, budget_hours, safety, most_per_run (null: no cap), per_week."""
    gb = F.col("kbps") * 1000 / 8 * F.col("hours") * 3600 / 1e9
    hosted = F.col("feeds") * F.col("host_share")
    timed = F.greatest(F.lit(1).cast("long"), F.floor(F.col("budget_hours") * 3600 * F.col("safety") / F.col("seconds_each")))
    cap = F.nullif(F.col("most_per_run"), F.lit(0))
    out = df.withColumns({"storage_gb": hosted * F.col("archive_items") * gb, "time_bound": timed, "per_run": F.least(timed, cap)})
    out = out.withColumns({"monthly_cost": F.greatest(F.lit(0.0), F.col("storage_gb") - free_gb) * price, "per_day": F.floor(F.col("per_run") * (F.lit(24) / F.col("cycle_hours"))), "inflow": F.col("feeds") * F.col("per_week") / 7.0, "backfill": F.floor(hosted * F.col("full_items"))})
    return out.withColumns({"keeps_up": F.col("per_day") >= F.col("inflow"), "backfill_days": F.when(F.col("per_day") > 0, F.col("backfill") / F.col("per_day")).otherwise(F.lit(float("inf"))), "capped": F.coalesce(F.col("most_per_run") < timed, F.lit(False))})
