"""Status aggregates over records: their states, rows by feed and by city, merged runs and small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.sources.scratch import spread

#: Counters of a feed's row, by state.
STATES = ("linked_video", "served", "stale", "pending", "deferred", "dead", "transient_error")
SUMS = ("episodes", "hosted", *STATES, "hours_hosted", "hours_linked", "gb_stored", "tx_synced", "tx_text", "tx_none")


def state_of(url: Column, spec: Column, wanted: Column, error: Column, kind: Column, host_direct: Column, profiled: bool = False) -> Column:
    """served, stale, linked_video, deferred, dead, transient_error or pending: the first that fits."""
    kind = F.coalesce(kind, F.lit("direct"))
    hosted = F.coalesce(url, F.lit("")) != ""
    old = spec.isNull() | (spec == "legacy")
    return (
        F.when(hosted & old, "stale" if profiled else "served")
        .when(hosted, F.when(spec.eqNullSafe(wanted), "served").otherwise("stale"))
        .when((kind == "direct") & ~F.coalesce(host_direct, F.lit(False)), "linked_video")
        .when(error == "deferred", "deferred")
        .when(error == "dead", "dead")
        .when(error.isNotNull(), "transient_error")
        .otherwise("pending")
    )


def duration_of(audio: bool | Column, served: Column, source: Column) -> Column:
    """The served duration for audio, where known; else the source's; else 0."""
    audio = F.lit(audio) if isinstance(audio, bool) else audio
    return F.coalesce(F.when(audio, served), source, F.lit(0.0))


def _measures(records: DataFrame, max_kbps: int) -> dict[str, Column]:
    state, host = F.col("state"), F.col("state").isin("served", "stale")
    known = duration_of(host, F.col("served_seconds"), F.col("source_seconds"))
    seconds = F.when((known == 0) & (F.coalesce("bytes", F.lit(0)) > 0), F.col("bytes") * 8 / (max_kbps * 1000)).otherwise(known)
    synced, text = F.coalesce("synced", F.lit(False)), F.coalesce("transcript_key", F.lit("")) != ""
    return {
        "episodes": F.count("*"),
        "hosted": F.count_if(host),
        **{s: F.count_if(state == s) for s in STATES},
        "hours_hosted": F.round(F.coalesce(F.sum(F.when(host, seconds / 3600)), F.lit(0.0)), 2),
        "hours_linked": F.round(F.coalesce(F.sum(F.when(state == "linked_video", seconds / 3600)), F.lit(0.0)), 2),
        "gb_stored": F.round(F.coalesce(F.sum(F.when(host, F.col("bytes") / 1e9)), F.lit(0.0)), 4),
        "gb_exact": F.count_if(host & F.col("bytes").isNull()) == 0,
        "last_published": F.to_date(F.max("published")).cast("string"),
        "tx_synced": F.count_if(synced),
        "tx_text": F.count_if(~synced & text),
        "tx_none": F.count_if(~synced & ~text),
    }


def feed_rows(records: DataFrame, by: list[str], max_kbps: int) -> DataFrame:
    """One row a feed. records: by, state, published, served_seconds, source_seconds, bytes, synced and transcript_key."""
    made = records.groupBy(*by).agg(*[c.alias(n) for n, c in _measures(records, max_kbps).items()])
    bad = (F.col("dead") > 0) | (F.col("transient_error") > 0)
    waits = (F.col("deferred") > 0) | (F.col("stale") > 0) | (F.col("pending") > 0)
    return made.withColumn("health", F.when(bad, "error").when(waits, "warn").otherwise("ok"))


#: What the measures are made of, in the order by which one of a record's unlike rows is chosen: the least, null first.
MEASURED = ("published", "state", "served_seconds", "source_seconds", "bytes", "synced", "transcript_key")


def source_actuals(records: DataFrame, keys: list[str], max_kbps: int, rows: int | None = None) -> DataFrame:
    """The same measures over everything, each record of several feeds being counted once: of its rows the one published first, and of those the least by MEASURED. rows tells how many there are, where known, so that tasks get shares of bounded size."""
    records = records.select(*keys, *MEASURED)
    records = records if rows is None else spread(records, rows, *keys)
    first = records.groupBy(*keys).agg(F.min(F.struct(*MEASURED)).alias("own")).select("own.*")
    return first.agg(*[c.alias(n) for n, c in _measures(first, max_kbps).items()])


def city_rows(feeds: DataFrame, city: str, provider: str) -> DataFrame:
    """Feeds rolled up by city."""
    places = {"hours_hosted": 2, "hours_linked": 2, "gb_stored": 4}
    return feeds.groupBy(city).agg(
        F.count("*").alias("feeds"),
        F.array_join(F.sort_array(F.collect_set(provider)), ", ").alias("provider"),
        *[(F.round(F.sum(c), places[c]) if c in places else F.sum(c)).alias(c) for c in SUMS],
        F.every("gb_exact").alias("gb_exact"),
        F.max("last_published").alias("last_published"),
        *[F.count_if(F.col("health") == h).alias(f"health_{h}") for h in ("ok", "warn", "error")],
    )


def stage_totals(runs: DataFrame, by: list[str], stages: str, counters: tuple[str, ...], maps: tuple[str, ...]) -> DataFrame:
    """Per stage the sums of its counters, and its maps of counters added up by key. runs holds stages as a map from name to a struct. Maps are exploded and summed, so that no task holds a run's maps together."""
    each = runs.select(*by, F.explode(stages).alias("stage", "own"))
    keys = [*by, "stage"]
    out = each.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("own")[c]), F.lit(0)).alias(c) for c in counters])
    for m in maps:
        parts = each.select(*keys, F.explode(F.col("own")[m]).alias("own_k", "own_v")).groupBy(*keys, "own_k").agg(F.sum("own_v").alias("own_v"))
        whole = parts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("own_k", "own_v")))).alias(m))
        out = out.join(whole, keys, "left").withColumn(m, F.coalesce(m, F.create_map().cast(dict(whole.dtypes)[m])))
    return out


def merged_runs(rows: DataFrame, run: list[str], own: str, ts: str, sums: list[str]) -> DataFrame:
    """Sibling shards of one run as one row: counters are summed, all else is the newest row's. Rows without a run stay single, each by its own key."""
    single = F.when(F.coalesce(*[F.col(c).isNull() for c in run]) if len(run) == 1 else F.greatest(*[F.col(c).isNull() for c in run]), F.col(own))
    rest = [c for c in rows.columns if c not in (*run, *sums)]
    grouped = rows.groupBy(*run, single.alias("own_single")).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums], F.max_by(F.struct(*rest), F.struct(ts, own)).alias("own_last"), F.count("*").alias("shards"))
    return grouped.select(*run, *sums, "own_last.*", "shards")


def confidence_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, low (below 0.5), medium (below 0.9), high, min and avg, rounded to 3 places."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("count"), F.count_if(v < 0.5).alias("low"), F.count_if((v >= 0.5) & (v < 0.9)).alias("medium"), F.count_if(v >= 0.9).alias("high"), F.round(F.min(v), 3).alias("min"), F.round(F.avg(v), 3).alias("avg"))


def truncated_feeds(shown: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    """One row: feeds, those that show fewer rows than are archived, and how many rows they hide. shown and archived: key and n."""
    both = archived.select(key, F.col("n").alias("all_n")).join(shown.select(key, "n"), key, "left").withColumn("hidden", F.col("all_n") - F.coalesce("n", F.lit(0)))
    return both.agg(F.count("*").alias("feeds"), F.count_if(F.col("hidden") > 0).alias("truncated"), F.sum(F.greatest("hidden", F.lit(0))).alias("hidden"))


def failure_counts(df: DataFrame, error: str) -> DataFrame:
    return df.where(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("n"))


def erring_providers(runs: DataFrame, ts: str, errors: str, look_back: int, threshold: int, tie: list[str]) -> DataFrame:
    """Of the newest runs (of one time, those first in the order of tie), how many met an error at each provider; those at the threshold or above. runs holds errors as a map from provider to a number."""
    newest = runs.orderBy(F.col(ts).desc(), *tie).limit(look_back)
    return newest.select(F.explode(errors).alias("provider", "n")).where("n > 0").groupBy("provider").agg(F.count("*").alias("runs")).where(F.col("runs") >= threshold)


def too_few(df: DataFrame, feeds: DataFrame, key: str, least: str, archived: str, materialized: str) -> DataFrame:
    """Feeds with no row, unless some are kept, and with fewer than their least number, unless the archive holds enough: key, n and code (drift or empty). feeds: key, least, archived and materialized."""
    found = feeds.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none, few = (F.col("n") == 0) & (F.col(materialized) == 0), (F.col("n") > 0) & (F.col("n") < F.col(least)) & (F.col(archived) < F.col(least))
    return found.withColumn("code", F.when(none, "drift").when(few, "empty")).where("code is not null").select(key, "n", "code")


def coverage(df: DataFrame, parts: str) -> DataFrame:
    """One row: documents, and those with parts."""
    return df.agg(F.count("*").alias("documents"), F.count_if(F.size(parts) > 0).alias("with_parts"))


def newest_per_backend(df: DataFrame, backend: str, outcome: str, outcomes: list[str], seconds: str, order: list[str]) -> DataFrame:
    """Per backend: samples by outcome, the mean and greatest seconds, and the newest outcome."""
    return df.groupBy(backend).agg(F.count("*").alias("samples"), *[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes], F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("most_seconds"), F.max_by(outcome, F.struct(*order)).alias("latest"))


def ages(df: DataFrame, by: list[str], ts: str, now: str) -> DataFrame:
    """n, how many have a time, and the least and greatest age in hours at now."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3.6e9
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(ts).alias("timed"), F.min(age).alias("newest_hours"), F.max(age).alias("oldest_hours"))
