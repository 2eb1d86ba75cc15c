"""Observed limits and quotas: histories, thresholds, calibration by quantiles, calendars and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_observations(existing: DataFrame, incoming: DataFrame, scope: list[str], now: str, days: int = 90, runs: int = 6) -> DataFrame:
    """Observations of the last days, of each run and source the greatest, and of each scope those of its newest runs. Columns: scope, run, source, value, observed_at. Ties of runs go to the greater name."""
    at = F.lit(now).cast("timestamp")
    seen = existing.unionByName(incoming).where((F.col("observed_at") <= at) & (F.col("observed_at") >= at - F.expr(f"make_dt_interval({days})")))
    best = seen.groupBy(*scope, "run", "source").agg(F.max(F.struct("value", "observed_at")).alias("own")).select(*scope, "run", "source", "own.*")
    latest = best.groupBy(*scope, "run").agg(F.max("observed_at").alias("own_latest"))
    newest = latest.withColumn("own_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.col("own_latest").desc(), F.col("run").desc()))).where(F.col("own_rank") <= runs).select(*scope, "run")
    return best.join(newest, [*scope, "run"], "left_semi")


def effective_limits(df: DataFrame, by: list[str], scope: list[str], ceilings: tuple[str, ...]) -> DataFrame:
    """The greatest value of a group where it has one scope and one source, and that source tells of ceilings; else null."""
    single = (F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope]) == 1) & (F.count_distinct("source") == 1)
    return df.groupBy(*by).agg(F.when(single & F.min("source").isin(list(ceilings)), F.max("value")).alias("effective"))


def limit_changes(df: DataFrame, by: list[str], scope: list[str], ceilings: tuple[str, ...], configured: str) -> DataFrame:
    """by, action (defer, offer_increase, tighten or unchanged), value and material. An increase is offered over 6/5 of the configured value; a limit is tightened below 4/5 if the last three observations all lie there, materially below 1/2. Comparisons are of whole numbers."""
    last = df.withColumn("own_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("observed_at").desc(), F.col("run").desc())))
    low = F.col("value") * 5 < F.col(configured) * 4
    told = last.groupBy(*by).agg(F.first(configured).alias("own_set"), F.count("*").alias("own_n"), F.every(low | (F.col("own_back") > 3)).alias("own_low"))
    both = told.join(effective_limits(df, by, scope, ceilings), by)
    e, c = F.col("effective"), F.col("own_set")
    action = F.when(e.isNull() | c.isNull() | (c <= 0), "defer").when(e * 5 > c * 6, "offer_increase").when((F.col("own_n") >= 3) & (e * 5 < c * 4) & F.col("own_low"), "tighten").otherwise("unchanged")
    return both.select(*by, action.alias("action"), F.when(action.isin("offer_increase", "tighten"), e).alias("value"), ((action == "tighten") & (e * 2 < c)).alias("material"))


def calibration(df: DataFrame, by: list[str], ratio: str, order: list[str], window: int, fewest: int, full: int, prior: float, bounds: tuple[float, float], headroom: float) -> DataFrame:
    """From the last ``window`` valid ratios of a group: n, their p75, p95 and p99 (nearest rank), and the ratio to reserve by: the prior below ``fewest`` samples, then a blend with the tail that leaves the prior no weight from ``full`` samples on, within bounds."""
    low, high = bounds
    valid = df.where(F.col(ratio).between(low, high)).withColumn("own_back", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]))).where(F.col("own_back") <= window)
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by `{ratio}`)")
    told = valid.groupBy(*by).agg(F.count("*").alias("n"), q(0.75).alias("p75"), q(0.95).alias("p95"), q(0.99).alias("p99"))
    weight = F.greatest(F.lit(0.0), 1 - F.col("n") / full)
    blend = F.least(F.lit(high), F.greatest(F.lit(low), weight * prior + (1 - weight) * F.greatest(F.col("p95") * headroom, F.col("p99"))))
    return told.withColumn("reserve", F.when(F.col("n") < fewest, prior).otherwise(blend))


def zoned_day(ts: Column, zone: str) -> Column:
    """The civil day of an instant, held in UTC, in a time zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def next_midnight(ts: Column, zone: str) -> Column:
    """The instant, in UTC, at which the zone's next day begins."""
    return F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), 1).cast("timestamp"), zone)


def payment_backoff(streak: Column, day: Column) -> Column:
    """The day that ends a pause after unpaid calls: the next day, then the Monday after it, then the next month's first; each step at least a day after the one before."""
    one = F.date_add(day, 1)
    monday = F.next_day(day, "MON")
    two = F.greatest(F.when(monday == one, F.date_add(monday, 7)).otherwise(monday), F.date_add(one, 1))
    three = F.greatest(F.add_months(F.trunc(day, "month"), 1), F.date_add(two, 1))
    s = F.greatest(F.coalesce(streak, F.lit(1)), F.lit(1))
    return F.when(s == 1, one).when(s == 2, two).otherwise(three)


def earliest_start(now: Column, gates: dict[str, Column]) -> Column:
    """(at, reason): the latest of all gates' times, not before now, and the gate that it comes from."""
    all_gates = F.array_compact(F.array(F.struct(now.alias("at"), F.lit("ready").alias("reason")), *[F.when(t.isNotNull(), F.struct(t.alias("at"), F.lit(name).alias("reason"))) for name, t in gates.items()]))
    return F.aggregate(all_gates, all_gates[0], lambda acc, x: F.when(x["at"] > acc["at"], x).otherwise(acc))


def within_budget(ledger: DataFrame, keys: list[str], asks: DataFrame, axes: dict[str, str]) -> DataFrame:
    """asks with fits: whether on each axis what is used, what is reserved and what is asked stay within the limit. ledger: keys and, for each axis, used, reserved and limit as <axis>_used and so on; a null limit bounds nothing."""
    held = asks.join(ledger, keys, "left")
    fits = F.lit(True)
    for axis, asked in axes.items():
        total = F.coalesce(f"{axis}_used", F.lit(0)) + F.coalesce(f"{axis}_reserved", F.lit(0)) + F.coalesce(asked, F.lit(0))
        fits = fits & (F.col(f"{axis}_limit").isNull() | (total <= F.col(f"{axis}_limit")))
    return held.withColumn("fits", fits).select(*asks.columns, "fits")


def settled_ledger(events: DataFrame, keys: list[str], owner: str, kind: str, amount: str, ts: str, window: list[Column]) -> DataFrame:
    """A ledger from an append-only log of reserve and settle events: per key and window (as the day of ts) what is used, by settlements, and what is reserved still, by owners without one. An owner's events are two sums; nothing is gathered."""
    per = events.groupBy(*keys, *window, owner).agg(F.sum(F.when(F.col(kind) == "reserve", F.col(amount))).alias("own_r"), F.sum(F.when(F.col(kind) == "settle", F.col(amount))).alias("own_s"), F.max(ts).alias("own_at"))
    names = [c for c in per.columns if c not in (owner, "own_r", "own_s", "own_at")]
    return per.groupBy(*names).agg(F.sum(F.coalesce("own_s", F.lit(0.0))).alias("used"), F.sum(F.when(F.col("own_s").isNull(), F.coalesce("own_r", F.lit(0.0))).otherwise(0.0)).alias("reserved"), F.count_if(F.col("own_s").isNull()).alias("open"))


def route_ladder(df: DataFrame, by: list[str], order: list[str], failed: Column, threshold: int, rungs: list[int]) -> DataFrame:
    """For each row the failures in a row up to it and the pause, in seconds, that they earn: none below the threshold, then one rung for each failure more, up to the last. Streaks are islands of a window: each success begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    island = df.withColumn("own_bad", failed.cast("int")).withColumn("own_island", F.sum(1 - F.col("own_bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("own_bad").over(Window.partitionBy(*by, "own_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    pause = F.when(F.col("streak") < threshold, 0).otherwise(F.element_at(F.array(*[F.lit(r) for r in rungs]), F.least(F.col("streak") - threshold + 1, F.lit(len(rungs))).cast("int")))
    return island.withColumn("streak", streak).withColumn("pause", pause).drop("own_bad", "own_island")


def health_ladder(df: DataFrame, by: list[str], ts: str, started: str, outcome: str, thresholds: dict[str, int], rungs: list[int]) -> DataFrame:
    """Each route's state after its last event: rung, until, class and one count a class of failures; zeros if it is healthy.

    A success forgets everything, so only the failures after a route's last success are gathered, as three numbers each, and folded in order of ts and started. A healthy
    route climbs to the first rung when a class's count reaches its threshold; on the ladder, a failure climbs only if its call started at or after the pause's end (the
    half-open probe), any other is counted alone. Times and rungs are whole seconds. A failure of a class without a threshold changes nothing.
    """
    classes = [c for c, n in thresholds.items() if n > 0]
    last = F.max(F.when(F.col(outcome) == "success", F.struct(ts, started))).over(Window.partitionBy(*by))
    rows = df.withColumn("own_last", last).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col(outcome).isin(classes) & (F.col("own_last").isNull() | (F.struct(ts, started) > F.col("own_last"))), F.struct(F.col(ts).cast("long").alias("at"), F.least(F.coalesce(started, ts), ts).cast("long").alias("began"), F.col(outcome).alias("cls"))))).alias("own_events")
    )
    steps, zero = F.array(*[F.lit(r).cast("long") for r in rungs]), F.lit(0).cast("long")

    def step(state: Column, e: Column) -> Column:
        counts = {c: state[c] + (e["cls"] == c).cast("long") for c in classes}
        reached = F.lit(False)
        for c in classes:
            reached = reached | ((e["cls"] == c) & (counts[c] >= thresholds[c]))
        up = F.when(state["rung"] > 0, e["began"] >= state["until"]).otherwise(reached)
        rung = F.when(up, F.least(state["rung"] + 1, F.lit(len(rungs)).cast("long"))).otherwise(state["rung"])
        until = F.when(up, e["at"] + F.element_at(steps, F.greatest(rung, F.lit(1)).cast("int"))).otherwise(state["until"])
        return F.struct(rung.alias("rung"), until.alias("until"), F.when(up, e["cls"]).otherwise(state["cls"]).alias("cls"), *[n.alias(c) for c, n in counts.items()])

    start = F.struct(zero.alias("rung"), zero.alias("until"), F.lit("").alias("cls"), *[zero.alias(c) for c in classes])
    return rows.select(*by, F.aggregate("own_events", start, step).alias("own_state")).select(*by, "own_state.rung", "own_state.until", F.col("own_state.cls").alias("class"), *[F.col(f"own_state.{c}") for c in classes])


def by_capacity(routes: DataFrame, model: str, limit: str, used: str) -> DataFrame:
    """Models by what their routes have left, most first: model, left, place."""
    left = routes.groupBy(model).agg(F.sum(F.greatest(F.col(limit) - F.col(used), F.lit(0))).alias("left"))
    return left.withColumn("place", F.rank().over(Window.orderBy(F.col("left").desc(), model)))


def pruned(df: DataFrame, day: str, before: str, order: list[str], most: int) -> DataFrame:
    """The rows that stay after the oldest ones, up to so many, from before a day are deleted: a bounded pass of retention."""
    gone = df.where(F.col(day) < F.lit(before)).orderBy(day, *order).limit(most).select(*order)
    return df.join(gone, order, "left_anti")


def empty_groups(groups: DataFrame, members: DataFrame, key: str, after: object, n: int) -> DataFrame:
    """The next n groups by key that have no member: a keyset page and then an anti-join."""
    return groups.where(F.col(key) > F.lit(after)).orderBy(key).limit(n).join(members.select(key), key, "left_anti")
