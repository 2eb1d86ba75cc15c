"""Budgets replayed from a log: what is used on several axes in several windows, when the next call may start, and what fits.

A ledger's fold is written as running sums. A counter that never falls below 0 is its plain running sum less that sum's
lowest value so far, if that is negative. A schedule that each call moves on, from its time or from the schedule's own,
whichever is later, is a running sum of the calls' lengths plus the greatest of their times less the sum before them. So a
route's log is sorted once, nothing is gathered, and only counters of the windows that rows lie in are told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame, route: list[str], order: list[str], windows: dict[str, Column], fixed: list[str], limits: dict[str, float], per_minute: float | None = None) -> DataFrame:
    """The log's rows that count, with used_<axis>_<window> after each, ready_at and, for asks, fits.

    log: route, order (unique in a route), owner, kind (reserve, settle or ask), at (timestamp), requests and tokens. A reserve counts if its owner has no
    reservation open, a settle if it has one: a repeated one changes nothing. A settle replaces what was reserved by what
    it tells (null: nothing is changed), requests in windows that are still those of the reservation and not below 0;
    tokens also in later ones, but in windows named ``fixed`` as requests. With per_minute, tokens in a minute, each reservation moves ready_at on, and
    its settlement corrects that while no other reservation of the route came between. An ask fits if all counters that have a limit
    (by ``<axis>_<window>``) hold what it asks as well.
    """
    seq = Window.partitionBy(*route, "owner").orderBy(*order)
    calls = log.where(F.col("kind").isin("reserve", "settle"))
    last = F.lag("kind").over(seq)
    counts = F.when(F.col("kind") == "reserve", ~last.eqNullSafe(F.lit("reserve"))).otherwise(last.eqNullSafe(F.lit("reserve")))
    held = F.struct("at", "requests", "tokens", *[w.alias(f"w_{n}") for n, w in windows.items()], F.struct(*order).alias("place"))
    good = calls.withColumn("own_good", counts).where("own_good").drop("own_good")
    good = good.withColumn("own_first", F.when(F.col("kind") == "settle", F.lag(held).over(seq))).withColumn("own_end", F.when(F.col("kind") == "reserve", F.lead(F.struct(F.struct(*order).alias("place"), "tokens")).over(seq)))
    asks = log.where("kind = 'ask'").withColumns({c: F.lit(None).cast(good.schema[c].dataType) for c in ("own_first", "own_end")})
    rows = good.unionByName(asks)
    out, fits = rows, F.lit(True)
    for window, key in windows.items():
        for axis in ("requests", "tokens"):
            moved = F.col(axis) - F.col(f"own_first.{axis}")
            same = key.eqNullSafe(F.col(f"own_first.w_{window}")) if axis == "requests" or window in fixed else F.lit(True)
            delta = F.when(F.col("kind") == "reserve", F.col(axis)).when((F.col("kind") == "settle") & same, moved)
            name = f"{axis}_{window}"
            w = Window.partitionBy(*route, f"own_k_{window}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumns({f"own_k_{window}": key, "own_d": F.coalesce(delta, F.lit(0))}).withColumn("own_sum", F.sum("own_d").over(w))
            out = out.withColumn(f"used_{name}", F.col("own_sum") - F.least(F.lit(0), F.min("own_sum").over(w))).drop("own_d", "own_sum")
            if name in limits:
                fits = fits & (F.col(f"used_{name}") + F.coalesce(axis, F.lit(0)) <= limits[name])
    if per_minute:
        r = Window.partitionBy(*route).orderBy(*order)
        so_far = r.rowsBetween(Window.unboundedPreceding, 0)
        of = lambda tokens: F.coalesce(tokens, F.lit(0)) * 60 / per_minute
        reserve = F.col("kind") == "reserve"
        at = F.unix_micros("at") / 1e6
        following = F.first(F.when(reserve, F.struct(*order)), ignorenulls=True).over(r.rowsBetween(1, Window.unboundedFollowing))
        out = out.withColumn("own_next", following)
        corrected = F.col("own_end.tokens").isNotNull() & (F.col("own_next").isNull() | (F.col("own_end.place") < F.col("own_next")))
        final = F.when(corrected, F.col("own_end.tokens")).otherwise(F.col("tokens"))
        out = out.withColumn("own_c", F.when(reserve, of(final)).otherwise(0.0)).withColumn("own_p", F.sum("own_c").over(so_far) - F.col("own_c"))
        out = out.withColumn("own_m", F.max(F.when(reserve, at - F.col("own_p"))).over(so_far))
        latest = F.last(F.when(reserve, F.struct("owner", F.struct(*order).alias("place"), "tokens", "own_p", "own_m", F.when(corrected, F.col("own_end")).alias("end"))), ignorenulls=True).over(so_far)
        out = out.withColumn("own_l", latest)
        done = F.col("own_l.end").isNotNull() & (F.col("own_l.end.place") <= F.struct(*order))
        ready = F.col("own_l.own_p") + F.col("own_l.own_m") + of(F.when(done, F.col("own_l.end.tokens")).otherwise(F.col("own_l.tokens")))
        out = out.withColumn("ready_at", F.round(ready, 6))
        fits = fits & F.coalesce(F.col("ready_at") <= at, F.lit(True))
    kept = [c for c in out.columns if not c.startswith("own_")]
    return out.select(*kept, F.when(F.col("kind") == "ask", fits).alias("fits"))
