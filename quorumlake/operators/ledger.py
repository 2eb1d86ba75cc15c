"""Ordered folds over append-only events: state machines, token buckets and windows of quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def availability(df: DataFrame, by: list[str], order: str, ok: str, dead_after: int) -> DataFrame:
    """The last state of each key: failures in a row, state (ok, failing or dead) and the number of recoveries, by sums over a window; no history is gathered."""
    back = Window.partitionBy(*by).orderBy(F.col(order).desc())
    told = df.select(*by, F.col(ok).alias("own_ok"), F.sum(F.col(ok).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("own_after"), F.lead(ok).over(back).alias("own_before"))
    held = told.groupBy(*by).agg(F.count_if(F.col("own_after") == 0).cast("int").alias("fails"), F.count_if(F.col("own_ok") & ~F.col("own_before")).cast("int").alias("recovered"))
    return held.withColumn("state", F.when(F.col("fails") == 0, "ok").when(F.col("fails") >= dead_after, "dead").otherwise("failing"))


def token_bucket(df: DataFrame, by: list[str], at: Column, order: str, cost: Column, capacity: float, per_second: float) -> DataFrame:
    """For each key how many requests a bucket of tokens, refilled over time, admits in order, and what is left. A null cost is none."""
    rows = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(order).alias("o"), F.coalesce(cost.cast("double"), F.lit(0.0)).alias("cost"))))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(float(capacity)).alias("level"), F.lit(0).alias("admitted"), F.lit(0).alias("refused"))

    def fold(acc: Column, x: Column) -> Column:
        level = F.least(F.lit(float(capacity)), acc["level"] + F.coalesce(x["at"] - acc["at"], F.lit(0.0)) * per_second)
        ok = level >= x["cost"]
        return F.struct(x["at"].alias("at"), F.when(ok, level - x["cost"]).otherwise(level).alias("level"), (acc["admitted"] + ok.cast("int")).alias("admitted"), (acc["refused"] + (~ok).cast("int")).alias("refused"))

    held = df.groupBy(*by).agg(F.aggregate(rows, start, fold).alias("s"))
    return held.select(*by, "s.admitted", "s.refused", "s.level")


def fixed_window(df: DataFrame, by: list[str], ts: str, width: str, limit: int) -> DataFrame:
    """Requests by tumbling window, and whether they are over the limit."""
    return df.groupBy(*by, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def reap(leases: DataFrame, artifacts: DataFrame, key: str, expires: str, now: Column) -> DataFrame:
    """State of leased work: done where its artifact exists, requeued where the lease is over, else running."""
    return leases.join(artifacts.select(key).distinct().withColumn("own_done", F.lit(True)), key, "left").withColumn("state", F.when(F.col("own_done"), "done").when(F.col(expires) <= now, "requeued").otherwise("running")).drop("own_done")


def sessions(df: DataFrame, by: list[str], ts: str, order: str, gap_seconds: int) -> DataFrame:
    """Runs of events with no gap over the bound: number, start, end and size."""
    w = Window.partitionBy(*by).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.when(micros - F.lag(micros).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("own_new", fresh).withColumn("session", F.sum("own_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
