"""Keyed merges, prioritised joins, set differences and the rewrites of upserts and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_right(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of fresh, and those of stored whose key fresh doesn't have."""
    return fresh.unionByName(stored.join(fresh.select(*keys).distinct(), keys, "left_anti"))


def merge_columns(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge; in each column the fresh value wins unless it is null. Keys are unique on either side."""
    cols = [c for c in stored.columns if c not in keys]
    both = stored.alias("s").join(fresh.alias("f"), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}")).alias(c) for c in cols])


def merge_owned(remote: DataFrame, local: DataFrame, baseline: DataFrame, key: str, owned: Column, guarded: str, free: list[str]) -> DataFrame:
    """Three-way merge. Free columns are local where the row is owned, else remote. The guarded column is local only where the row is owned and the remote value still is the baseline's."""
    r, m, b = remote.alias("r"), local.alias("l"), baseline.select(key, F.col(guarded).alias("base_value"))
    both = r.join(m, key, "full_outer").join(b, key, "left").withColumn("own", owned & F.col(f"l.{free[0]}").isNotNull() | F.col(f"r.{free[0]}").isNull())
    safe = F.col("own") & (F.col(f"r.{guarded}").eqNullSafe(F.col("base_value")) | F.col(f"r.{free[0]}").isNull())
    return both.select(key, *[F.when(F.col("own"), F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in free], F.when(safe, F.col(f"l.{guarded}")).otherwise(F.col(f"r.{guarded}")).alias(guarded))


def attach_by_priority(left: DataFrame, right: DataFrame, keys: list[list[str]], value: str) -> DataFrame:
    """The value of the first list of keys on which the right side has exactly one row; ambiguous keys match nothing. Adds value and by, the list's number from 1."""
    out, found, by = left, [], []
    for i, key in enumerate(keys):
        one = right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).groupBy(*key).agg(F.count("*").alias("n"), F.first(value).alias(f"value_{i}")).where("n = 1").drop("n")
        out = out.join(one, key, "left")
        found.append(F.col(f"value_{i}"))
        by.append(F.when(F.col(f"value_{i}").isNotNull(), i + 1))
    return out.select(*left.columns, F.coalesce(*found).alias(value), F.coalesce(*by).alias("by"))


def split_by_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All rows, with matched: whether the other side has the key."""
    return df.join(other.select(key).distinct().withColumn("own_hit", F.lit(True)), key, "left").withColumn("matched", F.coalesce("own_hit", F.lit(False))).drop("own_hit")


def owner_by_pattern(df: DataFrame, text: str, patterns: DataFrame, fallback: str) -> DataFrame:
    """The owner of the first pattern (by rank) that the text contains. patterns (pattern, owner, rank) is a configuration table: it is held in one expression, and a list over 1000 is refused."""
    rows = sorted((r["rank"], r["pattern"], r["owner"]) for r in patterns.limit(1001).collect())
    if len(rows) > 1000:
        raise ValueError("too many patterns for an expression")
    out = F
    for _, pattern, owner in rows:
        out = out.when(F.contains(F.col(text), F.lit(pattern)), owner)
    return df.withColumn("owner", out.otherwise(fallback) if rows else F.lit(fallback))


def set_difference(fetched: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: only_fetched, only_stored and both, as numbers of distinct keys."""
    tagged = fetched.select(key, F.lit(1).alias("f"), F.lit(0).alias("s")).unionByName(stored.select(key, F.lit(0).alias("f"), F.lit(1).alias("s")))
    per = tagged.groupBy(key).agg(F.max("f").alias("f"), F.max("s").alias("s"))
    return per.agg(F.count_if((F.col("f") == 1) & (F.col("s") == 0)).alias("only_fetched"), F.count_if((F.col("f") == 0) & (F.col("s") == 1)).alias("only_stored"), F.count_if((F.col("f") == 1) & (F.col("s") == 1)).alias("both"))


def upsert_counters(stored: DataFrame, fresh: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Insert, or add to counters and raise maxima: one partial aggregation over both sides."""
    return stored.unionByName(fresh).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def insert_or_ignore(stored: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The fresh rows that are added: the first of each key that isn't stored."""
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in fresh.columns if c != key]), F.struct(*order)).alias("own")).select(key, "own.*")
    return first.join(stored.select(key).distinct(), key, "left_anti")


def rollup_decisions(df: DataFrame, key: str, decision: str, order: str) -> DataFrame:
    """Of each key the last row, but one with a decision is never replaced by one without."""
    held = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(held, F.struct(F.col(decision).isNotNull(), order)).alias("own")).select(key, "own.*")


def orphan_ledger(ledger: DataFrame, orphans: DataFrame, key: str, runs: int) -> DataFrame:
    """Keys that are still orphaned, their sightings counted on; deletable after so many runs."""
    return orphans.select(key).distinct().join(ledger.select(key, "sightings"), key, "left").select(key, (F.coalesce("sightings", F.lit(0)) + 1).alias("sightings")).withColumn("deletable", F.col("sightings") >= runs)


def changed(now: DataFrame, stored: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """The rows of now whose mark differs from the stored one, or that aren't stored."""
    return now.join(stored.select(*keys, F.col(mark).alias("stored_mark")), keys, "left").where(~F.col(mark).eqNullSafe(F.col("stored_mark"))).drop("stored_mark")


def carried_forward(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
