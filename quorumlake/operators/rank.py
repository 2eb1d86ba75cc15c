"""Ranking, retention, keyset pages, deterministic samples and time series by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank. The order must end with a unique column. Spark keeps only n rows of a group in each task before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def retention_tiers(df: DataFrame, by: list[str], order: list[Column], visible: int, full: int) -> DataFrame:
    """tier: visible, archive or deep, by rank in the group."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("tier", F.when(r <= visible, "visible").when(r <= full, "archive").otherwise("deep"))


def assign_ids(df: DataFrame, by: list[str], order: list[Column], name: str = "uid") -> DataFrame:
    """A stable id from the group's key and the row's number in it."""
    seq = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("seq", seq).withColumn(name, F.left(F.md5(F.concat_ws("|", *by, "seq")), F.lit(16)))


def rank_fraction(df: DataFrame, by: list[str], order: list[Column], name: str = "fraction") -> DataFrame:
    """1 for the first row of a group down to 0 for the last; 1 for a row alone."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, 1 - (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1))


def keyset_page(df: DataFrame, keys: list[str], after: tuple, n: int) -> DataFrame:
    """The n rows that follow a place in the order of the keys."""
    beyond = F.lit(False)
    for i in range(len(keys) - 1, -1, -1):
        beyond = (F.col(keys[i]) > F.lit(after[i])) | ((F.col(keys[i]) == F.lit(after[i])) & beyond)
    return df.where(beyond).orderBy(*keys).limit(n)


def hash_sample(df: DataFrame, key: str, score: str, best: int, others: int, salt: str) -> DataFrame:
    """The best rows by score and, of the rest, those with the least salted hashes: how, key."""
    top = df.orderBy(F.col(score).desc(), key).limit(best).select(key)
    rest = df.select(key).join(top, key, "left_anti").orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(others)
    return top.withColumn("how", F.lit("best")).unionByName(rest.withColumn("how", F.lit("hash")))


def unseen(df: DataFrame, seen: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows whose key hasn't been seen."""
    return df.join(seen.select(key).distinct(), key, "left_anti").orderBy(*order).limit(n)


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row in the order; partial results are merged before the shuffle."""
    held = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(held, F.struct(*order)).alias("own")).select(*keys, "own.*")


def daily_trend(df: DataFrame, by: list[str], ts: str, value: str, days: int) -> DataFrame:
    """Over the last days that have rows: their number, the slope of the daily sums over their index, and the mean."""
    daily = df.groupBy(*by, F.to_date(ts).alias("day")).agg(F.sum(value).alias("total"))
    w = Window.partitionBy(*by)
    last = daily.withColumn("back", F.row_number().over(w.orderBy(F.col("day").desc()))).where(F.col("back") <= days)
    return last.groupBy(*by).agg(F.count("*").alias("days"), F.regr_slope(F.col("total"), -F.col("back")).alias("slope"), F.avg("total").alias("mean"))


def cadence(df: DataFrame, by: list[str], ts: str, now: str, factor: float = 5.0, fewest: int = 4, floor_days: float = 45.0) -> DataFrame:
    """n, the median gap in seconds between rows of a group, the last row's time, and stale: whether that is older at now than factor times the median and than floor_days. Groups with fewer rows or a median of 0 aren't stale."""
    at = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    gaps = df.withColumn("own_gap", at(F.col(ts)) - at(F.lag(ts).over(Window.partitionBy(*by).orderBy(ts))))
    told = gaps.groupBy(*by).agg(F.count("*").alias("n"), F.expr("percentile_cont(0.5) within group (order by own_gap)").alias("median_gap"), F.max(ts).alias("last"))
    age = at(F.lit(now)) - at(F.col("last"))
    old = (F.col("n") >= fewest) & (F.col("median_gap") > 0) & (age > F.greatest(factor * F.col("median_gap"), F.lit(floor_days * 86400)))
    return told.withColumn("stale", F.coalesce(old, F.lit(False)))


def trailing_streak(df: DataFrame, by: list[str], order: list[Column], hit: Column, ts: str) -> DataFrame:
    """How many of a group's last rows in a row are hits, and since when; null since where the last row is none."""
    back = df.withColumn("hit", hit).withColumn("misses", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)))
    return back.groupBy(*by).agg(F.count_if(F.col("misses") == 0).alias("streak"), F.min(F.when(F.col("misses") == 0, F.col(ts))).alias("since"))


def trailing_sum(df: DataFrame, by: list[str], seconds: Column, value: str, width: int, name: str) -> DataFrame:
    """The sum over the trailing range of width, the row itself included."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(seconds).rangeBetween(-width, 0)))


def smoothed(df: DataFrame, by: list[str], order: str, value: str, start: float, quick: float = 0.3, slow: float = 0.2, quick_for: int = 10) -> DataFrame:
    """Exponential smoothing of a group's positive values in order, from a given start: the newest weighs ``quick`` among the first ``quick_for`` and then ``slow``. Each value's share in the result follows from its place and the number of values, so the estimate is one sum and nothing is gathered."""
    w = Window.partitionBy(*by)
    placed = df.where(F.col(value) > 0).select(*by, F.col(value).alias("own_v"), F.row_number().over(w.orderBy(order)).alias("own_i"), F.count("*").over(w).alias("own_n"))
    i, n, early = F.col("own_i"), F.col("own_n"), F.least(F.col("own_n"), F.lit(quick_for))
    later = lambda k: F.pow(F.lit(1 - quick), F.greatest(early - k, F.lit(0))) * F.pow(F.lit(1 - slow), F.greatest(n - F.greatest(k, F.lit(quick_for)), F.lit(0)))
    share = F.when(i <= quick_for, quick).otherwise(slow) * later(i)
    return placed.groupBy(*by).agg((F.sum(F.col("own_v") * share) + start * F.first(later(F.lit(0)))).alias("estimate"))


def smoothed_rate(df: DataFrame, by: list[str], order: list[str], value: str, radius: int, name: str) -> DataFrame:
    """Centred moving mean with the edges' values repeated."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    before, after = F.greatest(F.lit(0), radius + 1 - r), F.greatest(F.lit(0), r + radius - n)
    inside = F.sum(value).over(w.rowsBetween(-radius, radius))
    return df.withColumn(name, (inside + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / (2 * radius + 1))
