"""Interval algebra: union, gaps, overlap and as-of joins, and timelines of kept segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The union of a group's intervals as disjoint ones; touching intervals join."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("own_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("own_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def covered(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The length of the union of a group's intervals."""
    return islands(df, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What lies between the islands of a group."""
    w = Window.partitionBy(*by).orderBy(start)
    return islands(df, by, start, end).withColumn("gap_start", F.lag(end).over(w)).where(F.col("gap_start").isNotNull()).select(*by, "gap_start", F.col(start).alias("gap_end"))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals (l_start, l_end) and (r_start, r_end) of a group that overlap, and by how much.

    Both sides are dealt to cells of the given width, so the join is an equi join; each pair comes from the cell where
    the later of the two begins. The width should be near the usual length of the intervals.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1e-9) / width)))
    a = left.where("l_end > l_start").withColumn("cell", cells("l_start", "l_end"))
    b = right.where("r_end > r_start").withColumn("cell", cells("r_start", "r_end"))
    both = a.join(b, [*by, "cell"]).where("l_start < r_end and r_start < l_end")
    first = F.floor(F.greatest("l_start", "r_start") / width)
    return both.where(F.col("cell") == first).drop("cell").withColumn("overlap", F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the last right row at or before it. One sort over both sides, without a range join."""
    cols = left.columns
    both = left.withColumns({"own_side": F.lit(1), name: F.lit(None).cast(dict(right.dtypes)[value])}).unionByName(
        right.select(*by, at, F.col(tie).alias(tie), F.lit(0).alias("own_side"), F.col(value).alias(name)), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(at, "own_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("own_side = 1").select(*cols, name)


def overlap_flags(df: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Whether an interval overlaps another one of its group."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(start).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("overlaps", F.coalesce(before > F.col(start), F.lit(False)) | F.coalesce(after < F.col(end), F.lit(False)))


def packed_timeline(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """served_start and served_end: the segments of a group laid end to end in order."""
    w = Window.partitionBy(*by).orderBy(start)
    length = F.col(end) - F.col(start)
    done = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("served_end", done).withColumn("served_start", F.col("served_end") - length)


def remapped(points: DataFrame, timeline: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """Points in source time to served time; points in cuts are dropped. timeline: by, start, end, served_start."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1e-9) / width)))
    segments = timeline.select(*by, "start", "end", "served_start", cells.alias("cell"))
    return points.withColumn("cell", F.floor(F.col(at) / width)).join(segments, [*by, "cell"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).withColumn("served", F.col("served_start") + F.col(at) - F.col("start")).drop("cell", "start", "end", "served_start")
