"""Cells of telemetry that changes are folded into, and a derived table that follows its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def failure_cells(stored: DataFrame, events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cells (keys, count, last_status, last_seen, last_sent, last_output, max_output) with events folded in, in one aggregation.

    events: keys, order, seen, status, sent and output. The last status counts even if it is null; of what was sent and
    put out the last value that isn't. A single event leaves max_output as it is; from the second on null counts as 0.
    """
    before = stored.select(*keys, F.lit(None).cast(events.schema[order].dataType).alias("o"), F.lit(0).alias("side"), F.col("count").alias("n"), F.col("last_status").alias("status"), F.col("last_seen").alias("seen"), F.col("last_sent").alias("sent"), F.col("last_output").alias("output"), F.col("max_output").alias("most"))
    sent, output = F.when(F.col("sent") > 0, F.col("sent")), F.when(F.col("output") >= 0, F.col("output"))
    fresh = events.select(*keys, F.col(order).alias("o"), F.lit(1).alias("side"), F.lit(1).cast("long").alias("n"), "status", "seen", sent.alias("sent"), output.alias("output"), output.alias("most"))
    place = F.struct("side", "o")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))
    most = F.when(F.count("*") > 1, F.greatest(F.coalesce(F.max("most"), F.lit(0)), F.lit(0))).otherwise(F.max("most"))
    return before.unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("count"), F.max_by("status", place).alias("last_status"), F.max_by("seen", place).alias("last_seen"), known("sent").alias("last_sent"), known("output").alias("last_output"), most.alias("max_output"))


def usage_cells(stored: DataFrame, cells: DataFrame, keys: list[str], order: str, sums: list[str], maxima: list[str], samples: list[str], most: int) -> DataFrame:
    """Cells with counters added up, maxima raised, and arrays of samples filled in order up to ``most``. Samples beyond that are left out before they are gathered."""
    both = stored.withColumns({"own_side": F.lit(0), "own_o": F.lit(None).cast(cells.schema[order].dataType)}).unionByName(cells.withColumns({"own_side": F.lit(1), "own_o": F.col(order)}).drop(order))
    out = both.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums], *[F.max(F.coalesce(c, F.lit(0))).alias(c) for c in maxima])
    for name in samples:
        each = both.select(*keys, "own_side", "own_o", F.posexplode(name).alias("own_i", "own_x"))
        first = each.withColumn("own_r", F.row_number().over(Window.partitionBy(*keys).orderBy("own_side", "own_o", "own_i"))).where(F.col("own_r") <= most)
        told = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("own_r", "own_x"))), lambda s: s["own_x"]).alias(name))
        out = out.join(told, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(cells.schema[name].dataType)))
    return out


def synced_priorities(index: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The index (job, model, priority, created) after its jobs (job, priority, created, models) changed: rows of a job whose priority is another now take it, if they still have the job's old priority and time and their model is among its models; all its rows, if it names none."""
    old = before.select("job", F.col("priority").alias("own_old"), F.col("created").alias("own_created"))
    moved = after.select("job", F.col("priority").alias("own_new"), "models").join(old, "job").where(~F.col("own_new").eqNullSafe(F.col("own_old")))
    met = index.join(moved, "job", "left").withColumn("own_moved", F.col("own_old").isNotNull() | F.col("own_new").isNotNull())
    named = F.array_contains("models", F.col("model")) & (F.col("priority") == F.col("own_old")) & (F.col("created") == F.col("own_created"))
    follows = F.col("own_moved") & F.when(F.col("models").isNull(), F.lit(True)).otherwise(F.coalesce(named, F.lit(False)))
    return met.withColumn("priority", F.when(follows, F.col("own_new")).otherwise(F.col("priority"))).select(*index.columns)
