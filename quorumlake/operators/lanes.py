"""Shares of a row budget for lanes of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _jobs(value: Column) -> Column:
    return F.floor(F.round(value, 9)).cast("long")  # rounded first, so that a whole number isn't missed by the last digit


def reservations(lanes: DataFrame, by: list[str], live_jobs: int, row_cap: float, fixed_rows: float, rows_per_unit: float, rows_per_run: float, queue_days: int) -> DataFrame:
    """lanes (by, lane, live, ratio, units) with reserved_jobs, reserved_units, daily_units and max_queued.

    Live lanes share live_jobs by their ratios. What their jobs leave of the rows, the fixed ones taken off, is shared by
    the others so that ratio times one factor is a lane's jobs. A job costs the rows of its units and of its run. A lane
    may borrow up to all lanes' units in a day, and queue its jobs of some days; one that reserves nothing, those of the
    largest lane. Where a kind of lanes has no ratio above 0, or no rows are left, the others' numbers are null.
    """
    w = Window.partitionBy(*by)
    cost = F.col("units") * rows_per_unit + rows_per_run
    live_weight = F.sum(F.when(F.col("live"), F.col("ratio"))).over(w)
    own = lanes.withColumn("own_live", F.when(F.col("live"), _jobs(F.try_divide(live_jobs * F.col("ratio"), live_weight))))
    left = row_cap - fixed_rows - F.coalesce(F.sum(F.col("own_live") * cost).over(w), F.lit(0.0))
    weight = F.sum(F.when(~F.col("live"), F.col("ratio") * cost)).over(w)
    factor = F.when((left > 0) & (weight > 0), left / weight)
    own = own.withColumn("own_factor", factor).withColumn("reserved_jobs", F.when(F.col("live"), F.col("own_live")).otherwise(_jobs(F.col("ratio") * F.col("own_factor"))))
    own = own.withColumn("reserved_units", F.col("reserved_jobs") * F.col("units"))
    queued = F.when(F.col("reserved_jobs") > 0, F.col("reserved_jobs")).otherwise(F.when(F.col("reserved_jobs").isNotNull(), F.max("reserved_jobs").over(w)))
    return own.withColumns({"daily_units": F.sum("reserved_units").over(w), "max_queued": queue_days * queued}).drop("own_live", "own_factor")
