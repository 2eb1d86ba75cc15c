"""Structured Streaming forms of the folds: windowed counts with late data, sessions, and keyed failure streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts by sliding window; events later than the watermark are left out, windows are emitted once they are closed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, ts: str, by: list[str], gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def failure_streaks(events: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """key, fails, seen: after each batch the failures in a row and the number of events of the keys that had any. The state of a key is two numbers."""

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, seen = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for bad in rows[failed]:
            fails, seen = (fails + 1 if bad else 0), seen + 1
        state.update((fails, seen))
        yield pd.DataFrame({key: [own[0]], "fails": [fails], "seen": [seen]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, fails long, seen long", "fails long, seen long", "update", GroupStateTimeout.NoTimeout)
