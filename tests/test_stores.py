"""Saved records, stored files and marks of logs at sizes that grow."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from quorumlake.operators import timeline
from quorumlake.plans import provided
from quorumlake.sources import readers
from quorumlake.sources.scratch import fresh_folder, shared_folder


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(urlparse(folder).path) for f in names if f.endswith((".parquet", ".txt"))}


def test_keys_share_a_bounded_number_of_folders(spark):
    folder, kind = fresh_folder(spark, "kept"), "k long, v string"
    readers.save_records(spark.createDataFrame([(k, "first") for k in range(500)] + [(None, "first")] * 2, kind), folder, "k", 8)
    before = files(folder)
    assert len(before) == 8
    readers.save_records(spark.createDataFrame([(7, "second"), (None, "second")], kind), folder, "k", 8)
    got = sorted(((r["k"], r["v"]) for r in readers.saved_records(spark, folder).collect()), key=str)
    assert got == sorted([(k, "second" if k == 7 else "first") for k in range(500)] + [(None, "second")], key=str)
    assert len(files(folder)) == 8 and len(before.keys() - files(folder).keys()) <= 2


def test_no_file_of_a_store_grows_with_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(provided, "RECORDS_IN_FILE", 100)
    rows = spark.range(2000).select(F.col("id").alias("o_orderkey"), F.lit(1.5).alias("o_totalprice"), F.lit("1998-01-01 00:00:00").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    before = set(os.listdir(urlparse(shared_folder(spark)).path))
    got = provided.stored_records(spark, str(tmp_path))
    assert sorted(int(r["uid"]) for r in got.select("uid").collect()) == list(range(2000))
    (store,) = [d for d in set(os.listdir(urlparse(shared_folder(spark)).path)) - before if d.startswith("store-")]
    assert len(files(f"{shared_folder(spark)}/{store}")) == 20


def test_marks_after_ten_million_seconds(spark):
    """Spark writes a double from 10**7 on with an exponent."""
    logs = spark.createDataFrame([("a", 12345678.5), ("b", 2.5)], "k string, at double").select("k", F.concat(F.lit("x_start: "), "at", F.lit("\nx_end: "), F.col("at") + 1, F.lit(" | more\n")).alias("log"))
    assert [tuple(r) for r in timeline.marked_intervals(logs, "k", "log", "x_start", "x_end").orderBy("k").collect()] == [("a", 1, 12345678.5, 12345679.5), ("b", 1, 2.5, 3.5)]


def test_all_rows_are_placed_without_one_task(spark):
    from quorumlake.operators import workqueue

    rows = spark.range(1000, numPartitions=5).withColumn("v", F.col("id") * 7 % 10)
    got = workqueue.positions(rows, [], [[F.col("v").desc()]], "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in got.orderBy("position").collect()] == [r["id"] for r in sorted(rows.collect(), key=lambda r: (-r["v"], r["id"]))]
    assert "row_number()" not in plan and got.agg(F.max("position")).first()[0] == 1000


def test_partitions_follow_the_rows(spark):
    from quorumlake.sources.scratch import TASK_ROWS, spread

    assert spread(spark.range(10), 40 * TASK_ROWS, "id").rdd.getNumPartitions() == 40
    assert spread(spark.range(10), 10, "id").rdd.getNumPartitions() == 8


def test_long_turns_are_aligned_in_little_memory(spark, monkeypatch):
    import numpy as np

    from quorumlake.operators import align

    a, b = (np.array([f"w{(i * k) % 31}" for i in range(200)], object) for k in (3, 5))
    whole = align.word_pairs(a, b), align._deltas(a, b, np.arange(200.0), np.arange(200.0))
    monkeypatch.setattr(align, "MOST_CELLS", 100)
    assert (align.word_pairs(a, b), align._deltas(a, b, np.arange(200.0), np.arange(200.0))) == whole
