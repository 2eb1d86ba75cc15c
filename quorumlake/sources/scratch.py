"""The folder that the driver and all executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder in local mode, and an error elsewhere, as executors couldn't share it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quorumlake-"))
    return context.getCheckpointDir().get()


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a task of a spread frame holds, on average.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The frame by hash of columns in as many partitions as its rows ask for, so that a task's share doesn't grow with them; what groups by these columns needs no other shuffle."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *by)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once and read from there."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
