"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expressions for the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a local folder takes its place, and only in local mode, as other executors couldn't read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quorumlake-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def packed(df: DataFrame, *needed: str, name: str = "own_row") -> DataFrame:
    """The needed columns as they are, and all columns together as one struct, so that no name of an operator's own meets one of the caller's."""
    return df.select(*[F.col(f"`{c}`") for c in needed if c != name], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(columns: list[str], changed: dict[str, Column] | None = None, name: str = "own_row") -> list[Column]:
    """The packed columns again, in order, some of them changed."""
    return [(changed or {}).get(c, F.col(name)[c]).alias(c) for c in columns]


#: Frames of so few rows, one a source or a language, may be broadcast.
SMALL_SIDE = 10_000


def broadcast_if_small(side: DataFrame, most: int = SMALL_SIDE) -> DataFrame:
    """A written frame, marked for broadcasting if it has at most so many rows; else as it is, and Spark shuffles both sides."""
    side = materialize(side, "small-side")
    return F.broadcast(side) if side.count() <= most else side


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it back: the lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing that is still to be run reads it."""
    spark = written.sparkSession
    base, files = shared_dir(spark), written.inputFiles()
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName() and path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
