"""Tables that follow a stream of changes, each batch applied once, and derived tables that are carried along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorumlake.sources.scratch import exists


class FollowedTables:
    """Named tables in a folder, one version for each applied batch. A version counts from the moment its mark is written, which comes last: all tables of a batch change together or not at all, and a batch that is delivered again, after a failure say, changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def applied(self) -> int | None:
        """The last batch that is applied."""
        path = f"{self.folder}/applied"
        return self.spark.read.parquet(path).agg(F.max("batch")).first()[0] if exists(self.spark, path) else None

    def table(self, name: str) -> DataFrame:
        last = self.applied()
        if last is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/batch={last}")

    def apply(self, batch: DataFrame, number: int, step: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]) -> bool:
        """Brings all tables on by a batch: step gets the tables and the batch, and returns the tables after it. Returns whether anything was done."""
        last = self.applied()
        if last is not None and number <= last:
            return False
        now = step({name: self.table(name) for name in self.schemas}, batch)
        for name, schema in self.schemas.items():
            kind = self.spark.createDataFrame([], schema).schema
            now[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind]).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        self.spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(f"{self.folder}/applied")
        return True

    def follow(self, changes: DataFrame, step: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]], checkpoint: str, **trigger) -> StreamingQuery:
        """Starts to apply a stream's batches."""
        return changes.writeStream.foreachBatch(lambda df, n: self.apply(df, n, step)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
