"""Stable ids of records: kept from run to run, bound by reviewed overrides, and never given twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uid_of(by: list[str], seq: str) -> Column:
    """An id from a bucket's columns and a number in it."""
    return F.left(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col(seq).cast("string"))), F.lit(16))


def assign_uids(records: DataFrame, stored: DataFrame, overrides: DataFrame, by: list[str], guid: str, order: list[str], written, most_rounds: int = 20) -> DataFrame:
    """records (guid, by, order) with uid and how: override, stored, fresh or conflict (uid is null).

    An override (guid, uid) binds a record to an id. A record that has a stored id (guid, uid) keeps it. All others take,
    bucket by bucket in their order, the least numbers whose ids neither a stored record nor an override has; that some of
    a bucket's numbers are taken is found round by round, each with twice as many numbers. An override to an id that
    another record has, stored or by override, is a conflict. Rows added later change no earlier id, once it is stored.
    """
    one = overrides.groupBy(guid).agg(F.min("uid").alias("own_override"))
    kept = stored.groupBy(guid).agg(F.min("uid").alias("own_stored"))
    known = records.join(one, guid, "left").join(kept, guid, "left").withColumn("uid", F.coalesce("own_override", "own_stored"))
    claims = one.select(guid, F.col("own_override").alias("uid")).unionByName(kept.join(one, guid, "left_anti").select(guid, F.col("own_stored").alias("uid")))
    claimed = written(claims.groupBy("uid").agg(F.count("*").alias("own_claims")), "claims")
    settled = known.where("uid is not null").join(claimed, "uid", "left")
    clash = F.col("own_override").isNotNull() & (F.col("own_claims") > 1)
    how = F.when(clash, "conflict").when(F.col("own_override").isNotNull(), "override").otherwise("stored")
    out = settled.withColumns({"how": how, "uid": F.when(~clash, F.col("uid"))}).select(*records.columns, "uid", "how")
    first = Window.partitionBy(*by).orderBy(*order, guid)
    left = known.where("uid is null").select(*records.columns).withColumn("own_place", F.row_number().over(first))
    left = written(left.withColumns({"own_from": F.lit(0).cast("long"), "own_width": F.count("*").over(Window.partitionBy(*by))}), "unnamed")
    for _ in range(most_rounds):
        buckets = left.select(*by, "own_from", "own_width").distinct()
        numbers = buckets.select(*by, F.explode(F.sequence(F.col("own_from"), F.col("own_from") + F.col("own_width") - 1)).alias("own_seq")).withColumn("uid", uid_of(by, "own_seq"))
        free = numbers.join(claimed, "uid", "left_anti").withColumn("own_place", F.row_number().over(Window.partitionBy(*by).orderBy("own_seq"))).drop("own_seq")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*by, "own_place")]
        found = written(left.alias("l").join(free.alias("f"), same, "left").select("l.*", F.col("f.uid").alias("uid")), "named")
        out = out.unionByName(found.where("uid is not null").select(*records.columns, "uid", F.lit("fresh").alias("how")))
        rest = found.where("uid is null").drop("uid")
        if rest.isEmpty():
            return out
        again = rest.withColumn("own_place", F.row_number().over(Window.partitionBy(*by).orderBy("own_place")))
        left = written(again.withColumns({"own_from": F.col("own_from") + F.col("own_width"), "own_width": 2 * F.col("own_width")}), "unnamed")
    raise RuntimeError("too many numbers of a bucket are taken; allow more rounds")
