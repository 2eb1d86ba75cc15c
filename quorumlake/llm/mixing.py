"""Mixing sources to target weights.

Tokens are summed by source, the targets follow from the weights, and each document is taken floor(rate) times, plus
once more where a hash of its doc_id falls below the rate's fraction. The rate of a source is its target over its size.

Defined results: a null text has size 0; a null source is a source of its own, after all others; documents with one
doc_id share one draw, and those without one draw by their texts; an empty table gives no rows; further columns are carried through, and those of the operator's
own names are replaced. No document is taken more than ``max_repeat`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import broadcast_if_small, n_words

OWN = ("size", "source_size", "target", "rate", "copies", "taken")
SEED = "mix-1"


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 by the first 48 bits of an MD5 hash of the doc_id or, where it is null, of the text: any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def targets(sizes: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For (source, source_size): the target of each source.

    Sources in order of code point, null last, weigh ``weights`` in turn. A target stops at max_repeat times the
    source's size and the excess is shared among the others by weight, until none is above: all others then have one
    level of target per weight. The level is found by a running sum over the sources in order of the level at which
    each stops. The input is one row a source, already summed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumns({"cap": F.col("source_size") * float(max_repeat), "level": F.col("source_size") * float(max_repeat) / F.col("weight")})
        .withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": F.sum("source_size").over(everything).cast("double"), "weights": F.sum("weight").over(everything)})
        .withColumn("share", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("water", F.first(F.when(F.col("share") <= F.col("level"), F.col("share")), ignorenulls=True).over(everything))
    )
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("water", F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """The documents with size, source_size, target, rate, copies and taken. The sums by source are the only shuffle; the frame that is joined has one row a source and is broadcast up to SMALL_SIDE of them."""
    sized = docs.select("doc_id", n_words(F.col("text")).alias("size"), "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row"))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = targets(by_source, max_repeat, weights).select(F.col("source").alias("rated_source"), "source_size", "target").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.floor("rate")
    mixed = (
        sized.join(broadcast_if_small(rated), F.col("source").eqNullSafe(F.col("rated_source")), "left")
        .withColumn("copies", F.least(F.lit(max_repeat).cast("long"), whole + (draw(F.col("doc_id"), F.col("own_row")["text"], seed) < F.col("rate") - whole).cast("long")))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
    return mixed.select(*[F.col("own_row")[c].alias(c) for c in docs.columns if c not in OWN], *OWN)


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, with its number from 0 in ``copy``; documents that it doesn't take have none."""
    return mixed.drop("copy").where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
