"""Connected components of a graph given by its edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize


def _to_least(edges: DataFrame, nearer: bool) -> DataFrame:
    """One star step over (a, b): the neighbours of each node that lie on one side of it are tied to the least of all it has there, itself included. Neighbour lists are never gathered: a join brings the least to each of them."""
    if nearer:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        tied = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        tied = tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = pairs.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """edges: (a, b), of any comparable type, without nulls. Returns (node, root), the root being the least node of the component; nodes without an edge don't appear.

    Each round shuffles the edges a few times and writes them to the shared folder. The number of rounds grows with the
    logarithm of the longest path; rounds end when the edges stay as they are.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(most_rounds):
        edges = materialize(_to_least(_to_least(edges, nearer=False), nearer=True), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("the components aren't settled; allow more rounds")
