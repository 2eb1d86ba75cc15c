"""Terms of a vocabulary that equal, begin with or are near to those asked for, found by joins on equal pieces.

If a term of length L is within k edits of another one, then of its k + 1 nearly equal pieces at least one occurs in the
other unchanged, at most k places away. So both sides are cut into pieces and joined on them; only the pairs that are met
are compared letter by letter, and never a term with a whole vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Up to so many terms asked for, and pieces of them, are told to every task: the vocabulary then stays where it lies.
MOST_TOLD = 200_000


def edits_for(term: Column, fuzzy: float, most: int = 6) -> Column:
    """How many edits a term allows: a share of its letters below 1, rounded half up and at most ``most``; else the number itself."""
    return (F.least(F.lit(most), F.floor(F.length(term) * fuzzy + 0.5)) if fuzzy < 1 else F.lit(int(fuzzy))).cast("int")


def _piece_at(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Where the i-th of k + 1 pieces begins and ends."""
    return F.floor(length * i / (k + 1)), F.floor(length * (i + 1) / (k + 1))


def pieces(vocabulary: DataFrame, most: int, wanted: DataFrame) -> DataFrame:
    """term and its pieces (k, size, i, piece) for each number of edits up to ``most`` that is wanted (k, size) for its size."""
    sized = vocabulary.select("term", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).select("term", "k", F.length("term").alias("size"))
    cut = sized.join(F.broadcast(wanted), ["k", "size"]).select("term", "k", "size", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    a, b = _piece_at(F.col("size"), F.col("k"), F.col("i"))
    return cut.select("term", "k", "size", "i", F.substring("term", (a + 1).cast("int"), (b - a).cast("int")).alias("piece"))


def probes(asked: DataFrame) -> DataFrame:
    """For asked (asked, k): the pieces that a term within k edits must have one of."""
    n = F.length("asked")
    sized = asked.where("k > 0").select("asked", "k", F.explode(F.sequence(F.greatest(n - F.col("k"), F.lit(1)), n + F.col("k"))).alias("size"))
    numbered = sized.select("asked", "k", "size", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    a, b = _piece_at(F.col("size"), F.col("k"), F.col("i"))
    moved = numbered.select("asked", "k", "size", "i", a.alias("a"), (b - a).alias("width"), F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("shift"))
    inside = moved.where((F.col("a") + F.col("shift") >= 0) & (F.col("a") + F.col("shift") + F.col("width") <= n))
    return inside.select("asked", "k", "size", "i", F.substring("asked", (F.col("a") + F.col("shift") + 1).cast("int"), F.col("width").cast("int")).alias("piece")).distinct()


def near_terms(vocabulary: DataFrame, asked: DataFrame, fuzzy: float, prefix: bool = True, prefix_weight: float = 0.375, fuzzy_weight: float = 0.45, most_edits: int = 6) -> DataFrame:
    """asked, term and weight for a vocabulary (term) and terms asked for (asked), distinct both.

    An equal term weighs 1. One that begins with the term asked for weighs prefix_weight n / (n + 0.3 more), n being its
    letters and ``more`` those beyond; any other within the edits allowed weighs fuzzy_weight n / (n + edits).
    """
    size = F.length("term")
    held = lambda df: F.broadcast(df) if df.limit(MOST_TOLD + 1).count() <= MOST_TOLD else df
    asked = held(asked.select("asked"))
    found = vocabulary.join(asked.select("asked", F.col("asked").alias("term")), "term").select("asked", "term", F.lit(1.0).alias("weight"))
    if prefix:
        lengths = asked.select(F.length("asked").alias("own_n")).distinct()
        cut = vocabulary.where(size > 1).select("term", F.explode(F.sequence(F.lit(1), size - 1)).alias("own_n")).join(F.broadcast(lengths), "own_n")
        begun = cut.select("term", F.substring(F.col("term"), F.lit(1), F.col("own_n")).alias("asked")).join(asked, "asked")
        found = found.unionByName(begun.select("asked", "term", (prefix_weight * size / (size + 0.3 * (size - F.length("asked")))).alias("weight")))
    told = asked.select("asked", edits_for(F.col("asked"), fuzzy, most_edits).alias("k"))
    most = told.agg(F.max("k")).first()[0] or 0
    if most > 0:
        sought = probes(told)
        met = pieces(vocabulary, most, sought.select("k", "size").distinct()).join(held(sought), ["k", "size", "i", "piece"]).select("asked", "term", "k").distinct()
        far = met.withColumn("far", F.levenshtein("asked", "term")).where("far between 1 and k")
        if prefix:
            far = far.where(~F.startswith("term", "asked"))
        found = found.unionByName(far.select("asked", "term", (fuzzy_weight * size / (size + F.col("far"))).alias("weight")))
    return found
