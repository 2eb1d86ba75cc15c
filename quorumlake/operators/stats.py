"""Conditional and statistical aggregates, calibration and agreement."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The distribution function of a Poisson number of mean 1 below 1, 2, ... 9, in parts of 2**32.
POISSON_CUTS = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k))) for k in range(1, 10))


def histogram(df: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """Rows by fixed-width bins from 0, the last one open, empty bins included."""
    spark = df.sparkSession
    found = df.where(F.col(value).isNotNull()).groupBy(F.least(F.greatest(F.floor(F.round(F.col(value) / width, 9)), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r; null where one side is constant."""
    return df.groupBy(*by).agg(F.when((F.coalesce(F.var_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.var_pop(y), F.lit(0.0)) > 0), F.corr(x, y)).alias("r"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: ece over equal bins (the last one closed), brier and n."""
    cells = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(y).alias("y"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))
    return cells.agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def agreement(df: DataFrame, by: list[str], said: Column, gold: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, and accuracy."""
    tp, fp, fn, tn = F.count_if(said & gold), F.count_if(said & ~gold), F.count_if(~said & gold), F.count_if(~said & ~gold)
    return df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn")).withColumns(
        {"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))}
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of a share."""
    p = F.try_divide(hits, n)
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def stratified_mean(df: DataFrame, strata: dict[str, float], stratum: str, value: str) -> DataFrame:
    """The mean of the strata's means by fixed weights, those of the strata that occur made to sum to 1."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in strata.items() for x in kv]), F.col(stratum))
    means = df.where(F.col(stratum).isin(list(strata))).groupBy(stratum).agg(F.avg(value).alias("m"))
    return means.agg((F.sum(F.col("m") * weight) / F.sum(weight)).alias("mean"))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact: n, total, least, linear median and p90, and the nearest-rank p90."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"),
        F.expr(f"percentile_cont(0.5) within group (order by {value})").alias("median"),
        F.expr(f"percentile_cont(0.9) within group (order by {value})").alias("p90"),
        F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("p90_nearest"),
    )


def two_grains(df: DataFrame, key: str, place: str, ok: Column, least: int, margin: float) -> DataFrame:
    """Places whose share of ok verdicts for a key is below the key's own by more than the margin, both with enough verdicts. Both grains come from one scan."""
    both = df.withColumn("own_ok", ok.cast("int")).rollup(key, place).agg(F.count("*").alias("n"), F.sum("own_ok").alias("ok"), F.grouping_id().alias("g"))
    whole = both.where("g = 1").select(key, F.col("n").alias("all_n"), (F.col("ok") / F.col("n")).alias("all_share"))
    return both.where("g = 0").join(whole, key).where((F.col("n") >= least) & (F.col("all_n") >= least)).withColumn("share", F.col("ok") / F.col("n")).where(F.col("share") < F.col("all_share") - margin).select(key, place, "n", "share", "all_share")


def census(df: DataFrame, by: str, state: str, states: list[str]) -> DataFrame:
    """Counts by state as columns, with a total."""
    return df.groupBy(by).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count("*").alias("total"))


def complete_groups(df: DataFrame, by: list[str], index: str, total: str) -> DataFrame:
    """complete: whether a group's parts disagree about their number (then nothing is waited for) or are all there."""
    return df.groupBy(*by).agg(F.when(F.count_distinct(total) != 1, True).otherwise(F.count_distinct(index) == F.max(total)).alias("complete"))


def joined_details(df: DataFrame, by: list[str], detail: str, most: int) -> DataFrame:
    """Distinct details of a group in order, joined, at most so many named, and how many there are."""
    return df.select(*by, detail).distinct().withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(detail))).groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.col(detail)))), ", ").alias("details"))


def pairwise_agreement(df: DataFrame, subject: str, model: str, answer: str) -> DataFrame:
    """For all pairs of models (few) the subjects that both answered and the share that they agree on."""
    a = df.select(subject, F.col(model).alias("model_a"), F.col(answer).alias("x"))
    b = df.select(subject, F.col(model).alias("model_b"), F.col(answer).alias("y"))
    return a.join(b, subject).where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agree"))


def imputed_weight(df: DataFrame, value: str, name: str) -> DataFrame:
    """The value or, where it is null, the mean of all known ones: a sum that joins as one row."""
    mean = df.agg(F.avg(value).alias("own_mean"))
    return df.join(F.broadcast(mean)).withColumn(name, F.coalesce(value, "own_mean")).drop("own_mean")


def bootstrap_interval(df: DataFrame, by: list[str], cluster: str, value: str, reps: int, seed: str) -> DataFrame:
    """The mean with its 95% percentile interval over resampled clusters, strata being ``by``.

    A replicate weighs each cluster by a Poisson number of mean 1 that a hash of seed, replicate and cluster gives, so
    that no task has to number or draw from all clusters; two values with the same seed see the same resamples.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_rep").cast("string"), F.col(cluster).cast("string"))), 1, 8), 16, 10).cast("long")
    weight = sum(((draw >= cut).cast("int") for cut in POISSON_CUTS), F.lit(0))
    drawn = sums.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_w", weight)
    means = drawn.groupBy(*by, "_rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    ends = means.groupBy(*by).agg(F.expr("percentile_cont(0.025) within group (order by _m)").alias("low"), F.expr("percentile_cont(0.975) within group (order by _m)").alias("high"))
    return sums.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean")).join(ends, by)


def bootstrap_fixed(df: DataFrame, by: list[str], cluster: str, value: str, reps: int, seed: str, size: int = 20_000) -> DataFrame:
    """by, mean, low and high, and draws: the mean with its 95% percentile interval over replicates that each draw as many clusters as there are, with replacement.

    A stratum's clusters lie in buckets of about ``size``. A replicate's draws are dealt to the buckets by binomial splits,
    from the first on, each with the share of the clusters that are left; within a bucket they are dealt to its clusters
    in the same way. All numbers come from hashes of seed, stratum, replicate and bucket, so that reruns agree. draws is what each replicate drew.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_n"))
    totals = sums.groupBy(*by).agg(F.count("*").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    whole = totals.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_all")
    told = (sums.join(F.broadcast(whole), same) if by else sums.crossJoin(F.broadcast(whole))).drop(*[f"_{i}" for i in range(len(by))])
    told = told.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), cluster), F.ceil(F.col("_all") / size)))
    counts = told.groupBy(*by, "_bucket").agg(F.count("*").alias("_m"), F.first("_all").alias("_all"))
    lists = counts.groupBy(*by, "_all").agg(F.array_sort(F.collect_list(F.struct("_bucket", "_m"))).alias("_buckets"))  # a row for each bucket
    keys = "".join(f"`{c}` {dict(told.dtypes)[c]}, " for c in by)

    def number(*parts: object) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.sha256("\x1f".join(map(str, (seed, *parts))).encode()).digest()[:8], "big"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                sizes = np.array([x["_m"] for x in row["_buckets"]])
                rng = number("buckets", *[row[c] for c in by])
                drawn = rng.multinomial(int(row["_all"]), sizes / sizes.sum(), reps)
                yield pd.DataFrame([{**{c: row[c] for c in by}, "_bucket": x["_bucket"], "_draws": drawn[:, i].tolist()} for i, x in enumerate(row["_buckets"])])

    dealt = lists.mapInPandas(deal, f"{keys}_bucket long, _draws array<long>")

    def draw(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({**{c: [] for c in by}, "_rep": [], "_ws": [], "_wn": [], "_w": []})
        a = a.sort_values(cluster, kind="stable")
        key = [a[c].iloc[0] for c in by]
        rng, s, n = number("clusters", *key, int(a["_bucket"].iloc[0])), a["_s"].to_numpy(), a["_n"].to_numpy()
        w = np.stack([rng.multinomial(int(k), np.full(len(a), 1 / len(a))) for k in b["_draws"].iloc[0]])
        return pd.DataFrame({**dict(zip(by, key)), "_rep": np.arange(1, reps + 1), "_ws": w @ s, "_wn": w @ n, "_w": w.sum(axis=1)})

    group = [*by, "_bucket"]
    parts = told.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInPandas(draw, f"{keys}_rep long, _ws double, _wn long, _w long")
    means = parts.groupBy(*by, "_rep").agg((F.sum("_ws") / F.sum("_wn")).alias("_m"), F.sum("_w").alias("_w"))
    ends = means.groupBy(*by).agg(F.expr("percentile_cont(0.025) within group (order by _m)").alias("low"), F.expr("percentile_cont(0.975) within group (order by _m)").alias("high"), F.min("_w").alias("draws"), F.max("_w").alias("_most")).where("draws = _most").drop("_most")
    mean = sums.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean")).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "mean")
    both = mean.join(ends, same) if by else mean.crossJoin(ends)
    return both.select(*by, "mean", "low", "high", "draws")
