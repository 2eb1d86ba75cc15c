"""Order-dependent packing and folds over the rows of one key, run by Spark key by key."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_shards(df: DataFrame, by: str, key: str, weight: str, shards: int) -> DataFrame:
    """Heaviest first to the least loaded shard, within each group; ties by the number of members, then by shard. A group is one plan and has to fit a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, key], ascending=[False, True], kind="stable")
        heap = [(0.0, 0, s) for s in range(shards)]
        own = []
        for w in pdf[weight]:
            load, n, s = heapq.heappop(heap)
            own.append(s)
            heapq.heappush(heap, (load + w, n + 1, s))
        return pdf[[by, key, weight]].assign(shard=own)

    kinds = dict(df.dtypes)
    return df.select(by, key, weight).groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {key} {kinds[key]}, {weight} {kinds[weight]}, shard int")


def pack_in_order(df: DataFrame, by: str, order: list[str], tokens: str, ceiling: int) -> DataFrame:
    """Packs by number: rows in order go to one pack while their tokens fit the ceiling; a larger row is a pack alone.

    The packs of one key depend on each other from first to last. A task reads its sorted rows batch by batch and holds
    only the open pack's number and load, so that a large key takes time and no memory. A null size counts as 0.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pack, load = object(), 0, 0
        for b in batches:
            own = []
            for k, t in zip(b[by], b[tokens].fillna(0), strict=True):
                if k != key and not (pd.isna(k) and pd.isna(key)):
                    key, pack, load = k, 0, 0
                if load and load + t > ceiling:
                    pack, load = pack + 1, 0
                load += t
                own.append(pack)
            yield b.assign(pack=own)

    schema = ", ".join([*[f"{c} {t}" for c, t in df.dtypes], "pack int"])
    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(walk, schema)


def microbatches(df: DataFrame, by: str, tokens: str, budget: int) -> DataFrame:
    """Per key the number of batches and their padded tokens, rows taken by size while rows x largest fit the budget.

    Equal sizes are counted before the fold, which then works on the distinct sizes of a key and not on its rows. Null
    sizes are left out.
    """

    def fold(sizes: pd.DataFrame) -> pd.DataFrame:
        made, padded, rows, largest = 0, 0, 0, 0
        for size, left in sizes.sort_values(tokens)[[tokens, "_count"]].itertuples(index=False):
            room = max(1, budget // size) if size else rows + left
            if rows >= room:
                made, padded, rows = made + 1, padded + rows * largest, 0
            taken = min(room - rows, left)
            rows, left, largest = rows + taken, left - taken, size
            if left:  # the open batch is full: close it, then all full ones of this size
                full, rest = divmod(left, room)
                if not rest:
                    full, rest = full - 1, room
                made, padded, rows = made + 1 + full, padded + (rows + full * room) * size, rest
        if rows:
            made, padded = made + 1, padded + rows * largest
        return pd.DataFrame({by: sizes[by].head(1), "batches": made, "padded": padded})

    counted = df.where(F.col(tokens).isNotNull()).groupBy(by, F.col(tokens).cast("long").alias(tokens)).agg(F.count("*").alias("_count"))
    return counted.groupBy(by).applyInPandas(fold, f"{by} {dict(df.dtypes)[by]}, batches long, padded long")


def reservations(df: DataFrame, by: list[str], weight: str, budget: int) -> DataFrame:
    """The floor of each row's share of the budget."""
    return df.withColumn("reserved", F.floor(budget * F.col(weight) / F.sum(weight).over(Window.partitionBy(*by))))


def greedy_matches(df: DataFrame, by: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of a group, best scores first, ties by left and then right."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        used_l, used_r, keep = set(), set(), []
        for a, b in zip(pdf[left], pdf[right], strict=True):
            free = a not in used_l and b not in used_r
            keep.append(free)
            if free:
                used_l.add(a)
                used_r.add(b)
        return pdf[keep]

    cols = df.select(by, left, right, score)
    return cols.groupBy(by).applyInPandas(one, cols.schema)
