"""Vector code compression: a codebook for each part of a vector, learned by Lloyd rounds with Yinyang bounds.

Components become integers floor(4096 x); a vector is cut into equal parts, and each part is coded by the nearest entry
of its codebook (squared distance, ties to the lower index). A codebook starts as the part of the first vectors by key
and is replaced in each round by its parts' componentwise floor(sum / count); unused entries stay.

The entries of a codebook are clustered into groups. Each vector carries, for each part, an upper bound of the distance to
its entry and one lower bound for each group, of the distance to the group's other entries. When entries move, the bounds
move with them; only groups whose bound doesn't lie above the upper bound are scanned, in exact integers, so that ties
are settled by index. Bounds are kept rounded outwards, so that a group that is left out holds no tie either.

The bounds are written with the vectors after each round and the round before is deleted. Per task at most parts x
entries x width sums leave a round, and the driver holds the codebooks alone: their size doesn't grow with the rows.

Defined results: rows without a vector, with a null or non-finite component, or without components are dropped, and so
are vectors whose length can't be cut into the parts or isn't that of the first vector that can, by key; nulls of the key
come last; rows that share a key are separate rows, in the order of their components; with fewer rows than entries, the
codebook has as many entries as rows; integers are held to +-2**28 at most (less for parts of over 8 components), so that
distances fit into 64 bits; an empty table gives no rows; only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize, remove

PARTS, ENTRIES, ROUNDS, GROUPS = 8, 16, 6, 4
SCALE = 4096
#: Bounds are moved outwards by this share whenever they are computed; it covers the rounding of 32-bit floats.
SLACK = 1e-6
#: A label with more than one in so many rows is hot; so there are fewer hot labels than this.
HOT = 1000


def integers(vector: Column, limit: int) -> Column:
    return F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), v.cast("double") * SCALE))).cast("int"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - entries[None, :, :]
    return np.einsum("nmw,nmw->nm", d, d)


def grouped(book: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """The entries in groups that lie together: seeds as far apart as can be, then each entry to the nearest seed."""
    seeds = [0]
    while len(seeds) < min(groups, len(book)):
        seeds.append(int(squared(book, book[seeds]).min(axis=1).argmax()))
    nearest = squared(book, book[seeds]).argmin(axis=1)
    return [np.flatnonzero(nearest == g) for g in range(groups)]


def assign(x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, groups: list[np.ndarray], drift: np.ndarray | None) -> None:
    """Puts the nearest entries of one part into codes, and new bounds into upper and lower. drift: how far each entry has moved; None: there are no bounds yet."""
    n = len(x)
    best_d = np.full(n, np.iinfo(np.int64).max)
    if drift is None:
        rows, failing = np.arange(n), np.ones((n, len(groups)), bool)
        codes[:] = len(book)
    else:
        upper[:] = (upper + drift[codes]) * (1 + SLACK)
        moved = np.array([drift[g].max(initial=0) for g in groups])
        lower[:] = lower - moved - SLACK * (np.minimum(np.abs(lower), 1e30) + moved)  # infinite: the group has no other entry
        rows = np.flatnonzero(upper >= lower.min(axis=1))
        step = x[rows] - book[codes[rows]]
        best_d[rows] = np.einsum("nw,nw->n", step, step)
        upper[rows] = np.sqrt(best_d[rows]) * (1 + SLACK)
        failing = np.zeros((n, len(groups)), bool)
        failing[rows] = lower[rows] <= upper[rows, None]
    before, before_d = codes.copy(), best_d.copy()
    scans = []
    for g, members in enumerate(groups):
        at = np.flatnonzero(failing[:, g])
        if not len(at):
            continue
        if not len(members):
            lower[at, g] = np.inf
            continue
        d = squared(x[at], book[members])
        first = d.argmin(axis=1)
        least = d[np.arange(len(at)), first]
        d[np.arange(len(at)), first] = np.iinfo(np.int64).max
        scans.append((g, at, members[first], least, d.min(axis=1)))
        better = (least < best_d[at]) | ((least == best_d[at]) & (members[first] < codes[at]))
        best_d[at[better]], codes[at[better]] = least[better], members[first[better]]
    for g, at, first, least, second in scans:
        rest = np.where(first == codes[at], second, least).astype(np.float64)
        rest[rest >= np.iinfo(np.int64).max] = np.inf
        lower[at, g] = np.sqrt(rest) * (1 - SLACK)
    left = np.flatnonzero((before != codes) & (before < len(book)))
    of = np.zeros(len(book) + 1, np.int64)
    for g, members in enumerate(groups):
        of[members] = g
    own = of[before[left]]
    unscanned = ~failing[left, own]
    left, own = left[unscanned], own[unscanned]
    lower[left, own] = np.minimum(lower[left, own], np.sqrt(before_d[left]) * (1 - SLACK))
    upper[rows] = np.sqrt(best_d[rows]) * (1 + SLACK)


def matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def next_state(state: DataFrame, books: np.ndarray, drift: np.ndarray | None, groups: list[list[np.ndarray]]) -> DataFrame:
    """The state with each vector's codes for these codebooks."""
    parts, width = len(books), books.shape[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = matrix(b.column(2), n, np.int64).reshape(n, parts, width)
            if drift is None:
                codes, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, GROUPS))
            else:
                codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                upper, lower = matrix(b.column(4), n, np.float64), matrix(b.column(5), n, np.float64).reshape(n, parts, GROUPS)
            for p in range(parts):
                assign(x[:, p], codes[:, p], upper[:, p], lower[:, p], books[p], groups[p], None if drift is None else drift[p])
            told = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), told, lists(upper, pa.float32()), lists(lower.reshape(n, -1), pa.float32())], ["id", "label", "x", "codes", "upper", "lower"])

    return state.mapInArrow(of, state.schema)


def sums(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by part and entry, and sums by part, entry and component, as Python's integers."""
    parts, entries, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            n = b.num_rows
            if n:
                x = matrix(b.column(2), n, np.int64).reshape(n, parts, width)
                codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, parts)
                for p in range(parts):
                    total[p] += (codes[:, p] == np.arange(entries)[:, None]).astype(np.int64) @ x[:, p]
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        both = np.concatenate([count[:, :, None], total], axis=2).ravel()
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(both[some], pa.int64())], ["place", "value"])

    both = np.zeros(parts * entries * (width + 1), object)
    for place, value in state.mapInArrow(of, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        both[place] = int(value)
    both = both.reshape(parts, entries, width + 1)
    return both[:, :, 0], both[:, :, 1:]


def moved(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """The codebooks after a round."""
    count, total = sums(state, books)
    out = books.copy()
    used = count > 0
    out[used] = (total[used] // count[used][:, None]).astype(np.int64)
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def errors_of(state: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part) and error, the squared distances summed over the parts."""
    parts, width = len(books), books.shape[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                x = matrix(b.column(2), n, np.int64).reshape(n, parts, width)
                held = b.column(3).to_pylist()
                codes = np.frombuffer(b"".join(held), np.uint8).reshape(n, parts)
                step = x - books[np.arange(parts)[None, :], codes]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.hex() for c in held]), pa.array(np.einsum("npw,npw->n", step, step), pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(state.dtypes)
    return state.mapInArrow(of, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with the errors summed over equal labels, nulls together. Hot labels are broadcast, all others joined."""
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    by = materialize(by.withColumnRenamed("label", "of"), "labels")
    hot = F.broadcast(by.where(F.col("rows") * HOT > coded.count()).drop("rows"))
    same = F.col("label").eqNullSafe(F.col("of"))
    return coded.join(hot, same).drop("of").unionByName(coded.join(hot, same, "left_anti").join(by.drop("rows"), same).drop("of"))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """For each row kept its key, code, error and label_error; and the codebooks, by part, entry and component."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    own = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in ((key, "id"), (label, "label"), (vector, "vector"))])
    own = own.where(usable(F.col("vector"))).where(F.size("vector") % parts == 0)
    by_key = F.col("id").asc_nulls_last()
    first = own.orderBy(by_key, "vector").select(F.size("vector")).first()
    kinds = dict(own.dtypes)
    if first is None:
        nothing = own.sparkSession.createDataFrame([], f"`{key}` {kinds['id']}, code string, error long, label_error long")
        return nothing, np.zeros((parts, 0, 0), np.int64)
    width = first[0] // parts
    limit = 1 << min(28, 30 - ((width - 1).bit_length() + 1) // 2)  # width * (2 * limit) ** 2 is below 2 ** 63
    x = own.where(F.size("vector") == first[0]).select("id", "label", integers(F.col("vector"), limit).alias("x"))
    seeds = np.array([r["x"] for r in x.orderBy(by_key, "x").limit(entries).collect()], np.int64)
    books = seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    groups = [grouped(b) for b in books]
    empty = {"codes": "binary", "upper": "array<float>", "lower": "array<float>"}
    state = materialize(next_state(x.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]), books, None, groups), "codes")
    for _ in range(rounds):
        after = moved(books, state)
        step = (after - books).astype(np.float64)
        drift = np.sqrt(np.einsum("pew,pew->pe", step, step)) * (1 + SLACK)
        books, last = after, state
        state = materialize(next_state(last, books, drift, groups), "codes")
        remove(last)
    coded = materialize(errors_of(state, books), "coded")
    remove(state)
    return with_label_errors(coded).select(F.col("id").alias(key), "code", "error", "label_error"), books
