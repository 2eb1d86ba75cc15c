"""The best match by cosine among all rows, exactly, without comparing all pairs where distances to pivots rule them out.

On unit vectors the cosine follows from the distance, so the triangle inequality holds bounds. Each reference lies in the
block of its nearest pivot, and a block knows how near and how far from its pivot its members are. A query first looks
into its own nearest block; what it finds there bounds its distance, and it then visits just those other blocks whose
members can lie as near. Blocks and their visitors are dealt to pieces of bounded size, which meet in an equi join of
groups; each group is one product of matrices. Vectors far apart in many dimensions are ruled out seldom: the
work then is that of all pairs, in pieces of the same bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side that meet in one task's group, on average.
PIECE = 4096
#: Of a group, so many queries are compared at once; of what a task tells, so many rows go out at once.
SLICE = 256
#: Scores are compared at so many digits; bounds leave room for a difference of one in the last of them.
DIGITS = 5


def units(vectors: pd.Series, width: int) -> np.ndarray:
    x = np.array([v if v is not None and len(v) == width else [np.nan] * width for v in vectors], np.float64).reshape(len(vectors), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows (id, vec, ...) with a direction, as unit vectors, with block, their nearest pivot, and its distance."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = units(b["vec"], pivots.shape[1])
            good = np.isfinite(x).all(axis=1)
            b, x = b[good].copy(), x[good]
            d = apart(x, pivots)
            b["vec"], b["block"], b["far"] = list(x), d.argmin(axis=1), d.min(axis=1)
            yield b

    kinds = {**dict(rows.dtypes), "vec": "array<double>", "block": "int", "far": "double"}
    return rows.mapInPandas(of, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def visits(queries: DataFrame, pivots: np.ndarray, near: np.ndarray, far: np.ndarray) -> DataFrame:
    """For queries (id, vec, block, best) each other block that can hold a match as good as best, a cosine or null."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = apart(np.stack(b["vec"]) if len(b) else np.zeros((0, pivots.shape[1])), pivots)
            least = np.maximum(d - far, near - d)  # infinite for empty blocks
            best = np.nan_to_num(b["best"].to_numpy(np.float64, na_value=np.nan), nan=-1.0)
            most = np.sqrt(np.maximum(0.0, 2 - 2 * (best - 2 * 10.0**-DIGITS)))
            wanted = least <= most[:, None] + 1e-9
            wanted[np.arange(len(b)), b["block"]] = False
            q, block = np.nonzero(wanted)
            for i in range(0, len(q), PIECE):
                own = q[i : i + PIECE]
                yield pd.DataFrame({"id": b["id"].to_numpy()[own], "vec": b["vec"].to_numpy()[own], "block": block[i : i + PIECE]})

    return queries.mapInPandas(of, f"id {dict(queries.dtypes)['id']}, vec array<double>, block int")


def met(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """The best match of each query in each piece of the blocks that it visits: id, score (rounded) and ref; a row with the query's own id is no match. Equal scores go to the least ref."""
    count = lambda df: {r["block"]: r["count"] for r in df.groupBy("block").count().collect()}  # noqa: E731 - a row for each pivot
    spread = lambda n: F.create_map(*[x for block, c in n.items() for x in (F.lit(block), F.lit(-(-c // PIECE)))]) if n else F.create_map(F.lit(-1), F.lit(1))
    of_refs, of_queries = spread(count(refs)), spread(count(queries))
    own = lambda df, n: F.pmod(F.xxhash64("id"), F.coalesce(n[F.col("block")], F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n[F.col("block")], F.lit(1)) - 1))
    q = queries.select("id", "vec", "block", own(queries, of_queries).alias("qp"), every(of_refs).alias("rp"))
    r = refs.select("id", "vec", "block", own(refs, of_refs).alias("rp"), every(of_queries).alias("qp"))
    kind = dict(queries.dtypes)["id"]

    def of(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "score": [], "ref": []})
        b = b.sort_values("id", kind="stable")
        ids, refs, x, y = a["id"].to_numpy(), b["id"].to_numpy(), np.stack(a["vec"]), np.stack(b["vec"]).T
        at, best = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for i in range(0, len(ids), SLICE):
            s = np.round(x[i : i + SLICE] @ y, DIGITS)
            s[ids[i : i + SLICE, None] == refs[None, :]] = -np.inf
            at[i : i + SLICE] = s.argmax(axis=1)  # the first of equal ones
            best[i : i + SLICE] = s.max(axis=1)
        some = np.isfinite(best)
        return pd.DataFrame({"id": ids[some], "score": best[some], "ref": refs[at[some]]})

    keys = ("block", "qp", "rp")
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(of, f"id {kind}, score double, ref {kind}")


def best_of(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.max("score").alias("score"), F.min_by("ref", F.struct(-F.col("score"), "ref")).alias("ref"))


def best_matches(queries: DataFrame, refs: DataFrame, written, most_pivots: int = 128) -> DataFrame:
    """id, score and ref: for each query (id, vec) the reference (id, vec) with the greatest cosine, at DIGITS digits, that isn't the query itself; equal ones go to the least id.

    Vectors without a direction, or of another length than the first pivot, are neither asked nor found. ``written`` puts
    a frame down for what reads it next. The driver holds the pivots, and a few numbers for each.
    """
    drawn = refs.where(F.size("vec") > 0).orderBy(F.xxhash64("id"), "id").limit(most_pivots).select("vec").collect()
    if not drawn:
        return refs.sparkSession.createDataFrame([], f"id {dict(queries.dtypes)['id']}, score double, ref {dict(queries.dtypes)['id']}")
    pivots = units(pd.Series([r["vec"] for r in drawn]), len(drawn[0]["vec"]))
    pivots = np.unique(pivots[np.isfinite(pivots).all(axis=1)], axis=0)
    if not len(pivots):
        pivots = np.eye(1, len(drawn[0]["vec"]))
    r, q = written(placed(refs.select("id", "vec"), pivots), "refs"), written(placed(queries.select("id", "vec"), pivots), "queries")
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for row in r.groupBy("block").agg(F.min("far"), F.max("far")).collect():
        near[row[0]], far[row[0]] = row[1], row[2]
    first = written(best_of(met(q, r)), "first")
    asked = q.join(first.select("id", F.col("score").alias("best")), "id", "left").select("id", "vec", "block", "best")
    return best_of(first.select("id", "score", "ref").unionByName(met(written(visits(asked, pivots, near, far), "visits"), r)))


def _against(x: list, y: list) -> np.ndarray:
    """Cosines of vectors; -1 where lengths differ or one has no direction, NaN where a component is none."""
    out = np.full((len(x), len(y)), -1.0)
    widths = [np.array([-1 if v is None else len(v) for v in side]) for side in (x, y)]
    for w in np.intersect1d(*widths):
        if w > 0:
            i, j = (np.flatnonzero(n == w) for n in widths)
            a, b = (np.stack([side[k] for k in own]).astype(np.float64) for side, own in ((x, i), (y, j)))
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                norm = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
                out[np.ix_(i, j)] = np.where(norm == 0, -1.0, (a @ b.T) / norm)
    return out


def best_of_all(queries: DataFrame, refs: DataFrame, piece: int = 4 * PIECE) -> DataFrame:
    """id, score, ref and most: for each query (id, vec) the reference (id, vec) with the greatest cosine at DIGITS digits, of equal ones the least, and the greatest cosine itself; a row with the query's own id is no match.

    All pairs are compared: both sides are dealt to pieces of bounded size, and each pair of pieces is a group whose
    products of matrices are made some queries at a time. Vectors of other lengths, null, zero or with null components
    have a cosine of -1; one with a component that is no number is NaN, which counts as the greatest.
    """
    whole = lambda df: df.where("id is not null").select("id", F.when(~F.exists("vec", lambda v: v.isNull()), F.col("vec")).alias("vec"))
    pieces = [max(1, -(-df.count() // piece)) for df in (queries, refs)]
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = whole(queries).select("id", "vec", own(pieces[0]).alias("qp"), every(pieces[1]).alias("rp"))
    r = whole(refs).select("id", "vec", own(pieces[1]).alias("rp"), every(pieces[0]).alias("qp"))
    kind = dict(queries.dtypes)["id"]

    def of(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        ids, others, x, y = a["id"].to_numpy(), b["id"].to_numpy(), list(a["vec"]), list(b["vec"])
        out = [pd.DataFrame({"id": ids[:0], "score": np.zeros(0), "ref": others[:0], "most": np.zeros(0)})]
        for i in range(0, len(ids) if len(others) else 0, SLICE):
            s = _against(x[i : i + SLICE], y)
            s[np.isnan(s)] = np.inf
            s[ids[i : i + SLICE, None] == others[None, :]] = -np.inf
            most, s = s.max(axis=1), np.round(s, DIGITS)
            at, some = s.argmax(axis=1), most > -np.inf
            out.append(pd.DataFrame({"id": ids[i : i + SLICE][some], "score": s.max(axis=1)[some], "ref": others[at[some]], "most": most[some]}))
        return pd.concat(out)

    found = q.groupBy("qp", "rp").cogroup(r.groupBy("qp", "rp")).applyInPandas(of, f"id {kind}, score double, ref {kind}, most double")
    told = lambda c: F.when(c == float("inf"), float("nan")).otherwise(c)
    best = found.groupBy("id").agg(F.max("score").alias("score"), F.min_by("ref", F.struct(-F.col("score"), "ref")).alias("ref"), F.max("most").alias("most"))
    return best.withColumns({"score": told(F.col("score")), "most": told(F.col("most"))})
