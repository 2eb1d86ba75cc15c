"""Edit distances over words, alignments with times, and fuzzy names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf


def plain_words(text: Column) -> Column:
    """Lower-case words of a-z, 0-9 and apostrophes; null gives none."""
    cut = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9']+", ""))
    return F.filter(cut, lambda w: w != "")


def word_distance(a: Column, b: Column) -> Column:
    """The edit distance of two arrays of words: each word becomes one character, its place among the pair's words."""
    known = F.array_distinct(F.concat(a, b))

    def spelled(words: Column) -> Column:
        mark = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 65536), 8, "0")), "UTF-32")
        return F.array_join(F.transform(words, mark), "")

    return F.levenshtein(spelled(a), spelled(b))


def error_rates(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds wer and cer. Where one side has no word both are 1, where both have none 0; nulls count as empty."""
    made = df.withColumns({"_a": plain_words(F.col(reference)), "_b": plain_words(F.col(hypothesis))})
    one, other = F.size("_a"), F.size("_b")
    bare = F.when((one == 0) & (other == 0), 0.0).when((one == 0) | (other == 0), 1.0)
    x, y = F.array_join("_a", " "), F.array_join("_b", " ")
    return made.withColumns(
        {"wer": bare.otherwise(word_distance(F.col("_a"), F.col("_b")) / one), "cer": bare.otherwise(F.levenshtein(x, y) / F.length(x))}
    ).drop("_a", "_b")


#: Up to so many cells, 8 MB, a table of distances is kept whole.
MOST_CELLS = 1_000_000


def _next_row(above: np.ndarray, i: int, word: object, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    open_row = np.concatenate(([i], np.minimum(above[1:] + 1, above[:-1] + (b != word))))
    return np.minimum.accumulate(open_row - steps) + steps


def word_pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int | None, int | None]]:
    """The places that a best alignment puts together, None for a word alone: from the end on a pair where one is optimal, else a word of a, else one of b.

    A table up to MOST_CELLS is kept whole. Of a larger one only every root(n)-th row is kept; the rows between two of them are made again when the way back enters
    them. So 2 root(n) rows are held, and each is made twice.
    """
    n, steps, width = len(a), np.arange(len(b) + 1), max(1, math.isqrt(len(a)))
    kept, row, small = {0: steps}, steps, len(a) * len(b) <= MOST_CELLS
    rows, base = ([steps], 0) if small else ([], None)
    for i in range(1, n + 1):
        row = _next_row(row, i, a[i - 1], b, steps)
        if small:
            rows.append(row)
        elif i % width == 0:
            kept[i] = row
    out, i, j = [], n, len(b)
    while i or j:
        if base is None or i - 1 < base and i:
            base = (i - 1) // width * width if i else 0
            rows = [kept[base]]
            for r in range(base + 1, min(base + width, n) + 1):
                rows.append(_next_row(rows[-1], r, a[r - 1], b, steps))
        if i and j and rows[i - base][j] == rows[i - 1 - base][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and rows[i - base][j] == rows[i - 1 - base][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def aligned_words(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """keys, seq, a, b, a_word and b_word: the pairs of a best alignment of two columns of words, as rows; a side is null where a word stands alone. Null counts as no words."""
    kinds = dict(df.dtypes)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                *key, x, y = row
                x, y = (np.array([] if w is None else list(w), object) for w in (x, y))
                pairs = word_pairs(x, y)
                if pairs:
                    told = pd.DataFrame({"seq": range(len(pairs)), "a": pd.array([p for p, _ in pairs], "Int64"), "b": pd.array([q for _, q in pairs], "Int64"), "a_word": [None if p is None else x[p] for p, _ in pairs], "b_word": [None if q is None else y[q] for _, q in pairs]})
                    yield told.assign(**dict(zip(keys, key)))[[*keys, *told.columns]]

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "seq int, a int, b int, a_word string, b_word string"])
    return df.select(*keys, left, right).mapInPandas(of, schema)


def _deltas(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray) -> tuple[float, float]:
    """Agreement of two word lists, and the mean distance in time of the words that an alignment puts together."""
    if not len(a) or not len(b):
        return (1.0 if len(a) == len(b) else 0.0), 0.0
    pairs = word_pairs(a, b)
    apart = [abs(at[i] - bt[j]) for i, j in pairs if i is not None and j is not None and (at[i] > 0 or bt[j] > 0)][::-1]
    edits = sum(i is None or j is None or a[i] != b[j] for i, j in pairs)
    return 1.0 - edits / max(len(a), len(b)), float(np.mean(apart)) if apart else 0.0


def timed_agreement(df: DataFrame, left: str, right: str, drift: float = 0.8) -> DataFrame:
    """Adds agreement, delta and drifts for two columns array<struct<word, start>>, which hold clips; null counts as empty."""

    @arrow_udf("agreement double, delta double")
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lefts, rights in batches:
            out = []
            for x, y in zip(lefts, rights, strict=True):  # a row at a time; the batch itself stays in Arrow
                x, y = (v.as_py() or [] for v in (x, y))
                words = [np.array([u["word"] for u in side], dtype=object) for side in (x, y)]
                times = [np.array([u["start"] or 0.0 for u in side], dtype=float) for side in (x, y)]
                out.append(_deltas(*words, *times))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in out], pa.float64()) for i in (0, 1)], ["agreement", "delta"])

    return df.withColumn("_m", compare(left, right)).select(*df.columns, "_m.*").withColumn("drifts", F.col("delta") > drift)


def canonical_names(df: DataFrame, roster: DataFrame, by: str, name: str, least: float = 0.90) -> DataFrame:
    """Adds canonical: the roster's spelling where it is the same but for case and space, else where exactly one entry of
    the same ``by`` and number of words is at least ``least`` alike, else the name as it is. Each distinct name is judged
    once, against the entries whose length allows the ratio; a null name stays null."""

    @pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    def keyed(frame: DataFrame, norm: str) -> DataFrame:
        return frame.withColumn(norm, F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))).where(F.col(norm) != "").withColumn("_n", F.size(F.split(norm, " ")))

    known = keyed(roster.select(by, name), "_k").groupBy(by, "_n", "_k").agg(F.min(F.trim(name)).alias("_spelling"))
    asked = keyed(df.select(by, name), "_q").select(by, "_n", "_q").distinct()
    bound = 2 * F.least(F.length("_q"), F.length("_k")) >= least * (F.length("_q") + F.length("_k"))
    near = asked.join(known, [by, "_n"]).where(bound).withColumn("_r", alike("_q", "_k")).where(F.col("_r") >= least)
    found = near.groupBy(by, "_q").agg(F.count("*").alias("_c"), F.max("_spelling").alias("_one"), F.max(F.when(F.col("_q") == F.col("_k"), F.col("_spelling"))).alias("_same"))
    norm = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    back = df.withColumn("_q", norm).join(found, [by, "_q"], "left")
    return back.select(*df.columns, F.coalesce("_same", F.when(F.col("_c") == 1, F.col("_one")), F.col(name)).alias("canonical"))
