"""Scores of documents against a set of queries that is told to every task, as arrays.

Postings are numbered where they lie, by the terms that every task is told, and become lists of numbers; they meet at their
document once, together with what terms outside that table add, and a block of documents is scored at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Postings that are looked up, or expanded, at once; cells of a block of documents by terms and pairs asked for.
ROWS, ENTRIES, CELLS = 200_000, 250_000, 4_000_000
NUMBERED = "doc {}, field int, length int, ids array<int>, tfs array<int>, adds array<double>"


@dataclass
class Told:
    """fields, and of each its boost and mean length; terms, with idf by field, and the terms asked for that they are near to (entries first[i] up to first[i + 1] of asked and weight); queries, and pairs of a query and an asked term by query: (begins of a query, asked, times)."""

    fields: list[str]
    boost: np.ndarray
    mean: np.ndarray
    terms: pa.Array
    idf: np.ndarray
    first: np.ndarray
    asked: np.ndarray
    weight: np.ndarray
    n_asked: int
    queries: pa.Array
    begins: np.ndarray
    pair_asked: np.ndarray
    times: np.ndarray
    every: bool
    k1: float
    b: float
    delta: float

    def raw(self, field: np.ndarray, length: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.boost[field] * self.idf[field, term] * (self.delta + tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean[field])))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of so many rows at least."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def numbered(postings: DataFrame, held) -> DataFrame:
    """Postings (doc, field, length, term, tf) of the terms told, as NUMBERED: a row for each run of one document's field."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Told = held.value
        fields = pa.array(told.fields, pa.string())
        for t in gathered(batches, max(ROWS, len(told.terms))):
            t = t.append_column("id", pc.index_in(t["term"], told.terms)).filter(pc.is_valid(pc.index_in(t["term"], told.terms))).combine_chunks()
            if not t.num_rows:
                continue
            docs = t["doc"].combine_chunks()
            keys = [docs.dictionary_encode("encode").indices.to_numpy(), pc.index_in(t["field"], fields).to_numpy(), t["length"].to_numpy()]
            begins = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            ends = pa.array(np.append(begins, t.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, t[c].combine_chunks().cast(pa.int32())) for c in ("id", "tf")]
            n = len(begins)
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(begins)), pa.array(keys[1][begins], pa.int32()), pa.array(keys[2][begins], pa.int32()), *lists, pa.nulls(n, pa.list_(pa.float64()))], ["doc", "field", "length", "ids", "tfs", "adds"])

    return postings.mapInArrow(of, NUMBERED.format(postings.schema["doc"].dataType.simpleString()))


def others(postings: DataFrame, held) -> DataFrame:
    """Postings of terms that aren't told."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Told = held.value
        for t in gathered(batches, max(ROWS, len(told.terms))):
            yield from t.filter(pc.and_(pc.is_valid(t["term"]), pc.is_null(pc.index_in(t["term"], told.terms)))).to_batches()

    return postings.mapInArrow(of, postings.schema)


def blocks(batches: Iterator[pa.RecordBatch], most_docs: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of doc as tables of whole documents, up to so many and about ENTRIES entries; with them the place of each row's document."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        while t.num_rows:
            codes = t["doc"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            entries = np.cumsum(pc.list_value_length(t["ids"]).to_numpy())
            full = np.flatnonzero((np.arange(1, len(begins)) >= most_docs) | (entries[begins[1:] - 1] >= ENTRIES))  # the last document may go on in the next batch
            if not len(full):
                break
            stop = begins[full[0] + 1]
            yield t.slice(0, stop), np.cumsum(np.isin(np.arange(stop), begins)) - 1
            t = t.slice(stop).combine_chunks()
        rest = t
    if rest is not None and rest.num_rows:
        codes = rest["doc"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        yield rest, np.cumsum(np.concatenate([[0], codes[1:] != codes[:-1]]))


def scored(rows: DataFrame, held, query: str, key: str, kind: str) -> DataFrame:
    """query, key, score and matched of rows (NUMBERED) in the order of doc. A row without a field adds its adds to the terms asked for that its ids number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Told = held.value
        sizes = np.diff(np.append(told.begins, len(told.pair_asked)))
        for t, place in blocks(batches, max(1, CELLS // (told.n_asked + len(told.pair_asked) + 1))):
            n, own = int(place[-1]) + 1, np.asarray(pc.is_valid(t["field"]))
            count = pc.list_value_length(t["ids"]).to_numpy()
            ids = pc.list_flatten(t["ids"]).to_numpy()
            of_told = np.repeat(own, count)
            term, row = ids[of_told], np.repeat(np.flatnonzero(own), count[own])
            field, length = (t[c].fill_null(0).to_numpy()[row] for c in ("field", "length"))
            raw = told.raw(field, length, term, pc.list_flatten(t["tfs"]).to_numpy())
            degree = told.first[term + 1] - told.first[term]
            source = np.repeat(np.arange(len(term)), degree)
            at = told.first[term][source] + np.arange(len(source)) - np.repeat(np.cumsum(degree) - degree, degree)
            cells = np.concatenate([place[row][source] * told.n_asked + told.asked[at], np.repeat(place[~own], count[~own]) * told.n_asked + ids[~of_told]])
            adds = np.concatenate([raw[source] * told.weight[at], pc.list_flatten(t["adds"]).to_numpy()])
            sums = np.bincount(cells, adds, n * told.n_asked).reshape(n, -1)
            hit = (np.bincount(cells, minlength=n * told.n_asked) > 0).reshape(n, -1)
            total = np.add.reduceat(sums[:, told.pair_asked] * told.times, told.begins, axis=1)
            matched = np.add.reduceat(hit[:, told.pair_asked], told.begins, axis=1, dtype=np.int64)
            d, q = np.nonzero(matched == sizes if told.every else matched)
            if len(d):
                docs = t["doc"].combine_chunks().take(pa.array(np.searchsorted(place, d)))
                yield pa.RecordBatch.from_arrays([told.queries.take(pa.array(q)), docs, pa.array(total[d, q] * matched[d, q]), pa.array(matched[d, q])], [query, key, "score", "matched"])

    return rows.mapInArrow(of, f"`{query}` {kind}, `{key}` {rows.schema['doc'].dataType.simpleString()}, score double, matched long")
