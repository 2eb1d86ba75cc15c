"""Ranked lexical search by sort-based accumulation.

Terms are runs of ASCII letters, digits and all other characters, A-Z in lower case. A query set is asked against all
documents, in blocks of bounded size. For each block a pass over the texts writes what each document has of the block's
terms, and from it come the counts of the collection. A second pass accumulates: the (query, document, impact) entries
of many documents are concatenated, their packed keys are sorted by radix passes of 16 bits, and equal keys are summed;
the best of each query are held in a heap for each task. The tasks' best meet in ranges of queries.

A term weighs w = floor(1000 ln((2N+2) / (2df+1))); a document with n terms has m = 10 + (90 n N) div L; a query's score
is the sum of w * ((10**9 tf) div (1000 tf + 8 m)) over its distinct terms. All numbers but the logarithm are integers.

Defined results: a null text has no terms, and neither it nor an empty one counts among the N documents; a query without
terms, or without a document that scores above 0, gives no rows; rows of the query set are separate queries even if they
share their id, and rows of the documents separate documents; equal scores follow the document's id, a null id last, then
the row; an empty table on either side gives no rows; only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize, remove

#: Terms of all queries in a block, repeats between queries counted, on average: what a task holds of the query set.
BLOCK_TERMS = 300_000
#: Entries that are sorted together, unless one document has more.
CHUNK = 1 << 21
#: Maps each byte of UTF-8 to itself, A-Z to lower case, other ASCII characters to a blank.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of unsigned numbers, by passes over 16 bits each; passes whose digits are in order already are left out."""
    order, top = np.arange(len(keys)), int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]  # numpy's stable sort of 16-bit numbers is a radix sort
    return order


class QueryBlock:
    """The inverted lists of a block of queries: for each term the queries that have it."""

    def __init__(self, names: list, texts: list[str | None]):
        self.names = names
        self.vocabulary: dict[bytes, int] = {}
        pairs = sorted({(self.vocabulary.setdefault(t, len(self.vocabulary)), q) for q, text in enumerate(texts) for t in terms_of(None if text is None else text.encode("utf-8", "surrogatepass"))})
        self.queries = np.array([q for _, q in pairs], np.int64)
        self.degree = np.bincount(np.array([t for t, _ in pairs], np.int64), minlength=len(self.vocabulary))
        self.first = np.cumsum(self.degree) - self.degree


def matches(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n and, of the terms in the vocabulary, those that the document has and how often."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            n, terms, counts = [], [], []
            for text in b.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                at, often = np.unique(np.fromiter((known[w] for w in words if w in known), np.int32), return_counts=True)
                n.append(len(words))
                terms.append(at)
                counts.append(often.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(of, f"id {docs.schema[0].dataType.simpleString()}, n long, terms array<int>, counts array<long>")


def entries(block: QueryBlock, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of all pairs with a common term, by query, then document: concatenated, radix sorted, summed."""
    degree = block.degree[terms]
    source = np.repeat(np.arange(len(terms)), degree)
    within = np.arange(len(source)) - np.repeat(np.cumsum(degree) - degree, degree)
    keys = (block.queries[block.first[terms][source] + within].astype(np.uint64) << np.uint64(32)) | docs[source].astype(np.uint64)
    if not len(keys):
        return docs[:0], docs[:0], impacts[:0]
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[starts] >> np.uint64(32)).astype(np.int64), (keys[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(impacts[source[order]], starts)


class Best:
    """The k best documents of each query, each in a heap whose root is the worst of them."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(queries)], np.zeros(queries, np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """Rows come by query. Only scores that reach the worst one held are looked at; equal scores are settled by id."""
        near = np.flatnonzero((scores > 0) & (scores >= self.least[queries]))
        for part in np.split(near, np.flatnonzero(np.diff(queries[near])) + 1) if len(near) else ():
            q = queries[part[0]]
            if len(part) > self.k:  # of many, those below the k-th can't be among the best
                part = part[scores[part] >= np.partition(scores[part], -self.k)[-self.k]]
            heap = self.heaps[q]
            for i in part:
                value = ids[i]
                row = (int(scores[i]), value is not None, Reversed(value))
                if len(heap) < self.k:
                    heapq.heappush(heap, row)
                else:
                    heapq.heappushpop(heap, row)
            if len(heap) == self.k:
                self.least[q] = heap[0][0]


class Reversed:
    """Orders values of any kind the other way round."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: Reversed) -> bool:
        return self.value is not None and other.value is not None and other.value < self.value

    def __eq__(self, other: Reversed) -> bool:
        return self.value == other.value


def best_of_tasks(found: DataFrame, block: QueryBlock, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query (its place in the block), id and score: the k best of each query in each task."""
    held = found.sparkSession.sparkContext.broadcast((block, weights))
    kind = found.schema["id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = held.value
        best, id_type = Best(len(block.names), k), None
        for b in batches:
            id_type = b.schema.field("id").type
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            terms, counts = lists.flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy()
            docs = np.repeat(np.arange(b.num_rows), sizes)
            m = 10 + (90 * n_docs * b.column(1).to_numpy()) // n_terms
            impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[docs]))
            cost = np.cumsum(np.bincount(docs, block.degree[terms], b.num_rows))
            ends = np.cumsum(sizes)
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CHUNK, "right")))
                part = slice(ends[at - 1] if at else 0, ends[stop - 1])
                queries, where, scores = entries(block, docs[part], terms[part], impacts[part])
                best.add(queries, scores, b.column(0).take(pa.array(where)).to_pylist())
                at = stop
        rows = [(q, r[2].value, r[0]) for q, heap in enumerate(best.heaps) for r in heap]
        if rows:
            q, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, id_type), pa.array(scores, pa.int64())], ["query", "id", "score"])

    return found.mapInArrow(of, f"query long, id {kind}, score long")


def ask_block(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """The best of a block of queries, rows of (name, text), against all documents (id, text)."""
    spark = docs.sparkSession
    block = QueryBlock(*map(list, zip(*asked)))
    found = materialize(matches(docs, block.vocabulary), "matches")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(block.vocabulary), np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    parts = max(1, min(len(asked), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tops = materialize(best_of_tasks(found, block, weights, n_docs, max(n_terms, 1), k), "tops")
    remove(found)
    last = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = tops.repartitionByRange(parts, "query").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return materialize(ranked, "ranked")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """query key, rank (from 1), key and score of the k best documents of each query."""
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    asked = queries.select(F.col(f"`{query_key}`").alias("name"), F.col(f"`{query_text}`").alias("text"))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(size / 6 / block_terms) or 1  # about six characters a term
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    if blocks > 1:
        dealt = materialize(dealt.repartition("block"), "queries")
    out = None
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).orderBy("name", "text").select("name", "text").collect()
        if not rows:
            continue
        kind = asked.schema["name"].dataType.simpleString()
        names = docs.sparkSession.createDataFrame([(i, r["name"]) for i, r in enumerate(rows)], f"query long, name {kind}")
        best = ask_block(own, [tuple(r) for r in rows], k).join(F.broadcast(names), "query").drop("query")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"name {asked.schema['name'].dataType.simpleString()}, rank int, id {own.schema['id'].dataType.simpleString()}, score long")
    return out.select(F.col("name").alias(query_key), "rank", F.col("id").alias(key), "score")
