"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3 code points of the lower-cased text). Each
language has several centroids, found by clustering its training vectors by cosine; a text gets the language of its
nearest centroid, and is marked as rejected where that is too far.

The model is fitted on a bounded sample, at most ``per_language`` texts of each language and their first draws by hash;
it is fitted on the driver. Every text is judged whole.

Defined results: a null text and one without a letter are "und" with score 0 and rejected; without a training row all
are "und"; repeated rows agree; an empty table gives no rows. Only the key and the text are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 13
PER_LANGUAGE, CLUSTERS, MIN_COSINE = 300, 3, 0.35
SALTS = 16
#: Texts above this many code points are counted in pieces, so that memory stays bounded.
PIECE = 1 << 20


@dataclass(frozen=True)
class Centroids:
    languages: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a whole text."""
    out = np.zeros(DIMENSIONS, np.float32)
    carry = ""
    for at in range(0, max(1, len(text)), PIECE):
        piece = text[at : at + PIECE].lower()
        new, piece = len(carry), carry + piece
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(code), np.uint32)
        for n in (1, 2, 3):
            h = (h[: len(code) - n + 1] if n > 1 else h) * np.uint32(0x9E3779B1) + code[n - 1 :] if len(code) >= n else h[:0]
            first = max(0, new - n + 1)
            mixed = (h[first:] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            out += np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=DIMENSIONS)
        carry = piece[-2:]
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    return v / (np.linalg.norm(v) or 1.0)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; begins with the row nearest to the mean and then with those farthest from the ones chosen."""
    mean = vectors.mean(0)
    chosen = [int(np.argmax(vectors @ mean))]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(1))))
    centers = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centers.T, 1)
        sums = np.stack([vectors[own == j].sum(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers


def fit(raw: np.ndarray, languages: list[str], clusters: int = CLUSTERS) -> Centroids:
    """raw: the counts of the training texts, one row each."""
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))).astype(np.float32) + 1
    v = np.log1p(raw) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], int)
    groups = [cluster(v[label == i], clusters) for i in range(len(names))]
    return Centroids(names, np.array([i for i, g in enumerate(groups) for _ in g], int), np.concatenate(groups) if groups else np.zeros((0, DIMENSIONS), np.float32), idf)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The training sample: of each language the texts with the smallest hashes of doc_id.

    The hash up to which a language's texts are wanted is found first, from languages and hashes alone, so that hardly
    any text beyond the sample is shuffled; a language's hashes are ranked in SALTS parts,
    each of the rows of some input partitions, before those that remain meet in one task. The parts don't change what
    is found. There is one such bound a language, as there are centroids in the model.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").withColumn("draw", F.xxhash64("doc_id"))
    drawn = known.select("lang", "draw", (F.spark_partition_id() % SALTS).alias("salt"))
    for by in (["lang", "salt"], ["lang"]):
        drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("draw"))).where(F.col("rank") <= per_language)
    upto = [(r["lang"], r["upto"]) for r in drawn.groupBy("lang").agg(F.max("draw").alias("upto")).collect()]
    if not upto:
        return known.select("lang", "text").limit(0)
    bound = F.create_map(*[F.lit(x) for pair in upto for x in pair])
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    near = known.where(F.col("draw") <= bound[F.col("lang")])
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Centroids:
    """The model of a sample. The texts are counted where they lie, and the driver gets their counts: 4 * DIMENSIONS bytes a text, however long it is."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                if any(c.isalpha() for c in text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([counts(text.as_py()).tobytes()], pa.binary())], ["lang", "counts"])

    rows = sorted((r["lang"], bytes(r["counts"])) for r in sample(docs, per_language).mapInArrow(of, "lang string, counts binary").toLocalIterator())
    raw = np.stack([np.frombuffer(c, np.float32) for _, c in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return fit(raw, [lang for lang, _ in rows], clusters)


def predict(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """key, lang_pred, score (the cosine) and rejected, for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(value: str | None, m: Centroids) -> tuple[str, float, bool]:
        if not value or not len(m.owner) or not any(c.isalpha() for c in value):
            return "und", 0.0, True
        near = m.vectors @ vector(value, m.idf)
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        return m.languages[m.owner[best]], score, score < min_cosine

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            rows = [judge(x.as_py(), m) for x in b.column(1)]
            lang, score, far = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], [key, "lang_pred", "score", "rejected"])

    return docs.select(key, text).mapInArrow(of, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double, rejected boolean")
