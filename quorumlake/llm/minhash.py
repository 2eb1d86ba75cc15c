"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its w-word shingles. The sketch has ``BANDS * BAND_ROWS`` coordinates and is filled in rounds:
in each round every shingle is hashed to one coordinate and to a value, a coordinate keeps the smallest value of the
first round that reaches it, and coordinates that half of the rounds leave empty are then filled one by one, so that
every coordinate gets a value. Bands of coordinates make buckets; the documents of a bucket are candidates, and links
are confirmed on the full sets.

Documents with equal sets are one class from the start. Within a bucket the classes are first compared with one of
them only; where a bucket still holds several components, a few rounds compare classes outside its main component with
members of others. What then still lies in different components of a bucket, and could be similar by its set's size, is
compared pair by pair, so that no candidate between different components is left out. Components, not links, are what is
asked for: copies are never paired among themselves, nor are those that are already known to belong together.

Defined results: a null text counts as empty; an empty set has no links; a null doc_id is in the component of its class
without being kept; documents that share a doc_id are one node with the links of all of them, and each row is returned;
an empty table gives no rows; only the key and the text are read, so further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize
from quorumlake.llm.components import connected_components

#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8 ** 5) ** 40, about 1e-7.
BANDS, BAND_ROWS = 40, 5
SIZE = BANDS * BAND_ROWS
WORD_CACHE = 300_000
#: Of each coordinate PLANES bits are kept for a closer look at candidates. At a similarity of 0.8 the kept bits of 37.5
#: coordinates of 200 differ on average, with a standard deviation of 5.5; more than MOST_DIFFERENT do so in 1 of 10 ** 6.
PLANES, MOST_DIFFERENT = 4, 65
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A strong mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: bytes do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], k: int, cache: WordHashes) -> np.ndarray:
    """Distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(cache) > WORD_CACHE:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix((out + h[i : len(h) - size + 1 + i]) * GOLD)
    return np.unique(out)


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The coordinates of a set that isn't empty."""
    out = np.zeros(size, np.uint64)
    filled = np.zeros(size, bool)
    n, first = len(elements), 0
    step = max(1, math.ceil(size * (math.log(size) + 2) / n))
    while first < size and not filled.all():
        rounds = np.arange(first, min(size, first + step), dtype=np.uint64)
        h = mix(elements[None, :] + mix(rounds * GOLD + np.uint64(1))[:, None])
        place = (h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
        # in one number: the coordinate, then the round, then the hash, so that sorting brings the first of each
        key = np.sort(((place << np.uint64(54)) | ((rounds - np.uint64(first))[:, None] << np.uint64(44)) | (mix(h) >> np.uint64(20))).ravel()) if len(rounds) <= 1024 else None
        where, at = np.unique(key >> np.uint64(54), return_index=True)
        where = where.astype(np.int64)
        fresh = ~filled[where]
        out[where[fresh]] = mix(key[at[fresh]] + np.uint64(first))
        filled[where] = True
        first += len(rounds)
    for j in np.flatnonzero(~filled):
        out[j] = mix(elements + mix(np.array([size + j], np.uint64) * GOLD + np.uint64(1))).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = coordinates.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * GOLD
    for i in range(rows.shape[1]):
        key = mix((key + rows[:, i]) * GOLD)
    return key


def planes_of(coordinates: np.ndarray) -> np.ndarray:
    """The lowest PLANES bits of all coordinates, plane by plane, each filled up to whole numbers of 64 bits."""
    bits = (coordinates[None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(np.pad(bits.astype(np.uint8), ((0, 0), (0, -len(coordinates) % 64))), axis=1).reshape(-1).view(np.int64)


def differing(a: Column, b: Column, size: int = SIZE) -> Column:
    """How many coordinates differ in one of their kept bits."""
    width = -(-size // 64)
    out = F.lit(0)
    for i in range(width):
        any_plane = a[i].bitwiseXOR(b[i])
        for p in range(1, PLANES):
            any_plane = any_plane.bitwiseOR(a[p * width + i].bitwiseXOR(b[p * width + i]))
        out = out + F.bit_count(any_plane)
    return out


def sketches(docs: DataFrame, k: int, bands: int = BANDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, a 128-bit hash of the set in two longs, and the keys of its bands and its planes (null for an empty set)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows = []
            for value in b.column(1).cast(pa.binary()):
                s = shingles((value.as_py() or b"").lower().split(), k, cache)
                both = xxhash.xxh3_128_digest(s.tobytes())
                drawn = sketch(s, bands * BAND_ROWS) if len(s) else None
                rows.append((len(s), int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True), *((None, None) if drawn is None else (band_keys(drawn, bands).view(np.int64), planes_of(drawn)))))
            n, hi, lo, keys, planes = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (n, hi, lo)], *[pa.array(c, pa.list_(pa.int64())) for c in (keys, planes)]], [key, "n_shingles", "set_hi", "set_lo", "bands", "planes"])

    return docs.select(key, text).mapInArrow(of, f"`{key}` {dict(docs.dtypes)[key]}, n_shingles long, set_hi long, set_lo long, bands array<long>, planes array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) those whose sets have at least least[0] / least[1] of their union in common. Sets are of the words themselves. The pairs follow their first document, so its set is made once."""

    def shingle_set(words: list[bytes]) -> set:
        return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else {tuple(words)} if words else set()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                first = b.column(2)[i].as_py()
                if first != last:
                    last, held = first, shingle_set(words_of(first))
                other = shingle_set(words_of(b.column(3)[i].as_py()))
                common = len(held & other)
                keep.append(bool(common) and least[1] * common >= least[0] * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    second = pairs.join(texts.toDF("b", "b_text"), "b")
    both = second.join(texts.toDF("a", "a_text"), "a").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(of, f"a {kind}, b {kind}").distinct()


SMALL_BUCKET, ROUNDS = 8, 3
#: A class with more than one in so many rows is hot; so there are fewer hot classes than this.
HOT = 1000


def _first_pairs(buckets: DataFrame) -> DataFrame:
    hubs = buckets.groupBy("key").agg(F.min_by("rep", F.xxhash64("key", "rep")).alias("hub"))
    return _ordered(buckets.join(hubs, "key").select("rep", "hub"))


def _ordered(pairs: DataFrame) -> DataFrame:
    a, b = (F.col(c) for c in pairs.columns)
    return pairs.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _unsettled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """key, rep, size, n and root of the buckets that hold several components. Written once, for all that reads it."""
    held = materialize(buckets.join(roots.toDF("rep", "root"), "rep", "left").select("key", "rep", "size", "n", F.coalesce("root", "rep").alias("root")), "held")
    several = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return materialize(held.join(several, "key", "left_semi"), "open-buckets")


def _cross_pairs(held: DataFrame, seed: int) -> DataFrame:
    """Pairs across the components of a bucket. A small bucket gives all; a large one compares what is outside its main component with a member of that one and with one of the others, by chance."""
    parts = held.groupBy("key", "root").agg(F.count("*").alias("c"), F.min_by("rep", F.xxhash64(F.lit(seed), "key", "rep")).alias("hub"))
    mains = parts.groupBy("key").agg(F.max_by(F.struct("root", "hub"), F.struct("c", "root")).alias("main"))
    others = parts.join(mains, "key").where(F.col("root") != F.col("main.root")).groupBy("key").agg(F.min_by(F.struct("root", "hub"), F.xxhash64(F.lit(seed), "root")).alias("other"))
    large = held.where(F.col("n") > SMALL_BUCKET).join(mains, "key").where(F.col("root") != F.col("main.root"))
    to_main = large.select("rep", "main.hub")
    to_other = large.join(others, "key").where(F.col("root") != F.col("other.root")).select("rep", "other.hub")
    few = held.where(F.col("n") <= SMALL_BUCKET)
    small = few.select("key", F.col("rep").alias("a"), F.col("root").alias("a_root")).join(few.select("key", F.col("rep").alias("b"), F.col("root").alias("b_root")), "key").where("a < b and a_root <> b_root").select(F.col("a").alias("rep"), F.col("b").alias("hub"))
    return _ordered(to_main.unionByName(to_other).unionByName(small))


def _prefixes(texts: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """For texts (doc_id, text, several): rep, hash and r, the rank from 1: of each set so many of its rarest shingles that two sets without a common one among these can't have the similarity. Shingles that no other set has take their ranks but aren't returned; a document with several texts gives all its shingles, with rank 1."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for i, value in enumerate(b.column(1).cast(pa.binary())):
                s = shingles((value.as_py() or b"").lower().split(), k, cache).view(np.int64)
                if len(s):
                    size = 0 if b.column(2)[i].as_py() else len(s)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(s))), pa.array(s), pa.array([size] * len(s))], ["rep", "hash", "size"])

    found = materialize(texts.mapInArrow(of, f"rep {dict(texts.dtypes)['doc_id']}, hash long, size long"), "open-shingles")
    shared = found.groupBy("hash").agg(F.count("*").alias("c"))
    ranked = found.join(shared, "hash").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("c", "hash")))
    needed = F.col("size") - F.ceil(F.col("size") * least[0] / least[1] - 1e-9) + 1
    kept = ranked.where((F.col("c") > 1) & ((F.col("size") == 0) | (F.col("r") <= needed)))
    return kept.groupBy("rep", "hash").agg(F.min(F.when(F.col("size") == 0, 1).otherwise(F.col("r"))).alias("r"))


def _remaining_pairs(held: DataFrame, planes: DataFrame, texts: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """The pairs of the buckets that lie in different components and could have the similarity, by exact bounds and by the sketches. One side of each is outside a bucket's main component, so that these are never joined with themselves.

    The bounds: the rarest common shingle is among the prefixes of both sets, and what lies before it in either is not common.
    """
    parts = held.groupBy("key", "root").agg(F.count("*").alias("c"))
    mains = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    members = held.join(mains, "key").groupBy("rep").agg(F.first("root").alias("root"), F.max("size").alias("size"), F.max(F.col("root") != F.col("main")).alias("outside"))
    members = materialize(members.join(planes, "rep"), "open-classes")
    several = members.join(texts.groupBy(F.col("doc_id").alias("rep")).agg((F.count("*") > 1).alias("several")), "rep").select(F.col("rep").alias("doc_id"), "several")
    found = _prefixes(texts.join(several, "doc_id").select("doc_id", "text", "several"), k, least)
    told = materialize(found.join(members, "rep"), "open-prefixes")
    side = lambda n: told.select("hash", F.col("r").alias(f"{n}_r"), *[F.col(c).alias(f"{n}_{c}") for c in ("rep", "root", "size", "outside", "planes")])
    most_common = F.least(F.col("a_size") - F.col("a_r"), F.col("b_size") - F.col("b_r")) + 1
    fits = (most_common * (least[0] + least[1]) >= (F.col("a_size") + F.col("b_size")) * least[0]) & (differing(F.col("a_planes"), F.col("b_planes")) <= MOST_DIFFERENT)
    pairs = side("a").where("a_outside").join(side("b"), "hash").where((F.col("a_root") != F.col("b_root")) & (~F.col("b_outside") | (F.col("a_rep") < F.col("b_rep"))) & fits)
    return _ordered(pairs.select("a_rep", "b_rep"))


def near_duplicates(docs: DataFrame, k: int = 5, least: tuple[int, int] = (80, 100), bands: int = BANDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component) and kept (doc_id = component_id), one row for each row of docs.

    Rounds of comparisons end when one finds no link between different components, or after ``rounds``; a last step
    compares all candidates that are left. In buckets of up to SMALL_BUCKET classes a round compares all pairs across
    components, and the bucket is done; in larger ones it compares each class outside the main component with two of
    the others, so its work stays in proportion to the bucket. Buckets that hold one component only are done as well.
    """
    drawn = materialize(sketches(docs, k, bands), "sketches")
    known = drawn.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    keys = classes.select("rep", "size", F.explode("bands").alias("key"))
    buckets = materialize(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "rep", "size", "n"), "buckets")
    texts = materialize(docs.select("doc_id", "text").join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidate-texts")
    tried = materialize(_first_pairs(buckets), "pairs")
    roots = connected_components(materialize(confirm(tried, texts, k, least), "links"))
    left = buckets.where("n > 2")  # a bucket of two is compared by now
    fruitless = False
    for r in range(1, rounds + 1):
        if fruitless and r < rounds:
            continue
        held = _unsettled(left, roots)
        if held.isEmpty():
            break
        wanted = _cross_pairs(held, r) if r < rounds else _remaining_pairs(held, classes.select("rep", "planes"), texts, k, least)
        pairs = materialize(wanted.join(tried, ["a", "b"], "left_anti"), "pairs")
        fresh = materialize(confirm(pairs, texts, k, least), "links")
        tried = tried.unionByName(pairs)
        left = held.where(F.col("n") > SMALL_BUCKET).drop("root")
        fruitless = fresh.isEmpty()
        if not fruitless:
            roots = connected_components(roots.toDF("a", "b").unionByName(fresh))
    return _named(drawn, classes.select("set_hi", "set_lo", "rep", "rows"), roots)


def _named(drawn: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with the component of their class. A class follows its least document; rows that share that document's id follow it too. The classes with more than one in HOT of all rows, fewer than HOT in number, are broadcast, so that no key of the join has more rows than that."""
    named = materialize(classes.join(roots.toDF("rep", "root"), "rep", "left").select("set_hi", "set_lo", "rows", F.coalesce("root", "rep").alias("root")), "classes")
    hot = F.broadcast(named.where(F.col("rows") * HOT > drawn.count()).drop("rows"))
    own, by = drawn.select("doc_id", "n_shingles", "set_hi", "set_lo"), ["set_hi", "set_lo"]
    out = own.join(hot, by).unionByName(own.join(hot, by, "left_anti").join(named.drop("rows"), by, "left"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
