"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its k-word shingles, as 64-bit hashes; documents with equal sets are one class. For a required
similarity t, two similar sets have at least ceil(t n) elements in common, n being the size of either. So, in any order of
all shingles, they share at least l of the first n - ceil(t n) + l elements of each: its l-prefix. The longer the prefix,
the more joined rows it costs, and the fewer candidates share as many of its elements.

1. Sieve. In the order of the hashes each class gives the prefix for l = 1 + floor(SIEVE n). A class that doesn't share the
   needed number of its prefix with other classes has no partner and is left out.
2. The shingles of the classes that are left are counted, and ordered from rare to frequent. Each class takes the l with the
   least estimated cost of its candidates: the rows J(l) that its prefix meets, and verification of at most J(l) / l
   documents that share l elements with it. Two classes are candidates if they share as many elements of their prefixes
   as the lesser l of the two says, and if bitmaps of their sets, whose differing bits can't outnumber the sets' differing
   elements, and their sizes allow the similarity. All these bounds are exact.
3. Candidates are verified on the words themselves.

``components`` first compares the classes of a prefix element with one of them, and once more where several components are
left; candidates in one component aren't made after that, so that a family of near copies isn't expanded into its pairs.
``links`` gives all pairs of classes.

Defined results: a null or empty text has an empty set, which isn't linked with anything; a null doc_id gets the component
of its class, and is nobody's component_id (null if all of the component have none); rows that share a doc_id are separate
documents, and the id names all of them; an empty table gives no rows; only the key and the text are read, so further
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize, remove
from quorumlake.llm.components import connected_components
from quorumlake.llm.minhash import GOLD, confirm, mix

#: The share of a set that the sieve's prefix is longer, and that must be met.
SIEVE = 0.05
#: The longest multi-match prefixes tried, in elements more than the shortest.
MOST_MATCHES = 16
#: Bits of a set's bitmap.
BITS = 512
#: Texts are looked up by a broadcast of their hashes if these are not more, else by a join.
MOST_HASHES = 500_000
#: A class with more than one in so many rows is hot; so there are fewer hot classes than this.
HOT = 1000

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word's hash is the sum of its bytes' values, each times a power of an odd number, from running sums over so many bytes at once.
BASE, SPAN = int(GOLD) | 1, 1 << 20
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingles:
    """Hashes of the k-word shingles of many texts at once."""

    def __init__(self, k: int):
        self.k, self.up, self.down = k, powers(BASE, 0), powers(BASE, 0)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words at these places, A-Z as in lower case."""
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(end, start[at] + SPAN, "right")))
            part = data[start[at] : end[stop - 1]]
            if len(self.up) <= len(part):
                self.up, self.down = powers(BASE, max(SPAN, len(part)) + 1), powers(pow(BASE, -1, 1 << 64), max(SPAN, len(part)) + 1)
            running = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(VALUES[LOWER[part]] * self.up[: len(part)], out=running[1:])
            a, b = start[at:stop] - start[at], end[at:stop] - start[at]
            out[at:stop] = mix((running[b] - running[a]) * self.down[a] + (b - a).astype(np.uint64))
            at = stop
        return out

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text the sorted distinct hashes; of a text with fewer words, that of the whole sequence; none without words."""
        texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~SPACES[data]
        begins, ends = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
        begins[offsets[:-1]] |= word[1:][offsets[:-1]]  # texts lie side by side
        ends[offsets[1:]] |= word[:-1][offsets[1:]]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        h = self.words(data, start, end)
        edges = np.searchsorted(start, offsets)
        rolled, out = {}, []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            size = min(self.k, b - a)
            if size and size not in rolled:
                x = np.full(len(h) - size + 1, size, np.uint64)
                for i in range(size):
                    x = mix((x + h[i : len(h) - size + 1 + i]) * GOLD)
                rolled[size] = x
            out.append(np.unique(rolled[size][a : b - size + 1]) if size else h[:0])
        return out


def least_common(n, least: tuple[int, int]):
    """The least number of common elements of a set of n with a similar one, of numbers or of a column."""
    up = n * least[0] + (least[1] - 1)
    return F.floor(up / least[1]) if isinstance(n, Column) else up // least[1]


def matches_of(n: int) -> int:
    return 1 + int(SIEVE * n)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit an element, flipped for each element that falls on it."""
    odd = np.bincount(((hashes >> np.uint64(7)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def in_spans(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of (id, text) with so many bytes of text, or one row."""
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(1)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def sets(docs: DataFrame, k: int, least: tuple[int, int], what: str) -> DataFrame:
    """For docs (id, text): id, n, the set's 128-bit hash, and by ``what`` nothing more (members), the prefix for the sieve (prefix), or text, hashes and bitmap (whole)."""
    more = {"members": "", "prefix": ", prefix array<long>", "whole": ", text string, hashes array<long>, bits array<long>"}[what]
    names = ["id", "n", "set", *(m.split()[0] for m in more.split(",")[1:])]
    longs = pa.list_(pa.int64())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(k)
        for batch in batches:
            for b in in_spans(batch):
                found = made.of(b.column(1))
                columns = [b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())]
                if what == "prefix":
                    columns.append(pa.array([s[: len(s) - least_common(len(s), least) + matches_of(len(s))].view(np.int64) for s in found], longs))
                if what == "whole":
                    columns += [b.column(1), pa.array([s.view(np.int64) for s in found], longs), pa.array([bitmap(s) for s in found], longs)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("id", "text").mapInArrow(of, f"id {dict(docs.dtypes)['id']}, n long, set binary{more}")


def sieved(docs: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """The classes that can have a partner: node (a number), set, n, text, hashes and bits."""
    marked = docs.select(F.xxhash64("text").alias("id"), "text")
    drawn = sets(marked, k, least, "prefix").where("n > 0")
    firsts = drawn.groupBy("set").agg(F.first("n").alias("n"), F.min("id").alias("mark"), F.first("prefix").alias("prefix"))
    classes = materialize(firsts.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    elements = classes.select("node", F.explode("prefix").alias("hash"))
    shared = elements.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    met = elements.join(shared, "hash", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
    needed = 1 + F.floor(least_common(F.col("n"), least) * SIEVE - 1e-9)  # what the smallest partner's prefix asks for
    left = materialize(classes.join(met, "node").where(F.col("met") >= needed).select("set", "mark"), "sieved")
    remove(classes)
    few = F.broadcast if left.count() <= MOST_HASHES else lambda df: df
    texts = marked.join(few(left.select(F.col("mark").alias("id"))), "id", "left_semi")
    whole = sets(texts, k, least, "whole").join(few(left.select("set")), "set", "left_semi")
    kept = whole.groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "text", "hashes", "bits")])
    return materialize(kept.withColumn("node", F.monotonically_increasing_id()), "classes")


def prefixes(classes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """For each class the elements of its prefix that others share: key, node, n, place (from 1), matches, the number l that it chose, and central, how frequent its elements are on average."""
    elements = classes.select("node", "n", F.explode("hashes").alias("key"))
    counts = elements.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    told = elements.join(counts, "key").groupBy("node", "n").agg(F.collect_list(F.struct("c", "key")).alias("shared"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            counts, keys = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            rows, held, places = [], [], []
            for i, n in enumerate(b.column(1).to_pylist()):
                c, key = counts[ends[i] : ends[i + 1]], keys[ends[i] : ends[i + 1]]
                order = np.lexsort((key, c))
                alone = n - len(c)  # elements of this class only come first, and meet nobody
                common = least_common(n, least)
                matches = np.arange(1, min(MOST_MATCHES, common) + 1)
                some = np.clip(n - common + matches - alone, 0, len(c))
                joined = np.concatenate([[0], np.cumsum(c[order] - 1)])[some]
                best = int(np.argmin(joined * (1 + n / matches)))
                held.append(key[order[: some[best]]])
                places.append(alone + np.arange(1, some[best] + 1))
                rows.append((i, n, some[best], matches[best], int(1000 * np.log2(c).sum() / n)))
            if rows:
                i, n, some, chosen, central = (np.array(c, np.int64) for c in zip(*rows))
                columns = [np.concatenate(held), b.column(0).to_numpy()[np.repeat(i, some)], np.repeat(n, some), np.concatenate(places), np.repeat(chosen, some), np.repeat(central, some)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node", "n", "place", "matches", "central"])

    found = materialize(told.mapInArrow(of, "key long, node long, n long, place long, matches long, central long"), "found")
    several = found.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    return materialize(found.join(several, "key", "left_semi"), "met")


def possible(a_n: Column, b_n: Column, a_bits: Column, b_bits: Column, least: tuple[int, int]) -> Column:
    """Whether sizes and bitmaps allow the similarity: the sets differ in at most (1 - t) / (1 + t) of their sizes' sum."""
    flips = sum((F.bit_count(a_bits[i].bitwiseXOR(b_bits[i])) for i in range(BITS // 64)), F.lit(0))
    up, down = least
    return (a_n * down >= b_n * up) & (b_n * down >= a_n * up) & (flips * (up + down) <= (a_n + b_n) * (down - up))


def rooted(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds each node's component."""
    if roots is None:
        return met.withColumn("root", F.col("node"))
    return met.join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def still_open(met: DataFrame) -> DataFrame:
    """The rows of the elements that several components share, and ``main``, the component with the most rows there."""
    parts = met.groupBy("key", "root").agg(F.count("*").alias("c"))
    mains = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return met.join(mains.select("key", "main"), "key")


def candidates(met: DataFrame, bits: DataFrame, roots: DataFrame | None, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of classes of different components that share enough elements of their prefixes. One side of each is outside the main component of an element, so that main components are never joined with themselves."""
    open_ = materialize(still_open(rooted(met, roots)), "open")
    outside = open_.groupBy("node").agg(F.max(F.col("root") != F.col("main")).alias("outside"))
    told = open_.drop("main", "central").join(outside.join(bits, "node"), "node")
    told = materialize(told, "told")
    side = lambda s: told.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "place", "matches", "bits", "root", "outside")])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    matches = F.least(a("matches"), b("matches"))
    within = lambda x: x("place") <= x("n") - least_common(x("n"), least) + matches
    once = (a("root") != b("root")) & (~b("outside") | (a("node") < b("node")))
    fits = once & possible(a("n"), b("n"), a("bits"), b("bits"), least) & within(a) & within(b)
    pairs = side("a").where("a_outside").join(side("b"), "key").where(fits).select("a_node", "b_node", matches.alias("matches"))
    enough = pairs.groupBy("a_node", "b_node", "matches").agg(F.count("*").alias("shared")).where("shared >= matches")
    return enough.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def with_hubs(met: DataFrame, bits: DataFrame, roots: DataFrame | None, seed: int, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of each class with one other class of each of its elements: at first the most central one, as the text that many were copied from; with roots, one of the element's main component, drawn by hash, if its own is another. Pairs that can't be similar are left out."""
    held = rooted(met, roots)
    if roots is not None:
        held = materialize(still_open(held), "open")
    among = held if roots is None else held.where(F.col("root") == F.col("main"))
    drawn = F.xxhash64(F.lit(seed), "node")
    hubs = among.groupBy("key").agg(F.max_by("node", F.struct("central", drawn) if roots is None else drawn).alias("hub"))
    pairs = held.where("true" if roots is None else "root <> main").join(hubs, "key").where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    told = pairs.join(bits.toDF("a", "a_n", "a_bits"), "a").join(bits.toDF("b", "b_n", "b_bits"), "b")
    return told.where(possible(*map(F.col, ("a_n", "b_n", "a_bits", "b_bits")), least)).select("a", "b")


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))


def links(docs: DataFrame, k: int = 5, least: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of linked classes, each once; and the rows' membership: key, n_shingles and class (null for an empty set)."""
    own = named(docs, key, text)
    classes = sieved(own, k, least)
    pairs = materialize(candidates(prefixes(classes, least), classes.select("node", "bits"), None, least), "candidates")
    found = confirm(pairs, classes.select(F.col("node").alias("doc_id"), "text"), k, least)
    for c in ("a", "b"):
        found = found.join(classes.select(F.col("node").alias(c), F.col("set").alias(f"{c}_class")), c).drop(c)
    members = sets(own, k, least, "members").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("class"))
    return found.toDF("a", "b"), members


def components(docs: DataFrame, k: int = 5, least: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """Each row's key, n_shingles and component_id, the least key that is reachable by links."""
    own = named(docs, key, text)
    classes = sieved(own, k, least)
    met, bits = prefixes(classes, least), classes.select("node", "n", "bits")
    texts = classes.select(F.col("node").alias("doc_id"), "text")
    tried = roots = None
    for r in range(rounds + 1):
        pairs = with_hubs(met, bits, roots, r, least) if r < rounds else candidates(met, bits.drop("n"), roots, least)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = materialize(confirm(pairs, texts, k, least), "links")
        if roots is None:
            roots = connected_components(fresh)
        elif not fresh.isEmpty():
            roots = connected_components(roots.toDF("a", "b").unionByName(fresh))
    linked = materialize(rooted(classes.select("set", "node"), roots).select("set", "root"), "roots")
    return _least_members(materialize(sets(own, k, least, "members"), "members"), linked, key)


def _least_members(members: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """The rows (id, n, set) with the least id of their component; roots: (set, root) of the classes that may be linked. Classes with more than one in HOT of all rows, fewer than HOT in number, are broadcast, all others joined."""
    by_set = members.where("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    linked = materialize(by_set.join(roots, "set").select("set", "root", "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(least, "root").select("set", "component_id")
    told = by_set.join(of_linked, "set", "left").select("set", "rows", F.coalesce("component_id", "least").alias("component_id"))
    told = materialize(told, "told")
    hot = F.broadcast(told.where(F.col("rows") * HOT > members.count()).drop("rows"))
    full, empty = members.where("n > 0"), members.where("n = 0").withColumn("component_id", F.col("id"))
    rest = full.join(hot, "set", "left_anti").join(told.drop("rows"), "set")
    out = full.join(hot, "set").unionByName(rest).unionByName(empty)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
