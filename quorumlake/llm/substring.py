"""Removal of repeated passages with a log-structured index of fingerprints.

A word goes if a window of ``WINDOW`` words covers it whose word sequence starts earlier as well: in a document of a
smaller doc_id, or earlier in the same one. Documents arrive in batches, in order of doc_id. The index is a row of
sorted, immutable runs in the shared folder, of two kinds:

* anchors: the winnowed K-word hashes of a batch, each with its number and its first place. Every window contains the
  anchor that is the least hash in it, wherever the window occurs, so a window can only be repeated if its anchor is;
* windows: 128-bit fingerprints, of two hashes that are made apart, of the windows below repeated anchors, with their first places.

A batch's anchors are merge-joined with the runs. Anchors that occur once in all name, document by document, what need
not be looked at; the windows below the others are fingerprinted, as are those of earlier documents whose anchor has
now been met again, and joined with the runs of windows. Each fingerprint keeps its first place only, so a passage that
a third of all documents share is summed where it lies and never gathered. Runs are compacted when there are many.

Exact copies of earlier documents are settled by a hash of their words alone.

Defined results: a null text counts as empty; documents under the window's length keep all words; a null doc_id comes
before all others; rows with one doc_id and one text are one document and all get its result; different texts under one
doc_id are different documents, in the order of their hashes; an empty table gives no rows; only the key and the text
are read, so further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize
from quorumlake.llm.minhash import GOLD, WORD_CACHE, WordHashes, mix
from quorumlake.llm.urlfilter import BITS_PER_KEY, MAX_LEVEL_BYTES, build_level

WINDOW, K = 20, 8
NULL_ID = -(1 << 63)
PLACE = ("doc_id", "own")
SECOND, BASE = np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _joined(a: np.ndarray, b: np.ndarray, skip: int) -> np.ndarray:
    """Hashes of longer windows from those of two parts, the second of which starts skip words on."""
    n = max(0, len(b) - skip)
    return mix((mix(a[:n] * GOLD) + b[skip:]) * GOLD)


def grams(words: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all K-word and all 4-word windows."""
    if len(cache) > WORD_CACHE:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    two = _joined(h, h, 1)
    four = _joined(two, two, 2)
    return _joined(four, four, 4), four


def long_grams(eight: np.ndarray, four: np.ndarray) -> np.ndarray:
    """64-bit hashes of all WINDOW-word windows."""
    return _joined(_joined(eight, eight, 8), four, 16)


def checks(words: list[bytes], cache: WordHashes) -> np.ndarray:
    """A second 64-bit hash of all WINDOW-word windows that shares no step with the first: a polynomial in an odd base over the words' hashes, mixed anew."""
    h = mix(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)) ^ SECOND)
    out = np.zeros(max(0, len(h) - WINDOW + 1), np.uint64)
    for i in range(WINDOW):
        out = out * BASE + h[i : i + len(out)]
    return mix(out)


#: Low bits that tell a place when the least hash is looked for; the bits above tell the hash.
PLACE_BITS = 28


def anchors(short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the anchors, in order, and for each window the number of its anchor: the least of its K-word hashes by their upper bits, and then the first."""
    width = WINDOW - K + 1
    if len(short) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, span = (short & ~low) | np.arange(len(short), dtype=np.uint64), 1
    while 2 * span <= width:  # the least of twice as many places each time
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: len(short) - width + 1], least[width - span :])
    at = (least & low).astype(np.int64)  # never falls
    fresh = np.concatenate([[True], at[1:] != at[:-1]])
    return at[fresh], np.cumsum(fresh) - 1


def draw(docs: DataFrame) -> DataFrame:
    """doc_id (NULL_ID for null), own (64 bits of the hash of the words: of a million different texts with one doc_id two meet with a probability of 3e-8), n_words, a 128-bit hash of the words in two longs, all_sha256 (of all words) and the anchors' hashes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows = []
            for value in b.column(1).cast(pa.binary()):
                words = words_of(value.as_py())
                joined = b" ".join(words)
                both = xxhash.xxh3_128_digest(joined)
                short, _ = grams(words, cache)
                hi = int.from_bytes(both[:8], "big", signed=True)
                rows.append((hi, len(words), hi, int.from_bytes(both[8:], "big", signed=True), hashlib.sha256(joined).hexdigest(), short[anchors(short)[0]].view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "own", "n_words", "seq_hi", "seq_lo", "all_sha256", "anchors"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    return keyed.mapInArrow(of, "doc_id long, own long, n_words long, seq_hi long, seq_lo long, all_sha256 string, anchors array<long>")


def _per_document(rows: DataFrame, fields: str, fn: Callable) -> DataFrame:
    """fn(words, cache, row) -> an iterable of tuples of the fields; rows must have a text."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            lists = [(c, b.column(c)) for c in ("chosen", "firsts") if c in b.schema.names]
            for i in range(b.num_rows):
                row = {"doc_id": b.column("doc_id")[i].as_py(), "own": b.column("own")[i].as_py()}
                row |= {c: np.zeros(0, np.int64) if (v := held[i].values) is None else v.to_numpy(zero_copy_only=False).astype(np.int64) for c, held in lists}
                cols = fn(words_of(texts[i].as_py()), cache, row)
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return rows.mapInArrow(of, fields)


def marked(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows: doc_id, own, text, and chosen, the numbers of anchors. The windows below these: hash, check, doc_id, own, pos."""

    def fn(words: list[bytes], cache: WordHashes, row: dict) -> list:
        short, four = grams(words, cache)
        places, anchor = anchors(short)
        long = long_grams(short, four)
        pos = np.flatnonzero(marked(row["chosen"], len(places))[anchor])
        return [long[pos].view(np.int64), checks(words, cache)[pos].view(np.int64), np.full(len(pos), row["doc_id"]), np.full(len(pos), row["own"]), pos.astype(np.int32)]

    return _per_document(rows, "hash long, check long, doc_id long, own long, pos int", fn)


def removals(rows: DataFrame) -> DataFrame:
    """rows: doc_id, own, text, chosen, and firsts, the places of windows that occur nowhere earlier. doc_id, own, n_removed and kept_sha256; kept_text is made by the same rule in ``kept_text``."""

    def fn(words: list[bytes], cache: WordHashes, row: dict) -> list:
        kept = _kept(words, cache, row)
        return [[row["doc_id"]], [row["own"]], [len(words) - len(kept)], [hashlib.sha256(b" ".join(kept)).hexdigest()]]

    return _per_document(rows, "doc_id long, own long, n_removed long, kept_sha256 string", fn)


def kept_text(rows: DataFrame) -> DataFrame:
    """As ``removals``, with the words that stay, joined by single spaces, in kept_text."""

    def fn(words: list[bytes], cache: WordHashes, row: dict) -> list:
        return [[row["doc_id"]], [row["own"]], [b" ".join(_kept(words, cache, row)).decode("utf-8", "surrogatepass")]]

    return _per_document(rows, "doc_id long, own long, kept_text string", fn)


def _kept(words: list[bytes], cache: WordHashes, row: dict) -> list[bytes]:
    short, _ = grams(words, cache)
    places, anchor = anchors(short)
    repeated = marked(row["chosen"], len(places))[anchor]
    repeated[row["firsts"]] = False
    change = np.zeros(len(words) + 1, np.int64)
    pos = np.flatnonzero(repeated)
    np.add.at(change, pos, 1)
    np.add.at(change, pos + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]


class Index:
    """The runs of anchors and of windows. ``add`` takes the next batch and returns its documents' removals."""

    def __init__(self, documents: DataFrame, max_runs: int = 4) -> None:
        """documents: where the texts of all batches, past ones too, can be read: doc_id, own, text."""
        self.documents, self.max_runs = documents, max_runs
        self.anchor_runs: list[DataFrame] = []
        self.window_runs: list[DataFrame] = []

    @staticmethod
    def _merged(runs: list[DataFrame], by: tuple[str, ...], name: str) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        sums = [F.sum("n").alias("n")] if "n" in out.columns else []
        return materialize(out.groupBy(*by).agg(*sums, F.min("place").alias("place")).sortWithinPartitions(*by), name)

    def compact(self) -> None:
        """Merges the runs of each kind into one."""
        if len(self.anchor_runs) > 1:
            self.anchor_runs = [self._merged(self.anchor_runs, ("hash",), "anchor-run")]
        if len(self.window_runs) > 1:
            self.window_runs = [self._merged(self.window_runs, ("hash", "check"), "window-run")]

    def _texts(self, chosen: DataFrame) -> DataFrame:
        """The texts of chosen documents. While their number allows it, a Bloom filter keeps the others out of the shuffle; the join settles the rest."""
        texts, count = self.documents, chosen.count()
        if 0 < count * BITS_PER_KEY <= 8 * MAX_LEVEL_BYTES:
            key = lambda: F.concat_ws(":", *PLACE)
            texts = texts.where(build_level(chosen.select(key().alias("key")), count, 1).passes(key()))
        return texts.dropDuplicates(PLACE).join(chosen, list(PLACE))

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: doc_id, own, anchors, of documents that no earlier one copies. Returns what ``removals`` and ``kept_text`` take: the documents that have a repeated anchor, and only these."""
        rows = batch.select(*PLACE, F.posexplode("anchors").alias("at", "hash"))
        place = F.struct(*PLACE, "at")
        run = materialize(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("place")).sortWithinPartitions("hash"), "anchor-run")
        if self.anchor_runs:
            past = [r.select("hash", F.col("n").alias("past_n"), F.col("place").alias("past_place")) for r in self.anchor_runs]
            met = run
            for i, p in enumerate(past):
                met = met.hint("merge").join(p.toDF("hash", f"n{i}", f"place{i}"), "hash", "left")
            seen = sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(len(past))), F.lit(0))
            met = materialize(met.select("n", "place", seen.alias("past_n"), F.coalesce(*[f"place{i}" for i in range(len(past))]).alias("past_place")).where("n = 1 or past_n = 1"), "met")
            single = met.where("n = 1 and past_n = 0")
            again = met.where("past_n = 1").select("past_place.*").groupBy(*PLACE).agg(F.collect_list("at").alias("chosen"))
        else:
            single, again = run.where("n = 1"), None
        once = single.select("place.*").groupBy(*PLACE).agg(F.collect_list("at").alias("once"))
        others = F.array_except(F.sequence(F.lit(0), F.size("anchors") - 1), F.coalesce("once", F.array().cast("array<int>")))
        chosen = batch.where(F.size("anchors") > 0).join(once, list(PLACE), "left").select(*PLACE, others.alias("chosen")).where(F.size("chosen") > 0)
        held = materialize(self._texts(materialize(chosen, "chosen")), "repeated-texts")
        fresh = fingerprints(held)
        if again is not None:
            fresh = fresh.unionByName(fingerprints(self._texts(materialize(again, "again"))))
        by = ("hash", "check")
        windows = materialize(fresh.groupBy(*by).agg(F.min(F.struct(*PLACE, "pos")).alias("place")).sortWithinPartitions(*by), "window-run")
        first = windows
        for p in self.window_runs:
            first = first.hint("merge").join(p.select(*by), list(by), "left_anti")
        firsts = first.select("place.*").groupBy(*PLACE).agg(F.collect_list("pos").alias("firsts"))
        self.anchor_runs.append(run)
        self.window_runs.append(windows)
        if len(self.anchor_runs) > self.max_runs:
            self.compact()
        return held.join(firsts, list(PLACE), "left")


def deduplicate(docs: DataFrame, batches: int = 2, max_runs: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by single spaces), one row for each row of docs."""
    drawn = materialize(draw(docs), "drawn")
    seq = ["seq_hi", "seq_lo"]
    leads = drawn.groupBy(*seq).agg(F.min("doc_id").alias("lead"))
    first = materialize(drawn.where(f"n_words >= {WINDOW}").join(leads, seq).where("doc_id = lead").select(*PLACE, "anchors").dropDuplicates(PLACE), "batch")
    index = Index(keyed_texts(docs), max_runs)
    cuts = sorted(set(first.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    results = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = first.where((F.col("doc_id") > low if low is not None else F.lit(True)) & (F.col("doc_id") <= high if high is not None else F.lit(True)))
        out = materialize(removals(index.add(batch)), "removals")
        results = out if results is None else results.unionByName(out)
    named = drawn.select(*PLACE, "n_words", *seq, "all_sha256").join(leads, seq).join(results, list(PLACE), "left")
    copy = (F.col("doc_id") != F.col("lead")) & (F.col("n_words") >= WINDOW)
    return named.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, own and text, as ``draw`` names them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words_of(v.as_py())))[:8], "big", signed=True) for v in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64()), b.column(1)], ["doc_id", "own", "text"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(of, "doc_id long, own long, text string")
