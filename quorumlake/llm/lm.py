"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token after its predecessor is a mixture of three estimates: the bigram's and the word's relative
frequencies in the training documents, and an equal share for each word and one unknown. The weights depend on the
context's frequency, by powers of two, and are learned by expectation-maximisation on held-out tokens: those of a tenth
of the blocks, each taken with its own occurrence deleted from the counts.

Documents are dealt by hash to blocks of bounded size. A block asks for the counts of its distinct n-grams, in sorted
arrays; these are dealt by key to buckets, where the counts of all blocks are summed, and each block gets its sums back.
So a frequent n-gram meets in one place once for each block and never once for each occurrence, no model is broadcast,
and what is shuffled grows with the input.

Defined results: a null text counts as empty, and an empty text is its end token alone; a row with a null train flag
trains; rows with one key and one text are scored alike, each on its own; an empty table gives no rows; without a
training row the counts are 0, all words are unknown and each has probability 1; only the named columns are read, so
further columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize
from quorumlake.llm.minhash import GOLD, WORD_CACHE, WordHashes, mix

#: Bytes of text in a block, on average.
BLOCK_BYTES = 12 << 20
#: A block of every so many gives the held-out tokens.
HELD_OUT_BLOCKS = 10
START, END = np.uint64(0x51A7), np.uint64(0xE9D3)
STEPS, LEAST = 4, -160  # cells of a probability's binary logarithm; LEAST: none
FREQUENCIES = 40


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, plane by plane, after a byte with that width."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def tokens_of(text: bytes | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and of the end."""
    if len(cache) > WORD_CACHE:
        cache.clear()
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def ngrams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words (even), of all bigrams (odd), and the length of each document, in tokens."""
    cache = WordHashes()
    docs = [tokens_of(t.as_py(), cache) for t in texts.cast(pa.binary())]
    lengths = np.array([len(d) for d in docs], np.int64)
    own = np.concatenate(docs)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(lengths) - lengths] = START
    even, odd = ~np.uint64(1), np.uint64(1)
    return mix(own) & even, mix((mix(before * GOLD) + own) * GOLD) | odd, lengths


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys: equal ranges of the keys."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the distinct keys, as differences, and their counts in training documents."""

    def of(table: pa.Table) -> pa.Table:
        words, pairs, lengths = ngrams(table["text"])
        train = np.repeat(np.array(table["train"].to_pylist(), bool), lengths)
        keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([train, train]), len(keys)).astype(np.uint64)
        bounds = bucket_bounds(keys, buckets)
        some = np.flatnonzero(np.diff(bounds))
        parts = [slice(bounds[i], bounds[i + 1]) for i in some]
        block = table["block"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(some), pa.int64()),
                "bucket": pa.array(some, pa.int64()),
                "keys": pa.array([pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
                "counts": pa.array([pack(counts[p]) for p in parts], pa.binary()),
            }
        )

    return blocks.groupBy("block").applyInArrow(of, "block long, bucket long, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """For each block and bucket the sums of the counts over all blocks, in the order of its keys. A bucket also tells, in a row without a block, how many words of it train and how often."""

    def of(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in table["keys"]]
        counts = np.concatenate([unpack(c.as_py()) for c in table["counts"]])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, counts, len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        words = sums[(distinct & np.uint64(1)) == 0]
        n = len(keys)
        return pa.table(
            {
                "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
                "bucket": pa.array([table["bucket"][0].as_py()] * (n + 1), pa.int64()),
                "sums": pa.array([*[pack(sums[at[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)], None], pa.binary()),
                "n_words": pa.array([*[None] * n, int((words > 0).sum())], pa.int64()),
                "n_tokens": pa.array([*[None] * n, int(words.sum())], pa.int64()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(of, "block long, bucket long, sums binary, n_words long, n_tokens long")


def token_counts(docs: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of a block the counts of the bigram, of its context and of the word, and the documents' lengths."""
    words, pairs, lengths = ngrams(docs["text"])
    _, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
    order = np.argsort(np.array(told["bucket"].to_pylist(), np.int64))
    sums = np.concatenate([unpack(told["sums"][int(i)].as_py()) for i in order]).astype(np.int64)
    word, pair = sums[at[: len(words)]], sums[at[len(words) :]]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(lengths) - lengths] = word[lengths[0] - 1]  # a start is as frequent as an end
    return pair, context, word, lengths


def frequency(context: np.ndarray) -> np.ndarray:
    """0 for a context that doesn't occur, and then by powers of two."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, FREQUENCIES - 1), 0)


def cells(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.maximum(np.rint(np.log2(np.maximum(p, 1e-300)) * STEPS), LEAST + 1), LEAST).astype(np.int64)


def held_out(blocks: DataFrame, told: DataFrame, total: int) -> DataFrame:
    """Held-out tokens by the context's frequency and the cells of both estimates, their own occurrence deleted: freq, two, one, n. At most FREQUENCIES * LEAST ** 2 rows."""

    def of(docs: pa.Table, own: pa.Table) -> pa.Table:
        empty = {"freq": [], "two": [], "one": [], "n": []}
        if docs.num_rows and own.num_rows:
            pair, context, word, lengths = token_counts(docs, own)
            train = np.repeat(np.array(docs["train"].to_pylist(), bool), lengths)
            pair, context, word = (x[train] - 1 for x in (pair, context, word))
            both = np.stack([frequency(context), cells(pair / np.maximum(context, 1)), cells(word / max(total - 1, 1))])
            found, n = np.unique(both, axis=1, return_counts=True)
            empty = dict(zip(empty, [*found, n], strict=True))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in empty.items()})

    made = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(of, "freq long, two long, one long, n long")
    return made.groupBy("freq", "two", "one").agg(F.sum("n").alias("n"))


def learn(rows: list[tuple[int, int, int, int]], share: float, rounds: int = 60) -> np.ndarray:
    """The weights of bigram, word and equal share, for each frequency, by expectation-maximisation. Frequencies without held-out tokens get the weights of all together."""
    data = np.array(rows, np.int64).reshape(-1, 4)
    p = np.stack([np.where(data[:, 1] > LEAST, 2.0 ** (data[:, 1] / STEPS), 0), np.where(data[:, 2] > LEAST, 2.0 ** (data[:, 2] / STEPS), 0), np.full(len(data), share)], 1)

    def fitted(of: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds if len(of) else 0):
            parts = p[of] * w
            w = (parts / parts.sum(1, keepdims=True) * data[of, 3:]).sum(0) / data[of, 3].sum()
        return w

    whole = fitted(np.arange(len(data)))
    out = np.stack([fitted(own) if len(own := np.flatnonzero(data[:, 0] == f)) else whole for f in range(FREQUENCIES)])
    out[:, 2] = np.maximum(out[:, 2], 1e-6)  # unknown words stay possible
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score (add-a-tenth unigrams) and score (deleted interpolation), as log10."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(8).cast("long"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    blocks = keyed.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(n_blocks)))
    told = materialize(answers(requests(blocks, 2 * n_blocks)), "ngram-sums")
    n_words, total = (x or 0 for x in told.where("block is null").agg(F.sum("n_words"), F.sum("n_tokens")).first())
    told = told.where("block is not null").select("block", "bucket", "sums")
    chosen = F.col("block") % HELD_OUT_BLOCKS == 0
    rows = [tuple(r) for r in held_out(blocks.where(chosen), told.where(chosen), total).orderBy("freq", "two", "one").collect()]
    share = 1 / (n_words + 1)
    weights = learn(rows, share)

    def of(own: pa.Table, sums: pa.Table) -> pa.Table:
        cols: dict = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        if own.num_rows and sums.num_rows:
            pair, context, word, lengths = token_counts(own, sums)
            w = weights[frequency(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] * share
            begin = np.cumsum(lengths) - lengths
            base = np.log10((word + 0.1) / (total + 0.1 * (n_words + 1)))
            cols = {"n_tokens": lengths, "n_known": np.add.reduceat((word > 0).astype(np.int64), begin), "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(np.log10(p) if total else np.zeros(len(p)), begin)}
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({"key": own["key"], "train": own["train"], **{k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds, strict=True)}})

    kind = dict(docs.dtypes)[key]
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(of, f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
