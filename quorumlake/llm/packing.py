"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. A full piece is a sequence of its own. The others are dealt by
hash to groups of bounded size; each group is packed by best-fit decreasing, and a lower bound from dual feasible
functions tells whether its count of sequences is the least possible. Groups without that certificate keep their full
sequences and put the documents of the others into a pool, which is dealt anew and packed again, so that documents
change groups; the last round keeps what it gets.

Defined results: a null text counts as empty, and an empty document is its end token alone; a null doc_id is a document
like others; repeated rows are packed each on its own; an empty table gives no rows; only the key and the text are
read, so further columns don't matter. Texts are tokenised whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize

CAPACITY, END_ID, GROUP_ROWS, ROUNDS = 1024, 2, 8192, 3
CACHE = 500_000

# Letters and numbers among the characters of PLAIN texts, as in the tokenizer's own pattern.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Texts of these characters are split here; any other text goes to the tokenizer whole.
PLAIN = re.compile(r"[\n\r\t\x20-\x7e¡-¬®-ɏ–—‘’“”…]*+")
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{LETTER}]+|[{NUMBER}]+|[^\s{LETTER}{NUMBER}]+)|\s+(?!\S)|\s+")


def added_tokens(path: Path) -> dict[str, bytes]:
    """The added tokens of a vocabulary file for the tokenizers library, with their ids; none with options that change how they are found."""
    added = json.loads(path.read_bytes())["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"added tokens with options in {path}")
    return {t["content"]: array("I", [t["id"]]).tobytes() for t in added}


class Encoder(dict):
    """Token ids as little-endian 32-bit bytes, from the ranks of a byte-level BPE.

    Ids never reach across the parts of the pre-tokenizer's pattern, so those of a part are looked up once. The ranks
    give the same ids as the vocabulary file of the same name for the tokenizers library, at several times its speed;
    the tests hold them against each other. As there, a text is split at that file's added tokens first.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = added_tokens(Path(ranks_path).with_suffix(".json"))
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = array("I", self.encode(part)).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += self.ordinary(text[at : m.start()]), self.added[m.group()]
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])]) if at else self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            return array("I", self.encode(text)).tobytes()
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, SPLIT.findall(text)))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = total % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, total, capacity)]]


def pieces(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, and with keep_ids the ids as little-endian bytes."""
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for b in batches:
            keys, rows = [], []
            for i, value in enumerate(b.column(1)):
                ids = encode.ids(value.as_py() or "") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    keys.append(i)
                    rows.append((n, start, length, zlib.crc32(own), own if keep_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [b.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [key, "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(key, text).mapInArrow(of, f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item, by best-fit decreasing. Open bins lie in stacks by free space; a bit mask finds the tightest."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            own = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            own, free, count = count, capacity, count + 1
        bins[i], offsets[i] = own, capacity - free
        if left := free - size:
            stacks[left].append(own)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound from three families of dual feasible functions, over their parameters: rounding down to multiples, dropping small items while large ones count whole, and the sum itself."""
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True)
    best = -(-int(size @ n) // capacity)
    for k in range(2, 21):  # whole multiples keep their share, others are rounded down
        exact = (k + 1) * size % capacity == 0
        best = max(best, -(-int(np.where(exact, size * k, (k + 1) * size // capacity * capacity) @ n) // (capacity * k)))
    for e in np.unique(np.minimum(size, capacity - size)):
        if 0 < e <= capacity // 2:
            best = max(best, -(-int(np.where(size > capacity - e, capacity, np.where(size < e, 0, size)) @ n) // capacity))
    return best


def _pack_group(names: list[str], capacity: int, r: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "own_draw"], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths)
        base = (r + 1 << 58) + (int(pdf["own_group"].iloc[0]) << 28)
        return pdf[names].assign(sequence_id=base + bins, offset=offsets, certified=len(fill) <= lower_bound(lengths, capacity), own_full=fill[bins] >= capacity)

    return one


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """items: any columns beside length, piece and doc_id; returns them with sequence_id, offset and certified.

    The items are written once, with a number each, and dealt to groups by hashes of these numbers, group_rows on
    average: however many rows are equal, they don't meet in one group.
    """
    items = items.drop("sequence_id", "offset", "certified", "own_group", "own_full", "own_draw")
    names = items.columns
    items = materialize(items.withColumn("own_draw", F.monotonically_increasing_id()), "pieces")
    schema = ", ".join([*[f"`{c}` {t}" for c, t in items.dtypes], "sequence_id long, offset long, certified boolean, own_full boolean"])
    whole = items.where(F.col("length") >= capacity)
    done = [whole.withColumns({"sequence_id": F.col("own_draw"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})]
    pool = items.where(F.col("length") < capacity)
    for r in range(rounds):
        count = pool.count()
        if not count:
            break
        groups = max(1, -(-count // group_rows))

        dealt = pool.withColumn("own_group", F.pmod(F.xxhash64(F.lit(r), "own_draw"), F.lit(groups)))
        packed = materialize(dealt.groupBy("own_group").applyInPandas(_pack_group(items.columns, capacity, r), schema), f"packed-{r}")
        keep = F.col("certified") | F.col("own_full") | F.lit(r == rounds - 1)
        done.append(packed.where(keep).drop("own_full"))
        pool = packed.where(~keep).select(*items.columns)
        if r == rounds - 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*names, "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places. The pieces are written once, so that no text is tokenised again."""
    return pack(pieces(docs, path, pattern, capacity=capacity, keep_ids=keep_ids), capacity)
