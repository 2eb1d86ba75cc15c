"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

A cascade answers exactly, for every key of a known universe, whether the key is listed: its first level encodes the
listed keys, the second the keys of the universe that pass the first though they aren't listed, the third the listed
keys that pass the second, and so on until nothing passes wrongly. The universe is every key that occurs in the corpus,
so no url is judged wrongly and the urls need no join: a level is a binary literal in the expression.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and the method's verdict for an
unlisted host (allow); repeated rows are judged alike, each on its own; an empty table gives no rows; further columns
are carried through, and those of the operator's own names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import materialize

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Hosts, each with its subdomains, that are blocked where no rule fits.
BLOCKED_HOSTS = tuple(f"{label}.example.{top}" for label in ("adult-x", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org"))

BITS_PER_KEY, HASHES = 10, 4
#: A level above this size isn't put into an expression.
MAX_LEVEL_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, listed: list[tuple[str, str]]) -> Column:
    """The keys of a url that could be listed: its host's endings of as many labels as listed hosts have, with its path's beginnings of the listed lengths."""
    labels = sorted({h.count(".") + 1 for h, _ in listed})
    lengths = sorted({len(p) for _, p in listed})
    parts = F.split(host, r"\.")
    found = [
        F.when((F.size(parts) >= n) & (F.length(path) >= m) & (host != ""), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n in labels
        for m in lengths
    ]
    return F.array_compact(F.array(*found))


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    seed: int

    def passes(self, key: Column) -> Column:
        tests = [_bit(self.bits, _place(key, self.size, self.seed, i)) for i in range(HASHES)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _place(key: Column, size: int, seed: int, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * HASHES + i), key), F.lit(size).cast("long"))


def _bit(bits: bytes, place: Column) -> Column:
    """Words of 64 bits are written with their highest byte first."""
    byte = (place / 64).cast("int") * 8 + 8 - ((place % 64) / 8).cast("int")
    return F.getbit(F.conv(F.hex(F.substring(F.lit(bits), byte, F.lit(1))), 16, 10).cast("int"), (place % 8).cast("int")) == 1


#: 64-bit words in a row that the driver gets.
BLOCK_WORDS = 512


def build_level(keys: DataFrame, count: int, seed: int) -> Level:
    """keys: a frame with the column key. The bits are gathered by words of 64, and these in blocks of BLOCK_WORDS, where they lie; the driver gets the blocks as bytes, MAX_LEVEL_BYTES at most, and joins them."""
    words = max(1, -(-count * BITS_PER_KEY // 64))
    if words * 8 > MAX_LEVEL_BYTES:
        raise ValueError("the level is too large for an expression; use listed_by_join")
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), 64 * words, seed, i) for i in range(HASHES)])).alias("place"))
    own = places.select((F.col("place") / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int")).alias("bits"))
    full = own.unionByName(keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: F.lpad(F.hex(x["bits"]), 16, "0")), "")
    blocks = full.groupBy((F.col("word") / BLOCK_WORDS).cast("long").alias("block")).agg(F.unhex(spelled).alias("bits")).orderBy("block")
    return Level(b"".join(bytes(r["bits"]) for r in blocks.toLocalIterator()), 64 * words, seed)


def build_cascade(universe: DataFrame, listed: str, seed: int = 1) -> list[Level]:
    """universe: one row a key, with a boolean column by the name in listed."""
    levels: list[Level] = []
    inside, outside = universe.where(F.col(listed)).select("key"), universe.where(~F.col(listed)).select("key")
    count = inside.count()
    while count:
        levels.append(level := build_level(inside, count, seed + len(levels)))
        inside, outside = outside.where(level.passes(F.col("key"))), inside
        count = inside.count()
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for every key of the universe: a key is listed if the first level that it fails is an even one."""
    out = F.lit(bool(len(levels) % 2))
    for n in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[n].passes(key), F.lit(bool(n % 2))).otherwise(out)
    return out


def listed_by_join(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The other way, for lists beyond the bound of a level: the column listed by a join on key."""
    return keys.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def small(universe: DataFrame, names: list[str]) -> bool:
    """Whether the levels of all lists have a size for an expression: none is larger than the first two, which encode the listed keys and at most all others."""
    counts = universe.agg(*[F.count_if(F.col(n)).alias(n) for n in names], F.count("*").alias("n_all")).first()
    return max((counts[n] for n in names), default=0) * BITS_PER_KEY <= 8 * MAX_LEVEL_BYTES and counts["n_all"] * BITS_PER_KEY <= 8 * MAX_LEVEL_BYTES * 10


def listings(pages: DataFrame, rules: tuple, blocked_hosts: tuple[str, ...]) -> DataFrame:
    """key, allowed, blocked and bad_host of the listed keys: a frame, so that lists may be of any length where they come as frames."""
    rows = [(h + p, v == "allow", v == "block", False) for v, h, p in rules] + [(h, False, False, True) for h in blocked_hosts]
    listed = pages.sparkSession.createDataFrame(rows, "key string, allowed boolean, blocked boolean, bad_host boolean")
    return listed.groupBy("key").agg(*[F.bool_or(c).alias(c) for c in LISTS])


LISTS = ("allowed", "blocked", "bad_host")


def judge(pages: DataFrame, rules: tuple = RULES, blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS, cascade: bool | None = None) -> DataFrame:
    """The pages with host, path, rule and verdict.

    The universe, the distinct keys of the pages, learns once which of its keys are listed; the pages are then judged by
    the cascades alone. Where the levels would be too large for an expression, or with cascade=False, the distinct
    hosts and paths are judged by a join on their keys.
    """
    by_rule = [(h, p) for _, h, p in rules]
    split = pages.select(host_of(F.col("url")).alias("own_host"), path_of(F.col("url")).alias("own_path"), F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("own_row")).withColumns(
        {"rule_keys": keys_of(F.col("own_host"), F.col("own_path"), by_rule), "host_keys": keys_of(F.col("own_host"), F.col("own_path"), [(h, "") for h in blocked_hosts])}
    )
    keys = split.select(F.explode(F.array_union("rule_keys", "host_keys")).alias("key")).distinct()
    told = keys.join(listings(pages, rules, blocked_hosts), "key", "left").select("key", *[F.coalesce(c, F.lit(False)).alias(c) for c in LISTS])
    universe = materialize(told, "url-keys")
    longest = lambda found: F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    if small(universe, list(LISTS)) if cascade is None else cascade:
        cascades = {name: build_cascade(universe, name, 1 + 64 * i) for i, name in enumerate(LISTS)}
        allow, block = (longest(F.filter("rule_keys", partial(is_listed, cascades[n]))) for n in LISTS[:2])
        judged = split.withColumns({"allow_rule": allow, "block_rule": block, "bad": F.exists("host_keys", lambda k: is_listed(cascades["bad_host"], k))})
    else:
        by = ["own_host", "own_path"]
        places = split.select(*by, "rule_keys", "host_keys").distinct()
        each = places.select(*by, F.explode(F.array_union("rule_keys", "host_keys")).alias("key"), F.array_contains("rule_keys", F.col("key")).alias("of_rule"), F.array_contains("host_keys", F.col("key")).alias("of_host")).join(universe.where("allowed or blocked or bad_host"), "key")
        best = lambda c: F.max(F.when(F.col("of_rule") & F.col(c), F.struct(F.length("key").alias("n"), F.col("key").alias("key"))))["key"]
        met = each.groupBy(*by).agg(best("allowed").alias("allow_rule"), best("blocked").alias("block_rule"), F.bool_or(F.col("of_host") & F.col("bad_host")).alias("bad"))
        judged = split.join(met, by, "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    by_allow = F.coalesce(F.length("allow_rule"), F.lit(-1)) >= F.coalesce(F.length("block_rule"), F.lit(-1))
    rule = F.when(by_allow, F.col("allow_rule")).otherwise(F.col("block_rule"))
    verdict = F.when(F.col("allow_rule").isNotNull() | F.col("block_rule").isNotNull(), F.when(by_allow, "allow").otherwise("block")).otherwise(F.when(F.col("bad"), "block").otherwise("allow"))
    made = {"host": F.col("own_host"), "path": F.col("own_path"), "rule": rule, "verdict": verdict}
    return judged.select(*[F.col("own_row")[c].alias(c) for c in pages.columns if c not in made], *[v.alias(k) for k, v in made.items()])
