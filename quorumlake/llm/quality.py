"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with the histograms of its language
by Jensen-Shannon distance (base 2, 0 to 1). The references are sums over all documents of a language that pass the
base rules, so they are exact and follow the corpus. About seven of eight words are not common ones; so that their one
bin doesn't swamp the others, it is scaled, in the document and the reference alike, to leave the common words
``COMMON_SHARE`` of the reference. A text without any common word then lies at 0.78 from each language.

Defined results: a null text counts as empty and fails the base rules; a null language is held against the sum of all
languages; a document of fewer than ``min_words`` words is judged by the base rules alone; repeated rows are judged
alike, each on its own; an empty table gives no rows; further columns are carried through untouched, and those of the
operator's own names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import broadcast_if_small, materialize, words

# Frequent function words of four languages.
COMMON_WORDS = ("the of and to in " "de la le et les " "der die und in den " "de la que el y").split()
VOCABULARY = sorted(set(COMMON_WORDS))

# Character classes beside a-z, as Java character sets.
CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "stop": ".,;:!?'\"()\\-",
    "symbol": "#*$%&|<>",
    "letter": "\\p{L}&&[^a-zA-Z]",
}

MIN_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 50, 0.28, 0.62
# Fixed value: the share of the common words in a reference as it is compared.
COMMON_SHARE = 0.8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def unusual(text: Column) -> Column:
    """The text without a-z and white space: short for most texts, so that the other classes are cheap to count."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def class_histogram(word_chars: Column, rest: Column) -> Column:
    """Counts of a-z, of the other classes, and of all else in words. rest: unusual(text)."""
    filled = F.array(F.array(word_chars.cast("int"), F.length(rest), *[_count(rest, c) for c in CLASSES.values()]))
    n = len(CLASSES)
    # one name for the array, so that each count is computed once
    return F.transform(filled, lambda a: F.array(a[0] - a[1], *[a[i + 2] for i in range(n)], a[1] - sum((a[i + 2] for i in range(n)), F.lit(0))))[0]


def word_histogram(word_list: Column) -> Column:
    """Counts of the common words, by VOCABULARY, in lower case or with a capital first, and of all others."""
    forms = VOCABULARY + [v.capitalize() for v in VOCABULARY]
    bare = F.filter(word_list, lambda w: w.isin(forms))
    spaced = F.array(F.lower(F.concat(F.lit(" "), F.array_join(bare, "  "), F.lit(" "))))
    held = F.transform(spaced, lambda s: F.array(*[((F.length(s) - F.length(F.replace(s, F.lit(f" {v} "), F.lit("")))) / (len(v) + 2)).cast("int") for v in VOCABULARY]))[0]
    return F.transform(F.array(F.struct(held.alias("h"), F.size(word_list).alias("n"))), lambda x: F.concat(x["h"], F.array(x["n"] - F.aggregate(x["h"], F.lit(0), lambda a, b: a + b))))[0]


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long")


def n_repeat_words(word_list: Column, k: int = 5) -> Column:
    """Words in k-word windows found twice or more. Windows are told apart by 64-bit hashes. Most texts
    have no equal ones, which a set tells; for the others the hashes are sorted with their places, so that equal ones
    are neighbours."""

    def windows(w: Column) -> Column:
        return F.arrays_zip(*[F.slice(w, i + 1, F.size(w) - (k - 1)).alias(f"w{i}") for i in range(k)])

    def covered(hashes: Column) -> Column:
        # fixed-width keys of hash and place sort as plain strings, much faster than structs
        keys = F.sort_array(F.transform(hashes, lambda x, i: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(i.cast("string"), 10, "0"))))
        places = F.transform(F.array(keys), lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(F.substring(a, 1, 16) == F.substring(b, 1, 16), F.array(F.substring(a, 17, 10).cast("int"), F.substring(b, 17, 10).cast("int"))).otherwise(F.array().cast("array<int>"))))[0]
        steps = F.transform(F.array(F.array_sort(F.array_distinct(F.flatten(places)))), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(k), F.coalesce(b - a, F.lit(k)))))[0]
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    def joined(h: Column, g: Column, skip: int) -> Column:
        """Hashes of longer windows: each of h with the one of g that is skip places on."""
        n = F.size(g) - skip
        return F.zip_with(F.slice(h, 1, n), F.slice(g, skip + 1, n), lambda a, b: F.xxhash64(a, b))

    def of(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        hashes = F.transform(F.array(one), lambda h: F.transform(F.array(joined(h, h, 1)), lambda p: joined(joined(p, p, 2), h, 4))[0])[0] if k == 5 else F.transform(windows(w), lambda x: F.xxhash64(*[x[f"w{j}"] for j in range(k)]))
        return F.transform(F.array(hashes), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)))[0]

    return F.when(F.size(word_list) <= k, F.lit(0)).otherwise(F.transform(F.array(word_list), of)[0]).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """The documents with the counts of the base rules and the two histograms."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.withColumns({"own_words": words(F.col("text")), "own_rest": unusual(text)})
        .withColumns(
            {
                "n_words": F.size("own_words").cast("long"),
                "word_chars": F.length(F.array_join("own_words", "")).cast("long"),
                "n_symbols": _count(F.col("own_rest"), CLASSES["symbol"]).cast("long"),
                "n_dup_lines": n_dup_lines(text),
                "n_repeat_words": n_repeat_words(F.col("own_words")),
                "word_counts": word_histogram(F.col("own_words")),
            }
        )
        .withColumns({"class_counts": class_histogram(F.col("word_chars"), F.col("own_rest")), "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})
        .drop("own_words", "own_rest")
    )


def references(judged: DataFrame) -> DataFrame:
    """For each language, and for null all together, the summed histograms of the documents that pass the base rules and have enough words: a few rows, summed where the data lies."""
    n, m = len(CLASSES) + 2, len(VOCABULARY) + 1
    good = judged.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS)).select(F.col("own_lang").alias("lang"), "class_counts", "word_counts")
    sums = [F.sum(F.col("class_counts")[i]).alias(f"c{i}") for i in range(n)] + [F.sum(F.col("word_counts")[i]).alias(f"w{i}") for i in range(m)]
    by_lang = good.groupBy("lang").agg(*sums)
    total = by_lang.agg(*[F.sum(c).alias(c) for c in by_lang.columns[1:]]).where(F.col("c0").isNotNull())
    both = by_lang.where(F.col("lang").isNotNull()).unionByName(total.withColumn("lang", F.lit(None).cast("string")))
    return both.select(F.col("lang").alias("ref_lang"), F.array(*[f"c{i}" for i in range(n)]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(m)]).alias("ref_words"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, base 2; null if either is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(x: Column) -> Column:
        parts = F.zip_with(x["a"], x["b"], lambda u, v: F.transform(F.array(F.struct((u / x["n"]).alias("p"), (v / x["m"]).alias("q"))), lambda t: term(t["p"], (t["p"] + t["q"]) / 2) + term(t["q"], (t["p"] + t["q"]) / 2))[0])
        return F.when((x["n"] > 0) & (x["m"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / 2)))

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), total(a).alias("n"), total(b).alias("m"))), of)[0]


def balanced(counts: Column, ref: Column) -> Column:
    """The word histogram with its last bin scaled so that the common words have COMMON_SHARE of the reference; as it is where the reference has no common words or no others."""
    common, other = F.aggregate(F.slice(ref, 1, len(VOCABULARY)), F.lit(0.0), lambda a, b: a + b), ref[len(VOCABULARY)]
    scale = F.when((common > 0) & (other > 0), common * (1 - COMMON_SHARE) / (COMMON_SHARE * other)).otherwise(1.0)
    return F.transform(counts, lambda x, i: F.when(i == len(VOCABULARY), x * scale).otherwise(x.cast("double")))


def judge(docs: DataFrame, carried: tuple[str, ...] | None = None, refs: DataFrame | None = None) -> DataFrame:
    """The documents with the base counts, class_distance, word_distance and kept.

    carried: the columns of docs to return, all by default. The counts are written to the shared folder once, and both
    the references and the verdicts are taken from there. The references are one row a language; up to SMALL_SIDE of
    them are broadcast, so that no text is shuffled.
    """
    carried = tuple(docs.columns) if carried is None else carried
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("text", lang.alias("own_lang"), F.struct(*[F.col(f"`{c}`") for c in carried], F.lit(0).alias("own_end")).alias("own_row"))
    held = materialize(base_columns(rows).drop("text"), "quality-counts")
    refs = broadcast_if_small(references(held) if refs is None else refs)
    judged = (
        held.join(refs, F.col("own_lang").eqNullSafe(F.col("ref_lang")), "left")
        .withColumns({"word_counts": balanced(F.col("word_counts"), F.col("ref_words")), "ref_words": balanced(F.col("ref_words"), F.col("ref_words"))})
        .withColumns({"class_distance": js_distance(F.col("class_counts"), F.col("ref_classes")), "word_distance": js_distance(F.col("word_counts"), F.col("ref_words"))})
        .withColumn("diverges", F.coalesce((F.col("n_words") >= MIN_WORDS) & ((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)), F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("diverges"))
    )
    made = (*BASE, "class_distance", "word_distance", "kept")
    return judged.select(*[F.col("own_row")[c].alias(c) for c in carried if c not in made], *made)
