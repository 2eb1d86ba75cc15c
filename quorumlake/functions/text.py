"""Text functions: tokens, phrases, n-grams, timed cues, and full-text search with BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.dictionary import near_terms


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and the apostrophe."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """The distinct n-grams of an array of words, which is made once and not for each of them."""
    of = lambda w: F.array_distinct(F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.transform(F.array(words), of)[0]


def tag_phrases(docs: DataFrame, key: str, text: str, taxonomy: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """key, tag and hits: for each tag with a phrase in the text, on word boundaries and with any white space between words, the number of matches; a text with an excluded phrase doesn't get the tag. The taxonomy (tag, include, exclude) is configuration and becomes expressions."""
    as_pattern = lambda phrases: r"(?iU)(?<!\w)(?:" + "|".join(r"\s+".join(p.split()) for p in phrases) + r")(?!\w)"
    hits = [F.struct(F.lit(tag).alias("tag"), F.when(F.col(text).rlike(as_pattern(no)) if no else F.lit(False), 0).otherwise(F.regexp_count(F.col(text), F.lit(as_pattern(yes)))).alias("hits")) for tag, yes, no in taxonomy]
    return docs.select(key, F.explode(F.array(*hits)).alias("t")).select(key, "t.tag", "t.hits").where("hits > 0")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, and the document's length in terms."""
    terms = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.7, delta: float = 0.5) -> DataFrame:
    """key and score of all documents with a term of the query, BM25+. Only the query's terms are counted: nothing else of the texts is shuffled."""
    count = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    counted = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("length"), *[count(t).alias(f"tf_{i}") for i, t in enumerate(query)])
    totals = counted.agg(F.count("*").alias("own_n"), F.avg("length").alias("own_mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(query))])
    both = counted.join(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("own_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * (delta + tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("own_mean"))))).otherwise(0.0)
    return both.select(key, score.alias("score")).where("score > 0")


def expand_terms(posted: DataFrame, query: list[str], fuzzy: int = 1, prefix_weight: float = 0.375, fuzzy_weight: float = 0.45) -> DataFrame:
    """asked, term, weight: the vocabulary's terms that equal, begin with or are near to a term of the query. A weight falls with the letters that a term has beyond the one asked for, or with the edits between both, as shares of the term's length."""
    asked = posted.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(query)], "asked string")
    return near_terms(posted.select("term").distinct(), asked, fuzzy, True, prefix_weight, fuzzy_weight)


def tfidf_overlap(docs: DataFrame, key: str, text: str, units: DataFrame, unit: str, unit_text: str, most_terms: int = 20_000) -> DataFrame:
    """For each document and unit that share a term: the idf weights of the shared terms over those of the unit's. idf is taken over the documents.

    Up to most_terms terms of the units, with their counts, are told to every task: the texts are then made into terms
    twice, once for the counts and once for the result, and a document's shared terms meet its units where it lies, so a
    term that all documents have is no hot key. Beyond that bound both sides are joined by term.
    """
    asked = units.select(unit, F.array_distinct(tokens(F.col(unit_text))).alias("own_terms")).select(unit, F.explode("own_terms").alias("term"))
    n, vocabulary = docs.count(), asked.select("term").distinct()
    few = vocabulary.limit(most_terms + 1).count() <= most_terms
    terms = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    have = terms.join(F.broadcast(vocabulary) if few else vocabulary, "term")
    idf = have.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log((1 + F.lit(n)) / (1 + F.col("df"))).alias("idf"))
    weighed = asked.join(idf, "term")
    whole = weighed.groupBy(unit).agg(F.sum("idf").alias("whole"))
    by_term = weighed.groupBy("term", "idf").agg(F.collect_list(unit).alias("own_units")) if few else weighed
    met = terms.join(F.broadcast(by_term), "term").select(key, F.explode("own_units").alias(unit), "idf") if few else terms.join(weighed, "term")
    return met.groupBy(key, unit).agg(F.sum("idf").alias("shared")).join(whole, unit).select(key, unit, F.try_divide("shared", "whole").alias("overlap"))


def quoted(docs: DataFrame, key: str, text: str, quotes: DataFrame, quote: str, quote_text: str, n: int, most_grams: int = 200_000) -> DataFrame:
    """key, quote and grams: documents that hold an n-gram of a quote, and how many distinct ones. The n-grams are compared as 64-bit hashes first; up to most_grams of the quotes are told to every task, so that no other n-gram is shuffled, and the n-grams themselves settle what is left."""
    have = docs.select(key, F.explode(ngrams(tokens(F.col(text)), n)).alias("gram")).withColumn("own_hash", F.xxhash64("gram"))
    want = quotes.select(quote, F.explode(ngrams(tokens(F.col(quote_text)), n)).alias("gram")).withColumn("own_hash", F.xxhash64("gram"))
    known = want.select("own_hash").distinct()
    few = known.limit(most_grams + 1).count() <= most_grams
    near = have.join(F.broadcast(known) if few else known, "own_hash", "left_semi")
    return near.join(want, ["own_hash", "gram"]).groupBy(key, quote).agg(F.count("*").alias("grams"))


def cues(text: Column) -> Column:
    """start, end and text of the cues of a WebVTT or SRT text."""
    clock = lambda s: F.aggregate(F.split(F.replace(s, F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    time = r"((?:\d+:)?\d+:\d+[.,]\d+)\s+-->\s+((?:\d+:)?\d+:\d+[.,]\d+)"
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n"), lambda b: b.rlike(time))
    return F.transform(blocks, lambda b: F.struct(clock(F.regexp_extract(b, time, 1)).alias("start"), clock(F.regexp_extract(b, time, 2)).alias("end"), F.regexp_replace(F.regexp_replace(b, rf"(?s)^.*?{time}[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; -1 where the lengths differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(-1.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def best_rows(scored: DataFrame, by: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The best row of each group, and of these the n best."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("own_r", F.row_number().over(w)).where("own_r = 1").drop("own_r").orderBy(F.col(score).desc(), tie).limit(n)
