"""Quotes in timed texts, clips around them, and scores of items by weighted n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.intervals import as_of


def plain(text: Column) -> Column:
    """Lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def token(word: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def transcript_region(quotes: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """quotes (by, quote_id, quote) with start and end of the segments that hold the quote's first place in the joined text; null if it isn't found or has no length. segments: by, seq, start, end, text.

    A transcript's segments are joined to one text, as long as the transcript is; the places of segments in it are running
    sums of lengths. Quotes and segments are then sorted together, and each quote looks at its first and last segment.
    """
    told = segments.withColumn("own_text", plain(F.col("text"))).where("own_text <> ''")
    w = Window.partitionBy(*by).orderBy("seq")
    placed = told.withColumn("own_at", F.sum(F.length("own_text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("own_text"))
    whole = told.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "own_text"))), lambda x: x["own_text"]), " ").alias("own_whole"))
    found = quotes.withColumn("own_quote", plain(F.col("quote"))).join(whole, by, "left")
    found = found.withColumn("own_first", F.when(F.col("own_quote") != "", F.nullif(F.instr("own_whole", F.col("own_quote")), F.lit(0))))
    found = found.withColumn("own_last", F.col("own_first") + F.length("own_quote") - 1).select(*quotes.columns, "own_first", "own_last")
    touched = placed.select(*by, F.col("start").alias("own_start"), F.coalesce("end", "start").alias("own_end"), "own_at", (F.col("own_at") + F.length("own_text") - 1).alias("own_to"))
    # a quote that begins or ends in the space between two segments belongs to the later one
    asked = found.where("own_first is not null")
    first = as_of(asked.withColumn("own_p", -F.col("own_first")), touched.select(*by, (-F.col("own_to")).alias("own_p"), "own_at", "own_start"), by, "own_p", "own_at", "own_start", "start")
    both = as_of(first.withColumn("own_p", F.col("own_last") + 1), touched.select(*by, F.col("own_at").alias("own_p"), "own_at", "own_end"), by, "own_p", "own_at", "own_end", "end")
    spans = both.where("end > start").select(*by, "quote_id", "start", "end")
    return quotes.join(spans, [*by, "quote_id"], "left")


def word_region(quotes: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """quotes (by, quote_id, quote, near_start, near_end) with word_start and word_end, where the quote's tokens occur as consecutive words just once, within a second of near; else null. words: by, seq, text, start, end, seq without gaps.

    Each quote's tokens meet the words by token; hits of a quote at one place are counted, so nothing but matching words is
    shuffled, and a full count is a full match.
    """
    tokens = quotes.select(*by, "quote_id", "near_start", "near_end", F.filter(F.transform(F.split("quote", r"\s+"), token), lambda t: t != "").alias("own_tokens")).where(F.size("own_tokens") > 0)
    each = tokens.select(*by, "quote_id", "near_start", "near_end", F.size("own_tokens").alias("own_n"), F.posexplode("own_tokens").alias("own_i", "own_token"))
    spoken = words.select(*by, "seq", token(F.col("text")).alias("own_token"), F.col("start").alias("own_s"), F.col("end").alias("own_e"))
    hits = each.join(spoken, [*by, "own_token"]).groupBy(*by, "quote_id", "near_start", "near_end", "own_n", (F.col("seq") - F.col("own_i")).alias("own_at"))
    full = hits.agg(F.count("*").alias("own_c"), F.min_by("own_s", "own_i").alias("s"), F.max_by("own_e", "own_i").alias("e")).where("own_c = own_n and (near_start is null or (s >= near_start - 1 and s <= near_end + 1))")
    one = full.groupBy(*by, "quote_id").agg(F.count("*").alias("own_hits"), F.first("s").alias("word_start"), F.first("e").alias("word_end")).where("own_hits = 1 and word_end > word_start").drop("own_hits")
    return quotes.join(one, [*by, "quote_id"], "left")


def quote_timing(quotes: DataFrame, segments: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """by, quote_id, start, end and basis: the words' times where they settle it, else the cues'; nothing without a cue."""
    cues = transcript_region(quotes, segments, by).where("start is not null")
    near = cues.select(*by, "quote_id", "quote", F.col("start").alias("near_start"), F.col("end").alias("near_end"))
    both = word_region(near, words, by)
    exact = F.col("word_start").isNotNull()
    return both.select(*by, "quote_id", F.coalesce("word_start", "near_start").alias("start"), F.coalesce("word_end", "near_end").alias("end"), F.when(exact, "words").otherwise("cues").alias("basis"))


def clip_window(start: Column, end: Column, low: Column, high: Column, padding: float, least: float, most: float) -> Column:
    """A padded window within bounds, widened to the least length; null if it stays below that or is over the most."""
    a, b = F.greatest(low, start - padding), F.least(high, end + padding)
    short = least - (b - a)
    a1 = F.when(short > 0, F.greatest(low, a - short / 2)).otherwise(a)
    b2 = F.when(short > 0, F.least(high, a1 + least)).otherwise(b)
    a2 = F.when(short > 0, F.greatest(low, b2 - least)).otherwise(a1)
    return F.when((b2 - a2 >= least) & (b2 - a2 <= most), F.struct(a2.alias("start"), b2.alias("end")))


def quote_attribution(quotes: DataFrame, turns: DataFrame, by: list[str]) -> DataFrame:
    """quotes (by, quote_id, start, end) with the speaker of the one turn that covers them, isn't overlapped and has an identity; null with none or several. turns: by, start, end, overlap, speaker, status.

    Quotes and turns are sorted together once. Of the turns that have begun the two latest ends are kept along: a quote is
    covered once if the latest end reaches its own, and the one after it doesn't.
    """
    t = turns.where("not coalesce(overlap, false) and status in ('provisional', 'confirmed')")
    own = t.select(*by, F.col("start").alias("own_at"), F.lit(0).alias("own_side"), F.struct(F.col("end").alias("e"), "speaker", "status").alias("own_turn"))
    both = quotes.withColumns({"own_at": F.col("start"), "own_side": F.lit(1)}).unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("own_at", "own_side", "own_turn")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("own_turn.e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lesser = F.when((F.col("own_side") == 0) & before.isNotNull(), F.least("own_turn.e", before))
    met = both.withColumns({"own_top": F.max("own_turn").over(up_to), "own_lesser": lesser}).withColumn("own_second", F.max("own_lesser").over(up_to)).where("own_side = 1")
    once = (F.col("own_top.e") >= F.col("end")) & F.coalesce(F.col("own_second") < F.col("end"), F.lit(True))
    return met.select(*quotes.columns, F.when(once, F.col("own_top.speaker")).alias("speaker"), F.when(once, F.col("own_top.status")).alias("status"))


def grams(words: Column, most: int = 2) -> Column:
    """All n-grams of up to ``most`` words."""

    def of(n: int) -> Column:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))


def tfidf_scores(items: DataFrame, units: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """by, item, unit and score: cosines of n-gram vectors with 1 + ln(tf) and smooth idf of the group's units. items: by, item, words; units: by, unit, words. Only pairs with a common n-gram are joined; a unit's vectors are made where it lies."""
    def weights(df: DataFrame, key: str) -> DataFrame:
        return df.select(*by, key, F.explode(grams(F.col("words"), most)).alias("gram")).groupBy(*by, key, "gram").agg((1 + F.log(F.count("*"))).alias("tf"))

    u, i = weights(units, "unit"), weights(items, "item")
    n = units.groupBy(*by).agg(F.count("*").alias("n"))
    idf = u.groupBy(*by, "gram").agg(F.count("*").alias("df")).join(n, by).select(*by, "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    scaled = lambda df, key: df.join(idf, [*by, "gram"]).withColumn("w", F.col("tf") * F.col("idf")).select(*by, key, "gram", "w")
    unit, item = scaled(u, "unit"), scaled(i, "item")
    norm = lambda df, key: df.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"{key}_norm"))
    dots = item.withColumnRenamed("w", "iw").join(unit, [*by, "gram"]).groupBy(*by, "item", "unit").agg(F.sum(F.col("iw") * F.col("w")).alias("dot"))
    return dots.join(norm(item, "item"), [*by, "item"]).join(norm(unit, "unit"), [*by, "unit"]).select(*by, "item", "unit", (F.col("dot") / (F.col("item_norm") * F.col("unit_norm"))).alias("score"))


#: Words that carry no weight, and what a formal identifier looks like.
STOPWORDS = "a an and are at be by for from in into is it of on or that the this to with".split()
IDENTIFIER = r"(?<![a-z0-9])(?:[a-z]{1,8}\d+[a-z0-9]*(?:[./-][a-z0-9]+)*|\d+[./-][a-z0-9]+)(?![a-z0-9])"


def lexical_scores(items: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """by, item, unit and score for the pairs of a group with a token in common, all others have 0: the weights of the item's tokens that the unit has over those of all the item's tokens, those that no unit has included. A token weighs its rarity among the group's units and 1, three times that if it is a formal identifier. items: by, item, text; units: by, unit, text."""
    folded = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    tokens = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0))), lambda t: ~t.isin(STOPWORDS))
    have = units.select(*by, "unit", F.explode(tokens(F.col("text"))).alias("own_t"))
    df = have.groupBy(*by, "own_t").agg(F.count("*").alias("own_df"))
    n = units.groupBy(*by).agg(F.count("*").alias("own_n"))
    named = F.regexp_extract_all(folded(F.col("text")), F.lit(IDENTIFIER), F.lit(0))
    asked = items.select(*by, "item", named.alias("own_ids"), F.explode(tokens(F.col("text"))).alias("own_t"))
    asked = asked.select(*by, "item", "own_t", F.when(F.array_contains("own_ids", F.col("own_t")), 3.0).otherwise(1.0).alias("own_f"))
    weight = (F.log((F.col("own_n") + 1) / (F.coalesce("own_df", F.lit(0)) + 1)) + 1) * F.col("own_f")
    weighed = asked.join(df, [*by, "own_t"], "left").join(n, by).select(*by, "item", "own_t", weight.alias("own_w"))
    whole = weighed.groupBy(*by, "item").agg(F.sum("own_w").alias("own_whole"))
    met = have.join(weighed, [*by, "own_t"]).groupBy(*by, "item", "unit").agg(F.sum("own_w").alias("own_met"))
    return met.join(whole, [*by, "item"]).select(*by, "item", "unit", (F.col("own_met") / F.col("own_whole")).alias("score"))


def with_neighbours(ranked: list[DataFrame], by: list[str], unit: str, score: str, top: int, radius: int) -> DataFrame:
    """The best units of each ranking, with those up to radius places around them."""
    out = None
    for r in ranked:
        best = r.withColumn("own_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), unit))).where(F.col("own_r") <= top)
        near = best.select(*by, F.explode(F.sequence(F.greatest(F.col(unit) - radius, F.lit(0)), F.col(unit) + radius)).alias(unit))
        out = near if out is None else out.unionByName(near)
    return out.distinct()


def combined(results: list[DataFrame], how: str, key: str, score: str) -> DataFrame:
    """Result sets joined: OR adds scores, AND keeps what all have, AND_NOT what only the first has."""
    if how == "AND_NOT":
        out = results[0]
        for r in results[1:]:
            out = out.join(r.select(key), key, "left_anti")
        return out.select(key, score)
    every = results[0].select(key, score)
    for r in results[1:]:
        every = every.unionByName(r.select(key, score))
    summed = every.groupBy(key).agg(F.sum(score).alias(score), F.count("*").alias("own_n"))
    return summed.where(F.col("own_n") == len(results)).drop("own_n") if how == "AND" else summed.drop("own_n")


def title_spans(texts: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """by, seq and span_start, the first place of each title in its text at or after the end of the title before it that was found, in order; null where it isn't. texts: by, text; titles: by, seq, title. A text's titles are its agenda: one array."""
    listed = titles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", plain(F.col("title")).alias("t")))).alias("own_titles"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<seq:long,span_start:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.when(x["t"] != "", F.nullif(F.call_function("locate", x["t"], F.col("own_text"), acc["at"]), F.lit(0)))
        return F.struct(F.coalesce(hit + F.length(x["t"]), acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), hit.alias("span_start")))).alias("out"))

    found = texts.withColumn("own_text", plain(F.col("text"))).join(listed, by)
    return found.select(*by, F.explode(F.aggregate("own_titles", start, step, lambda a: a["out"])).alias("s")).select(*by, "s.seq", "s.span_start")


def without_preamble(text: Column, titles: Column) -> Column:
    """The text from the first of its titles on; as it is where it has none."""
    places = F.array_compact(F.transform(titles, lambda t: F.nullif(F.instr(F.lower(text), F.lower(t)), F.lit(0))))
    return F.when(F.size(places) > 0, F.substring(text, F.array_min(places), F.length(text))).otherwise(text)


def title_matches(candidate: Column, title: Column) -> Column:
    """Whether one title holds the other, with no letter or number right beside it."""
    a, b = F.concat(F.lit(" "), F.regexp_replace(plain(candidate), r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(plain(title), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    some = (F.trim(a) != "") & (F.trim(b) != "")
    return some & (F.contains(a, F.concat(F.lit(" "), F.trim(b), F.lit(" "))) | F.contains(b, F.concat(F.lit(" "), F.trim(a), F.lit(" "))))


def share_of_pages(page: Column, pages: Column, chapters: Column) -> Column:
    """The chapter, from 0, that a page of a document falls to by its share."""
    return F.least(chapters - 1, F.floor(page * chapters / pages)).cast("int")
