"""Judgments of models: noise, disagreement, newest judges, sampled comparisons, and links put to chapters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def binary(flag: Column, number: Column) -> Column:
    """A yes or no from a flag or, where that is null, from a number of 0.5 or more."""
    return F.coalesce(flag, number >= 0.5)


def judge_noise(df: DataFrame) -> DataFrame:
    """Per model the share of its rows that were turned when asked again or whose quote isn't in the evidence. df: subject, model, question, tier, role, sample, said (boolean), quote_valid. Questions asked again end in _s."""
    quoted = df.where("role in ('sibling', 'adjudicator')").select("model", (F.col("quote_valid") == False).alias("own_bad"))  # noqa: E712
    keys = ["subject", "model", "question", "tier"]
    first = df.where("sample = 'routine'").groupBy(*keys).agg(F.first("said").alias("own_first"))
    again = df.where("sample = 'stability'").withColumn("question", F.regexp_replace("question", "_s$", ""))
    turned = again.join(first, keys).where("said is not null and own_first is not null").select("model", (F.col("said") != F.col("own_first")).alias("own_bad"))
    return quoted.unionByName(turned).groupBy("model").agg(F.avg(F.coalesce("own_bad", F.lit(False)).cast("double")).alias("noise"), F.count("*").alias("n"))


def newest_judge(df: DataFrame, now: str, days: int = 14) -> DataFrame:
    """The model that was first seen last, if others were seen before and it came within so many days: one row or none. df: model, role, judged_at."""
    seen = df.where("role <> 'audit' and judged_at is not null").groupBy("model").agg(F.min("judged_at").alias("own_at"))
    told = seen.agg(F.count("*").alias("n"), F.min("own_at").alias("own_oldest"), F.max(F.struct("own_at", "model")).alias("own"))
    return told.where((F.col("n") > 1) & (F.col("own.own_at") > F.col("own_oldest")) & (F.col("own.own_at").cast("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval({days})"))).select("own.model")


def disagreements(df: DataFrame, since: str) -> DataFrame:
    """Per task how often an audit since a day differs from the adjudicator's newest word. df: task, subject, question, role, said, judged_at."""
    keys = ["task", "subject", "question"]
    audits = df.where((F.col("role") == "audit") & F.col("said").isNotNull() & (F.col("judged_at") >= F.lit(since))).groupBy(*keys).agg(F.min_by("said", "judged_at").alias("own_audit"))
    last = df.where((F.col("role") == "adjudicator") & F.col("said").isNotNull()).groupBy(*keys).agg(F.max_by("said", "judged_at").alias("own_last"))
    return audits.join(last, keys).where("own_audit <> own_last").groupBy("task").agg(F.count("*").alias("n"))


def logical_model(model: Column, aliases: dict[str, str]) -> Column:
    """A model's name without a backend before a colon, by its alias if it has one."""
    bare = F.when(F.regexp_extract(model, "^([^:]*):(.+)$", 1).rlike("^[^/]+$"), F.regexp_extract(model, "^[^:]*:(.+)$", 1)).otherwise(model)
    if not aliases:
        return bare
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), bare), bare)


def sha1_mod(key: Column, n: Column) -> Column:
    """The SHA-1 of a text as a number, modulo n: folded over its hex digits, as it has more bits than any number type."""
    digits = F.transform(F.split(F.sha1(key), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % n.cast("long"))


def sample_window(key: Column, duration: Column, seconds: int) -> Column:
    """(start, end) of a clip whose start a hash gives; all of what is no longer than the clip."""
    start = sha1_mod(key, F.floor(F.greatest(duration - seconds, F.lit(0))) + 1).cast("double")
    return F.when(duration <= seconds, F.struct(F.lit(0.0).alias("start"), F.greatest(duration, F.lit(0.0)).alias("end"))).otherwise(F.struct(start.alias("start"), (start + seconds).alias("end")))


def is_swapped(key: Column) -> Column:
    """Whether two candidates change places, by the parity of a hash."""
    return F.instr(F.lit("13579bdf"), F.right(F.sha1(key), F.lit(1))) > 0


def signed_margin(scores: Column, one: str, other: str) -> Column:
    """The difference of two roles' scores in a map; null without both."""
    return F.round(F.try_element_at(scores, F.lit(one)) - F.try_element_at(scores, F.lit(other)), 4)


def routing(df: DataFrame, by: list[str], margin: str, winner: str, least: int, bound: float) -> DataFrame:
    """Per route its reviewed wins, its mean margin and a decision: keep or switch with a lead of ``least`` wins, else by the mean margin beyond the bound, else undecided."""
    told = df.groupBy(*by).agg(F.count_if(F.col(winner) == "one").alias("wins"), F.count_if(F.col(winner) == "other").alias("losses"), F.avg(margin).alias("mean_margin"))
    lead = F.col("wins") - F.col("losses")
    return told.withColumn("decision", F.when(lead >= least, "keep").when(lead <= -least, "switch").when(F.col("mean_margin") >= bound, "keep").when(F.col("mean_margin") <= -bound, "switch").otherwise("undecided"))


def evidence_summary(df: DataFrame, by: list[str], decision: str, flags: str) -> DataFrame:
    """Counts by decision and by timing flag: kind, name, n."""
    said = df.groupBy(*by, F.lit("decision").alias("kind"), F.col(decision).alias("name")).agg(F.count("*").alias("n"))
    return said.unionByName(df.select(*by, F.explode(flags).alias("name")).groupBy(*by, F.lit("flag").alias("kind"), "name").agg(F.count("*").alias("n")))


def turn_metrics(gold: DataFrame, said: DataFrame, mapping: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Per case: the share of common time in which a cluster is its speaker, and the share of true edges with a predicted one within the tolerance. gold: by, start, end, speaker; said: by, start, end, cluster; mapping: by, cluster, speaker."""
    s = said.select(*by, F.col("start").alias("s"), F.col("end").alias("e"), "cluster").join(mapping.select(*by, "cluster", F.col("speaker").alias("mapped")), [*by, "cluster"], "left")
    span = F.greatest(F.least("end", "e") - F.greatest("start", "s"), F.lit(0.0))
    share = gold.join(s, by).where(span > 0).groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("mapped") == F.col("speaker"), span).otherwise(0.0)), F.sum(span)).alias("accuracy"))
    edges = lambda df: df.select(*by, F.explode(F.array("start", "end")).alias("at"))
    actual = edges(gold).groupBy(*by, "at").agg(F.count("*").alias("c"))
    near = actual.join(edges(said).select(*by, F.col("at").alias("p")).distinct(), by).where(F.abs(F.col("p") - F.col("at")) <= tolerance).select(*by, "at").distinct().withColumn("hit", F.lit(1))
    recall = actual.join(near, [*by, "at"], "left").groupBy(*by).agg((F.sum(F.col("c") * F.coalesce("hit", F.lit(0))) / F.sum("c")).alias("boundary_recall"))
    return recall.join(share, by, "left")


def chapter_of_links(links: DataFrame, chapters: DataFrame, by: list[str], pattern: str) -> DataFrame:
    """links (by, link_id, label, url) with chapter: the first whose identifiers, or whose whole title if it has none, the link's text holds; null without one. chapters: by, chapter, title. An agenda's chapters are one array, joined on its key; links are shuffled once."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    text = squeeze(F.concat_ws(" ", F.coalesce("label", F.lit("")), "url"))
    ids = F.regexp_extract_all(F.col("title"), F.lit(pattern), F.lit(0))
    agenda = chapters.where("title <> ''").groupBy(*by).agg(F.collect_list(F.struct("chapter", squeeze(F.col("title")).alias("title"), ids.alias("ids"))).alias("own_agenda"))
    whole = lambda i: F.regexp_count(F.col("own_text"), F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.lower(i), F.lit(r"\E(?![0-9a-z])"))) > 0
    fits = lambda c: F.when(F.size(c["ids"]) > 0, F.exists(c["ids"], whole)).otherwise(F.contains(F.col("own_text"), c["title"]))
    both = links.withColumn("own_text", text).join(agenda, by, "left")
    return both.select(*by, *[c for c in links.columns if c not in by], F.array_min(F.transform(F.filter("own_agenda", fits), lambda c: c["chapter"])).alias("chapter"))


def _ratio(left: Column, right: Column) -> Column:
    """The matching ratio of two texts, in Arrow batches; null where either is null."""

    @pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return of(left, right)


def title_similarity(left: Column, right: Column) -> Column:
    """1 where one title of eight characters or more holds the other, 0 where one is empty, else the matching ratio."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    a, b = plain(left), plain(right)
    held = (F.least(F.length(a), F.length(b)) >= 8) & (F.contains(a, b) | F.contains(b, a))
    settled = (a == "") | (b == "") | held
    return F.when((a == "") | (b == ""), 0.0).when(held, 1.0).otherwise(_ratio(F.when(~settled, a), F.when(~settled, b)))


def text_similarity(left: Column, right: Column, least: float, most: int) -> Column:
    """The matching ratio of both texts' beginnings; where lengths alone keep it below ``least``, the bound that they set. The sample of ``most`` characters is the operator's parameter."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    a, b = plain(left), plain(right)
    bound = 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
    settled = (a == "") | (b == "") | (bound < least)
    return F.when((a == "") | (b == ""), 0.0).when(bound < least, bound).otherwise(_ratio(F.when(~settled, F.left(a, F.lit(most))), F.when(~settled, F.left(b, F.lit(most)))))


def phrase_audit(df: DataFrame, key: str, fields: list[str], taxonomy: list[tuple[str, list[str], list[str]]], samples: int = 3) -> DataFrame:
    """key, tag, kind (include or exclude), phrase, field, n and up to so many samples of what was found: observations of the taxonomy's phrases, suppressed ones too."""
    rows = []
    for tag, yes, no in taxonomy:
        for kind, phrases in (("include", yes), ("exclude", no)):
            for p in phrases:
                for f in fields:
                    found = F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(r"(?iU)(?<!\w)" + r"\s+".join(p.split()) + r"(?!\w)"), F.lit(0))
                    rows.append(F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("kind"), F.lit(p).alias("phrase"), F.lit(f).alias("field"), F.size(found).alias("n"), F.slice(F.array_distinct(found), 1, samples).alias("samples")))
    return df.select(key, F.explode(F.array(*rows)).alias("o")).select(key, "o.*").where("n > 0")


def chapter_texts(segments: DataFrame, chapters: DataFrame, by: list[str]) -> DataFrame:
    """The text of each chapter: segments that begin in it, in order. segments: by, seq, start, text; chapters: by, chapter, start, end (null for the last)."""
    c = chapters.select(*by, "chapter", F.col("start").alias("own_a"), F.coalesce("end", F.lit(float("inf"))).alias("own_b"))
    met = segments.join(c, by).where("start >= own_a and start < own_b")
    return met.groupBy(*by, "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda x: x["text"]), " ").alias("text"))


def unique_matches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs in which either side has the other as its only partner."""
    one = lambda c, other: pairs.groupBy(c).agg(F.count_distinct(other).alias("n")).where("n = 1").select(c)
    return pairs.select(left, right).distinct().join(one(left, right), left, "left_semi").join(one(right, left), right, "left_semi").select(left, right)


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The upper median of a value and its number: of an even number of values the greater of the middle two."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (-F.expr(f"percentile_disc(0.5) within group (order by -`{value}`)")).alias("median"))
