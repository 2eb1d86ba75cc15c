"""Label normalisers, classifiers and stable identifiers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def body_key(label: Column) -> Column:
    """Lower case, "&" as "and", no punctuation, one space between words, and no plural s on words of over three letters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(label), F.lit("&"), F.lit(" and ")), r"[^a-z0-9 ]+", " "), " +", " "))
    return F.array_join(F.transform(F.split(bare, " "), lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)), " ")


def plain_key(label: str) -> str:
    """``body_key`` of a configured label."""
    bare = " ".join(re.sub(r"[^a-z0-9 ]+", " ", label.lower().replace("&", " and ")).split())
    return " ".join(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in bare.split(" "))


def strip_qualifiers(label: Column, leading: tuple[str, ...], trailing: tuple[str, ...] | None = None) -> Column:
    """Removes qualifier words from both ends, as often as they occur; trailing ones are the leading ones if not given."""
    first, last = "|".join(leading), "|".join(leading if trailing is None else trailing)
    return F.trim(F.regexp_replace(F.regexp_replace(label, rf"(?i)^(?:(?:{first})\s+)+", ""), rf"(?i)(?:\s+(?:{last}))+$", ""))


def is_repetition(label: Column, expected: str) -> Column:
    """Whether a label is the expected words once or several times over, by the normal forms of both."""
    words = re.escape(plain_key(expected))
    return F.coalesce(body_key(label), F.lit("")).rlike(f"^{words}(?: {words})*$") if words else F.lit(False)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def notice_class(text: Column, placeholder: str, short: int = 40) -> Column:
    """empty, placeholder, short_notice or complete."""
    n = word_count(text)
    return F.when(n == 0, "empty").when(text.rlike(placeholder), "placeholder").when(n < short, "short_notice").otherwise("complete")


#: What a viewer's shell and a notice of a cancelled meeting say.
PLACEHOLDER = r"(?:documentviewer\.php|\bloading(?:\.\.\.|…)?\b|not currently published|please wait|javascript (?:is )?required|an error occurred|unable to load)"
NOTICE = r"\b(?:cancel(?:led|ed)?|no meeting|meeting (?:is )?(?:postponed|rescheduled)|meeting notice|meeting has been canceled)\b"


def agenda_class(text: Column, score: Column) -> Column:
    """empty, unpublished-placeholder, viewer-placeholder, short-notice or complete. A viewer's shell counts as such in a short text, or in one with an agenda score of 0; so do raw PDF bytes, and a link or file name alone. A short notice has at most 1,000 characters and says that a meeting isn't held as planned."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    lower, n = F.lower(spaced), F.length(spaced)
    shell = lower.rlike(PLACEHOLDER) & (lower.contains("documentviewer.php") | (n <= 500) | (F.coalesce(score, F.lit(0)) == 0))
    bare = (n <= 180) & lower.rlike("[a-z0-9]") & (lower.rlike("^https?://") | spaced.rlike(r"^[\p{L}\p{N}_./-]+$"))
    return (
        F.when(spaced == "", "empty")
        .when(lower.contains("not currently published"), "unpublished-placeholder")
        .when(spaced.rlike(r"^%PDF-\d") | shell | bare, "viewer-placeholder")
        .when((n <= 1000) & lower.rlike(NOTICE), "short-notice")
        .otherwise("complete")
    )


def readable_ratio(text: Column) -> Column:
    """The share of words that consist of letters and common punctuation; null without a word."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    return F.try_divide(F.size(F.filter(words, lambda w: w.rlike(r"^[A-Za-z.,;:'-]+$"))), F.size(words))


def repeated_line_ratio(text: Column) -> Column:
    """1 - distinct / all of the lines that aren't blank, in lower case and with single spaces; 0 with fewer than three."""
    bare = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), bare), lambda x: x != "")
    return F.when(F.size(lines) < 3, 0.0).otherwise(1 - F.size(F.array_distinct(lines)) / F.size(lines))


def identifiers(text: Column, pattern: str) -> Column:
    """The distinct identifiers of a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over fields in order; null and empty stay apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)


def bucket_of(key: Column, buckets: int) -> Column:
    """A stable bucket: the first 48 bits of an MD5 hash modulo the number of buckets."""
    return F.conv(F.left(F.md5(key.cast("string")), F.lit(12)), 16, 10).cast("long") % buckets


def step_class(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that a value is below; null for null."""
    out = F.when(value.isNull(), None)
    for bound, name in steps:
        out = out.when(value < bound, name)
    return out.otherwise(last)


def capped_backoff(base: Column, cap: float, attempts: Column) -> Column:
    """Exponential backoff: none before the first attempt, the base after it, doubled after each further one up to the cap; the cap where the base isn't below it or isn't positive."""
    top = F.lit(float(cap))
    return F.when(attempts <= 0, 0.0).when((base <= 0) | (top <= base), top).otherwise(F.least(top, base * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(60)))))


def billing_cycle(day: Column, rollover: int) -> Column:
    """First day of the cycle that a day is in: cycles begin on the rollover day or, in shorter months, on the last."""
    own = F.date_add(F.trunc(day, "month"), F.least(F.lit(rollover), F.dayofmonth(F.last_day(day))) - 1)
    before = F.add_months(F.trunc(day, "month"), -1)
    return F.when(day >= own, own).otherwise(F.date_add(before, F.least(F.lit(rollover), F.dayofmonth(F.last_day(before))) - 1))


def agenda_score(text: Column, titled: Column) -> Column:
    """How much a text looks like an agenda, 0 to 6: the word itself 1, a numbered line 2, titles found 2, 500 letters 1. Null and empty texts have 0."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    score = spaced.rlike(r"\bagenda(?: items?)?\b").cast("int") + 2 * text.rlike(r"(?i)(?:^|\n)\s*(?:\d+|[IVXLC]+)(?:\.[A-Z])?\.").cast("int") + 2 * F.coalesce(titled, F.lit(False)).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(score + (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 500).cast("int"))


def feed_hash(df: DataFrame, by: list[str], uid: str, shown: list[str], fingerprint: str) -> DataFrame:
    """by and mark: a hash of each feed's shown columns in order of uid, which changes if and only if something shown does. Each row is hashed first, so that a feed gathers 64 characters a row."""
    own = F.sha2(F.to_json(F.struct(uid, *shown), {"ignoreNullFields": "false"}), 256)
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(uid).cast("string"), F.lit("")).alias("u"), own.alias("h")))).alias("own_rows"))
    return rows.select(*by, F.sha2(F.concat_ws(",", F.lit(fingerprint), F.transform("own_rows", lambda r: r["h"])), 256).alias("mark"))
