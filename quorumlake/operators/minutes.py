"""Attendance lines and votes of minutes, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that attendance lines and names are judged by.
MEMBER_WORDS = "member members councilmember councilmembers council board commission commissioners trustees aldermen supervisors directors".split()
STAFF_WORDS = "staff administration personnel employees also additionally".split()
LEFT_OUT_WORDS = "others other guests guest public visitors audience applicants applicant petitioners speakers".split()
TITLES = (
    "mayor pro tem", "deputy mayor", "vice mayor", "vice chair", "council member", "council person", "council man", "council woman",
    "councilmember", "councilperson", "councilman", "councilwoman", "councilor", "councillor", "commissioner", "alderman", "alderwoman", "alderperson", "selectman",
    "selectwoman", "selectperson", "freeholder", "assemblyman", "assemblywoman", "assemblymember", "trustee", "supervisor", "representative", "senator",
    "delegate", "chairman", "chairwoman", "chairperson", "chair", "mayor", "dr", "mr", "ms", "mrs",
)
ROLE_WORDS = (
    "acting administrator analyst assistant associate attorney chief city clerk coordinator county deputy director engineer executive general interim "
    "manager officer planner planning secretary senior specialist superintendent town village"
).split()
NO_NAME_WORDS = "a an absent all and at established excused held is meeting none no not of present quorum recused the there total vacant was were yes".split()

ATTENDANCE = r"(?imd)^[ \t]*([A-Za-z][A-Za-z /&'-]{0,40}?)?[ \t]*(present|absent|excused|recused)[ \t]*:[ \t]*(.+)$"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
HEADING = r"(?i)^\s*(?:item\s+)?\d+[A-Za-z.]*[.)\-:]\s*(.+)$"
VOTE_WORD = r"(?i)\b(?:vote|ayes?|nays?|motion|approved|opposed)\b"
VALUE = "yes|no|absent|recused|abstain(?:ed)?"
MEMBER_FIRST = rf"(?i)([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){{1,3}})\s*[-:–]\s*({VALUE})\b"
VALUE_FIRST = rf"(?i)\b({VALUE})\s*[:=-]\s*([^;]+)"


def _one_of(words: list[str]) -> str:
    return "|".join(words)


def roster_name(raw: Column) -> Column:
    """A person's name without leading titles and offices; null for anything that isn't shaped like a name: digits, over five words or 60 characters, words of prose, an office alone."""
    bare = F.btrim(F.regexp_replace(raw, r"\s+", " "), F.lit(" .,:;"))
    spaced = [t.replace(" ", r"\.* \.*") for t in TITLES]
    name = F.regexp_replace(bare, rf"(?i)^(?:\.*(?:{_one_of(spaced)})\.*(?: |$)|\.*(?:{_one_of(ROLE_WORDS)})\.* )+", "")
    plain = F.transform(F.split(F.lower(name), " "), lambda w: F.btrim(w, F.lit(".")))
    whole = (bare != "") & (F.length(bare) <= 60) & ~bare.rlike(r"\p{Nd}") & (name != "") & (F.size(plain) <= 5)
    prose = F.arrays_overlap(plain, F.array(*[F.lit(w) for w in NO_NAME_WORDS])) | (F.size(F.array_except(plain, F.array(*[F.lit(w) for w in ROLE_WORDS]))) == 0)
    clean = F.btrim(name, F.lit(" .,:;"))
    return F.when(whole & ~prose & (F.length(clean) >= 2) & clean.rlike(r"\p{L}"), clean)


def roster_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, pos, name, status, section (members, staff or null) and evidence of each person that an attendance line names. Lines on guests and the public have none, nor have null texts."""
    lines = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(ATTENDANCE), F.lit(0))).alias("line", "own_line"))
    part = lambda i: F.regexp_extract("own_line", ATTENDANCE, i)
    said = F.split(F.regexp_replace(F.lower(part(1)), r"[^a-z\s]", " "), r"\s+")
    has = lambda words: F.arrays_overlap(said, F.array(*[F.lit(w) for w in words]))
    kept = lines.where(~has(LEFT_OUT_WORDS))
    section = F.when(has(STAFF_WORDS), "staff").when(has(MEMBER_WORDS), "members")
    people = kept.select(key, "line", F.lower(part(2)).alias("status"), section.alias("section"), F.left("own_line", F.lit(500)).alias("evidence"), F.posexplode(F.split(part(3), r",|;|\s{2,}|\s+and\s+")).alias("pos", "own_raw"))
    return people.withColumn("name", roster_name(F.col("own_raw"))).where("name IS NOT NULL").drop("own_raw")


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def vote_rows(df: DataFrame, key: str, text: str, roster: DataFrame | None = None) -> DataFrame:
    """key, line, agenda_item (the last heading up to the line), member, value and evidence of each vote that a line with a word of voting tells.

    With a roster (key, name), votes of people who aren't on it are left out and the roster's spelling is taken; of two spellings with the same letters, the later by code point.
    Only headings and lines with such a word are carried into the window.
    """
    heading = F.nullif(F.trim(F.regexp_extract("own_line", HEADING, 1)), F.lit(""))
    lines = df.select(key, F.posexplode(F.split(text, LINE_END)).alias("line", "own_line")).withColumn("own_heading", heading).where(F.col("own_heading").isNotNull() | F.col("own_line").rlike(VOTE_WORD))
    carried = lines.withColumn("agenda_item", F.last("own_heading", ignorenulls=True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    found = lambda pattern, i: F.regexp_extract_all("own_line", F.lit(pattern), F.lit(i))
    row = lambda member, value: F.struct(F.trim(member).alias("member"), F.replace(F.lower(value), F.lit("abstained"), F.lit("abstain")).alias("value"))
    first = F.zip_with(found(MEMBER_FIRST, 1), found(MEMBER_FIRST, 2), row)
    names = lambda n: F.filter(F.transform(F.split(n, r",|\band\b"), lambda x: F.btrim(x, F.lit(" ."))), lambda x: (x != "") & ~F.lower(x).isin("yes", "no", "absent", "recused", "abstain", "abstained"))
    second = F.flatten(F.zip_with(found(VALUE_FIRST, 1), found(VALUE_FIRST, 2), lambda v, n: F.transform(names(n), lambda x: row(x, v))))
    votes = carried.where(F.col("own_line").rlike(VOTE_WORD)).select(key, "line", "agenda_item", F.left("own_line", F.lit(500)).alias("evidence"), F.explode(F.concat(first, second)).alias("own_vote")).select(key, "line", "agenda_item", "own_vote.member", "own_vote.value", "evidence")
    if roster is None:
        return votes
    known = roster.groupBy(key).agg(F.collect_set(F.struct(name_key(F.col("name")).alias("k"), F.col("name").alias("name"))).alias("own_known"))
    same = F.transform(F.filter("own_known", lambda x: x["k"] == F.col("own_key")), lambda x: x["name"])
    met = votes.withColumn("own_key", name_key(F.col("member"))).join(known, key)
    return met.withColumn("member", F.array_max(same)).where("member is not null").drop("own_key", "own_known")
