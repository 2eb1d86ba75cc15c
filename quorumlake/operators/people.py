"""People and tags: attendance, membership, merged tags and names proposed by several signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def observed(registry: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """The registry after a meeting's names: known people are seen later, new ones are added as probable. registry: by, name_key, name, first_seen, last_seen, section, status; seen: by, name, seen_at, section (null for names in votes only). The newest section that is told wins."""
    key = plain_name(F.col("name"))
    fresh = seen.where(F.trim(F.coalesce("name", F.lit(""))) != "").groupBy(*by, key.alias("name_key")).agg(F.min_by(F.trim("name"), F.struct("seen_at", "name")).alias("name"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max_by("section", F.when(F.col("section").isNotNull(), F.col("seen_at"))).alias("section"))
    both = registry.alias("r").join(fresh.alias("f"), [*by, "name_key"], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"r.{c}"), F.col(f"f.{c}")).alias(c)
    return both.select(*by, "name_key", pick("name"), pick("first_seen"), F.coalesce(F.col("f.last_seen"), F.col("r.last_seen")).alias("last_seen"), F.coalesce(F.col("f.section"), F.col("r.section")).alias("section"), F.coalesce("r.status", F.lit("probable")).alias("status"))


def membership(last_seen: Column, now: str, days: int, references: Column) -> Column:
    """review_only for people unseen for more than so many days, active for those with a reference, else probable."""
    old = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp")) > days * 86_400_000_000
    return F.when(last_seen.isNull() | old, "review_only").when(references > 0, "active").otherwise("probable")


def qualified(people: DataFrame, references: DataFrame, key: str, recipe: str, meetings: int) -> DataFrame:
    """Active people with references from so many meetings under a recipe: key, n."""
    n = references.where((F.col("recipe") == recipe) & (F.coalesce("meeting", F.lit("")) != "")).groupBy(key).agg(F.count_distinct("meeting").alias("n")).where(F.col("n") >= meetings)
    return people.where("status = 'active'").select(key).join(n, key)


def members(registry: DataFrame, body: Column) -> DataFrame:
    """The people of a body who are active or probable."""
    return registry.where(body & F.col("status").isin("active", "probable"))


def roster_ids(registry: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    """key of people whose name or an alias is on the roster. registry: key, name, aliases; roster: name."""
    names = registry.select(key, F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("own_name"))
    listed = roster.select(plain_name(F.col("name")).alias("own_name")).where("own_name <> ''").distinct()
    return names.withColumn("own_name", plain_name(F.col("own_name"))).join(listed, "own_name", "left_semi").select(key).distinct()


def fused(proposals: DataFrame, cluster: str, name: str, signal: str) -> DataFrame:
    """Proposals of one name for one cluster as one: the signals in order, and their number."""
    return proposals.groupBy(cluster, plain_name(F.col(name)).alias("name_key")).agg(F.min(name).alias("name"), F.sort_array(F.collect_set(signal)).alias("signals"), F.count("*").alias("n"))


def without_common_members(rosters: DataFrame, by: list[str], meeting: str, ts: str, person: str) -> DataFrame:
    """Meetings, but for the first, whose roster has nobody who was on an earlier one. A person's first meeting is enough to tell: no sets are gathered."""
    first = rosters.groupBy(*by, person).agg(F.min(F.struct(ts, meeting)).alias("own_first"))
    told = rosters.join(first, [*by, person]).withColumn("own_known", F.col("own_first") < F.struct(ts, meeting))
    each = told.groupBy(*by, meeting, ts).agg(F.bool_or("own_known").alias("own_known"))
    begin = rosters.groupBy(*by).agg(F.min(F.struct(ts, meeting)).alias("own_begin"))
    return each.join(begin, by).where(~F.col("own_known") & (F.struct(ts, meeting) != F.col("own_begin"))).select(*by, meeting)


def merged_tags(rule: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """Tags of two sources by id: the rule's come first, with the evidence of both. Columns: by, id, source, confidence, evidence (an array)."""
    both = rule.alias("r").join(model.alias("m"), [*by, "id"], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"r.{c}"), F.col(f"m.{c}")).alias(c)
    none = F.array().cast(dict(rule.dtypes)["evidence"])
    return both.select(*by, "id", pick("source"), F.when(F.col("r.source").isNotNull(), F.col("r.confidence")).otherwise(F.col("m.confidence")).alias("confidence"), F.array_union(F.coalesce("r.evidence", none), F.coalesce("m.evidence", none)).alias("evidence"))


def rolled_up(tags: DataFrame, by: list[str], taxonomy: DataFrame) -> DataFrame:
    """Tags of an item and of its chapters as one row an id, with ordinal, its place in the taxonomy: a rule makes source rule and confidence 1, else the most confident one tells both; n counts the chapters. tags: by, id, source, confidence, chapter; taxonomy: id, ordinal, broadcast by Spark while it is small."""
    best = F.max_by(F.struct("source", "confidence"), F.struct(F.col("source") == "rule", F.coalesce("confidence", F.lit(-1.0)), "source"))
    one = tags.groupBy(*by, "id").agg(best.alias("own"), F.count_distinct("chapter").alias("chapters"))
    return one.join(taxonomy, "id", "left").select(*by, "id", "own.source", F.when(F.col("own.source") == "rule", 1.0).otherwise(F.col("own.confidence")).alias("confidence"), "chapters", "ordinal")


def admission(manual: Column, gate: Column) -> Column:
    """(admission, display, reason) from a reviewer's word: Reject hides, Borderline stays in the shadow, Good is shown, with its clip where the gate allows; without a word it stays in the shadow."""
    word = F.initcap(F.coalesce(manual, F.lit("")))
    row = lambda a, d, r: F.struct(a.alias("admission") if isinstance(a, Column) else F.lit(a).alias("admission"), F.lit(d).alias("display"), F.lit(r).alias("reason"))
    good = row(F.when(F.coalesce(gate, F.lit(False)), "admitted").otherwise("admitted_text_only"), True, "manual-good")
    return F.when(word == "Reject", row("rejected", False, "manual")).when(word == "Borderline", row("shadow", False, "manual")).when(word == "Good", good).otherwise(row("shadow", False, "manual-only"))


def best_quote(quotes: DataFrame, by: list[str], score: str, order: list[str]) -> DataFrame:
    """Of each item its best quote that is shown."""
    held = F.struct(*[c for c in quotes.columns if c not in by])
    return quotes.where("display").groupBy(*by).agg(F.max_by(held, F.struct(score, *order)).alias("own")).select(*by, "own.*")


def disputed(members_: DataFrame, group: str, member: str) -> DataFrame:
    """Members that several groups declare, with the groups in order: the diagnostics of a selection."""
    return members_.groupBy(member).agg(F.sort_array(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def selected(records: DataFrame, groups: DataFrame, member: str) -> DataFrame:
    """Records without those that a group names beside its preferred one. groups: group, member, preferred. A dispute anywhere, a group without just one preferred member, or a preferred one that isn't among the records means that nothing is left out: the diagnostics are counted once, as one row."""
    odd = disputed(groups, "group", member).select(F.lit(1).alias("own_odd"))
    odd = odd.unionByName(groups.groupBy("group").agg(F.count_if("preferred").alias("n")).where("n <> 1").select(F.lit(1).alias("own_odd")))
    odd = odd.unionByName(groups.where("preferred").join(records.select(member), member, "left_anti").select(F.lit(1).alias("own_odd")))
    told = odd.agg((F.count("*") == 0).alias("own_fine"))
    hidden = groups.where("not preferred").select(member).distinct().crossJoin(F.broadcast(told)).where("own_fine").select(member)
    return records.join(hidden, member, "left_anti")


def canonical_copies(df: DataFrame, entity: str, uid: str, ok: str, encoded_at: str, source: str) -> DataFrame:
    """Items that several sources of an entity hold: entity, uid and the source to keep: the only one that is ok, else the one encoded last if it is alone in that, else null (unresolved)."""
    per = df.groupBy(entity, uid).agg(F.count("*").alias("own_n"), F.count_if(ok).alias("own_ok"), F.max(F.when(F.col(ok), F.col(source))).alias("own_sole"), F.max(encoded_at).alias("own_at"))
    newest = df.join(per.select(entity, uid, "own_at"), [entity, uid]).where(F.col(encoded_at) == F.col("own_at")).groupBy(entity, uid).agg(F.count("*").alias("own_c"), F.min(source).alias("own_new"))
    both = per.where("own_n > 1").join(newest, [entity, uid], "left")
    return both.select(entity, uid, F.when(F.col("own_ok") == 1, F.col("own_sole")).when(F.col("own_c") == 1, F.col("own_new")).alias("keep"))
