"""Summaries of judgments: who answered, what was quoted, where judges agree, what was escalated, and how probes came out.

Judgments are rows: subject, task, question, tier, role, model, sample, kind, said (a vote or null), quote_valid (or null), seq (their place in the ledger).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vote counts unless an adjudicator's quote isn't in the evidence.
USABLE = "(role <> 'adjudicator' or coalesce(quote_valid, true))"


def quote_counts(rows: DataFrame) -> DataFrame:
    """role, model, valid, invalid and unchecked: answers of siblings and adjudicators by whether their quote was in the evidence."""
    q = F.col("quote_valid")
    return rows.where("role in ('sibling', 'adjudicator')").groupBy("role", "model").agg(F.count_if(q).alias("valid"), F.count_if(~q).alias("invalid"), F.count_if(q.isNull()).alias("unchecked"))


def agreement(rows: DataFrame, families: DataFrame) -> DataFrame:
    """model, task, question, tier, agree, pairs and rate: each anchor's last vote on a subject beside that of the first sibling of another family. families: model and family; a model without one is a family of its own."""
    votes = rows.where("kind = 'validate' and said is not null and role in ('anchor', 'sibling')")
    keys = ["subject", "task", "question", "tier"]
    last = votes.groupBy(*keys, "role", "model").agg(F.max_by("said", "seq").alias("said"), F.min("seq").alias("first"))
    known = last.join(families, "model", "left").withColumn("family", F.coalesce("family", "model"))
    a = known.where("role = 'anchor'").select(*keys, "model", F.col("family").alias("own_family"), F.col("said").alias("own_said"))
    b = known.where("role = 'sibling'").select(*keys, "family", "said", "first")
    first = a.join(b, keys).where("family <> own_family").groupBy(*keys, "model", "own_said").agg(F.min_by("said", "first").alias("said"))
    out = first.groupBy("model", "task", "question", "tier").agg(F.count_if(F.col("said") == F.col("own_said")).alias("agree"), F.count("*").alias("pairs"))
    return out.withColumn("rate", F.round(F.col("agree") / F.col("pairs"), 4))


def escalation(rows: DataFrame, tier: str) -> DataFrame:
    """model, escalated and subjects: of the subjects that a model anchored in the first tier, those that it was asked again about."""
    seen = rows.groupBy("subject", "model").agg(F.max((F.col("role") == "anchor") & (F.col("tier") == tier)).alias("own_first"), F.max(F.col("sample") == "escalation").alias("own_again"))
    return seen.where("own_first").groupBy("model").agg(F.count_if("own_again").alias("escalated"), F.count("*").alias("subjects"))


def probe_results(rows: DataFrame, truths: DataFrame) -> DataFrame:
    """model, asked, scored, correct and unsupported over probes. truths: subject and truth; probes without one are counted but not scored."""
    both = rows.join(truths.withColumn("own_probe", F.lit(True)), "subject", "left")
    scored = F.expr(USABLE) & F.col("truth").isNotNull() & F.col("said").isNotNull()
    return both.groupBy("model").agg(F.count("*").alias("asked"), F.count_if(scored).alias("scored"), F.count_if(scored & (F.col("said") == F.col("truth"))).alias("correct"), F.count_if(F.col("quote_valid") == F.lit(False)).alias("unsupported"))


def stability(rows: DataFrame) -> DataFrame:
    """model, again and changed: second askings (question with _s) beside the routine answer of the same model, subject and tier, the last one of the ledger."""
    usable = rows.where(USABLE).where("said is not null")
    routine = usable.where("sample = 'routine'").groupBy("subject", "task", "model", "question", "tier").agg(F.max_by("said", "seq").alias("own_said"))
    again = usable.where("sample = 'stability'").withColumn("question", F.regexp_replace("question", "_s$", ""))
    met = again.join(routine, ["subject", "task", "model", "question", "tier"])
    return met.groupBy("model").agg(F.count("*").alias("again"), F.count_if(F.col("said") != F.col("own_said")).alias("changed"))


