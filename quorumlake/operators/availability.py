"""Whether recordings can be played, from logs of observations: confirmations, new source bytes, operators' overrides.

Observations of a key, in order, are of a kind: ``silent``, ``partial``, ``playable``, ``dead``, ``missing``,
``transport_failed`` or ``override`` (an operator's call: a state, or null to clear it). Silence and short sources are
suspected at first and confirmed by the second observation in a row. A failed transport says nothing about the recording.
A fingerprint other than the last one known retires confirmations, overrides and recoveries. ``verdicts`` has no fold: what
a fold would carry along are runs, counts and last values over windows of a key's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENT, PARTIAL, PLAYABLE, DEAD, MISSING, TRANSPORT, OVERRIDE = "silent", "partial", "playable", "dead", "missing", "transport_failed", "override"
CONTENT = (SILENT, PARTIAL, PLAYABLE, DEAD, MISSING)
#: States that aren't published, and those that an operator can set.
WITHHELD = ("suspected_empty", "confirmed_empty", "missing", "invalid")
SETTABLE = (*WITHHELD, "available", "recovered", "suspected_partial", "confirmed_partial")
CONFIRMED_AT = 2
#: What a verdict holds besides its key.
VERDICT = "state string, effective string, withheld boolean, silent_confirmations int, partial_confirmations int, fingerprint string, profile string, override string, override_reason string, recovered_at timestamp, last_check timestamp"


def state_of(kind: Column, times: Column, recovered: Column) -> Column:
    """The state after an observation: its kind, how many of them in a row, and whether it ends a withheld state."""
    sure = times >= CONFIRMED_AT
    content = F.when(kind == SILENT, F.when(sure, "confirmed_empty").otherwise("suspected_empty")).when(kind == PARTIAL, F.when(sure, "confirmed_partial").otherwise("suspected_partial"))
    return content.when(kind == DEAD, "invalid").when(kind == MISSING, "missing").when(kind.isNull() | ~recovered, "available").otherwise("recovered")


def verdicts(log: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """by, order and the verdict after each row of a log from the first one that gives a verdict. log: by, at, order, kind, fingerprint, profile, state and reason (of overrides). Rows of one key differ in order; overrides to a state that can't be set, and kinds that aren't known, change nothing."""
    known = log.where(F.col("kind").isin(*CONTENT, TRANSPORT) | ((F.col("kind") == OVERRIDE) & (F.col("state").isNull() | F.col("state").isin(*SETTABLE))))
    content, called = F.col("kind").isin(*CONTENT), F.col("kind") == OVERRIDE
    w = Window.partitionBy(*by).orderBy(*order)
    before, now = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda value, over: F.last(value, ignorenulls=True).over(over)
    own = known.withColumn("own_print", F.when(content & (F.col("fingerprint") != ""), F.col("fingerprint"))).withColumn("own_prior", last(F.col("own_print"), before))
    own = own.withColumn("own_epoch", F.sum(F.coalesce(F.col("own_print") != F.col("own_prior"), F.lit(False)).cast("int")).over(now))
    e = Window.partitionBy(*by, "own_epoch").orderBy(*order)
    e_before, e_now = e.rowsBetween(Window.unboundedPreceding, -1), e.rowsBetween(Window.unboundedPreceding, 0)
    seen, call = F.when(content, F.col("kind")), F.when(called, F.struct("state", "reason"))
    own = own.withColumns({"own_kind": last(seen, e_before), "own_call": last(call, e_before)})
    own = own.withColumn("own_run", F.sum((content & ~F.col("kind").eqNullSafe(F.col("own_kind"))).cast("int")).over(e_now))
    withheld = F.coalesce(F.col("own_call.state").isin(*WITHHELD), F.col("own_kind").isin(SILENT, DEAD, MISSING), F.lit(False))
    own = own.withColumn("own_back", content & (F.col("kind") == PLAYABLE) & withheld)
    run = Window.partitionBy(*by, "own_epoch", "own_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"own_times": F.sum(content.cast("int")).over(run).cast("int"), "own_now": last(F.when(content, F.struct("kind", F.col("own_back").alias("back"))), e_now), "own_set": last(call, e_now)})
    own = own.withColumns({"own_any": F.max(content | (called & F.col("state").isNotNull())).over(now), "own_recovered": last(F.when(F.col("own_back"), F.col(at)), e_now)})
    kind, times = F.col("own_now.kind"), F.col("own_times")
    told = own.where("own_any").withColumn("own_state", state_of(kind, times, F.coalesce("own_now.back", F.lit(False)))).withColumn("own_effective", F.coalesce("own_set.state", "own_state"))
    # a verdict's profile and fingerprint outlive new bytes; a run's count is that of its last observation
    return told.select(
        *by,
        *order,
        F.col("own_state").alias("state"),
        F.col("own_effective").alias("effective"),
        F.col("own_effective").isin(*WITHHELD).alias("withheld"),
        F.when(kind == SILENT, times).otherwise(0).alias("silent_confirmations"),
        F.when(kind == PARTIAL, times).otherwise(0).alias("partial_confirmations"),
        last(F.col("own_print"), now).alias("fingerprint"),
        F.coalesce(last(F.when(content & (F.col("profile") != ""), F.col("profile")), now), F.lit("")).alias("profile"),
        F.col("own_set.state").alias("override"),
        F.coalesce(F.when(F.col("own_set.state").isNotNull(), F.col("own_set.reason")), F.lit("")).alias("override_reason"),
        F.col("own_recovered").alias("recovered_at"),
        F.col(at).alias("last_check"),
    )


def latest_verdicts(log: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """The verdict of each key after all of its log."""
    every = verdicts(log, by, at, order)
    return every.withColumn("own_r", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]))).where("own_r = 1").drop("own_r", *order)
