"""Verdicts about recordings as a stream: the state of a key is its last verdict."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumlake.operators import availability as media

STATE = "state string, silent int, partial int, fingerprint string, profile string, override string, override_reason string, recovered_at timestamp, last_check timestamp"
NONE = {"state": None, "silent": 0, "partial": 0, "fingerprint": None, "profile": "", "override": None, "override_reason": "", "recovered_at": None, "last_check": None}


def after(held: dict | None, row: dict) -> dict | None:
    """The verdict after one observation."""
    kind, at = row["kind"], row["at"]
    if kind == media.TRANSPORT:
        return held and held | {"last_check": at}
    if kind == media.OVERRIDE:
        if row["state"] is None and held is None or row["state"] is not None and row["state"] not in media.SETTABLE:
            return held
        return (held or NONE | {"state": "available"}) | {"override": row["state"], "override_reason": row["reason"] or "" if row["state"] else "", "last_check": at}
    if kind not in media.CONTENT:
        return held
    known = held["fingerprint"] if held else None
    base = NONE if held is None or row["fingerprint"] and known and row["fingerprint"] != known else held
    silent, partial = (base[c] + 1 if kind == c else 0 for c in (media.SILENT, media.PARTIAL))
    ends = kind == media.PLAYABLE and (base["override"] or base["state"]) in media.WITHHELD
    sure = max(silent, partial) >= media.CONFIRMED_AT
    state = {media.SILENT: "confirmed_empty" if sure else "suspected_empty", media.PARTIAL: "confirmed_partial" if sure else "suspected_partial", media.DEAD: "invalid", media.MISSING: "missing", media.PLAYABLE: "recovered" if ends else "available"}[kind]
    return base | {"state": state, "silent": silent, "partial": partial, "fingerprint": row["fingerprint"] or known, "profile": row["profile"] or (held or NONE)["profile"], "recovered_at": at if ends else base["recovered_at"], "last_check": at}


class Verdicts(StatefulProcessor):
    """Folds a key's observations of a batch, in order, into its verdict."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("verdict", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        found = self.held.get()
        held = dict(zip(NONE, found)) if found is not None else None
        every = pd.concat(list(rows)).sort_values(self.order, kind="stable").astype(object)
        for row in every.where(every.notna(), None).to_dict("records"):
            held = after(held, row)
        if held is None:
            return
        self.held.update(tuple(held[c] for c in NONE))
        effective = held["override"] or held["state"]
        told = [key[0], held["state"], effective, effective in media.WITHHELD, *[held[c] for c in ("silent", "partial", "fingerprint", "profile", "override", "override_reason", "recovered_at", "last_check")]]
        yield pd.DataFrame([told], columns=[self.key, *[c.split()[0] for c in media.VERDICT.split(", ")]])

    def close(self) -> None:
        pass


def verdict_stream(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The verdicts of the keys of each batch after it. log: key, at, order, kind, fingerprint, profile, state, reason; a key's observations come in order from batch to batch. Needs the RocksDB state store."""
    kind = dict(log.dtypes)[key]
    return log.groupBy(key).transformWithStateInPandas(Verdicts(key, order), f"{key} {kind}, {media.VERDICT}", "Update", "None")
