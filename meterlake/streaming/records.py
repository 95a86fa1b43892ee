"""The ledger's decisions as a stream: each record's accepted version is state, kept by its key.

The same rules as ``ledger.classify``, one arrival at a time. Every arrival gets one row
with what became of it; the log of these rows tells how often a chain has changed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.semantics import KNOWN, METRICS
from ..operators.ledger import CHAIN, KEY, RECORD

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(s: dict | None, n: dict) -> tuple[str, dict | None]:
    """What becomes of record ``n`` where ``s`` is stored, and the record stored from now on."""
    if s is None:
        return "stored", n
    differs = {f for f in RECORD if s[f] != n[f]}
    newer, native = n["revision"] > s["revision"], s["identity_quality"] == n["identity_quality"] == "native"
    up = {m for m in METRICS if n[f"ev_{m}"] == KNOWN and n[m] is not None and (s[m] is None or n[m] > s[m])}
    relabelled = differs == {"model"} and n["kind"] == "cumulative" and "unknown" in (s["model"], n["model"])
    merged = s | {m: n[m] for m in up} | {f"ev_{m}": KNOWN for m in up}
    rules = (
        (not differs, "unchanged", s),
        (differs & {"session_id", "kind"}, "conflict:identity_collision", s),
        ("occurred_at" in differs and not (newer and native), "conflict:unverified_timestamp_correction", s),
        (n["parser_version"] < s["parser_version"], "conflict:parser_downgrade", s),
        (n["revision"] < s["revision"], "superseded:older_revision", s),
        (s["completeness"] == "final" and n["completeness"] == "partial", "superseded:final_dominates_partial", s),
        (newer, "stored", n),
        ("parser_version" in differs, "conflict:unverified_parser_correction", s),
        (relabelled and s["model"] == "unknown", "stored", n),
        (relabelled, "superseded:model_already_known", s),
        (s["completeness"] == "partial" and n["completeness"] == "final", "stored", n),
        (s["completeness"] == "final", "conflict:same_revision_final_conflict", s),
        (n["kind"] != "event", "conflict:same_revision_snapshot_conflict", s),
        (differs & {"model", "provider", "identity_quality"}, "conflict:same_revision_metadata_conflict", s),
        (up, "stored", merged),
    )
    return next(((what, kept) for holds, what, kept in rules if holds), ("superseded:partial_not_newer", s))


class Ledger(StatefulProcessor):
    """Holds a record's accepted version."""

    def __init__(self, schema: str):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = dict(zip(RECORD, self.kept.get())) if self.kept.exists() else None
        for row in sorted(rows, key=lambda r: r["arrival"]):
            said, kept = decide(kept, {f: row[f] for f in RECORD})
            yield Row(**{c: row[c] for c in (*KEY, "record_id", "session_id", "arrival")}, decision=said)
        if kept is not None:
            self.kept.update(tuple(kept[f] for f in RECORD))

    def close(self) -> None:
        pass


def classified(records: DataFrame) -> DataFrame:
    """A stream of records with ``arrival`` to ``KEY, record_id, session_id, arrival, decision``.

    Arrivals of a later batch count as later. The session has to keep state in
    RocksDB (``PROVIDER``).
    """
    # instants as numbers: state gives clocks back in another zone
    records = records.withColumn("occurred_at", F.unix_micros(F.col("occurred_at").cast("timestamp")))
    kind = {f.name: f.dataType.simpleString() for f in records.schema}
    own = ", ".join(f"{f} {kind[f]}" for f in RECORD)
    out = ", ".join([*[f"{c} {kind[c]}" for c in KEY], f"record_id {kind['record_id']}", f"session_id {kind['session_id']}", "arrival long", "decision string"])
    rows = records.select(*KEY, *RECORD, F.col("arrival").cast("long").alias("arrival"))
    return rows.groupBy(*KEY, "record_id").transformWithState(Ledger(own), out, "Append", "None")


def generations(decisions: DataFrame) -> DataFrame:
    """``CHAIN, generation``: how often a chain was touched, by a stored record or one sent again."""
    return decisions.where(F.col("decision").isin("stored", "unchanged")).groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("generation"))
