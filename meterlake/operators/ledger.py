"""The record ledger: cumulative snapshots to deltas, classification of arriving records, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import KNOWN, METRICS, poisoned_sum


def snapshot_deltas(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Running totals to what each added: a null adds nothing and leaves the base, a fall starts anew from 0.

    Rows that add nothing in any field are left out.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = lambda f: F.last(f, ignorenulls=True).over(before)
    base = lambda f: F.when(prev(f).isNull() | (F.col(f) < prev(f)), 0).otherwise(prev(f))
    out = rows.select("*", *[(F.col(f) - base(f)).alias(f"d_{f}") for f in fields])
    some = F.exists(F.array(*[F.coalesce(f"d_{f}", F.lit(0)) for f in fields]), lambda x: x != 0)
    return out.where(some)


CHAIN = ["member_id", "tool", "account_id", "session_id"]


def measured(records: DataFrame) -> tuple[str, ...]:
    return (*METRICS, "requests") if "requests" in records.columns else METRICS


def marked_chain(records: DataFrame) -> DataFrame:
    """Records of ``CHAIN``, all of them, with their contribution ``d_*`` and ``accepted, ambiguous, reset, impossible, verified``.

    Events count as they are. Cumulative records of one instant that disagree are
    all left out, and the chain is tainted from there on; so do a change of model,
    an incomplete or foreign record, a fall of a counter, and more cache reads than
    input. A tainted chain still counts, but not as verified. Requests are a metric
    where the records have them.
    """
    metrics = measured(records)
    cum = F.col("kind") == "cumulative"
    sign = F.xxhash64(*[F.coalesce(F.col(m).cast("string"), F.lit("null")) for m in metrics], "model", "provider")
    instant = Window.partitionBy(*CHAIN, "occurred_at")
    r = records.withColumn("sign", F.when(cum, sign))
    r = r.select("*", F.min("sign").over(instant).alias("s_min"), F.max("sign").over(instant).alias("s_max"), F.count("sign").over(instant).alias("n_cum"))
    r = r.withColumn("ambiguous", cum & (F.col("s_min") != F.col("s_max")))
    r = r.withColumn("nth", F.row_number().over(Window.partitionBy(*CHAIN, "occurred_at", cum).orderBy("record_id")))
    r = r.withColumn("accepted", ~cum | (~F.col("ambiguous") & (F.col("nth") == 1)))
    along = Window.partitionBy(*CHAIN).orderBy("occurred_at", "record_id")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    usable = cum & F.col("accepted")
    prev_model = F.last(F.when(usable, F.col("model")), ignorenulls=True).over(before)
    value = lambda m: F.when(usable & (F.col(f"ev_{m}") == KNOWN), F.col(m))
    prev = lambda m: F.last(value(m), ignorenulls=True).over(before)
    r = r.select(
        "*",
        *[F.when(~cum, F.col(m)).when(prev(m).isNull() | (value(m) < prev(m)), value(m)).otherwise(value(m) - prev(m)).alias(f"d_{m}") for m in metrics],
        F.exists(F.array(*[F.coalesce(value(m) < prev(m), F.lit(False)) for m in metrics]), lambda x: x).alias("reset"),
        (usable & ((F.col("completeness") != "final") | (F.col("identity_quality") != "native") | F.coalesce(prev_model != F.col("model"), F.lit(False)))).alias("odd"),
    )
    impossible = usable & F.coalesce(F.col("d_cache_read_tokens") > F.col("d_input_tokens"), F.lit(False))
    r = r.withColumn("impossible", impossible)
    fresh = F.col("d_input_tokens") - F.col("d_cache_read_tokens")
    r = r.withColumn("d_input_tokens", F.when(~cum, F.col("d_input_tokens")).when(fresh.isNotNull(), F.greatest(F.lit(0), fresh)))
    taint = F.max(F.col("ambiguous") | F.col("odd") | F.col("reset") | F.col("impossible")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    sound = (F.col("completeness") == "final") & (F.col("identity_quality") == "native")
    return r.withColumn("taint", taint).withColumn("verified", sound & (~(F.col("kind") == "cumulative") | ~F.col("taint")))


def derive_chain(records: DataFrame) -> DataFrame:
    """The records of a chain that count, as ``marked_chain`` has them."""
    return marked_chain(records).where("accepted")


def ledger_rows(chain: DataFrame, keys: list[str]) -> DataFrame:
    """What counts, added up by keys and verification; one missing value makes a sum missing, and its evidence unknown."""
    metrics = measured(chain)
    sums = [poisoned_sum(F.col(f"d_{m}")).alias(m) for m in metrics]
    out = chain.groupBy(*keys, "verified").agg(*sums, F.count_if("reset").alias("resets"))
    return out.select("*", *[F.when(F.col(m).isNotNull(), KNOWN).otherwise("unknown").alias(f"ev_{m}") for m in metrics])


def ledger_days(chain: DataFrame) -> DataFrame:
    """Derived rows by day, model and verification."""
    day = F.date_format(F.col("occurred_at") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")
    days = ledger_rows(chain.withColumn("date", day), ["member_id", "tool", "date", "model"])
    return days.select("member_id", "tool", "date", "model", "verified", *METRICS, "resets")


#: A partial record whose metrics a later one raises: stored, as both together.
MERGED = "merged"


def _decide(s: Column, n: Column) -> Column:
    """What becomes of record n where s is stored, by the first rule that holds."""
    differ = lambda f: ~s[f].eqNullSafe(n[f])
    same_else = F.forall(F.array(*[s[f].eqNullSafe(n[f]) for f in RECORD if f != "model"]), lambda x: x)
    raised = F.exists(F.array(*[F.coalesce((n[f"ev_{m}"] == KNOWN) & n[m].isNotNull() & (s[m].isNull() | (n[m] > s[m])), F.lit(False)) for m in METRICS]), lambda x: x)
    native = (s["identity_quality"] == "native") & (n["identity_quality"] == "native")
    one_unknown = (s["model"] == "unknown") | (n["model"] == "unknown")
    model_only = (n["kind"] == "cumulative") & differ("model") & one_unknown & same_else
    return (
        F.when(s["record_id"].isNull(), "stored")
        .when(F.forall(F.array(*[s[f].eqNullSafe(n[f]) for f in RECORD]), lambda x: x), "unchanged")
        .when(differ("session_id") | differ("kind"), "conflict:identity_collision")
        .when(differ("occurred_at") & ~((n["revision"] > s["revision"]) & native), "conflict:unverified_timestamp_correction")
        .when(n["parser_version"] < s["parser_version"], "conflict:parser_downgrade")
        .when(n["revision"] < s["revision"], "superseded:older_revision")
        .when((s["completeness"] == "final") & (n["completeness"] == "partial"), "superseded:final_dominates_partial")
        .when(n["revision"] > s["revision"], "stored")
        .when(differ("parser_version"), "conflict:unverified_parser_correction")
        .when(model_only & (s["model"] == "unknown"), "stored")
        .when(model_only, "superseded:model_already_known")
        .when((s["completeness"] == "partial") & (n["completeness"] == "final"), "stored")
        .when(s["completeness"] == "final", "conflict:same_revision_final_conflict")
        .when(n["kind"] != "event", "conflict:same_revision_snapshot_conflict")
        .when(differ("model") | differ("provider") | differ("identity_quality"), "conflict:same_revision_metadata_conflict")
        .when(raised, MERGED)
        .otherwise("superseded:partial_not_newer")
    )


def _raised(s: Column, n: Column) -> Column:
    """Record s with the metrics that n knows to be larger."""
    up = lambda m: F.coalesce((n[f"ev_{m}"] == KNOWN) & n[m].isNotNull() & (s[m].isNull() | (n[m] > s[m])), F.lit(False))
    news = {m: F.when(up(m), n[m]).otherwise(s[m]) for m in METRICS} | {f"ev_{m}": F.when(up(m), KNOWN).otherwise(s[f"ev_{m}"]) for m in METRICS}
    return F.struct(n["arrival"].alias("arrival"), *[news.get(f, s[f]).alias(f) for f in RECORD])


RECORD = ["record_id", "session_id", "kind", "occurred_at", "model", "provider", "parser_version", "revision", "completeness", "identity_quality", *METRICS, *[f"ev_{m}" for m in METRICS]]
KEY = ["member_id", "tool", "account_id"]


def with_digest(records: DataFrame) -> DataFrame:
    """Records with the digest of all that they tell."""
    told = [*RECORD, "requests", "ev_requests"] if "requests" in records.columns else RECORD
    return records.withColumn("digest", F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256))


def classify(records: DataFrame) -> DataFrame:
    """``KEY, record_id, arrival, decision`` of records in order of arrival, the ledger beginning empty.

    The versions of one record, a handful, are folded over a sorted array.
    """
    r = records
    item = F.struct("arrival", *RECORD)
    g = r.groupBy(*KEY, F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("versions"))
    kind = r.select(item.alias("x")).schema["x"].dataType.simpleString()
    zero = F.struct(F.lit(None).cast(kind).alias("kept"), F.array().cast("array<struct<arrival:bigint,decision:string>>").alias("said"))

    def step(state: Column, n: Column) -> Column:
        decision = _decide(state["kept"], n)
        told = F.when(decision == MERGED, "stored").otherwise(decision)
        said = F.concat(state["said"], F.array(F.struct(n["arrival"].cast("long").alias("arrival"), told.alias("decision"))))
        kept = F.when(decision == "stored", n).when(decision == MERGED, _raised(state["kept"], n)).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), said.alias("said"))

    out = g.select(*KEY, "id", F.explode(F.aggregate("versions", zero, step)["said"]).alias("x"))
    return out.select(*KEY, F.col("id").alias("record_id"), "x.arrival", "x.decision")


def reconcile(sent: DataFrame, stored: DataFrame) -> DataFrame:
    """``record_id, receipt``: matched, different or missing."""
    s = stored.select("record_id", F.col("digest").alias("have"))
    receipt = F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("digest"), "matched").otherwise("different")
    return sent.join(s, "record_id", "left").select("record_id", receipt.alias("receipt"))
