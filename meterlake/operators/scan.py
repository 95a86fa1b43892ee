"""The scan below every display query: one filter on all branches, reviewed days from the ledger, reports on top.

Three branches give facts: collected usage, the record ledger (for days that were
reviewed and cut over to it) and vendors' daily reports. A ``Match`` is applied to each of
them before anything is joined, so that each branch's source sees it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import report_tool
from ..functions.lineage import settled
from ..functions.semantics import KNOWN, METRICS, UNKNOWN, observe
from .ledger import CHAIN, ledger_rows, marked_chain, measured, with_digest
from .merge import replace_reviewed

FIELDS = (*METRICS, "requests")
#: Columns of a fact; ``hour`` is null on rows of whole days.
FACT = ["date", "hour", "tool", "model", "member_id", "external_id", "machine_id", "source", "date_basis", *FIELDS, *[f"ev_{f}" for f in FIELDS]]

_BOUNDS = {
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "ne": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != v),
    "in": lambda c, v: reduce(lambda a, b: a | b, [c.isNull() if x is None else c == x for x in v], F.lit(False)),
}


@dataclass(frozen=True)
class Match:
    """A filter on facts: by field a value (null: missing), or bounds by operator: gte, lte, gt, lt, ne, in.

    Only what is null is missing; a missing value is within no bound but ``ne``.
    """

    terms: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        for name, term in self.terms.items():
            if isinstance(term, Mapping) and not set(term) <= set(_BOUNDS):
                raise ValueError(f"{name}: bounds are {', '.join(_BOUNDS)}")

    def within(self, *fields: str) -> bool:
        """Whether no other field is asked for."""
        return set(self.terms) <= set(fields)

    def without(self, *fields: str) -> Match:
        return Match({k: v for k, v in self.terms.items() if k not in fields})

    def on(self, rows: DataFrame) -> DataFrame:
        """The rows that fit. Each term is a filter of its own, plain enough for a source to use."""
        for name, term in self.terms.items():
            bounds = term.items() if isinstance(term, Mapping) else [("in", [term])]
            for op, value in bounds:
                rows = rows.where(_BOUNDS[op](F.col(name), value))
        return rows


def facts_of(rows: DataFrame) -> DataFrame:
    """Rows as facts; columns they lack are null."""
    rows = rows.withColumnRenamed("ev_cache_creation", "ev_cache_creation_tokens")
    kinds = {**{f: "long" for f in FIELDS}, "member_id": "long"}
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FACT])


# Cutover. A reviewed scope is a member's tool and day with what the review saw of the ledger.
REVIEWED = "member_id long, tool string, date string, accounts array<string>, expected long, ledger_digest string, conflicts long"


def scope_state(records: DataFrame, scopes: DataFrame) -> DataFrame:
    """What the ledger holds for each scope, from its beginning to the end of the scope's day.

    Rows ``member_id, tool, date, n, digest, seen_accounts, unverified, unknown``. The
    digest is that of all (record, digest) pairs in any order: their hashes' sums, so
    it needs no one place where a ledger is put together.
    """
    s = scopes.select("member_id", "tool", "date")
    r = records.join(s.withColumnRenamed("date", "until"), ["member_id", "tool"]).where(F.col("date") <= F.col("until"))
    own = F.sha2(F.concat_ws("|", "account_id", "record_id", "digest"), 256)
    piece = lambda i: F.conv(F.substring(own, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    told = (F.col("kind") == "cumulative") | (F.col("date") == F.col("until"))
    open_ = F.exists(F.array(*[F.coalesce(F.col(f"ev_{m}"), F.lit(UNKNOWN)) == UNKNOWN for m in measured(records)]), lambda x: x)
    sums = F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[F.sum(piece(i)).cast("string") for i in range(4)])
    return r.groupBy("member_id", "tool", F.col("until").alias("date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(sums, 256).alias("digest"),
        F.array_sort(F.collect_set("account_id")).alias("seen_accounts"),
        F.bool_or((F.col("identity_quality") != "native") | (F.col("completeness") != "final")).alias("unverified"),
        F.bool_or(told & open_).alias("unknown"),
    )


def _kst(c: Column, form: str) -> Column:
    return F.date_format(c + F.expr("INTERVAL 9 HOURS"), form)


def dated(records: DataFrame) -> DataFrame:
    """Records with the Korean ``date`` of what they tell and their ``digest``."""
    have = set(records.columns)
    records = records if "date" in have else records.withColumn("date", _kst(F.col("occurred_at"), "yyyy-MM-dd"))
    return records if "digest" in have else with_digest(records)


def cutover_facts(records: DataFrame, scopes: DataFrame, *, today: str, grain: str = "day") -> tuple[DataFrame, DataFrame]:
    """The reviewed days' facts from the ledger, and the scopes with ``blockers``, an array that is empty where a review still holds.

    A scope is blocked while its day is open, when its ledger has changed since or is
    of other accounts, when a record is unverified or lacks a metric, when anything
    conflicts, and when its day has no facts or an unverified one.
    """
    records = dated(records)
    last = scopes.groupBy("member_id", "tool").agg(F.max("date").alias("last"))
    history = records.join(last, ["member_id", "tool"]).where(F.col("date") <= F.col("last")).drop("last")
    chain = marked_chain(history)
    day, hour = _kst(F.col("occurred_at"), "yyyy-MM-dd"), _kst(F.col("occurred_at"), "yyyy-MM-dd'T'HH")
    kept = chain.where("accepted").withColumn("date", day).withColumn("hour", hour if grain == "hour" else F.lit(None).cast("string"))
    derived = ledger_rows(kept, [*CHAIN, "date", "hour", "model"]).join(scopes.select("member_id", "tool", "date"), ["member_id", "tool", "date"], "left_semi")

    wrong = chain.where("ambiguous OR reset OR impossible").select("member_id", "tool", day.alias("at"))
    wrong = wrong.join(scopes.select("member_id", "tool", "date"), ["member_id", "tool"]).where("at <= date").groupBy("member_id", "tool", "date").agg(F.count(F.lit(1)).alias("n_wrong"))
    seen = derived.groupBy("member_id", "tool", "date").agg(F.bool_or(~F.col("verified")).alias("shaky"))
    key = ["member_id", "tool", "date"]
    s = scopes.join(scope_state(records, scopes), key, "left").join(wrong, key, "left").join(seen, key, "left")
    rules = [
        ("open_or_future_day", F.col("date") >= today),
        ("ledger_changed_or_incomplete", ~F.coalesce((F.col("n") == F.col("expected")) & (F.col("digest") == F.col("ledger_digest")), F.lit(False))),
        ("account_scope_mismatch", ~F.coalesce(F.col("seen_accounts") == F.array_sort(F.array_distinct("accounts")), F.lit(False))),
        ("unverified_source", F.coalesce("unverified", F.lit(False))),
        ("source_metrics_unknown", F.coalesce("unknown", F.lit(False))),
        ("unresolved_conflicts", F.coalesce("conflicts", F.lit(0)) + F.coalesce("n_wrong", F.lit(0)) > 0),
        ("target_day_unobserved", F.col("shaky").isNull()),
        ("unverified_derived", F.coalesce("shaky", F.lit(False))),
    ]
    blockers = F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())
    facts = derived.select("*", F.col("account_id").alias("external_id"), F.lit("").alias("machine_id"), F.lit("uploader-records").alias("source"), F.lit("KST").alias("date_basis"))
    return facts_of(facts), s.select(*scopes.columns, blockers.alias("blockers"))


def approved(scopes: DataFrame) -> DataFrame:
    """The scopes' keys; one that is blocked is an error, never a silent return to what was collected before. So is one that stands there twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("member_id", "tool", "date")) > 1
    said = F.concat(F.lit("reviewed collection scope requires reconciliation: "), F.array_join("blockers", ","))
    right = F.when(F.size("blockers") > 0, F.raise_error(said)).when(twice, F.raise_error(F.lit("duplicate cutover scope"))).otherwise(F.lit(True)).cast("boolean")
    return scopes.withColumn("right", right).where("right").select("member_id", "tool", "date")


# Reports. Rows of snapshots: account_id, period_start, period_end, collected_at, product, model, external_id and these.
SHEET = ("prompt_tokens", "uncached_input_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "reported_requests")


def report_facts(rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Facts of one-day reports, of each account and day the snapshot collected last.

    The whole of the input side counts only where a report doesn't split it. A column
    that a report has is a measurement, 0 too; one it lacks stays unknown. Rows without
    a positive value are none. Members are found by address (``email, member_id``).
    """
    one = rows.where("period_start = period_end")
    latest = F.max("collected_at").over(Window.partitionBy("account_id", "period_start"))
    one = one.withColumn("latest", latest).where("collected_at = latest")
    split = F.coalesce("uncached_input_tokens", "cache_read_tokens", "cache_write_tokens").isNotNull()
    said = {
        "input_tokens": F.when(split, F.col("uncached_input_tokens")).otherwise(F.col("prompt_tokens")),
        "output_tokens": F.col("completion_tokens"),
        "cache_read_tokens": F.col("cache_read_tokens"),
        "cache_creation_tokens": F.col("cache_write_tokens"),
        "requests": F.col("reported_requests"),
    }
    said = {f: F.when((v >= 0) & (v.cast("double") < float("inf")), v) for f, v in said.items()}
    mail = F.lower(F.trim(F.coalesce("external_id", F.lit(""))))
    out = one.select(
        F.col("period_start").alias("date"), report_tool(F.col("product")).alias("tool"), F.coalesce("model", F.lit("")).alias("model"), mail.alias("external_id"), F.lit("").alias("machine_id"),
        F.lit("claude-spend-csv").alias("source"), F.lit("UTC").alias("date_basis"), *[v.alias(f) for f, v in said.items()],
    )
    out = out.where(F.greatest(*[F.coalesce(f, F.lit(0)) for f in said]) > 0)
    out = out.join(addresses.select(F.col("email").alias("external_id"), "member_id").where("external_id != ''"), "external_id", "left")
    return facts_of(out.select("*", *[F.when(F.col(f).isNotNull(), KNOWN).alias(f"ev_{f}") for f in said]))


def larger_side(collected: DataFrame, reports: DataFrame, tool: str = "claude_code") -> DataFrame:
    """Collected facts with reports: products of their own are added, of ``tool`` a person's day keeps the larger side.

    Larger is who has more tokens without cache reads, then more requests; on a tie
    what was collected stays, which has devices and hours. Each side is read once; a
    window over a person's day sizes both.
    """
    seen = lambda f: F.coalesce(observe(f, F.col(f"ev_{f}"))["value"], F.lit(0.0))
    who = F.when(F.col("member_id").isNull(), F.concat(F.lit("x"), F.lower("external_id"))).otherwise(F.concat(F.lit("m"), F.col("member_id").cast("string")))
    both = F.col("tool") == tool
    rows = collected.select(*FACT, F.lit(False).alias("theirs")).unionByName(reports.select(*FACT, F.lit(True).alias("theirs")))
    rows = rows.select("*", who.alias("who"), sum((seen(f) for f in ("input_tokens", "output_tokens", "cache_creation_tokens")), F.lit(0.0)).alias("t"), seen("requests").alias("q"))
    day = Window.partitionBy("who", "date")
    size = lambda side: F.struct(*[F.coalesce(F.sum(F.when(both & (F.col("theirs") == side), F.col(c))).over(day), F.lit(0.0)).alias(c) for c in "tq"])
    rows = rows.withColumn("won", size(True) > size(False))
    return rows.where(~both | (F.col("theirs") == F.col("won"))).select(*FACT)


@dataclass(frozen=True)
class Review:
    """Records of the ledger, the scopes reviewed (columns of REVIEWED) and the first day that is still open."""

    records: DataFrame
    scopes: DataFrame
    today: str


@dataclass(frozen=True)
class Reports:
    """Report rows and the address book that finds their members."""

    rows: DataFrame
    addresses: DataFrame


def display_scan(collected: DataFrame, match: Match, *, grain: str = "day", review: Review | None = None, reports: Reports | None = None) -> DataFrame:
    """Facts of one grain for a display query: collected ones that fit, reviewed scopes replaced, reports merged.

    Reviewed scopes are taken only for filters on date, hour, member and tool, reports
    only on days and for filters on date and member: any other filter asks for rows
    that these branches can't tell apart, and leaves them out rather than widen
    what is seen.
    """
    facts = match.on(facts_of(collected))
    if review is not None and match.within("date", "hour", "member_id", "tool"):
        scopes = match.without("hour").on(review.scopes)
        # the ledger is read from its beginning, so only the filters on whose it is and an upper end of the days hold there
        derived, checked = cutover_facts(_history(match).on(dated(review.records)), scopes, today=review.today, grain=grain)
        facts = replace_reviewed(facts, match.on(derived), settled(approved(checked)))
    if reports is not None and grain == "day" and match.within("date", "member_id"):
        # a report's period is its facts' date; its member is known only after the address book
        dates = Match({"period_start": match.terms["date"]} if "date" in match.terms else {})
        facts = larger_side(facts, match.on(report_facts(dates.on(reports.rows), reports.addresses)))
    return facts


def _history(match: Match) -> Match:
    """The filter as far as it may cut a ledger that counts from its beginning: no lower end of days, no hours."""
    terms = {k: v for k, v in match.terms.items() if k in ("member_id", "tool")}
    when = match.terms.get("date")
    if isinstance(when, Mapping):
        upper = {op: v for op, v in when.items() if op in ("lte", "lt")}
        if upper:
            terms["date"] = upper
    elif when is not None:
        terms["date"] = {"lte": when}
    return Match(terms)
