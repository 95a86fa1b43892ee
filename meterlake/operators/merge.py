"""Merge operators: what a stored table becomes when a batch arrives, as pure functions of both.

``arrival`` orders observations; results depend on it and on nothing else. Where
the rule needs the rows of one key in order, a window over that key does it; keys
are (person, day, tool) or finer, so no window holds more than one person's day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import KNOWN, METRICS, UNSUPPORTED, default_evidence, machine_pseudonym, max_merged, sum_merged

# Which source wins for one logical key.
PRIORITY = {"poller": 2, "uploader": 1, "manual": 0}
LOGICAL = ["date", "tool", "model", "external_id"]
BUCKET = ["external_id", "tool", "session_id", "hour", "model"]


def priority(source: str = "source"):
    return F.coalesce(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col(source)], F.lit(0))


def upsert_usage(existing: DataFrame, incoming: DataFrame, *, bucket: str = "date") -> DataFrame:
    """Both tables as one: per logical key only the best source, per full key the latest arrival.

    A tagged row of a source drives out the untagged one of the same source (days
    only). Unknown sources have the lowest priority.
    """
    logical = [bucket, *LOGICAL[1:]]
    rows = existing.withColumn("new", F.lit(False)).unionByName(incoming.withColumn("new", F.lit(True)))
    rows = rows.withColumn("rank_of", priority()).withColumn("best", F.max("rank_of").over(Window.partitionBy(*logical))).where("rank_of = best")
    if bucket == "date":
        tagged = F.max(F.col("new") & (F.col("machine_id") != "")).over(Window.partitionBy(*logical, "source"))
        rows = rows.withColumn("tagged", tagged).where("NOT (tagged AND machine_id = '')").drop("tagged")
    last = Window.partitionBy(*logical, "machine_id").orderBy(F.desc("arrival"))
    return rows.withColumn("place", F.row_number().over(last)).where("place = 1").drop("new", "rank_of", "best", "place")


def merge_sessions(rows: DataFrame) -> DataFrame:
    """Session buckets by parser version: a late lower version is dropped, a higher one overwrites, an equal one takes each metric's maximum.

    Machine sets unite over every row that wasn't dropped.
    """
    so_far = F.max("parser_version").over(Window.partitionBy(*BUCKET).orderBy("arrival"))
    live = rows.withColumn("so_far", so_far).where("parser_version = so_far")
    final = F.max("parser_version").over(Window.partitionBy(*BUCKET))
    live = live.withColumn("top", final)
    best = [F.max(F.when(F.col("parser_version") == F.col("top"), F.col(m))).alias(m) for m in (*METRICS, "requests")]
    evidence = F.when(F.col("parser_version") == F.col("top"), default_evidence(F.col("input_tokens")))
    return live.groupBy(*BUCKET).agg(
        F.max("parser_version").alias("parser_version"), *best, F.array_sort(F.collect_set("machine_id")).alias("machine_ids"), max_merged(evidence).alias("ev_input_tokens")
    )


def drop_superseded(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored buckets that a batch doesn't replace by a newer parse of their session.

    Per person's session the batch's highest version and first hour count: stored
    buckets of a lower version from that hour on go, unless the batch has their key.
    """
    session = ["external_id", "tool", "session_id"]
    top = batch.groupBy(*session).agg(F.max("parser_version").alias("top"), F.min("hour").alias("since"))
    doomed = stored.join(top, session).where((F.col("parser_version") < F.col("top")) & (F.col("hour") >= F.col("since")))
    doomed = doomed.select(*BUCKET).join(batch.select(*BUCKET), BUCKET, "left_anti")
    return stored.join(doomed, BUCKET, "left_anti")


def merge_account_tags(tags: DataFrame, keys: list[str]) -> DataFrame:
    """``org`` of the strongest evidence; several at that strength are mixed."""
    strength = F.when(F.col("evidence") == "transcript", 2).when(F.col("evidence") == "hook", 1).otherwise(0)
    t = tags.withColumn("strength", strength).withColumn("top", F.max("strength").over(Window.partitionBy(*keys))).where("strength = top")
    orgs = F.collect_set("org")
    return t.groupBy(*keys).agg(F.when(F.size(orgs) > 1, "mixed").otherwise(F.element_at(orgs, 1)).alias("org"), F.max("strength").alias("strength"))


def derive_days(buckets: DataFrame) -> DataFrame:
    """Days from session buckets; the day's sessions are told on its first model row, the others have none."""
    b = buckets.withColumn("date", F.substring("hour", 1, 10))
    day = ["external_id", "tool", "date"]
    sums = b.groupBy(*day, "model").agg(*[F.sum(m).alias(m) for m in (*METRICS, "requests")], sum_merged(default_evidence(F.col("input_tokens"))).alias("ev_input_tokens"))
    n = b.groupBy(*day).agg(F.count_distinct("session_id").alias("n"))
    first = F.row_number().over(Window.partitionBy(*day).orderBy("model")) == 1
    return sums.join(n, day).withColumn("first", first).select(*day, "model", *METRICS, "requests", "ev_input_tokens", F.when(F.col("first"), F.col("n")).alias("sessions"), F.when(F.col("first"), KNOWN).otherwise(UNSUPPORTED).alias("ev_sessions"))


def merge_limits(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The last reading of a day and its high-water mark."""
    return readings.groupBy(*keys).agg(F.max_by("utilization_pct", "arrival").alias("utilization_pct"), F.max("utilization_pct").alias("peak_pct"))


def register_identities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Identities with those not known yet added; of several new ones the first by arrival."""
    first = incoming.groupBy("tool", "external_id").agg(F.min_by("member_id", "arrival").alias("member_id"))
    return existing.unionByName(first.join(existing, ["tool", "external_id"], "left_anti"))


def linked(facts: DataFrame, identities: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Facts without a member get that of their tool's identifier, by the registered identities (``tool, external_id, member_id``).

    A registered identity wins, whatever the address says; with a roster, identifiers that
    are a member's address are claimed next. Facts that have a member keep it. Of an
    identity registered twice the smallest member counts, so facts are never repeated.
    """
    own = identities.where("member_id IS NOT NULL").groupBy("tool", "external_id").agg(F.min("member_id").alias("registered"))
    out = facts.join(own, ["tool", "external_id"], "left").withColumn("member_id", F.coalesce("member_id", "registered")).select(*facts.columns)
    return out if roster is None else relink(out, roster).select(*facts.columns)


def relink(facts: DataFrame, roster: DataFrame) -> DataFrame:
    """Unlinked facts whose outside identifier is a member's address, whatever its case, get that member."""
    by_mail = roster.groupBy(F.lower("email").alias("mail")).agg(F.min("member_id").alias("claimed"))
    out = facts.join(by_mail, F.lower("external_id") == F.col("mail"), "left")
    return out.withColumn("member_id", F.coalesce("member_id", "claimed")).drop("mail", "claimed")


def divert(legacy: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy rows that stay, and those whose (person, tool, day) session data cover."""
    keys = ["external_id", "tool", "date"]
    return legacy.join(covered, keys, "left_anti"), legacy.join(covered, keys, "left_semi")


#: Fields that tell the scope of a report.
SCOPE = ["source_id", "account_id", "period_start", "period_end", "time_zone", "granularity", "coverage", "partition"]


def _scope() -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SCOPE])), 256)


def replace_reports(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored report rows with those of every scope of a batch replaced whole; a row that its scope no longer has is gone.

    ``batch`` has a ``snapshot`` beside the fields of ``stored``: two snapshots of one
    scope in a batch are an error. A snapshot without rows comes as one row whose
    ``external_id`` is null, and empties its scope.
    """
    b = batch.withColumn("scope", _scope())
    n = b.groupBy("scope").agg(F.count_distinct("snapshot").alias("n"))
    once = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.lit("two reports of one scope"))).cast("boolean")
    fresh = b.join(n, "scope").where(once)
    stays = stored.withColumn("scope", _scope()).join(fresh.select("scope").distinct(), "scope", "left_anti")
    return stays.select(*stored.columns).unionByName(fresh.where("external_id IS NOT NULL").select(*stored.columns))


def latest_reports(snapshots: DataFrame) -> DataFrame:
    """Report rows of each scope's latest arrival."""
    last = snapshots.withColumn("latest", F.max("arrival").over(Window.partitionBy(_scope())))
    return last.where("arrival = latest").drop("latest")


#: A session identifier that stands for a device's day, and its date.
DAY_SESSION = r"^grok-.{1,8}-(\d{4}-\d{2}-\d{2})$"


def drop_renamed(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored buckets that a batch doesn't replace under another name of their device's day.

    Both have BUCKET's columns, ``parser_version`` and ``machine_ids``, an array. A
    newer parser may name a device's days otherwise; then for each device in the
    batch, older versions' day sessions of the same person from its first day on go,
    unless the batch has them. Sessions with identifiers of their own stay.
    """
    day_of = F.regexp_extract("session_id", DAY_SESSION, 1)
    own = lambda df: df.where((F.col("tool") == "grok") & (day_of != "")).withColumn("machine", F.explode("machine_ids"))
    named = own(batch).select("external_id", "machine", "session_id", "parser_version", F.substring("hour", 1, 10).alias("day"))
    device = named.groupBy("external_id", "machine").agg(F.max("parser_version").alias("top"), F.min("day").alias("first"))
    stale = own(stored).withColumn("day", F.substring("hour", 1, 10)).where(day_of == F.col("day")).join(device, ["external_id", "machine"])
    stale = stale.where((F.col("day") >= F.col("first")) & (F.col("parser_version") < F.col("top")))
    stale = stale.join(named.select("external_id", "machine", "session_id").distinct(), ["external_id", "machine", "session_id"], "left_anti")
    return stored.join(stale.select(*BUCKET).distinct(), BUCKET, "left_anti")


def pseudonymous(rows: DataFrame) -> DataFrame:
    return rows.withColumn("machine_id", machine_pseudonym(F.col("machine_id")))


def replace_reviewed(legacy: DataFrame, derived: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Cutover: uploader rows of reviewed (member, tool, day) give way to derived ones.

    Derived rows that no review covers raise an error rather than count twice.
    """
    keys = ["member_id", "tool", "date"]
    cut = reviewed.select(*keys, F.lit(True).alias("cut"))
    stays = legacy.join(cut, keys, "left").where("NOT (source <=> 'uploader' AND cut IS NOT NULL)").select(*legacy.columns)
    marked = derived.join(reviewed.withColumn("ok", F.lit(True)), keys, "left")
    checked = marked.where(F.when(F.col("ok"), True).otherwise(F.raise_error(F.lit("derived row outside the reviewed days"))).cast("boolean"))
    return stays.unionByName(checked.select(*legacy.columns))
