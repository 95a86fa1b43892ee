"""Queries over the merge operators and the record ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import KNOWN, METRICS
from ..operators import ledger, merge
from ..sources.telemetry import daily_usage, limit_readings, roster, usage_events
from .registry import CTES, query

# Observations of one key by several sources: an event's model key is left out, so sources compete.
CTES["obs_rows"] = "SELECT date, tool, model, external_id, machine_id, source, input_tokens, output_tokens, event_id AS arrival, event_id % 2 = 1 AS fresh FROM ev"
CTES["won"] = """SELECT * FROM (SELECT *, CASE source WHEN 'poller' THEN 2 WHEN 'uploader' THEN 1 ELSE 0 END AS pr FROM obs_rows)
  QUALIFY pr = max(pr) OVER (PARTITION BY date, tool, model, external_id)"""
CTES["buckets"] = "SELECT external_id, tool, session_id, hour, model, parser_version, machine_id, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, requests, event_id AS arrival FROM ev WHERE source = 'uploader'"
CTES["live"] = "SELECT * FROM (SELECT *, max(parser_version) OVER (PARTITION BY external_id, tool, session_id, hour, model ORDER BY arrival) AS sf FROM buckets) WHERE parser_version = sf"
CTES["sessions"] = """SELECT external_id, tool, session_id, hour, model, max(top)::INT AS parser_version,
  max(input_tokens) FILTER (parser_version = top) AS input_tokens, max(output_tokens) FILTER (parser_version = top) AS output_tokens,
  max(cache_read_tokens) FILTER (parser_version = top) AS cache_read_tokens, max(cache_creation_tokens) FILTER (parser_version = top) AS cache_creation_tokens,
  max(requests) FILTER (parser_version = top) AS requests, string_agg(DISTINCT machine_id, ',' ORDER BY machine_id) AS machine_ids
  FROM (SELECT *, max(parser_version) OVER (PARTITION BY external_id, tool, session_id, hour, model) AS top FROM live) GROUP BY ALL"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    return usage_events(spark, d).select("date", "tool", "model", "external_id", "machine_id", "source", "input_tokens", "output_tokens", F.col("event_id").alias("arrival"), (F.col("event_id") % 2 == 1).alias("fresh"))


def buckets(spark: SparkSession, d: str) -> DataFrame:
    return usage_events(spark, d).where("source = 'uploader'").withColumn("arrival", F.col("event_id"))


@query("source_priority_dedup", "SELECT date, tool, model, external_id, machine_id, source, input_tokens, output_tokens, arrival FROM (SELECT *, max(CASE WHEN fresh AND machine_id <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY date, tool, model, external_id, source) AS tagged FROM won) WHERE NOT (tagged = 1 AND machine_id = '') QUALIFY row_number() OVER (PARTITION BY date, tool, model, external_id, machine_id ORDER BY arrival DESC) = 1")
def source_priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return merge.upsert_usage(o.where("NOT fresh").drop("fresh"), o.where("fresh").drop("fresh"))


@query("session_max_merge", "SELECT * FROM sessions")
def session_max_merge(spark: SparkSession, d: str) -> DataFrame:
    s = merge.merge_sessions(buckets(spark, d))
    return s.select(*merge.BUCKET, "parser_version", *METRICS, "requests", F.array_join("machine_ids", ",").alias("machine_ids"))


@query("superseded_buckets", "WITH b AS (SELECT * FROM sessions WHERE hour >= '2024-01-15T12' AND hour NOT LIKE '%3'), t AS (SELECT tool, session_id, min(hour) AS since FROM b GROUP BY ALL) SELECT s.external_id, s.tool, s.session_id, s.hour, s.model, s.parser_version FROM sessions s LEFT JOIN t ON s.tool = t.tool AND s.session_id = t.session_id WHERE NOT coalesce(s.parser_version < 3 AND s.hour >= t.since AND NOT EXISTS (SELECT 1 FROM b WHERE (b.external_id, b.tool, b.session_id, b.hour, b.model) = (s.external_id, s.tool, s.session_id, s.hour, s.model)), false)")
def superseded_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A later parse, version 3, resends sessions from midday of the 15th, but only some of their buckets."""
    s = merge.merge_sessions(buckets(spark, d)).select(*merge.BUCKET, "parser_version")
    late = s.where("hour >= '2024-01-15T12'")
    resent = late.withColumn("parser_version", F.lit(3)).where(~F.col("hour").endswith("3"))
    return merge.drop_superseded(s, resent)


@query("account_tag_merge", "WITH t AS (SELECT external_id, tool, CASE k % 3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'hook' ELSE 'none' END AS e, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS s, 'org' || (k % 4 // 3) AS org FROM ev), m AS (SELECT * FROM t QUALIFY s = max(s) OVER (PARTITION BY external_id, tool)) SELECT external_id, tool, CASE WHEN count(DISTINCT org) > 1 THEN 'mixed' ELSE min(org) END AS org, max(s)::INT AS strength FROM m GROUP BY ALL")
def account_tag_merge(spark: SparkSession, d: str) -> DataFrame:
    k3 = F.col("k") % 3
    t = usage_events(spark, d).select("external_id", "tool", F.when(k3 == 0, "transcript").when(k3 == 1, "hook").otherwise("none").alias("evidence"), F.concat(F.lit("org"), F.floor(F.col("k") % 4 / 3).cast("string")).alias("org"))
    return merge.merge_account_tags(t, ["external_id", "tool"])


@query("derive_daily", "WITH b AS (SELECT *, substr(hour, 1, 10) AS date FROM sessions), s AS (SELECT external_id, tool, date, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(requests)::BIGINT AS requests FROM b GROUP BY ALL), n AS (SELECT external_id, tool, date, count(DISTINCT session_id) AS n FROM b GROUP BY ALL) SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY external_id, tool, date ORDER BY model) = 1 THEN n END AS sessions FROM s JOIN n USING (external_id, tool, date)")
def derive_daily(spark: SparkSession, d: str) -> DataFrame:
    return merge.derive_days(merge.merge_sessions(buckets(spark, d))).drop("ev_input_tokens", "ev_sessions")


@query("limit_peak", 'SELECT date, member_id, window_ AS "window", round(arg_max(utilization_pct, arrival), 6) AS utilization_pct, round(max(utilization_pct), 6) AS peak_pct FROM limits GROUP BY ALL')
def limit_peak(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merge_limits(limit_readings(spark, d), ["date", "member_id", "window"])
    return m.select("date", "member_id", "window", F.round("utilization_pct", 6).alias("utilization_pct"), F.round("peak_pct", 6).alias("peak_pct"))


@query("identity_register", "WITH k AS (SELECT tool, external_id, min(member_id) AS member_id FROM ev WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT tool, external_id, arg_min(coalesce(member_id, -1), event_id) AS member_id FROM ev WHERE event_id % 2 = 1 GROUP BY ALL) SELECT * FROM k UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.tool = n.tool AND k.external_id = n.external_id)")
def identity_register(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d)
    known = e.where("event_id % 2 = 0").groupBy("tool", "external_id").agg(F.min("member_id").alias("member_id"))
    new = e.where("event_id % 2 = 1").select("tool", "external_id", F.coalesce("member_id", F.lit(-1).cast("long")).alias("member_id"), F.col("event_id").alias("arrival"))
    return merge.register_identities(known, new)


@query("identity_relink", "SELECT tool, coalesce(f.member_id, r.member_id) AS member_id, sum(tokens)::BIGINT AS tokens FROM f LEFT JOIN roster r ON lower(f.external_id) = lower(r.email) GROUP BY ALL")
def identity_relink(spark: SparkSession, d: str) -> DataFrame:
    from .totals import facts, total

    return merge.relink(facts(spark, d), roster(spark, d)).groupBy("tool", "member_id").agg(total("tokens").alias("tokens"))


@query("identity_link", "WITH i AS (SELECT tool, external_id, min(member_id) AS registered FROM ev WHERE member_id IS NOT NULL AND tool <> 'gemini' GROUP BY ALL) SELECT f.tool, coalesce(registered, r.member_id) AS member_id, sum(tokens)::BIGINT AS tokens FROM f LEFT JOIN i ON i.tool = f.tool AND i.external_id = f.external_id LEFT JOIN roster r ON lower(f.external_id) = lower(r.email) GROUP BY ALL")
def identity_link(spark: SparkSession, d: str) -> DataFrame:
    """Facts as they come, without members: identities link them, for a tool without any addresses do."""
    from .totals import facts, total

    known = usage_events(spark, d).where("tool != 'gemini'").select("tool", "external_id", "member_id").distinct()
    bare = facts(spark, d).withColumn("member_id", F.lit(None).cast("long"))
    return merge.linked(bare, known, roster(spark, d)).groupBy("tool", "member_id").agg(total("tokens").alias("tokens"))


CTES["covered"] = "SELECT DISTINCT external_id, tool, date FROM ev WHERE source = 'uploader' AND k % 3 = 0"


def covered(spark: SparkSession, d: str) -> DataFrame:
    return usage_events(spark, d).where("source = 'uploader' AND k % 3 = 0").select("external_id", "tool", "date").distinct()


@query("coverage_semi", "SELECT external_id, tool, date, model, input_tokens::BIGINT AS input_tokens FROM daily WHERE EXISTS (SELECT 1 FROM covered c WHERE (c.external_id, c.tool, c.date) = (daily.external_id, daily.tool, daily.date))")
def coverage_semi(spark: SparkSession, d: str) -> DataFrame:
    return merge.divert(daily_usage(spark, d), covered(spark, d))[1].select("external_id", "tool", "date", "model", "input_tokens")


@query("coverage_anti", "SELECT external_id, tool, date, model, input_tokens::BIGINT AS input_tokens FROM daily WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE (c.external_id, c.tool, c.date) = (daily.external_id, daily.tool, daily.date))")
def coverage_anti(spark: SparkSession, d: str) -> DataFrame:
    return merge.divert(daily_usage(spark, d), covered(spark, d))[0].select("external_id", "tool", "date", "model", "input_tokens")


@query("machine_pseudonyms", "SELECT CASE WHEN machine_id = '' THEN '' ELSE 'dev_' || substr(sha256(machine_id), 1, 12) END AS machine_id, count(*) AS rows FROM daily GROUP BY 1")
def machine_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return merge.pseudonymous(daily_usage(spark, d)).groupBy("machine_id").agg(F.count(F.lit(1)).alias("rows"))


@query("cutover_replace", "WITH r AS (SELECT DISTINCT member_id, tool, date FROM daily WHERE member_id % 2 = 0 AND date >= '2024-01-10'), x AS (SELECT member_id, tool, date, source, input_tokens FROM daily WHERE NOT (source = 'uploader' AND EXISTS (SELECT 1 FROM r WHERE (r.member_id, r.tool, r.date) = (daily.member_id, daily.tool, daily.date))) UNION ALL SELECT member_id, tool, date, 'derived', sum(input_tokens) FROM ev WHERE source = 'uploader' AND member_id % 2 = 0 AND date >= '2024-01-10' GROUP BY ALL) SELECT tool, source, count(*) AS rows, sum(input_tokens)::BIGINT AS input_tokens FROM x GROUP BY ALL")
def cutover_replace(spark: SparkSession, d: str) -> DataFrame:
    cols = ["member_id", "tool", "date", "source", "input_tokens"]
    legacy = daily_usage(spark, d).select(*cols)
    reviewed = legacy.where("member_id % 2 = 0 AND date >= '2024-01-10'").select("member_id", "tool", "date").distinct()
    derived = usage_events(spark, d).where("source = 'uploader' AND member_id % 2 = 0 AND date >= '2024-01-10'").groupBy("member_id", "tool", "date").agg(F.sum("input_tokens").alias("input_tokens")).withColumn("source", F.lit("derived")).select(*cols)
    out = merge.replace_reviewed(legacy, derived, reviewed)
    return out.groupBy("tool", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("input_tokens").alias("input_tokens"))


# Running totals of input by session, started anew from an event's own value where its key is a multiple of 20.
CTES["totals_e"] = """SELECT session_id, event_id, sum(input_tokens) OVER (PARTITION BY session_id, part ORDER BY event_id) AS total
  FROM (SELECT *, sum(CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_id) AS part FROM ev)"""


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("event_id")
    e = usage_events(spark, d).withColumn("part", F.sum((F.col("k") % 20 == 0).cast("int")).over(w))
    return e.withColumn("total", F.sum("input_tokens").over(Window.partitionBy("session_id", "part").orderBy("event_id")))


@query("snapshot_deltas", "SELECT session_id, event_id, (total - CASE WHEN prev IS NULL OR total < prev THEN 0 ELSE prev END)::BIGINT AS delta FROM (SELECT *, lag(total) OVER (PARTITION BY session_id ORDER BY event_id) AS prev FROM totals_e) WHERE total - CASE WHEN prev IS NULL OR total < prev THEN 0 ELSE prev END <> 0")
def snapshot_deltas(spark: SparkSession, d: str) -> DataFrame:
    return ledger.snapshot_deltas(running_totals(spark, d), ["session_id"], "event_id", ["total"]).select("session_id", "event_id", F.col("d_total").alias("delta"))


def ledger_records(spark: SparkSession, d: str) -> DataFrame:
    """Records: events as they are for some tools, running totals for the others, a third of them incomplete."""
    e = running_totals(spark, d).where("member_id IS NOT NULL")
    cum = F.col("tool").isin("codex", "gemini")
    r = e.select(
        "member_id", "tool", F.lit("acct").alias("account_id"), F.col("session_id"), F.format_string("r%010d", "event_id").alias("record_id"), F.when(cum, "cumulative").otherwise("event").alias("kind"),
        F.col("ts").alias("occurred_at"), F.when(cum, "m").otherwise(F.col("model")).alias("model"), F.lit("").alias("provider"), "parser_version", (F.col("k") % 3).alias("revision"),
        F.when(F.col("k") % 30 == 29, "partial").otherwise("final").alias("completeness"), F.lit("native").alias("identity_quality"), F.col("event_id").alias("arrival"),
        F.when(cum, F.col("total")).otherwise(F.col("input_tokens")).alias("input_tokens"), F.col("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_creation_tokens"),
    )
    return r.select("*", *[F.when(F.col(m).isNull(), "unknown").otherwise(KNOWN).alias(f"ev_{m}") for m in METRICS])


CTES["recs"] = """SELECT e.member_id, e.tool, e.session_id, e.event_id, e.ts, e.date, e.k, e.tool IN ('codex', 'gemini') AS cum, CASE WHEN e.tool IN ('codex', 'gemini') THEN 'm' ELSE e.model END AS model,
  CASE WHEN e.tool IN ('codex', 'gemini') THEN t.total ELSE e.input_tokens END AS v, e.output_tokens AS o, e.k % 30 = 29 AS partial FROM ev e JOIN totals_e t USING (event_id) WHERE e.member_id IS NOT NULL"""


@query("ledger_derive", """WITH a AS (SELECT *, lag(v) OVER c AS pv, lag(o) OVER c AS po, cum AND count(*) OVER (PARTITION BY member_id, tool, session_id, ts) > 1 AND (min(v) OVER i <> max(v) OVER i OR min(o) OVER i <> max(o) OVER i) AS amb FROM recs WINDOW c AS (PARTITION BY member_id, tool, session_id ORDER BY ts, event_id), i AS (PARTITION BY member_id, tool, session_id, ts)),
b AS (SELECT *, CASE WHEN NOT cum OR pv IS NULL OR v < pv THEN v ELSE v - pv END AS dv, CASE WHEN NOT cum OR po IS NULL OR o < po THEN o ELSE o - po END AS do_, cum AND coalesce(v < pv OR o < po, false) AS reset FROM a),
t AS (SELECT *, cum AND (partial OR reset OR amb) AS bad FROM b),
u AS (SELECT *, max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY member_id, tool, session_id ORDER BY ts, event_id) AS taint FROM t)
SELECT tool, date, model, NOT partial AND (NOT cum OR taint = 0) AS verified, sum(dv)::BIGINT AS input_tokens, sum(do_)::BIGINT AS output_tokens, count(*) FILTER (reset) AS resets FROM u GROUP BY ALL""")
def ledger_derive(spark: SparkSession, d: str) -> DataFrame:
    days = ledger.ledger_days(ledger.derive_chain(ledger_records(spark, d)))
    return days.groupBy("tool", "date", "model", "verified").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("resets").alias("resets"))


# One arrival after another of a record that differs in instant, model, parser, revision, completeness and counts; a stored one is replaced, a partial one raised.
_SAID = """CASE WHEN n.ts = k.ts AND n.model = k.model AND n.pv = k.pv AND n.rev = k.rev AND n.partial = k.partial AND n.v = k.v AND n.o = k.o THEN 'unchanged'
  WHEN n.ts <> k.ts AND n.rev <= k.rev THEN 'conflict:unverified_timestamp_correction' WHEN n.pv < k.pv THEN 'conflict:parser_downgrade' WHEN n.rev < k.rev THEN 'superseded:older_revision'
  WHEN NOT k.partial AND n.partial THEN 'superseded:final_dominates_partial' WHEN n.rev > k.rev THEN 'stored' WHEN n.pv <> k.pv THEN 'conflict:unverified_parser_correction'
  WHEN k.partial AND NOT n.partial THEN 'stored' WHEN NOT k.partial THEN 'conflict:same_revision_final_conflict' WHEN n.cum THEN 'conflict:same_revision_snapshot_conflict'
  WHEN n.model <> k.model THEN 'conflict:same_revision_metadata_conflict' WHEN n.v > k.v OR n.o > k.o THEN 'merged' ELSE 'superseded:partial_not_newer' END"""
_VERSION = ["ts", "model", "pv", "rev", "partial", "v", "o"]


@query("record_classify", f"""WITH RECURSIVE n AS (SELECT *, session_id || '#' || (event_id % 2) AS id, event_id % 3 + 1 AS pv, k % 3 AS rev, row_number() OVER (PARTITION BY member_id, tool, session_id, event_id % 2 ORDER BY event_id) AS i FROM recs),
  k AS (SELECT member_id, tool, id, i, {", ".join(_VERSION)}, 'stored' AS said FROM n WHERE i = 1 UNION ALL
  SELECT member_id, tool, id, i, {", ".join(f"CASE said WHEN 'stored' THEN n_{c} WHEN 'merged' THEN {f'greatest(n_{c}, k_{c})' if c in 'vo' else f'k_{c}'} ELSE k_{c} END" for c in _VERSION)}, said
  FROM (SELECT n.member_id, n.tool, n.id, n.i, {", ".join(f"n.{c} AS n_{c}, k.{c} AS k_{c}" for c in _VERSION)}, {_SAID} AS said FROM k JOIN n ON n.member_id = k.member_id AND n.tool = k.tool AND n.id = k.id AND n.i = k.i + 1))
  SELECT tool, CASE said WHEN 'merged' THEN 'stored' ELSE said END AS decision, count(*) AS n FROM k GROUP BY ALL""")
def record_classify(spark: SparkSession, d: str) -> DataFrame:
    """Each record arrives again as a later event of its session; the decisions, counted."""
    r = ledger_records(spark, d).withColumn("record_id", F.concat("session_id", F.lit("#"), (F.col("arrival") % 2).cast("string")))
    return ledger.classify(r).groupBy("tool", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("reconcile", "SELECT tool, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 5 = 1 THEN 'different' ELSE 'matched' END AS receipt, count(*) AS n FROM ev WHERE member_id IS NOT NULL GROUP BY ALL")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    sent = ledger.with_digest(ledger_records(spark, d))
    had = sent.where("arrival % 5 != 0").withColumn("digest", F.when(F.col("arrival") % 5 == 1, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return ledger.reconcile(sent, had).join(sent.select("record_id", "tool"), "record_id").groupBy("tool", "receipt").agg(F.count(F.lit(1)).alias("n"))
