"""What members see about their own data: collection status, digests, devices, and the display path of the rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import add_days, days_before
from ..operators import devices, feeds, merge
from ..operators.scan import Match
from ..sources.telemetry import AS_OF, daily_usage, members, roster, usage_events
from .display import view
from .merging import buckets, covered
from .registry import CTES, query
from .totals import facts, lead_days

WEEK_AGO = "2024-01-24"
# A member's digest of a day; the last event's key decides what became of it.
CTES["digests"] = "SELECT date, member_id, CASE arg_max(k % 3, event_id) WHEN 0 THEN 'draft' WHEN 1 THEN 'shared' ELSE 'skipped' END AS status, count(*) AS items FROM ev WHERE member_id IS NOT NULL GROUP BY date, member_id"


def digests(spark: SparkSession, d: str) -> DataFrame:
    g = usage_events(spark, d).where("member_id IS NOT NULL").groupBy("date", "member_id")
    g = g.agg(F.max_by(F.col("k") % 3, "event_id").alias("s"), F.count(F.lit(1)).alias("items"))
    return g.select("date", "member_id", F.when(F.col("s") == 0, "draft").when(F.col("s") == 1, "shared").otherwise("skipped").alias("status"), "items")


@query("digest_drafts", f"SELECT member_id, max(date) AS date, arg_max(items, date) AS items FROM digests WHERE status = 'draft' AND date >= '{WEEK_AGO}' GROUP BY member_id")
def digest_drafts(spark: SparkSession, d: str) -> DataFrame:
    return feeds.latest_drafts(digests(spark, d), WEEK_AGO)


@query("digest_team", f"SELECT g.date, coalesce(m.name, '?') AS name, g.items FROM digests g LEFT JOIN members m USING (member_id) WHERE status = 'shared' AND date >= '{WEEK_AGO}'")
def digest_team(spark: SparkSession, d: str) -> DataFrame:
    return feeds.shared_digests(digests(spark, d), members(spark, d), WEEK_AGO)


@query("member_status", "WITH h AS (SELECT external_id, machine_id, tool, max(ts) AS seen, arg_max(k // 19, event_id) AS odd FROM ev WHERE machine_id <> '' GROUP BY ALL), p AS (SELECT external_id, max(seen) AS seen, bool_or(odd >= 5) AS bad FROM h GROUP BY 1) SELECT r.member_id, r.name, strftime(p.seen, '%Y-%m-%d %H:%M:%S') AS last_received_at, CASE WHEN coalesce(p.bad, false) THEN 'error signal' WHEN p.seen IS NULL THEN 'unknown' WHEN p.seen < TIMESTAMP '2024-01-29 00:00:00' THEN 'nothing lately' ELSE 'received' END AS label FROM roster r LEFT JOIN p ON lower(p.external_id) = lower(r.email)")
def member_status(spark: SparkSession, d: str) -> DataFrame:
    """Each device's parsers, by their last report."""
    e = usage_events(spark, d).where("machine_id != ''").groupBy("external_id", "machine_id", "tool")
    h = e.agg(F.max("ts").alias("at"), F.max_by(F.floor(F.col("k") / 19), "event_id").alias("unrecognized"))
    s = devices.member_status(roster(spark, d), h, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return s.select("member_id", "name", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("last_received_at"), "label")


LOCAL = ("claude_code", "codex", "gemini", "grok", "opencode")


@query("tool_status", "WITH s AS (SELECT tool, count(*) AS records, count(*) FILTER (tool = 'codex' AND k % 50 = 49) AS conflicts, count(*) FILTER (k % 30 = 29) AS unverified FROM ev WHERE source = 'uploader' AND tool <> 'gemini' GROUP BY tool) SELECT t.tool, coalesce(s.records, 0) AS records, coalesce(s.conflicts, 0) AS conflicts, CASE WHEN s.conflicts > 0 THEN 'conflict' WHEN coalesce(s.records, 0) = 0 AND p.tool IS NOT NULL THEN 'earlier records' WHEN s.tool IS NULL THEN 'unknown' WHEN s.records = 0 THEN 'check source' WHEN s.unverified > 0 THEN 'received, to be compared' ELSE 'received' END AS label FROM (VALUES " + ", ".join(f"('{t}')" for t in LOCAL) + ") t(tool) LEFT JOIN s ON s.tool = t.tool LEFT JOIN (SELECT DISTINCT tool FROM daily) p ON p.tool = t.tool")
def tool_status(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d)
    conflict = (F.col("tool") == "codex") & (F.col("k") % 50 == 49)
    s = e.where("source = 'uploader' AND tool != 'gemini'").groupBy("tool").agg(F.count(F.lit(1)).alias("records"), F.count_if(conflict).alias("conflicts"), F.count_if(F.col("k") % 30 == 29).alias("unverified"), F.lit(False).alias("error"))
    tools = spark.createDataFrame([(t,) for t in LOCAL], "tool string")
    return devices.tool_status(tools, s, e.select("tool").distinct()).select("tool", "records", "conflicts", "label")


@query("my_machines", "WITH x AS (SELECT s.external_id, u.m AS machine_id, substr(s.hour, 1, 10) AS date, coalesce(s.input_tokens, 0) + coalesce(s.output_tokens, 0) AS t, s.requests AS q FROM sessions s, unnest(string_split(s.machine_ids, ',')) AS u(m) WHERE EXISTS (SELECT 1 FROM covered c WHERE (c.external_id, c.tool, c.date) = (s.external_id, s.tool, substr(s.hour, 1, 10))) UNION ALL SELECT external_id, machine_id, date, coalesce(input_tokens, 0) + coalesce(output_tokens, 0), requests FROM daily WHERE source = 'uploader' AND NOT EXISTS (SELECT 1 FROM covered c WHERE (c.external_id, c.tool, c.date) = (daily.external_id, daily.tool, daily.date))) SELECT external_id, machine_id, max(date) AS last_date, coalesce(sum(t) FILTER (date > '2024-01-17'), 0)::BIGINT AS recent_tokens, coalesce(sum(q) FILTER (date > '2024-01-17'), 0)::BIGINT AS recent_requests, max(date) < '2024-01-30' AS stale FROM x GROUP BY external_id, machine_id")
def my_machines(spark: SparkSession, d: str) -> DataFrame:
    """Devices by what sessions tell of them, and by older rows of days that no session covers; a session counts for each device that has it."""
    have = covered(spark, d)
    s = merge.merge_sessions(buckets(spark, d)).withColumn("date", F.substring("hour", 1, 10)).join(have, ["external_id", "tool", "date"], "left_semi")
    older = merge.divert(daily_usage(spark, d).where("source = 'uploader'"), have)[0]
    return devices.machines(s, older, AS_OF)


@query("session_validity", "SELECT CASE WHEN k % 13 = 0 THEN 'hour' WHEN k % 17 = 0 AND input_tokens > 0 THEN 'input_tokens' WHEN k % 19 = 0 THEN 'parser_version' ELSE 'valid' END AS outcome, count(*) AS n FROM ev WHERE source = 'uploader' GROUP BY 1")
def session_validity(spark: SparkSession, d: str) -> DataFrame:
    """Session buckets some of which are spoilt, counted by what is wrong with them."""
    spoilt = {
        "hour": F.when(F.col("k") % 13 == 0, F.col("date")).otherwise(F.col("hour")),
        "input_tokens": F.when(F.col("k") % 17 == 0, -F.col("input_tokens")).otherwise(F.col("input_tokens")),
        "parser_version": F.when(F.col("k") % 19 == 0, 0).otherwise(F.col("parser_version")),
    }
    good, bad = devices.valid_sessions(buckets(spark, d).withColumns(spoilt))
    both = good.select(F.lit("valid").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("display_member_list", "SELECT r.member_id, r.name, round(sum(x.usd_value), 9) AS value, coalesce(sum(x.unpriced), 0)::BIGINT AS unpriced_tokens, max(x.date) AS last_active, count(x.date) > 0 AS has_record FROM roster r LEFT JOIN shown x ON x.member_id = r.member_id GROUP BY r.member_id, r.name")
def display_member_list(spark: SparkSession, d: str) -> DataFrame:
    """The roster kept whole: who has no measured value has none, not 0."""
    x = view(spark, d).groupBy("member_id").agg(F.round(F.sum("value"), 9).alias("value"), F.sum("unpriced").cast("long").alias("unpriced_tokens"), F.max("date").alias("last_active"))
    out = roster(spark, d).select("member_id", "name").join(x, "member_id", "left")
    return out.withColumn("has_record", F.col("last_active").isNotNull()).na.fill(0, ["unpriced_tokens"])


@query("display_unmapped", "SELECT tool, external_id, round(sum(usd_value), 9) AS value, sum(unpriced)::BIGINT AS unpriced_tokens, max(date) AS last_date FROM shown WHERE member_id IS NULL GROUP BY tool, external_id")
def display_unmapped(spark: SparkSession, d: str) -> DataFrame:
    x = view(spark, d, Match({"member_id": None})).groupBy("tool", "external_id")
    return x.agg(F.round(F.sum("value"), 9).alias("value"), F.sum("unpriced").cast("long").alias("unpriced_tokens"), F.max("date").alias("last_date"))


@query("display_wow", "SELECT r.member_id, r.name, round(sum(x.usd_value) FILTER (x.date >= '2024-01-24'), 9) AS value, round(sum(x.usd_value) FILTER (x.date < '2024-01-24'), 9) AS prev_value, NULL::DOUBLE AS pct FROM roster r LEFT JOIN shown x ON x.member_id = r.member_id AND x.date >= '2024-01-17' AND x.date < '2024-01-31' GROUP BY r.member_id, r.name")
def display_wow(spark: SparkSession, d: str) -> DataFrame:
    """Two weeks side by side; observed values give no percentage, since either week may be incomplete."""
    mid = days_before(AS_OF, 7)
    x = view(spark, d, Match({"date": {"gte": days_before(AS_OF, 14), "lt": AS_OF}}))
    part = lambda c: F.round(F.sum(F.when(c, F.col("value"))), 9)
    x = x.groupBy("member_id").agg(part(F.col("date") >= mid).alias("value"), part(F.col("date") < mid).alias("prev_value"))
    return roster(spark, d).select("member_id", "name").join(x, "member_id", "left").withColumn("pct", F.lit(None).cast("double"))


@query("lead_first", "WITH a AS (SELECT model, member_id, min(date) AS first FROM f WHERE member_id IS NOT NULL AND model NOT IN ('', 'unknown', 'default') GROUP BY ALL), n AS (SELECT ceil(count(*) / 2.0)::BIGINT AS k FROM roster), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY first) AS place, min(first) OVER (PARTITION BY model) AS g FROM a) SELECT model, g AS global_first, date_diff('day', CAST(g AS DATE), CAST(first AS DATE))::BIGINT AS lead_days FROM r, n WHERE place = k ORDER BY g, model LIMIT 1")
def lead_first(spark: SparkSession, d: str) -> DataFrame:
    """The earliest model that half the team has taken up, one row."""
    since = facts(spark, d).where("member_id IS NOT NULL").groupBy("model").agg(F.min("date").alias("global_first"))
    return lead_days(spark, d).join(since, "model").select("model", "global_first", "lead_days").orderBy("global_first", "model").limit(1)
