"""Queries that send the adapter's events through the log readers, written as the tools write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import collectors, logs, payloads, vendors
from ..sources.telemetry import usage_events
from .merging import running_totals
from .registry import query

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _lines(df: DataFrame, file, body) -> DataFrame:
    return df.select(file.alias("file"), F.struct(F.col("event_id").alias("at"), F.lit(0).cast("long").alias("id")).alias("pos"), F.to_json(body).alias("value"))


@query("log_claude", "SELECT date, model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, count(DISTINCT session_id) AS sessions FROM (SELECT date, raw_model AS model, input_tokens, cache_creation_tokens, session_id FROM ev WHERE tool = 'claude_code' AND raw_model <> '') GROUP BY ALL")
def log_claude(spark: SparkSession, d: str) -> DataFrame:
    """Every message lies in two files, as after a resumed session."""
    e = usage_events(spark, d).where("tool = 'claude_code' AND raw_model != ''")
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.col("cache_creation_tokens").alias("cache_creation_input_tokens"))
    body = F.struct(F.lit("assistant").alias("type"), F.col("session_id").alias("sessionId"), F.date_format("ts", ISO).alias("timestamp"), F.col("event_id").cast("string").alias("requestId"), F.struct(F.concat(F.lit("msg"), F.col("event_id").cast("string")).alias("id"), F.col("raw_model").alias("model"), usage.alias("usage")).alias("message"))
    rows = _lines(e, F.lit("a.jsonl"), body).unionByName(_lines(e, F.lit("b.jsonl"), body))
    g = logs.claude_events(rows).groupBy("date", "model")
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("cache_creation_tokens").alias("cache_creation_tokens"), F.count_distinct("session_id").alias("sessions"))


@query("log_codex", "SELECT date, count(*) AS requests, sum(total - CASE WHEN prev IS NULL OR total < prev THEN 0 ELSE prev END)::BIGINT AS input_tokens FROM (SELECT e.date, t.total, lag(t.total) OVER (PARTITION BY e.session_id ORDER BY e.event_id) AS prev FROM ev e JOIN totals_e t USING (event_id) WHERE e.tool = 'codex') WHERE total - CASE WHEN prev IS NULL OR total < prev THEN 0 ELSE prev END <> 0 GROUP BY date")
def log_codex(spark: SparkSession, d: str) -> DataFrame:
    e = running_totals(spark, d).where("tool = 'codex'")
    info = F.struct(F.struct(F.col("total").alias("input_tokens"), F.lit(0).alias("cached_input_tokens"), F.lit(0).alias("output_tokens")).alias("total_token_usage"))
    body = F.struct(F.lit("event_msg").alias("type"), F.date_format("ts", ISO).alias("timestamp"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))
    g = logs.codex_events(_lines(e, F.col("session_id"), body)).groupBy("date")
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"))


@query("log_rollup", "SELECT tool, date, model, sum(input_tokens)::BIGINT AS input_tokens, count(*) AS requests, CASE WHEN row_number() OVER (PARTITION BY tool, date ORDER BY model) = 1 THEN any_value(n) END AS sessions FROM ev JOIN (SELECT tool, date, count(DISTINCT session_id) AS n FROM ev GROUP BY ALL) USING (tool, date) GROUP BY tool, date, model")
def log_rollup(spark: SparkSession, d: str) -> DataFrame:
    return logs.rolled_up(usage_events(spark, d)).select("tool", "date", "model", "input_tokens", "requests", "sessions")


_DAILY = "SELECT date, count(*) AS requests, {0} FROM ev WHERE {1} GROUP BY date"


@query("log_grok", _DAILY.format("sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(DISTINCT substr(sha1(machine_id), 1, 8) || date) AS sessions", "source = 'uploader'"))
def log_grok(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded events as that tool's lines, every other one in milliseconds; a device's day is a session."""
    e = usage_events(spark, d).where("source = 'uploader'").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    body = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("at")).otherwise(F.col("at") * 1000).alias("ts"), F.lit("grok-4").alias("model"), F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"))
    rows = e.select(F.lit("g.jsonl").alias("file"), F.col("event_id").alias("pos"), "machine_id", F.to_json(body).alias("value"))
    g = logs.grok_events(rows).groupBy("date")
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_distinct("session_id").alias("sessions"))


@query("log_opencode", _DAILY.format("sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens + 3)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens", "date >= '2024-01-10'"))
def log_opencode(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d)
    cache = F.struct(F.col("cache_read_tokens").alias("read"), F.col("cache_creation_tokens").alias("write"))
    tokens = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.lit(3).alias("reasoning"), cache.alias("cache"))
    data = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("model").alias("modelID"), tokens.alias("tokens")))
    m = e.select(F.col("event_id").alias("id"), "session_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("time_created"), data.alias("data"))
    users = m.withColumn("data", F.lit('{"role":"user"}'))
    g = logs.since(logs.opencode_events(m.unionByName(users)), "2024-01-10").groupBy("date")
    return g.agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")])


@query("log_gemini", "SELECT date, count(*) AS requests, sum(total - CASE WHEN prev IS NULL OR total < prev THEN 0 ELSE prev END)::BIGINT AS input_tokens FROM (SELECT e.date, t.total, lag(t.total) OVER (PARTITION BY e.session_id ORDER BY e.event_id) AS prev FROM ev e JOIN totals_e t USING (event_id) WHERE e.tool = 'gemini') WHERE total - CASE WHEN prev IS NULL OR total < prev THEN 0 ELSE prev END <> 0 GROUP BY date")
def log_gemini(spark: SparkSession, d: str) -> DataFrame:
    """Running totals by session, every message written twice."""
    e = running_totals(spark, d).where("tool = 'gemini'")
    tokens = F.struct(F.col("total").alias("input"), F.lit(0).alias("output"), F.lit(0).alias("cached"), F.lit(0).alias("thoughts"))
    body = F.struct(F.col("session_id").alias("sessionId"), F.date_format("ts", ISO).alias("timestamp"), F.col("event_id").cast("string").alias("id"), F.col("model"), tokens.alias("tokens"))
    once = _lines(e, F.col("session_id"), body)
    again = once.withColumn("pos", F.struct(F.col("pos.at"), F.lit(1).cast("long").alias("id")))
    g = logs.gemini_events(once.unionByName(again)).groupBy("date")
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"))


@query("vendor_cursor", "SELECT strftime(ts, '%Y-%m-%d') AS date, external_id, CASE model WHEN '' THEN 'unknown' ELSE model END AS model, sum(input_tokens)::BIGINT AS input_tokens, NULL::BIGINT AS requests FROM ev WHERE tool = 'cursor' GROUP BY ALL UNION ALL SELECT strftime(ts, '%Y-%m-%d'), external_id, '', NULL, count(*) * 2 FROM ev WHERE tool = 'cursor' GROUP BY ALL")
def vendor_cursor(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d).where("tool = 'cursor'").withColumn("email", F.upper("external_id"))
    events = e.withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))
    activity = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "email", F.lit(2).cast("long").alias("requests"))
    return vendors.cursor_usage(activity, events).select("date", "external_id", "model", "input_tokens", "requests")


@query("vendor_anthropic", "SELECT date, external_id, model, sum(input_tokens)::BIGINT AS input_tokens, CASE WHEN row_number() OVER (PARTITION BY date, external_id ORDER BY model) = 1 THEN any_value(n) END AS sessions FROM ev JOIN (SELECT date, external_id, count(DISTINCT session_id) AS n FROM ev GROUP BY ALL) USING (date, external_id) GROUP BY date, external_id, model")
def vendor_anthropic(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d)
    by_model = e.groupBy("date", "external_id", "model").agg(*[F.sum(f"{c}_tokens").alias(c) for c in ("input", "output", "cache_read", "cache_creation")])
    one = F.struct("model", F.struct("input", "output", "cache_read", "cache_creation").alias("tokens"))
    days = by_model.groupBy("date", "external_id").agg(F.sort_array(F.collect_list(one)).alias("model_breakdown"))
    n = e.groupBy("date", "external_id").agg(F.count_distinct("session_id").alias("num_sessions"))
    actor = F.struct(F.col("external_id").alias("email_address"), F.lit(None).cast("string").alias("api_key_name"))
    body = days.join(n, ["date", "external_id"]).select(F.concat("date", F.lit("T00:00:00Z")).alias("date"), actor.alias("actor"), "num_sessions", "model_breakdown")
    return vendors.anthropic_usage(body).select("date", "external_id", "model", "input_tokens", "sessions")


@query("vendor_copilot", "SELECT external_id AS account, date, model, sum(k)::DOUBLE AS requests FROM ev WHERE tool = 'copilot' AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.tool = 'copilot' AND o.external_id = ev.external_id AND o.date = ev.date AND o.k % 20 = 19) GROUP BY ALL")
def vendor_copilot(spark: SparkSession, d: str) -> DataFrame:
    """A twentieth of the items is in another unit, so their reports are refused."""
    e = usage_events(spark, d).where("tool = 'copilot'")
    item = F.struct("model", F.when(F.col("k") % 20 == 19, "seats").otherwise("Requests").alias("unit_type"), F.col("k").cast("double").alias("gross_quantity"))
    period = F.struct(*[F.split("date", "-")[i].cast("int").alias(n) for i, n in enumerate(("year", "month", "day"))])
    reports = e.groupBy(F.col("external_id").alias("account"), "date").agg(F.collect_list(item).alias("usage_items")).withColumn("time_period", period)
    return vendors.copilot_billing(reports).select("account", "date", "model", "requests")


@query("vendor_gemini_workspace", "SELECT strftime(ts, '%Y-%m-%d') AS date, external_id, tool AS model, count(*) AS requests FROM ev WHERE k % 3 <> 0 GROUP BY ALL")
def vendor_gemini_workspace(spark: SparkSession, d: str) -> DataFrame:
    """Activities twice each, a third of them in a category that is no use."""
    e = usage_events(spark, d)
    parameter = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    category = F.when(F.col("k") % 3 == 0, "inactive").when(F.col("k") % 3 == 1, "active_generate").otherwise("active_conversations")
    event = F.struct(F.array(parameter("app_name", F.col("tool")), parameter("event_category", category)).alias("parameters"))
    a = e.select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", ISO).alias("time"), F.col("external_id").alias("email"), F.array(event).alias("events"))
    return vendors.gemini_activity(a.unionAll(a)).select("date", "external_id", "model", "requests")


@query("landed_payloads", "SELECT date, external_id, tool, sum(input_tokens)::BIGINT AS input_tokens, count(*) AS rows FROM ev WHERE event_id % 50 <> 7 AND event_id // 10 NOT IN (SELECT event_id // 10 FROM ev WHERE event_id % 50 = 7) GROUP BY ALL")
def landed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Ten events to a body; one with a bad date refuses the whole body."""
    e = usage_events(spark, d).withColumn("batch", F.floor(F.col("event_id") / 10))
    row = F.struct(F.when(F.col("event_id") % 50 == 7, "2024-02-30").otherwise(F.col("date")).alias("date"), "tool", "model", F.col("external_id").alias("externalId"), F.col("input_tokens").alias("inputTokens"), F.lit("uploader").alias("source"))
    bodies = e.groupBy("batch", "external_id").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("body"), F.max(F.col("event_id") % 50 == 7).alias("spoilt"))
    spoilt = bodies.groupBy("batch").agg(F.max("spoilt").alias("any"))
    bodies = bodies.join(spoilt, "batch").select("external_id", F.col("batch").alias("arrival"), F.when(F.col("any"), F.replace("body", F.lit('"date":"2024-01'), F.lit('"date":"2024-13'))).otherwise(F.col("body")).alias("body"))
    g = payloads.parsed(bodies)["rows"].groupBy("date", "external_id", "tool")
    return g.agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("rows"))


@query("collected_claude", "SELECT date, count(*) FILTER (k % 9 <> 0) AS records, count(*) FILTER (k % 9 = 0) AS refused, coalesce(sum(input_tokens) FILTER (k % 9 <> 0), 0)::BIGINT AS input_tokens, count(*) FILTER (k % 9 <> 0 AND k % 4 = 0) AS partial FROM ev WHERE tool = 'claude_code' GROUP BY date")
def collected_claude(spark: SparkSession, d: str) -> DataFrame:
    """Messages as ledger records, each in two files; some have no instant and are refused once for each file."""
    e = usage_events(spark, d).where("tool = 'claude_code'")
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.col("cache_creation_tokens").alias("cache_creation_input_tokens"))
    message = F.struct(F.concat(F.lit("msg"), F.col("event_id").cast("string")).alias("id"), F.col("raw_model").alias("model"), F.when(F.col("k") % 4 != 0, "end_turn").alias("stop_reason"), usage.alias("usage"))
    at = F.when(F.col("k") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("on "), F.col("date")))
    body = F.struct(F.lit("assistant").alias("type"), at.alias("timestamp"), F.col("event_id").cast("string").alias("requestId"), message.alias("message"))
    records, refused, _ = collectors.collect("claude_code", _lines(e, F.lit("a.jsonl"), body).unionByName(_lines(e, F.lit("b.jsonl"), body)), "acct")
    day = F.date_format(F.col("occurred_at").cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")
    good = records.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("records"), F.sum("input_tokens").alias("input_tokens"), F.count_if(F.col("completeness") == "partial").alias("partial"))
    bad = refused.groupBy(F.regexp_extract("value", r"on (\d{4}-\d{2}-\d{2})", 1).alias("date")).agg((F.count(F.lit(1)) / 2).cast("long").alias("refused"))
    return good.join(bad, "date", "full").na.fill(0)


@query("collected_opencode", "SELECT date, count(*) AS records, sum(output_tokens + 3)::BIGINT AS output_tokens, count(*) FILTER (k % 5 = 0) AS partial FROM ev GROUP BY date")
def collected_opencode(spark: SparkSession, d: str) -> DataFrame:
    """All events as rows of a message table, every one sent as a user's message too, which tells nothing."""
    e = usage_events(spark, d)
    created = F.unix_millis(F.col("ts").cast("timestamp"))
    tokens = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.lit(3).alias("reasoning"))
    rows = e.withColumn("role", F.explode(F.array(F.lit("assistant"), F.lit("user"))))
    data = F.to_json(F.struct("role", F.col("raw_model").alias("modelID"), F.struct(created.alias("created"), F.when(F.col("k") % 5 != 0, created + 1).alias("completed")).alias("time"), tokens.alias("tokens")))
    table = rows.select(F.concat(F.col("event_id").cast("string"), F.lit("-"), "role").alias("id"), "session_id", created.alias("time_created"), created.alias("time_updated"), data.alias("data"))
    records = collectors.collect("opencode", table, "acct")[0]
    day = F.date_format(F.col("occurred_at").cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")
    return records.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("records"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("completeness") == "partial").alias("partial"))
