"""Queries on upkeep: device health, receipts, synchronisation, feeds, address books, cutover reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import device_label, family_of, few, report_tool, window_label
from ..functions.semantics import METRICS
from ..operators import devices, feeds
from ..sources.telemetry import daily_usage, members, roster, usage_events, vendor_reports
from .registry import CTES, FAMILY_SQL, query

NOW = "2024-01-30 12:00:00"
CTES["health"] = f"SELECT external_id, machine_id, tool AS parser, floor(epoch(ts))::BIGINT AS seen_at, k AS files, k // 2 AS emitted, event_id FROM ev WHERE machine_id <> '' AND ts <= TIMESTAMP '{NOW}'"
SECONDS = 1706616000


def health(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d).where((F.col("machine_id") != "") & (F.col("ts") <= F.lit(NOW).cast("timestamp_ntz")))
    return e.select("external_id", "machine_id", F.col("tool").alias("parser"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("k").alias("files"), F.floor(F.col("k") / 2).alias("emitted"))


@query("health_samples", f"""WITH RECURSIVE r AS (SELECT DISTINCT external_id, machine_id, parser, seen_at FROM health WHERE seen_at >= {SECONDS} - 7 * 86400),
  k AS (SELECT external_id, machine_id, parser, min(seen_at) AS at_ FROM r GROUP BY ALL
  UNION ALL SELECT r.external_id, r.machine_id, r.parser, min(r.seen_at) FROM k JOIN r ON r.external_id = k.external_id AND r.machine_id = k.machine_id AND r.parser = k.parser AND r.seen_at >= k.at_ + 43200 GROUP BY ALL)
  SELECT external_id, machine_id, parser, at_ AS at FROM k QUALIFY row_number() OVER (PARTITION BY external_id, machine_id, parser ORDER BY at_ DESC) <= 14""")
def health_samples(spark: SparkSession, d: str) -> DataFrame:
    return devices.health_samples(health(spark, d), SECONDS)


@query("health_latest", f"SELECT external_id, machine_id, parser, max(seen_at) AS seen_at FROM health WHERE seen_at >= {SECONDS} - 30 * 86400 GROUP BY ALL")
def health_latest(spark: SparkSession, d: str) -> DataFrame:
    return devices.latest_health(health(spark, d), SECONDS).select("external_id", "machine_id", "parser", F.col("at").alias("seen_at"))


@query("device_receipts", "SELECT external_id, machine_id, tool, count(*) FILTER (k % 4 = 0) AS stored, count(*) FILTER (k % 4 = 1) AS unchanged, count(*) FILTER (k % 4 = 2) AS superseded, count(*) FILTER (k % 4 = 3) AS conflict, 0::BIGINT AS rejected, max(event_id) AS last_at, max(event_id) FILTER (k % 4 = 0) AS last_stored_at FROM ev GROUP BY ALL")
def device_receipts(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("stored", "unchanged", "superseded", "conflict"))), F.col("k") % 4 + 1)
    return devices.receipts(usage_events(spark, d).select("external_id", "machine_id", "tool", said.alias("receipt"), F.col("event_id").alias("at")))


_RUN = "CASE k % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'partial' WHEN 2 THEN 'empty' ELSE 'ok' END"


@query("sync_window", f"WITH r AS (SELECT tool, date, event_id AS run_id, {_RUN} AS status FROM ev) SELECT tool, least(coalesce(CASE WHEN arg_max(status, run_id) = 'error' THEN arg_max(date, run_id) END, CASE WHEN tool = 'copilot' THEN '2023-11-01' END, strftime(CAST(arg_max(date, run_id) FILTER (status IN ('ok', 'partial')) AS DATE) - 3, '%Y-%m-%d'), '2023-11-01'), '2024-01-31') AS since FROM r GROUP BY tool")
def sync_window(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs of every outcome; one tool's reports come whole."""
    runs = usage_events(spark, d).select("tool", "date", F.col("event_id").alias("run_id"), F.expr(_RUN).alias("status"))
    runs = runs.withColumn("retry_since", F.when(F.col("status") == "error", F.col("date")))
    return devices.sync_since(runs, first="2023-11-01", lookback=3, as_of="2024-01-31", full=spark.sql("SELECT 'copilot' AS tool"))


CTES["sent"] = "SELECT external_id, tool, session_id, count(*) AS n, min(event_id) AS first FROM ev WHERE source = 'uploader' GROUP BY ALL"


@query("packed_sessions", """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY first) AS i FROM sent),
  p AS (SELECT external_id, i, n, 1::BIGINT AS batch, n AS held FROM s WHERE i = 1 UNION ALL SELECT s.external_id, s.i, s.n, p.batch + (p.held + s.n > 7)::BIGINT, CASE WHEN p.held + s.n > 7 THEN s.n ELSE p.held + s.n END FROM p JOIN s ON s.external_id = p.external_id AND s.i = p.i + 1)
  SELECT external_id, batch, sum(n)::BIGINT AS rows, count(*) AS sessions FROM p GROUP BY ALL""")
def packed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of at most seven rows, no session split."""
    e = usage_events(spark, d).where("source = 'uploader'")
    packed = devices.packed_sessions(e.select("external_id", "tool", "session_id", F.col("event_id").alias("arrival")), 7)
    return packed.groupBy("external_id", "batch").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("tool", "session_id").alias("sessions"))


@query("cutover_report", "WITH a AS (SELECT member_id, tool, date, sum(input_tokens) AS a FROM ev WHERE member_id IS NOT NULL AND k % 5 <> 0 GROUP BY ALL), b AS (SELECT member_id, tool, date, sum(input_tokens) AS b FROM ev WHERE member_id IS NOT NULL AND k % 7 <> 0 GROUP BY ALL) SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' WHEN a = b THEN 'same' ELSE 'different' END AS outcome, count(*) AS n FROM a FULL JOIN b ON (a.member_id, a.tool, a.date) = (b.member_id, b.tool, b.date) GROUP BY 1")
def cutover_report(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d).where("member_id IS NOT NULL")
    return devices.cutover_report(e.where("k % 5 != 0"), e.where("k % 7 != 0"), ["member_id", "tool", "date"], "input_tokens")


@query("email_index", "SELECT email, member_id FROM (SELECT lower(email) AS email, member_id, 0 AS r, 0 AS a FROM roster UNION ALL SELECT lower(external_id), coalesce(member_id, -event_id), 1, event_id FROM ev) QUALIFY row_number() OVER (PARTITION BY email ORDER BY r, a) = 1")
def email_index(spark: SparkSession, d: str) -> DataFrame:
    ids = usage_events(spark, d).select("external_id", F.coalesce("member_id", -F.col("event_id")).alias("member_id"), F.col("event_id").alias("arrival"))
    return devices.email_index(roster(spark, d), ids)


CTES["recs_in"] = "SELECT *, CASE WHEN k % 11 = 0 THEN 'known' WHEN cache_read_tokens IS NULL THEN 'unknown' ELSE 'known' END AS ev_c FROM ev"


@query("record_validation", "SELECT tool, count(*) FILTER (NOT (ev_c = 'known' AND cache_read_tokens IS NULL)) AS valid, count(*) FILTER (ev_c = 'known' AND cache_read_tokens IS NULL) AS refused FROM recs_in GROUP BY tool")
def record_validation(spark: SparkSession, d: str) -> DataFrame:
    """Records some of which claim a value they lack."""
    r = devices.to_records(usage_events(spark, d), [*METRICS], parser_version=1)
    r = r.withColumn("ev_cache_read_tokens", F.when(F.col("k") % 11 == 0, "known").otherwise(F.col("ev_cache_read_tokens")))
    good, bad = devices.valid_records(r, ["cache_read_tokens"])
    both = good.select("tool", F.lit(True).alias("ok")).unionByName(bad.select("tool", F.lit(False).alias("ok")))
    return both.groupBy("tool").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("refused"))


CTES["posts"] = "SELECT event_id AS id, ts AS posted, user_id AS member_id, k FROM ev WHERE tool = 'gemini'"


@query("feed", "WITH t AS (SELECT * FROM posts ORDER BY posted DESC, id DESC LIMIT 100) SELECT t.id, t.member_id, m.name, (SELECT count(DISTINCT e.user_id) FROM ev e WHERE e.tool = 'copilot' AND e.event_id % 50 = t.id % 50) AS reactors FROM t LEFT JOIN members m ON m.member_id = t.member_id")
def feed(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 posts; events of one kind stand for posts, of another for reactions to those of their remainder."""
    e = usage_events(spark, d)
    posts = e.where("tool = 'gemini'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("member_id"))
    who = e.where("tool = 'copilot'").groupBy((F.col("event_id") % 50).alias("rest")).agg(F.count_distinct("user_id").alias("reactors"))
    shown = feeds.feed(posts, members(spark, d), posts.select(F.col("id").alias("post_id"), F.lit("+").alias("emoji"), "member_id"))
    return shown.join(who, F.col("id") % 50 == F.col("rest"), "left").select("id", "member_id", "name", F.coalesce("reactors", F.lit(0)).alias("reactors"))


@query("feed_page", "SELECT id FROM posts WHERE posted <= TIMESTAMP '2024-01-20' ORDER BY posted DESC, id DESC LIMIT 21")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    posts = usage_events(spark, d).where("tool = 'gemini'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return feeds.page(posts, 20, boundary="2024-01-20 00:00:00").select("id")


@query("visible_rows", "SELECT count(*) AS n FROM ev WHERE user_id = 7 OR k % 3 = 0 OR (k % 3 = 1 AND user_id % 10 = 7)")
def visible_rows(spark: SparkSession, d: str) -> DataFrame:
    audience = F.element_at(F.array(*map(F.lit, ("team", "people", "private"))), F.col("k") % 3 + 1)
    rows = usage_events(spark, d).select(F.col("user_id").alias("owner"), audience.alias("audience"), F.array(F.col("user_id") % 10).alias("people"))
    return rows.where(feeds.visible(7)).agg(F.count(F.lit(1)).alias("n"))


@query("device_labels", "SELECT DISTINCT external_id, machine_id, 'Device ' || dense_rank() OVER (PARTITION BY external_id ORDER BY machine_id) AS label FROM daily WHERE machine_id <> ''")
def device_labels(spark: SparkSession, d: str) -> DataFrame:
    own = daily_usage(spark, d).where("machine_id != ''").select("external_id", "machine_id").distinct()
    return own.withColumn("label", device_label(["external_id"], "machine_id"))


@query("report_tools", "SELECT CASE product WHEN 'Claude Code' THEN 'claude_code' ELSE 'claude_' || lower(product) END AS tool, sum(tokens)::BIGINT AS tokens FROM reports GROUP BY 1")
def report_tools(spark: SparkSession, d: str) -> DataFrame:
    return vendor_reports(spark, d).groupBy(report_tool(F.col("product")).alias("tool")).agg(F.sum("tokens").alias("tokens"))


@query("model_families", f"SELECT DISTINCT d.model, {FAMILY_SQL.format(model='d.model', priced='p.family')} AS family FROM daily d LEFT JOIN price_of p ON d.model = p.model AND d.tool = p.tool AND d.date = p.date")
def model_families(spark: SparkSession, d: str) -> DataFrame:
    from .priced import priced

    return priced(spark, d).select("model", family_of(F.col("model"), F.col("family")).alias("family")).distinct()


@query("window_labels", "SELECT DISTINCT 'codex_' || (k * 60) || 'm' AS window_, CASE WHEN (k * 60) % 1440 = 0 THEN (k * 60 // 1440) || 'd' ELSE k || 'h' END AS label FROM ev WHERE k > 0")
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    w = usage_events(spark, d).where("k > 0").select(F.concat(F.lit("codex_"), (F.col("k") * 60).cast("string"), F.lit("m")).alias("window_")).distinct()
    return w.withColumn("label", window_label(F.col("window_")))


@query("price_latest", "SELECT family, provider, max(effective_from) AS effective_from, count(*) AS versions FROM prices GROUP BY family, provider")
def price_latest(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.pricing import seed_prices

    return seed_prices(spark).groupBy("family", "provider").agg(F.max("effective_from").alias("effective_from"), F.count(F.lit(1)).alias("versions"))


@query("onboarding_recency", "SELECT r.member_id, t.tool, coalesce(bool_or(f.date > '2024-01-17'), false) AS recent, coalesce(sum(f.tokens) FILTER (f.date > '2024-01-24'), 0)::BIGINT AS week_tokens FROM roster r CROSS JOIN (SELECT DISTINCT tool FROM f) t LEFT JOIN f ON f.member_id = r.member_id AND f.tool = t.tool GROUP BY ALL")
def onboarding_recency(spark: SparkSession, d: str) -> DataFrame:
    from .totals import facts

    f = facts(spark, d)
    used = f.groupBy("member_id", "tool").agg(F.bool_or(F.col("date") > "2024-01-17").alias("recent"), F.sum(F.when(F.col("date") > "2024-01-24", F.col("tokens"))).cast("long").alias("week_tokens"))
    cells = roster(spark, d).select("member_id").join(F.broadcast(few(f, "tool"))).withColumn("tool", F.explode("tool"))
    return cells.join(used, ["member_id", "tool"], "left").select("member_id", "tool", F.coalesce("recent", F.lit(False)).alias("recent"), F.coalesce("week_tokens", F.lit(0)).alias("week_tokens"))
