"""Totals, trends, rosters and heat-maps: the plain path, where a missing value counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_days, days_before, week
from ..functions.labels import few
from ..functions.semantics import active_user, counted_requests, premium, tokens
from ..sources.telemetry import AS_OF, TOOLS, daily_usage, hourly_usage, limit_readings, members, roster, usage_events
from .registry import query


def facts(spark: SparkSession, d: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Daily usage, of a range of days if given, with the columns most queries share."""
    return daily_usage(spark, d, first, last).select("*", tokens().alias("tokens"), active_user().alias("person"), counted_requests().alias("reqs"), week(F.col("date")).alias("week"))


def total(c: Column | str) -> Column:
    return F.sum(c).cast("long")


def share(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a * 100.0 / b), 6)


@query("period_totals", "SELECT sum(tokens)::BIGINT AS total_tokens, sum(coalesce(input_tokens, 0))::BIGINT AS total_input, sum(coalesce(output_tokens, 0))::BIGINT AS total_output, sum(reqs)::BIGINT AS total_requests, count(DISTINCT person) AS active_members, count(DISTINCT tool) AS tool_count FROM f WHERE date BETWEEN '2024-01-05' AND '2024-01-25'")
def period_totals(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d, "2024-01-05", "2024-01-25")
    return f.agg(
        total("tokens").alias("total_tokens"),
        total(F.coalesce("input_tokens", F.lit(0))).alias("total_input"),
        total(F.coalesce("output_tokens", F.lit(0))).alias("total_output"),
        total("reqs").alias("total_requests"),
        F.count_distinct("person").alias("active_members"),
        F.count_distinct("tool").alias("tool_count"),
    )


@query("tool_summary", "SELECT tool, sum(tokens)::BIGINT AS tokens, sum(reqs)::BIGINT AS requests, count(DISTINCT person) AS active_members FROM f GROUP BY tool")
def tool_summary(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).groupBy("tool").agg(total("tokens").alias("tokens"), total("reqs").alias("requests"), F.count_distinct("person").alias("active_members"))
    return f.orderBy(F.desc("tokens"), F.desc("requests"))


@query("daily_tokens_by_tool", "SELECT date, " + ", ".join(f"coalesce(sum(tokens) FILTER (tool = '{t}'), 0)::BIGINT AS {t}" for t in TOOLS.values()) + " FROM f GROUP BY date")
def daily_tokens_by_tool(spark: SparkSession, d: str) -> DataFrame:
    tools = list(TOOLS.values())
    return facts(spark, d).groupBy("date").pivot("tool", tools).agg(total("tokens")).na.fill(0, tools)


@query("weekly_active_by_tool", "SELECT week, tool, count(DISTINCT person) AS members FROM f GROUP BY week, tool")
def weekly_active_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("week", "tool").agg(F.count_distinct("person").alias("members"))


@query("adoption_rate", "SELECT week, active, total, round(active * 100.0::DOUBLE / total, 6) AS active_pct FROM (SELECT week, count(DISTINCT member_id) AS active FROM f GROUP BY week), (SELECT count(*) AS total FROM roster)")
def adoption_rate(spark: SparkSession, d: str) -> DataFrame:
    active = facts(spark, d).groupBy("week").agg(F.count_distinct("member_id").alias("active"))
    size = roster(spark, d).agg(F.count(F.lit(1)).alias("total"))
    return active.join(F.broadcast(size)).select("week", "active", "total", share(F.col("active"), F.col("total")).alias("active_pct"))


@query("adoption_matrix", "SELECT r.member_id, r.name, t.tool, max(f.date) AS last_date FROM roster r CROSS JOIN (SELECT DISTINCT tool FROM f) t LEFT JOIN f ON f.member_id = r.member_id AND f.tool = t.tool GROUP BY ALL")
def adoption_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    cells = roster(spark, d).select("member_id", "name").join(F.broadcast(few(f, "tool"))).withColumn("tool", F.explode("tool"))
    return cells.join(f.groupBy("member_id", "tool").agg(F.max("date").alias("last_date")), ["member_id", "tool"], "left")


@query("inactive_members", "SELECT r.member_id, r.name, max(f.date) AS last_date FROM roster r LEFT JOIN f ON f.member_id = r.member_id GROUP BY ALL HAVING max(f.date) IS NULL OR max(f.date) < '2024-01-29'")
def inactive_members(spark: SparkSession, d: str) -> DataFrame:
    last = facts(spark, d).groupBy("member_id").agg(F.max("date").alias("last_date"))
    out = roster(spark, d).select("member_id", "name").join(last, "member_id", "left")
    return out.where(F.col("last_date").isNull() | (F.col("last_date") < add_days(F.lit(AS_OF), -2)))


@query("member_list", "SELECT r.member_id, r.name, r.email, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(sum(reqs), 0)::BIGINT AS requests, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool), '') AS tools, max(date) AS last_active FROM roster r LEFT JOIN f ON f.member_id = r.member_id GROUP BY ALL")
def member_list(spark: SparkSession, d: str) -> DataFrame:
    used = facts(spark, d).groupBy("member_id").agg(total("tokens").alias("tokens"), total("reqs").alias("requests"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.max("date").alias("last_active"))
    return roster(spark, d).select("member_id", "name", "email").join(used, "member_id", "left").na.fill(0, ["tokens", "requests"]).na.fill("", ["tools"])


@query("unmapped_ids", "SELECT tool, external_id, sum(tokens)::BIGINT AS tokens, sum(reqs)::BIGINT AS requests, max(date) AS last_date, bool_or(regexp_matches(external_id, '^[^@[:space:]]+@[^@[:space:]]+[.][^@[:space:]]+$')) AS claimable FROM f WHERE member_id IS NULL GROUP BY tool, external_id")
def unmapped_ids(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).where("member_id IS NULL").groupBy("tool", "external_id")
    email = F.col("external_id").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    return f.agg(total("tokens").alias("tokens"), total("reqs").alias("requests"), F.max("date").alias("last_date"), F.bool_or(email).alias("claimable"))


@query("member_breakdown", "SELECT member_id, tool, model, sum(tokens)::BIGINT AS tokens, sum(coalesce(input_tokens,0))::BIGINT AS input, sum(coalesce(output_tokens,0))::BIGINT AS output, sum(coalesce(cache_read_tokens,0))::BIGINT AS cache_read, sum(coalesce(cache_creation_tokens,0))::BIGINT AS cache_creation, sum(reqs)::BIGINT AS requests FROM f WHERE member_id IS NOT NULL GROUP BY member_id, tool, model")
def member_breakdown(spark: SparkSession, d: str) -> DataFrame:
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    f = facts(spark, d).where("member_id IS NOT NULL").groupBy("member_id", "tool", "model")
    return f.agg(total("tokens").alias("tokens"), zero("input_tokens").alias("input"), zero("output_tokens").alias("output"), zero("cache_read_tokens").alias("cache_read"), zero("cache_creation_tokens").alias("cache_creation"), total("reqs").alias("requests"))


@query("member_trend", "SELECT member_id, date, sum(tokens)::BIGINT AS tokens, sum(reqs)::BIGINT AS requests FROM f WHERE member_id IS NOT NULL GROUP BY member_id, date")
def member_trend(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where("member_id IS NOT NULL").groupBy("member_id", "date").agg(total("tokens").alias("tokens"), total("reqs").alias("requests"))


@query("known_tools", "SELECT tool, count(*) AS rows FROM f GROUP BY tool")
def known_tools(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("tool").agg(F.count(F.lit(1)).alias("rows"))


@query("member_tools", "SELECT DISTINCT member_id, tool FROM f WHERE member_id IS NOT NULL")
def member_tools(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where("member_id IS NOT NULL").select("member_id", "tool").distinct()


@query("heatmap", "SELECT s.dow, s.hour, coalesce(sum(h.t), 0)::BIGINT AS tokens FROM (SELECT a.range AS dow, b.range AS hour FROM range(7) a, range(24) b) s LEFT JOIN (SELECT isodow(CAST(substr(hour,1,10) AS DATE)) - 1 AS dow, CAST(substr(hour,12,2) AS BIGINT) AS hour, coalesce(input_tokens,0)+coalesce(output_tokens,0) AS t FROM hourly) h USING (dow, hour) GROUP BY ALL")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_usage(spark, d).select(F.weekday(F.to_date(F.substring("hour", 1, 10))).cast("long").alias("dow"), F.substring("hour", 12, 2).cast("long").alias("hour"), tokens().alias("t"))
    cells = spark.range(168).select(F.floor(F.col("id") / 24).alias("dow"), (F.col("id") % 24).alias("hour"))
    return cells.join(h.groupBy("dow", "hour").agg(total("t").alias("tokens")), ["dow", "hour"], "left").na.fill(0, ["tokens"])


@query("model_distribution", "SELECT tool, model, sum(tokens)::BIGINT AS tokens FROM f GROUP BY tool, model HAVING sum(tokens) > 0")
def model_distribution(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("tool", "model").agg(total("tokens").alias("tokens")).where("tokens > 0")


@query("model_topk_other", "WITH m AS (SELECT tool || '/' || CASE WHEN model = '' THEN 'unspecified' ELSE model END AS label, sum(tokens) AS t FROM f GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY t DESC, label) AS place FROM m) SELECT CASE WHEN place <= 7 THEN label ELSE 'other' END AS label, sum(t)::BIGINT AS tokens FROM r GROUP BY 1")
def model_topk_other(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws("/", "tool", F.when(F.col("model") == "", "unspecified").otherwise(F.col("model")))
    m = facts(spark, d).groupBy(label.alias("label")).agg(total("tokens").alias("t"))  # a row for each tool and model
    top = m.orderBy(F.desc("t"), "label").limit(7).select("label", F.lit(True).alias("top"))
    return m.join(F.broadcast(top), "label", "left").groupBy(F.when(F.col("top"), F.col("label")).otherwise("other").alias("label")).agg(total("t").alias("tokens"))


@query("wow_deltas", "SELECT r.member_id, r.name, s.tokens, s.prev_tokens, CASE WHEN s.prev_tokens > 0 THEN round((s.tokens - s.prev_tokens) * 100.0::DOUBLE / s.prev_tokens, 6) END AS pct FROM (SELECT member_id, coalesce(sum(tokens) FILTER (date >= '2024-01-24'), 0)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (date < '2024-01-24'), 0)::BIGINT AS prev_tokens FROM f WHERE date >= '2024-01-17' AND date < '2024-01-31' AND member_id IS NOT NULL GROUP BY member_id) s JOIN members r USING (member_id)")
def wow_deltas(spark: SparkSession, d: str) -> DataFrame:
    mid, first = (add_days(F.lit(AS_OF), -n) for n in (7, 14))
    f = facts(spark, d).where((F.col("date") >= first) & (F.col("date") < AS_OF) & F.col("member_id").isNotNull())
    part = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0)).cast("long")
    s = f.groupBy("member_id").agg(part(F.col("date") >= mid).alias("tokens"), part(F.col("date") < mid).alias("prev_tokens"))
    s = s.join(members(spark, d).select("member_id", "name"), "member_id")
    return s.withColumn("pct", share(F.col("tokens") - F.col("prev_tokens"), F.col("prev_tokens")))


@query("limit_latest", "SELECT member_id, account_email, coalesce(organization, '') AS organization, window_ AS \"window\", utilization_pct, date FROM limits QUALIFY row_number() OVER (PARTITION BY member_id, account_email, coalesce(organization, ''), window_ ORDER BY date DESC, arrival DESC) = 1")
def limit_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest reading of each member's account, organisation (none is one) and window."""
    g = limit_readings(spark, d).groupBy("member_id", "account_email", F.coalesce("organization", F.lit("")).alias("organization"), "window")
    return g.agg(F.max_by(F.struct("utilization_pct", "date"), F.struct("date", "arrival")).alias("x")).select("member_id", "account_email", "organization", "window", "x.*")


@query("limit_history", 'SELECT account_email, date, window_ AS "window", round(max(utilization_pct), 6) AS peak_pct, round(arg_max(utilization_pct, arrival), 6) AS last_pct FROM limits GROUP BY ALL')
def limit_history(spark: SparkSession, d: str) -> DataFrame:
    g = limit_readings(spark, d).groupBy("account_email", "date", "window")
    return g.agg(F.round(F.max("utilization_pct"), 6).alias("peak_pct"), F.round(F.max_by("utilization_pct", "arrival"), 6).alias("last_pct"))


@query("limit_hits", 'WITH h AS (SELECT account_email, date, window_, max(utilization_pct) AS p FROM limits GROUP BY ALL) SELECT account_email, window_ AS "window", count(*) FILTER (p >= 90) AS days90, count(*) FILTER (p >= 100) AS days100 FROM h GROUP BY ALL HAVING count(*) FILTER (p >= 90) > 0')
def limit_hits(spark: SparkSession, d: str) -> DataFrame:
    g = limit_readings(spark, d).groupBy("account_email", "date", "window").agg(F.max("utilization_pct").alias("p")).groupBy("account_email", "window")
    return g.agg(F.count_if(F.col("p") >= 90).alias("days90"), F.count_if(F.col("p") >= 100).alias("days100")).where("days90 > 0")


@query("limit_history_pivot", "SELECT member_id, date, " + ", ".join(f"round(max(utilization_pct) FILTER (window_ = '{t}'), 6) AS {t}" for t in TOOLS.values()) + " FROM limits GROUP BY member_id, date")
def limit_history_pivot(spark: SparkSession, d: str) -> DataFrame:
    return limit_readings(spark, d).groupBy("member_id", "date").pivot("window", list(TOOLS.values())).agg(F.round(F.max("utilization_pct"), 6))


SUMS = "sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output, sum(cache_read_tokens)::BIGINT AS cache_read, sum(cache_creation_tokens)::BIGINT AS cache_creation, sum(reqs)::BIGINT AS requests, string_agg(DISTINCT model, ',' ORDER BY model) AS models"


def sums() -> list[Column]:
    names = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_creation", "reqs": "requests"}
    return [*[total(c).alias(n) for c, n in names.items()], F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")]


@query("scorecard_sums", f"SELECT member_id, tool, {SUMS} FROM f WHERE member_id IS NOT NULL GROUP BY member_id, tool")
def scorecard_sums(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where("member_id IS NOT NULL").groupBy("member_id", "tool").agg(*sums())


@query("scorecard_weekly", f"SELECT week, member_id, tool, {SUMS} FROM f WHERE member_id IS NOT NULL GROUP BY week, member_id, tool")
def scorecard_weekly(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where("member_id IS NOT NULL").groupBy("week", "member_id", "tool").agg(*sums())


@query("premium_share", "SELECT week, member_id, coalesce(sum(tokens) FILTER (regexp_matches(lower(model), 'opus|fable|mythos')), 0)::BIGINT AS premium_tokens, sum(tokens)::BIGINT AS total_tokens FROM f WHERE member_id IS NOT NULL GROUP BY week, member_id")
def premium_share(spark: SparkSession, d: str) -> DataFrame:
    g = facts(spark, d).where("member_id IS NOT NULL").groupBy("week", "member_id")
    return g.agg(F.sum(F.when(premium(F.col("model")), F.col("tokens")).otherwise(0)).cast("long").alias("premium_tokens"), total("tokens").alias("total_tokens"))


@query("model_breadth", "SELECT week, member_id, model, sum(tokens)::BIGINT AS tokens FROM f WHERE member_id IS NOT NULL GROUP BY ALL")
def model_breadth(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where("member_id IS NOT NULL").groupBy("week", "member_id", "model").agg(total("tokens").alias("tokens"))


@query("model_adoption", "WITH a AS (SELECT model, member_id, min(date) AS first FROM f WHERE member_id IS NOT NULL AND model NOT IN ('', 'unknown', 'default') GROUP BY ALL) SELECT model, min(first) AS global_first, count(*) AS adopters, string_agg(first, ',' ORDER BY first) AS member_first_dates FROM a GROUP BY model")
def model_adoption(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).where(F.col("member_id").isNotNull() & ~F.col("model").isin("", "unknown", "default"))
    first = f.groupBy("model", "member_id").agg(F.min("date").alias("first"))
    return first.groupBy("model").agg(F.min("first").alias("global_first"), F.count(F.lit(1)).alias("adopters"), F.array_join(F.array_sort(F.collect_list("first")), ",").alias("member_first_dates"))


@query("lead_days", "WITH a AS (SELECT model, member_id, min(date) AS first FROM f WHERE member_id IS NOT NULL AND model NOT IN ('', 'unknown', 'default') GROUP BY ALL), n AS (SELECT ceil(count(*) / 2.0)::BIGINT AS k FROM roster), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY first) AS place, min(first) OVER (PARTITION BY model) AS g FROM a) SELECT model, date_diff('day', CAST(g AS DATE), CAST(first AS DATE))::BIGINT AS lead_days FROM r, n WHERE place = k")
def lead_days(spark: SparkSession, d: str) -> DataFrame:
    """Days from a model's first use until half the team uses it; models that don't get so far are left out."""
    f = facts(spark, d).where(F.col("member_id").isNotNull() & ~F.col("model").isin("", "unknown", "default"))
    own = Window.partitionBy("model")
    first = f.groupBy("model", "member_id").agg(F.min("date").alias("first"))
    first = first.select("model", "first", F.row_number().over(own.orderBy("first")).alias("place"), F.min("first").over(own).alias("since"))
    half = roster(spark, d).agg(F.ceil(F.count(F.lit(1)) / 2).alias("half"))
    return first.join(F.broadcast(half), F.col("place") == F.col("half")).select("model", F.datediff(F.to_date("first"), F.to_date("since")).cast("long").alias("lead_days"))


@query("onboarding_activity", "SELECT r.member_id, r.onboarded_at, count(DISTINCT f.date) AS active_days, coalesce(string_agg(DISTINCT f.date, ',' ORDER BY f.date), '') AS active_dates FROM roster r LEFT JOIN f ON f.member_id = r.member_id AND f.date >= r.onboarded_at WHERE r.onboarded_at >= '2023-11-08' GROUP BY ALL")
def onboarding_activity(spark: SparkSession, d: str) -> DataFrame:
    r = roster(spark, d).select("member_id", "onboarded_at").where(F.col("onboarded_at") >= add_days(F.lit(AS_OF), -84))
    days = facts(spark, d).select("member_id", "date").distinct()
    own = r.join(days, "member_id", "left").withColumn("date", F.when(F.col("date") >= F.col("onboarded_at"), F.col("date")))
    return own.groupBy("member_id", "onboarded_at").agg(F.count("date").alias("active_days"), F.array_join(F.array_sort(F.collect_list("date")), ",").alias("active_dates"))


@query("ramp_weeks", "WITH a AS (SELECT r.member_id, date_diff('day', CAST(r.onboarded_at AS DATE), CAST(f.date AS DATE)) // 7 AS ramp_week, f.date FROM roster r JOIN f ON f.member_id = r.member_id AND f.date >= r.onboarded_at) SELECT ramp_week::BIGINT AS ramp_week, count(DISTINCT member_id) AS members, count(DISTINCT member_id || ' ' || date) AS active_days FROM a GROUP BY ramp_week")
def ramp_weeks(spark: SparkSession, d: str) -> DataFrame:
    days = facts(spark, d).select("member_id", "date").distinct()
    own = roster(spark, d).select("member_id", "onboarded_at").join(days, "member_id").where(F.col("date") >= F.col("onboarded_at"))
    n = F.floor(F.datediff(F.to_date("date"), F.to_date("onboarded_at")) / 7)
    return own.groupBy(n.alias("ramp_week")).agg(F.count_distinct("member_id").alias("members"), F.count(F.lit(1)).alias("active_days"))


@query("weekly_report", "SELECT tool, coalesce(sum(tokens) FILTER (date >= '2024-01-24' AND date < '2024-01-31'), 0)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (date >= '2024-01-17' AND date < '2024-01-24'), 0)::BIGINT AS prev_tokens, count(DISTINCT person) FILTER (date >= '2024-01-24' AND date < '2024-01-31') AS users FROM f WHERE date >= '2024-01-17' AND date < '2024-01-31' GROUP BY tool")
def weekly_report(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d, days_before(AS_OF, 14), days_before(AS_OF, 1)).withColumn("now", F.col("date") >= days_before(AS_OF, 7))
    part = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0)).cast("long")
    return f.groupBy("tool").agg(part(F.col("now")).alias("tokens"), part(~F.col("now")).alias("prev_tokens"), F.count_distinct(F.when(F.col("now"), F.col("person"))).alias("users"))


@query("collection_history", "SELECT tool, count(*) AS rows, max(date) AS latest_usage_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_received_at FROM ev GROUP BY tool")
def collection_history(spark: SparkSession, d: str) -> DataFrame:
    g = usage_events(spark, d).groupBy("tool")
    return g.agg(F.count(F.lit(1)).alias("rows"), F.max("date").alias("latest_usage_date"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_received_at"))


@query("sync_freshness", "WITH runs AS (SELECT tool || ':' || source AS connector, date, event_id, CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM ev) SELECT split_part(connector, ':', 1) AS tool, arg_max(date, event_id) AS last_synced_date, arg_max(status, event_id) AS status, max(event_id) AS run_id FROM runs GROUP BY 1")
def sync_freshness(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of each connector, events standing for runs."""
    runs = usage_events(spark, d).select(F.concat_ws(":", "tool", "source").alias("connector"), "date", "event_id", F.when(F.col("k") % 7 == 0, "error").otherwise("ok").alias("status"))
    last = runs.groupBy(F.split("connector", ":")[0].alias("tool")).agg(F.max_by(F.struct("date", "status"), "event_id").alias("x"), F.max("event_id").alias("run_id"))
    return last.select("tool", F.col("x.date").alias("last_synced_date"), "x.status", "run_id")


@query("recent_tools", "SELECT member_id, count(DISTINCT tool) AS tools FROM f WHERE date > '2024-01-24' AND member_id IS NOT NULL GROUP BY member_id")
def recent_tools(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d, days_before(AS_OF, 6)).where("member_id IS NOT NULL")
    return f.groupBy("member_id").agg(F.count_distinct("tool").alias("tools"))


@query("member_rank", "SELECT member_id, tokens, rank() OVER (ORDER BY tokens DESC) AS place FROM (SELECT member_id, sum(tokens)::BIGINT AS tokens FROM f WHERE member_id IS NOT NULL GROUP BY member_id)")
def member_rank(spark: SparkSession, d: str) -> DataFrame:
    per = facts(spark, d).where("member_id IS NOT NULL").groupBy("member_id").agg(total("tokens").alias("tokens"))  # a row for each member
    return per.withColumn("place", F.rank().over(Window.orderBy(F.desc("tokens"))).cast("long"))
