"""Scorecard ratios, exact quantiles over the team, entropies, and reports merged with usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import week
from ..functions.semantics import entropy, ratio
from ..sources.telemetry import AS_OF, daily_usage, usage_events, vendor_reports
from ..operators.devices import health_warnings
from .registry import CTES, query
from .totals import facts, premium_share, total

_Z = "coalesce(sum({0}), 0)::DOUBLE"
CTES["card_sessions"] = "SELECT strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS week, member_id, count(DISTINCT session_id)::DOUBLE AS s FROM ev WHERE member_id IS NOT NULL AND tool = 'claude_code' GROUP BY ALL"
CTES["card"] = f"""SELECT c.*, s FROM (SELECT week, member_id, {_Z.format('input_tokens')} AS i, {_Z.format('output_tokens')} AS o, {_Z.format('cache_read_tokens')} AS r, {_Z.format('cache_creation_tokens')} AS w, {_Z.format('reqs')} AS n,
  sum(CASE WHEN tool = 'claude_code' THEN reqs END)::DOUBLE AS c FROM f WHERE member_id IS NOT NULL GROUP BY week, member_id) c LEFT JOIN card_sessions USING (week, member_id)"""
#: Ratios of sums: what is divided by what.
RATIOS = {"cache_reuse": "rw", "context_yield": "ow", "depth": "cs", "input_per_request": "in", "cache_per_request": "rn", "output_per_request": "on"}
_RATIO = lambda a, b: f"CASE WHEN sum({b}) > 0 THEN sum({a}) / sum({b}) END"


def card(spark: SparkSession, d: str) -> DataFrame:
    """Weekly sums by member; ``c`` and ``s`` are requests and sessions of one tool only, null where it wasn't used."""
    names = {"input_tokens": "i", "output_tokens": "o", "cache_read_tokens": "r", "cache_creation_tokens": "w", "reqs": "n"}
    g = facts(spark, d).where("member_id IS NOT NULL").groupBy("week", "member_id")
    own = F.sum(F.when(F.col("tool") == "claude_code", F.col("reqs"))).cast("double").alias("c")
    sums = g.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(n) for c, n in names.items()], own)
    e = usage_events(spark, d).where("member_id IS NOT NULL AND tool = 'claude_code'").groupBy(week(F.col("date")).alias("week"), "member_id")
    return sums.join(e.agg(F.count_distinct("session_id").cast("double").alias("s")), ["week", "member_id"], "left")


def of_sums(name: str) -> Column:
    """A ratio of sums over the rows of a group, null where nothing is to divide by."""
    a, b = RATIOS[name]
    return ratio(F.sum(a), F.sum(b))


@query("scorecard_ratios", "SELECT member_id, " + ", ".join(f"round({_RATIO(*ab)}, 6) AS {n}" for n, ab in RATIOS.items()) + " FROM card GROUP BY member_id")
def scorecard_ratios(spark: SparkSession, d: str) -> DataFrame:
    return card(spark, d).groupBy("member_id").agg(*[F.round(of_sums(n), 6).alias(n) for n in RATIOS])


def banded(members: DataFrame, pooled: Column | None) -> DataFrame:
    """By week ``pooled`` over members' rows, and the exact median and quartiles of their ``x``; quartiles from eight members on."""
    q = lambda p: F.round(F.percentile("x", F.lit(p)), 6)
    several = F.count(F.lit(1)) >= 8
    whole = [] if pooled is None else [pooled.alias("pooled")]
    return members.groupBy("week").agg(*whole, q(0.5).alias("median"), F.when(several, q(0.25)).alias("p25"), F.when(several, q(0.75)).alias("p75"))


def team_series(members: DataFrame, name: str) -> DataFrame:
    """By week the ratio of all sums, and over members the exact median and quartiles; quartiles from eight members on."""
    a, b = RATIOS[name]
    return banded(members.withColumn("x", ratio(F.col(a), F.col(b))), F.round(of_sums(name), 6))


def _band_sql(rows: str, pooled: str, x: str) -> str:
    quartile = lambda p: f"CASE WHEN count(*) >= 8 THEN round(quantile_cont(x, {p}), 6) END"
    return f"SELECT week, {pooled} AS pooled, round(median(x), 6) AS median, {quartile(0.25)} AS p25, {quartile(0.75)} AS p75 FROM (SELECT *, {x} AS x FROM {rows}) GROUP BY week"


def _series_sql(name: str, rows: str = "card") -> str:
    a, b = RATIOS[name]
    return _band_sql(rows, f"round({_RATIO(a, b)}, 6)", f"CASE WHEN {b} > 0 THEN {a} / {b} END")


@query("weekly_series", _series_sql("cache_reuse"))
def weekly_series(spark: SparkSession, d: str) -> DataFrame:
    return team_series(card(spark, d), "cache_reuse")


@query("weekly_yield_series", _series_sql("context_yield"))
def weekly_yield_series(spark: SparkSession, d: str) -> DataFrame:
    return team_series(card(spark, d), "context_yield")


@query("weekly_depth_series", _series_sql("depth", "(SELECT * FROM card WHERE c IS NOT NULL)"))
def weekly_depth_series(spark: SparkSession, d: str) -> DataFrame:
    """Requests to a session, over those who used that tool in the week."""
    return team_series(card(spark, d).where("c IS NOT NULL"), "depth")


@query("premium_series", "WITH p AS (SELECT week, member_id, coalesce(sum(tokens) FILTER (regexp_matches(lower(model), 'opus|fable|mythos')), 0)::DOUBLE AS p, sum(tokens)::DOUBLE AS t FROM f WHERE member_id IS NOT NULL GROUP BY ALL) " + _band_sql("p", "round(CASE WHEN sum(t) > 0 THEN sum(p) / sum(t) END, 6)", "CASE WHEN t > 0 THEN p / t END"))
def premium_series(spark: SparkSession, d: str) -> DataFrame:
    """The share of tokens on top-tier models, by week: of all tokens, and its median and quartiles over members."""
    x = premium_share(spark, d).withColumn("x", ratio(F.col("premium_tokens").cast("double"), F.col("total_tokens")))
    return banded(x, F.round(ratio(F.sum("premium_tokens").cast("double"), F.sum("total_tokens")), 6))


_ENTROPY_SQL = "CASE WHEN count(*) FILTER (t > 0) = 1 THEN 0::DOUBLE WHEN count(*) FILTER (t > 0) > 1 THEN -sum(t / s * log2(t / s)) FILTER (t > 0) / log2(count(*) FILTER (t > 0)) END"


@query("breadth_series", f"""WITH m AS (SELECT week, member_id, model, sum(tokens)::DOUBLE AS t FROM f WHERE member_id IS NOT NULL AND model <> '' GROUP BY ALL),
  o AS (SELECT week, {_ENTROPY_SQL} AS pooled FROM (SELECT *, sum(t) OVER (PARTITION BY week) AS s FROM (SELECT week, model, sum(t) AS t FROM m GROUP BY ALL)) GROUP BY week),
  e AS (SELECT week, member_id, {_ENTROPY_SQL} AS x FROM (SELECT *, sum(t) OVER (PARTITION BY week, member_id) AS s FROM m) GROUP BY ALL)
  SELECT week, round(any_value(pooled), 6) AS pooled, round(median(x), 6) AS median, CASE WHEN count(*) >= 8 THEN round(quantile_cont(x, 0.25), 6) END AS p25, CASE WHEN count(*) >= 8 THEN round(quantile_cont(x, 0.75), 6) END AS p75 FROM e JOIN o USING (week) GROUP BY week""")
def breadth_series(spark: SparkSession, d: str) -> DataFrame:
    """How evenly tokens spread over models, by week: of the team's sums, and its median and quartiles over members."""
    t = facts(spark, d).where("member_id IS NOT NULL AND model != ''").groupBy("week", "member_id", "model").agg(F.sum("tokens").cast("double").alias("t"))
    team = t.groupBy("week", "model").agg(F.sum("t").alias("t")).groupBy("week").agg(F.round(entropy(F.collect_list("t")), 6).alias("pooled"))
    x = t.groupBy("week", "member_id").agg(entropy(F.collect_list("t")).alias("x"))
    return banded(x, None).join(team, "week").select("week", "pooled", "median", "p25", "p75")


_MINE = ["cache_reuse", "context_yield", "depth"]


@query("personal_scorecard", "WITH x AS (SELECT member_id, " + ", ".join(f"{_RATIO(*RATIOS[n])} AS {n}" for n in _MINE) + " FROM card GROUP BY member_id) SELECT member_id, " + ", ".join(f"round({n}, 6) AS {n}, round((SELECT median({n}) FROM x), 6) AS team_{n}" for n in _MINE) + " FROM x")
def personal_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Each member's ratios beside the team's medians."""
    s = card(spark, d).groupBy("member_id").agg(*[of_sums(n).alias(n) for n in _MINE])
    team = s.agg(*[F.round(F.percentile(n, F.lit(0.5)), 6).alias(f"team_{n}") for n in _MINE])
    return s.join(F.broadcast(team)).select("member_id", *[F.round(n, 6).alias(n) for n in _MINE], *[f"team_{n}" for n in _MINE])


@query("cache_savings_rate", "SELECT round(CASE WHEN saved + spent > 0 THEN saved / (saved + spent) END, 6) AS rate FROM (SELECT sum(r0 / 1e6::DOUBLE * (input_rate - cache_read_rate)) AS saved, sum((i0*input_rate + o0*output_rate + r0*cache_read_rate + w0*cache_write_rate) / 1e6::DOUBLE) AS spent FROM pf WHERE family IS NOT NULL)")
def cache_savings_rate(spark: SparkSession, d: str) -> DataFrame:
    """What cache reads saved, of what would have been spent without them."""
    from .priced import cache_savings

    return cache_savings(spark, d).select(F.round(ratio(F.col("saved"), F.col("spent") + F.col("saved")), 6).alias("rate"))


@query("tool_entropy", "WITH t AS (SELECT member_id, tool, sum(tokens)::DOUBLE AS t FROM f WHERE member_id IS NOT NULL GROUP BY ALL), p AS (SELECT member_id, t / sum(t) OVER (PARTITION BY member_id) AS p FROM t WHERE t > 0) SELECT member_id, round(CASE WHEN count(*) = 1 THEN 0 ELSE -sum(p * log2(p)) / log2(count(*)) END, 6) AS entropy FROM p GROUP BY member_id")
def tool_entropy(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d).where("member_id IS NOT NULL").groupBy("member_id", "tool").agg(F.sum("tokens").cast("double").alias("t"))
    return t.groupBy("member_id").agg(F.round(entropy(F.collect_list("t")), 6).alias("entropy")).where("entropy IS NOT NULL")


@query("model_breadth_entropy", "WITH t AS (SELECT week, member_id, model, sum(tokens)::DOUBLE AS t FROM f WHERE member_id IS NOT NULL GROUP BY ALL), p AS (SELECT week, member_id, t / sum(t) OVER (PARTITION BY week, member_id) AS p FROM t WHERE t > 0), e AS (SELECT week, member_id, CASE WHEN count(*) = 1 THEN 0::DOUBLE ELSE -sum(p * log2(p)) / log2(count(*)) END AS e FROM p GROUP BY ALL) SELECT week, round(median(e), 6) AS median_breadth, count(*) AS members FROM e GROUP BY week")
def model_breadth_entropy(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d).where("member_id IS NOT NULL").groupBy("week", "member_id", "model").agg(F.sum("tokens").cast("double").alias("t"))
    e = t.groupBy("week", "member_id").agg(entropy(F.collect_list("t")).alias("e")).where("e IS NOT NULL")
    return e.groupBy("week").agg(F.round(F.percentile("e", F.lit(0.5)), 6).alias("median_breadth"), F.count(F.lit(1)).alias("members"))


@query("context_yield_dump", f"SELECT week, round({_RATIO('o', 'w')}, 6) AS yield, round(min(CASE WHEN w > 0 THEN o / w END), 6) AS low, round(max(CASE WHEN w > 0 THEN o / w END), 6) AS high FROM card WHERE CAST(week AS DATE) > CAST('{{as_of}}' AS DATE) - 84 GROUP BY week")
def context_yield_dump(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve weeks' yield, and its spread over members."""
    own = ratio(F.col("o"), F.col("w"))
    c = card(spark, d).where(F.to_date("week") > F.date_sub(F.lit(AS_OF).cast("date"), 84))
    return c.groupBy("week").agg(F.round(of_sums("context_yield"), 6).alias("yield"), F.round(F.min(own), 6).alias("low"), F.round(F.max(own), 6).alias("high"))


@query("context_yield_delta", f"SELECT round(a, 6) AS now, round(b, 6) AS before, round(a - b, 6) AS delta FROM (SELECT {_RATIO('o', 'w').replace('sum(', 'sum(n')} AS a, {_RATIO('o', 'w').replace('sum(', 'sum(b')} AS b FROM (SELECT CASE WHEN date >= '2024-01-24' THEN coalesce(output_tokens, 0) END::DOUBLE AS no, CASE WHEN date >= '2024-01-24' THEN coalesce(cache_creation_tokens, 0) END::DOUBLE AS nw, CASE WHEN date < '2024-01-24' THEN coalesce(output_tokens, 0) END::DOUBLE AS bo, CASE WHEN date < '2024-01-24' THEN coalesce(cache_creation_tokens, 0) END::DOUBLE AS bw FROM f WHERE member_id IS NOT NULL AND date >= '2024-01-17' AND date < '2024-01-31'))")
def context_yield_delta(spark: SparkSession, d: str) -> DataFrame:
    """The team's yield of the last seven days against the seven before."""
    f = facts(spark, d, "2024-01-17", "2024-01-30").where("member_id IS NOT NULL")
    late = F.col("date") >= "2024-01-24"
    part = lambda c, when: F.sum(F.when(when, F.coalesce(c, F.lit(0)))).cast("double")
    x = f.agg(*[ratio(part("output_tokens", w), part("cache_creation_tokens", w)).alias(n) for n, w in (("now", late), ("before", ~late))])
    return x.select(F.round("now", 6).alias("now"), F.round("before", 6).alias("before"), F.round(F.col("now") - F.col("before"), 6).alias("delta"))


# Reports against usage: of a person's day the larger side counts for the tool both cover; other products are added.
CTES["local_cc"] = "SELECT date, external_id, sum(coalesce(input_tokens,0) + coalesce(output_tokens,0) + coalesce(cache_creation_tokens,0))::BIGINT AS t, sum(requests)::BIGINT AS q FROM daily WHERE tool = 'claude_code' GROUP BY ALL"
CTES["report_cc"] = "SELECT date, external_id, sum(tokens)::BIGINT // 100 AS t, sum(requests)::BIGINT AS q FROM reports WHERE product = 'Claude Code' GROUP BY ALL"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    new = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0))
    local = daily_usage(spark, d).where("tool = 'claude_code'").groupBy("date", "external_id").agg(F.sum(new).alias("t"), F.sum("requests").alias("q"))
    report = vendor_reports(spark, d).where("product = 'Claude Code'").groupBy("date", "external_id").agg(F.floor(F.sum("tokens") / 100).alias("t"), F.sum("requests").alias("q"))
    return local, report


@query("report_merge", "WITH j AS (SELECT coalesce(l.date, r.date) AS date, coalesce(l.external_id, r.external_id) AS external_id, l.t AS lt, l.q AS lq, r.t AS rt, r.q AS rq FROM local_cc l FULL JOIN report_cc r ON l.date = r.date AND l.external_id = r.external_id), c AS (SELECT *, lt IS NOT NULL AND (rt IS NULL OR lt > rt OR (lt = rt AND lq >= rq)) AS mine FROM j) SELECT date, external_id, 'claude_code' AS tool, CASE WHEN mine THEN 'local' ELSE 'report' END AS side, CASE WHEN mine THEN lt ELSE rt END AS tokens, CASE WHEN mine THEN lq ELSE rq END AS requests FROM c UNION ALL SELECT date, external_id, regexp_replace(lower(product), '[^a-z0-9]+', '_', 'g'), 'report', tokens // 100, requests FROM reports WHERE product <> 'Claude Code'")
def report_merge(spark: SparkSession, d: str) -> DataFrame:
    local, report = sides(spark, d)
    j = local.select("date", "external_id", F.col("t").alias("lt"), F.col("q").alias("lq")).join(report.select("date", "external_id", F.col("t").alias("rt"), F.col("q").alias("rq")), ["date", "external_id"], "full")
    mine = F.col("lt").isNotNull() & (F.col("rt").isNull() | (F.col("lt") > F.col("rt")) | ((F.col("lt") == F.col("rt")) & (F.col("lq") >= F.col("rq"))))
    pick = lambda a, b: F.when(mine, F.col(a)).otherwise(F.col(b))
    own = j.select("date", "external_id", F.lit("claude_code").alias("tool"), F.when(mine, "local").otherwise("report").alias("side"), pick("lt", "rt").alias("tokens"), pick("lq", "rq").alias("requests"))
    slug = F.regexp_replace(F.lower("product"), "[^a-z0-9]+", "_")
    rest = vendor_reports(spark, d).where("product != 'Claude Code'").select("date", "external_id", slug.alias("tool"), F.lit("report").alias("side"), F.floor(F.col("tokens") / 100).alias("tokens"), "requests")
    return own.unionByName(rest)


@query("growth_report_merge", "SELECT coalesce(l.date, r.date) AS date, coalesce(l.external_id, r.external_id) AS external_id, greatest(coalesce(l.t, 0), coalesce(r.t, 0)) AS tokens, greatest(coalesce(l.q, 0), coalesce(r.q, 0)) AS requests FROM local_cc l FULL JOIN report_cc r ON l.date = r.date AND l.external_id = r.external_id")
def growth_report_merge(spark: SparkSession, d: str) -> DataFrame:
    local, report = sides(spark, d)
    j = local.join(report.withColumnsRenamed({"t": "rt", "q": "rq"}), ["date", "external_id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("date", "external_id", F.greatest(zero("t"), zero("rt")).alias("tokens"), F.greatest(zero("q"), zero("rq")).alias("requests"))


# Touched files: a session's repository and file stand for an edit.
CTES["touched"] = "SELECT DISTINCT member_id, 'repo' || (k % 5) AS repo, 'file' || (event_id % 400) AS file FROM ev WHERE member_id IS NOT NULL AND date >= '2024-01-24'"
CTES["shared"] = "SELECT repo, file, string_agg(DISTINCT member_id::VARCHAR, '+' ORDER BY member_id::VARCHAR) AS members FROM touched GROUP BY ALL HAVING count(DISTINCT member_id) >= 2"


@query("digest_conflicts", "SELECT repo, members, count(*) AS file_count, string_agg(file, ',' ORDER BY file) FILTER (place <= 3) AS sample_files FROM (SELECT *, row_number() OVER (PARTITION BY repo, members ORDER BY file) AS place FROM shared) GROUP BY repo, members")
def digest_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Files that two or more members touched, by repository and set of members."""
    e = usage_events(spark, d, "2024-01-24").where("member_id IS NOT NULL")
    t = e.select(F.col("member_id").cast("string").alias("m"), F.concat(F.lit("repo"), (F.col("k") % 5).cast("string")).alias("repo"), F.concat(F.lit("file"), (F.col("event_id") % 400).cast("string")).alias("file"))
    shared = t.groupBy("repo", "file").agg(F.array_sort(F.collect_set("m")).alias("who")).where(F.size("who") >= 2)
    shared = shared.select("repo", "file", F.array_join("who", "+").alias("members"))
    place = F.row_number().over(Window.partitionBy("repo", "members").orderBy("file"))
    first = F.collect_list(F.when(F.col("place") <= 3, F.col("file")))
    return shared.withColumn("place", place).groupBy("repo", "members").agg(F.count(F.lit(1)).alias("file_count"), F.array_join(F.array_sort(first), ",").alias("sample_files"))


@query("device_union", "SELECT external_id, machine_id, max(date) AS last_date, sum(tokens) FILTER (date > '2024-01-17')::BIGINT AS recent_tokens, sum(reqs) FILTER (date > '2024-01-17')::BIGINT AS recent_requests, max(date) < '2024-01-30' AS stale FROM f WHERE machine_id <> '' GROUP BY external_id, machine_id")
def device_union(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).where("machine_id != ''")
    recent = lambda c: F.sum(F.when(F.col("date") > "2024-01-17", F.col(c))).cast("long")
    return f.groupBy("external_id", "machine_id").agg(F.max("date").alias("last_date"), recent("tokens").alias("recent_tokens"), recent("reqs").alias("recent_requests"), (F.max("date") < "2024-01-30").alias("stale"))


@query("device_health", "WITH h AS (SELECT machine_id, tool AS parser, date, count(*) AS files, count(*) FILTER (k % 9 = 0) AS odd, count(DISTINCT CASE WHEN k % 4 = 0 THEN session_id END) AS sessions FROM ev WHERE machine_id <> '' GROUP BY ALL), b AS (SELECT *, avg(odd) OVER w AS odd_before, avg(files) OVER w AS files_before FROM h WINDOW w AS (PARTITION BY machine_id, parser ORDER BY CAST(date AS DATE) RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)), l AS (SELECT * FROM b QUALIFY date = max(date) OVER (PARTITION BY machine_id, parser)) SELECT machine_id, parser, date, files, sessions, odd, round(files_before, 6) AS files_before, round(odd_before, 6) AS odd_before, odd_before IS NOT NULL AND (files > 0 AND files >= files_before AND sessions = 0 OR odd >= 5 AND odd / greatest(1, odd_before) > 1.2::DOUBLE) AS warn FROM l")
def device_health(spark: SparkSession, d: str) -> DataFrame:
    """The latest reading of each device's parser against the mean of the week before, events standing for files."""
    g = usage_events(spark, d).where("machine_id != ''").groupBy("machine_id", F.col("tool").alias("parser"), "date")
    h = g.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("k") % 9 == 0).alias("odd"), F.count_distinct(F.when(F.col("k") % 4 == 0, F.col("session_id"))).alias("sessions"))
    x = health_warnings(h)
    return x.select("machine_id", "parser", "date", "files", "sessions", "odd", F.round("files_before", 6).alias("files_before"), F.round("odd_before", 6).alias("odd_before"), "warn")


@query("sessions_vs_legacy", "WITH s AS (SELECT tool, machine_id, date, sum(input_tokens) AS a FROM ev WHERE source = 'uploader' AND k % 2 = 0 GROUP BY ALL), l AS (SELECT tool, machine_id, date, sum(input_tokens) AS b FROM daily WHERE source = 'uploader' GROUP BY ALL) SELECT coalesce(s.tool, l.tool) AS tool, coalesce(s.machine_id, l.machine_id) AS machine_id, coalesce(s.date, l.date) AS date, coalesce(a, 0)::BIGINT AS sessions, coalesce(b, 0)::BIGINT AS legacy, (coalesce(a, 0) - coalesce(b, 0))::BIGINT AS diff FROM s FULL JOIN l ON s.tool = l.tool AND s.machine_id = l.machine_id AND s.date = l.date")
def sessions_vs_legacy(spark: SparkSession, d: str) -> DataFrame:
    keys = ["tool", "machine_id", "date"]
    s = usage_events(spark, d).where("source = 'uploader' AND k % 2 = 0").groupBy(*keys).agg(F.sum("input_tokens").alias("sessions"))
    legacy = daily_usage(spark, d).where("source = 'uploader'").groupBy(*keys).agg(F.sum("input_tokens").alias("legacy"))
    return s.join(legacy, keys, "full").na.fill(0, ["sessions", "legacy"]).withColumn("diff", F.col("sessions") - F.col("legacy"))


@query("tool_freshness", "SELECT t.tool, u.last_usage, r.last_run FROM (SELECT DISTINCT tool FROM ev) t LEFT JOIN (SELECT tool, max(date) AS last_usage FROM ev WHERE k % 2 = 0 GROUP BY 1) u USING (tool) LEFT JOIN (SELECT tool, max(date) AS last_run FROM ev WHERE source = 'poller' GROUP BY 1) r USING (tool)")
def tool_freshness(spark: SparkSession, d: str) -> DataFrame:
    e = usage_events(spark, d)
    used = e.where("k % 2 = 0").groupBy("tool").agg(F.max("date").alias("last_usage"))
    ran = e.where("source = 'poller'").groupBy("tool").agg(F.max("date").alias("last_run"))
    return used.join(ran, "tool", "full")


def newest_reports(reports: DataFrame, limit: int = 20) -> DataFrame:
    """Every person's newest report rows, as many as asked for, at least one and at most 200."""
    place = F.row_number().over(Window.partitionBy("external_id").orderBy(F.desc("date"), "product"))
    return reports.withColumn("place", place).where(F.col("place") <= max(1, min(limit, 200))).drop("place")


@query("latest_reports", "SELECT date, external_id, product, tokens, requests FROM reports QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY date DESC, product) <= 20")
def latest_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every person's latest report rows, the feature being a short list of 20."""
    return newest_reports(vendor_reports(spark, d)).select("date", "external_id", "product", "tokens", "requests")


@query("local_audit", "SELECT tool, date, " + ", ".join(f"count(*) FILTER (raw_model = '{m}') AS m{i}" for i, m in enumerate(("opus-5", "gpt-5.5"))) + ", count(*) AS n FROM ev GROUP BY tool, date")
def local_audit(spark: SparkSession, d: str) -> DataFrame:
    one = lambda m, i: F.count_if(F.col("raw_model") == m).alias(f"m{i}")
    return usage_events(spark, d).groupBy("tool", "date").agg(*[one(m, i) for i, m in enumerate(("opus-5", "gpt-5.5"))], F.count(F.lit(1)).alias("n"))


@query("observation_snapshot", "SELECT coalesce(tool, '*') AS tool, coalesce(member_id, -1) AS member_id, sum(tokens)::BIGINT AS tokens FROM f WHERE member_id IS NOT NULL GROUP BY GROUPING SETS ((), (tool), (member_id))")
def observation_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Totals, tools and people from one scan."""
    f = facts(spark, d).where("member_id IS NOT NULL")
    g = f.groupingSets([[], ["tool"], ["member_id"]], "tool", "member_id").agg(total("tokens").alias("tokens"))
    return g.select(F.coalesce("tool", F.lit("*")).alias("tool"), F.coalesce("member_id", F.lit(-1)).alias("member_id"), "tokens")


@query("session_summary", "SELECT tool, count(DISTINCT session_id) AS sessions, min(date) AS first_date, max(date) AS last_date, sum(requests)::BIGINT AS requests FROM ev GROUP BY tool")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    g = usage_events(spark, d).groupBy("tool")
    return g.agg(F.count_distinct("session_id").alias("sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("requests").alias("requests"))
