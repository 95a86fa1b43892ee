"""The display path: values keep their evidence, missing is not 0, prices convert, spines show empty days."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import spine
from ..functions.pricing import convert, match_prices, reference_rates, seed_prices
from ..functions.labels import few
from ..functions.semantics import KNOWN, METRICS, UNSUPPORTED, observe
from ..operators.scan import Match, Reports, Review, display_scan
from ..sources.telemetry import AS_OF, daily_usage, hourly_usage, roster
from .registry import CTES, query
from .totals import share

# The observation rules over the adapter in SQL. Its values are never negative, fractional or infinite, and only cache creation carries evidence.
CTES["obs"] = (
    "SELECT *, "
    + ", ".join(
        f"CASE WHEN (source = 'poller' AND tool = 'copilot'){extra} THEN 'unsupported' WHEN {c} IS NULL OR {c} = 0 THEN 'unknown' ELSE 'known' END AS s_{c}"
        for c, extra in (("input_tokens", ""), ("output_tokens", ""), ("cache_read_tokens", ""), ("cache_creation_tokens", " OR ev_cache_creation = 'unsupported'"), ("requests", " OR (source = 'poller' AND tool = 'cursor' AND model <> '')"))
    )
    + " FROM daily"
)
CTES["seen"] = (
    "SELECT o.*, family, input_rate, output_rate, cache_read_rate, cache_write_rate, "
    + ", ".join(f"CASE WHEN s_{c} = 'known' THEN {c}::DOUBLE END AS v_{c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "requests"))
    + " FROM obs o LEFT JOIN price_of USING (model, tool, date)"
)
_V = [f"v_{c}" for c in METRICS]
_ANY = "(" + " OR ".join(f"{v} IS NOT NULL" for v in _V) + ")"
_RAW = " + ".join(f"coalesce({v}, 0)" for v in _V)
_USD = "(" + " + ".join(f"coalesce({v}, 0) * {r}" for v, r in zip(_V, ("input_rate", "output_rate", "cache_read_rate", "cache_write_rate"))) + ") / 1e6::DOUBLE"
_ALL_UNSUPPORTED = " AND ".join(f"s_{c} = 'unsupported'" for c in METRICS)
_ALL_KNOWN = " AND ".join(f"s_{c} IN ('known', 'unsupported')" for c in METRICS)
CTES["shown"] = f"""SELECT *, CASE WHEN {_ANY} THEN {_RAW} END AS raw_value,
  CASE WHEN {_ANY} AND ({_RAW} = 0 OR family IS NOT NULL) THEN CASE WHEN family IS NULL THEN 0 ELSE {_USD} END END AS usd_value,
  CASE WHEN {_ANY} AND family IS NULL THEN {_RAW} ELSE 0 END AS unpriced,
  CASE WHEN {_ALL_UNSUPPORTED} THEN 'unsupported' WHEN {_ALL_KNOWN} THEN 'known' ELSE 'unknown' END AS status FROM seen"""


def shown(spark: SparkSession, facts: DataFrame, unit: str = "usd", basis: str = "all") -> DataFrame:
    """Facts with observed metrics and ``value, unpriced, status`` in one unit.

    The value is null where no metric of the row was measured or its price is
    missing; the status is unsupported if all metrics are, known if none of the
    others is unknown.
    """
    evidence = {m: F.col(f"ev_{m}") for m in (*METRICS, "requests") if f"ev_{m}" in facts.columns}
    seen = facts.select("*", *[observe(m, evidence.get(m)).alias(f"o_{m}") for m in (*METRICS, "requests")])
    for m in METRICS:
        seen = seen.withColumn(m, F.col(f"o_{m}.value"))
    seen = seen.withColumn("requests", F.col("o_requests.value"))
    p = seed_prices(spark)
    seen = reference_rates(match_prices(seen, p), p).withColumn("c", convert(basis, unit))
    measured = F.coalesce(*METRICS).isNotNull()
    status = [F.col(f"o_{m}.status") for m in METRICS]
    every = lambda *ok: F.forall(F.array(*status), lambda s: s.isin(*ok))
    return seen.select(
        "*",
        F.when(measured & ~F.col("c.unpriced"), F.col("c.value")).alias("value"),
        F.when(measured & F.col("c.unpriced"), F.col("c.measured")).otherwise(0.0).alias("unpriced"),
        F.when(every(UNSUPPORTED), UNSUPPORTED).when(every(KNOWN, UNSUPPORTED), KNOWN).otherwise("unknown").alias("status"),
    )


def view(spark: SparkSession, d: str, match: Match = Match(), *, unit: str = "usd", basis: str = "all", grain: str = "day", review: Review | None = None, reports: Reports | None = None) -> DataFrame:
    """The scan that every display query starts from, shown in a unit; the filter's days reach the events as instants."""
    when = match.terms.get("date")
    when = when if isinstance(when, Mapping) else {"gte": when, "lte": when}
    facts = hourly_usage(spark, d) if grain == "hour" else daily_usage(spark, d, when.get("gte"), when.get("lte"))
    if grain == "hour":
        facts = facts.withColumn("date", F.substring("hour", 1, 10))
    return shown(spark, display_scan(facts, match, grain=grain, review=review, reports=reports), unit, basis)


def added_up(*, users: bool = True) -> list:
    """Aggregates of shown rows: null only if all are; what is unknown, unsupported, from where."""
    out = [
        F.round(F.sum("value"), 9).alias("value"),
        F.sum("unpriced").cast("long").alias("unpriced_tokens"),
        F.bool_or(F.col("status") == "unknown").alias("some_unknown"),
        F.bool_and(F.col("status") == UNSUPPORTED).alias("all_unsupported"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("date_basis")), ",").alias("bases"),
    ]
    return [*out, F.count_distinct("external_id").alias("users")] if users else out


ADDED = "round(sum(usd_value), 9) AS value, sum(unpriced)::BIGINT AS unpriced_tokens, bool_or(status = 'unknown') AS some_unknown, bool_and(status = 'unsupported') AS all_unsupported, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT date_basis, ',' ORDER BY date_basis) AS bases"


@query("display_totals", f"SELECT {ADDED}, count(DISTINCT external_id) AS users FROM shown")
def display_totals(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).agg(*added_up())


@query("display_tool_summary", f"SELECT tool, {ADDED}, count(DISTINCT external_id) AS users FROM shown GROUP BY tool")
def display_tool_summary(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).groupBy("tool").agg(*added_up())


def requests_only(rows: DataFrame) -> DataFrame:
    """Tools that report requests and nothing else that has a value."""
    g = rows.groupBy("tool").agg(F.sum("value").alias("v"), F.sum("requests").cast("long").alias("requests"))
    return g.where("v IS NULL AND requests > 0").select("tool", "requests")


@query("display_model_distribution", "SELECT tool, model, round(sum(usd_value), 9) AS value, sum(unpriced)::BIGINT AS unpriced_tokens FROM shown GROUP BY tool, model HAVING coalesce(sum(usd_value), 0) > 0 OR sum(unpriced) > 0")
def display_model_distribution(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d).groupBy("tool", "model").agg(F.round(F.sum("value"), 9).alias("value"), F.sum("unpriced").cast("long").alias("unpriced_tokens"))
    return g.where("coalesce(value, 0) > 0 OR unpriced_tokens > 0")


@query("display_daily_spine", "SELECT s.date, t.tool, round(sum(x.raw_value), 9) AS value, bool_or(x.status = 'unknown') AS some_unknown FROM (SELECT strftime(DATE '2023-12-28' + CAST(range AS INT), '%Y-%m-%d') AS date FROM range(40)) s CROSS JOIN (SELECT DISTINCT tool FROM daily) t LEFT JOIN shown x ON x.date = s.date AND x.tool = t.tool GROUP BY s.date, t.tool")
def display_daily_spine(spark: SparkSession, d: str) -> DataFrame:
    cells = spine(spark, "2023-12-28", "2024-02-05").join(F.broadcast(few(daily_usage(spark, d), "tool"))).withColumn("tool", F.explode("tool"))
    per = view(spark, d, unit="raw").groupBy("date", "tool").agg(F.round(F.sum("value"), 9).alias("value"), F.bool_or(F.col("status") == "unknown").alias("some_unknown"))
    return cells.join(per, ["date", "tool"], "left")


@query("display_daily_requests", "SELECT s.date, sum(x.v_requests)::BIGINT AS requests FROM (SELECT strftime(DATE '2023-12-28' + CAST(range AS INT), '%Y-%m-%d') AS date FROM range(40)) s LEFT JOIN seen x ON x.date = s.date GROUP BY s.date")
def display_daily_requests(spark: SparkSession, d: str) -> DataFrame:
    per = daily_usage(spark, d).groupBy("date").agg(F.sum(observe("requests")["value"]).cast("long").alias("requests"))
    return spine(spark, "2023-12-28", "2024-02-05").join(per, "date", "left")


@query("member_series_other", "WITH k AS (SELECT coalesce(r.member_id::VARCHAR, '__other') AS series, x.date, x.usd_value FROM shown x LEFT JOIN roster r ON r.member_id = x.member_id), a AS (SELECT series, date, usd_value FROM k UNION ALL SELECT '__total', date, usd_value FROM shown) SELECT series, date, round(sum(usd_value), 9) AS value FROM a GROUP BY ALL")
def member_series_other(spark: SparkSession, d: str) -> DataFrame:
    known = roster(spark, d).select("member_id", F.col("member_id").cast("string").alias("own"))
    x = view(spark, d).select("member_id", "date", "value").join(known, "member_id", "left")
    x = x.select("date", "value", F.explode(F.array(F.coalesce("own", F.lit("__other")), F.lit("__total"))).alias("series"))
    return x.groupBy("series", "date").agg(F.round(F.sum("value"), 9).alias("value"))


@query("member_series_spine", """WITH s AS (SELECT strftime(DATE '2023-12-28' + CAST(range AS INT), '%Y-%m-%d') AS date FROM range(40)), n AS (SELECT 'm' || member_id AS series, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' · ' || member_id ELSE name END AS label FROM roster UNION ALL SELECT 'other', 'other' WHERE EXISTS (SELECT 1 FROM shown LEFT JOIN roster r USING (member_id) WHERE r.member_id IS NULL)),
  k AS (SELECT coalesce('m' || r.member_id, 'other') AS series, x.date, x.usd_value, x.unpriced FROM shown x LEFT JOIN roster r ON r.member_id = x.member_id) SELECT n.series, n.label, s.date, round(sum(k.usd_value), 9) AS value, coalesce(sum(k.unpriced), 0)::BIGINT AS unpriced_tokens FROM s CROSS JOIN n LEFT JOIN k ON k.series = n.series AND k.date = s.date GROUP BY ALL""")
def member_series_spine(spark: SparkSession, d: str) -> DataFrame:
    """A value, null if none, for every listed member and day, the others together; members of one name are told apart."""
    same = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    names = roster(spark, d).select(F.concat(F.lit("m"), F.col("member_id").cast("string")).alias("series"), F.when(same, F.concat_ws(" · ", "name", F.col("member_id").cast("string"))).otherwise(F.col("name")).alias("label"), "member_id")
    x = view(spark, d).select("member_id", "date", "value", "unpriced").join(names.select("member_id", "series"), "member_id", "left")
    per = x.groupBy(F.coalesce("series", F.lit("other")).alias("series"), "date").agg(F.sum("value").alias("v"), F.sum("unpriced").alias("u"))
    other = per.where("series = 'other'").select("series", F.lit("other").alias("label")).limit(1)  # one label
    dates = F.transform(F.sequence(F.lit("2023-12-28").cast("date"), F.lit("2024-02-05").cast("date")), lambda x: F.date_format(x, "yyyy-MM-dd"))
    cells = names.select("series", "label").unionByName(other).select("series", "label", F.explode(dates).alias("date"))
    return cells.join(per, ["series", "date"], "left").select("series", "label", "date", F.round("v", 9).alias("value"), F.coalesce("u", F.lit(0)).cast("long").alias("unpriced_tokens"))


@query("display_heatmap", "SELECT s.dow, s.hour, sum(h.t)::BIGINT AS tokens FROM (SELECT a.range AS dow, b.range AS hour FROM range(7) a, range(24) b) s LEFT JOIN (SELECT isodow(CAST(substr(hour,1,10) AS DATE)) - 1 AS dow, CAST(substr(hour,12,2) AS BIGINT) AS hour, CASE WHEN NOT (source = 'poller' AND tool = 'copilot') THEN nullif(coalesce(input_tokens, 0) + coalesce(output_tokens, 0), 0) END AS t FROM hourly) h USING (dow, hour) GROUP BY ALL")
def display_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Cells without a measured value stay null."""
    both = [observe(m)["value"] for m in ("input_tokens", "output_tokens")]
    t = F.when(F.coalesce(*both).isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in both), F.lit(0.0)))
    h = hourly_usage(spark, d).select(F.weekday(F.to_date(F.substring("hour", 1, 10))).cast("long").alias("dow"), F.substring("hour", 12, 2).cast("long").alias("hour"), t.alias("t"))
    cells = spark.range(168).select(F.floor(F.col("id") / 24).alias("dow"), (F.col("id") % 24).alias("hour"))
    return cells.join(h.groupBy("dow", "hour").agg(F.sum("t").cast("long").alias("tokens")), ["dow", "hour"], "left")


@query("display_compare", "WITH a AS (SELECT tool, date >= '2024-01-24' AS now, sum(raw_value) AS v, bool_or(status = 'unknown') AS u, string_agg(DISTINCT source, ',' ORDER BY source) AS s, string_agg(DISTINCT date_basis, ',' ORDER BY date_basis) AS b FROM shown WHERE date >= '2024-01-17' AND date < '2024-01-31' GROUP BY ALL) SELECT n.tool, CASE WHEN NOT n.u AND NOT p.u AND n.s = p.s AND n.b = p.b THEN round(n.v - p.v, 6) END AS delta, CASE WHEN NOT n.u AND NOT p.u AND n.s = p.s AND n.b = p.b AND p.v > 0 THEN round((n.v - p.v) * 100.0::DOUBLE / p.v, 6) END AS pct, n.u OR p.u AS incomplete, n.s = p.s AND n.b = p.b AS alike FROM a n JOIN a p ON n.tool = p.tool AND n.now AND NOT p.now")
def display_compare(spark: SparkSession, d: str) -> DataFrame:
    """Change against the week before, told only where both weeks are complete, of the same sources and date bases."""
    x = view(spark, d, Match({"date": {"gte": "2024-01-17", "lte": "2024-01-30"}}), unit="raw").withColumn("now", F.col("date") >= "2024-01-24")
    return compared(x, AS_OF).select("tool", F.round("delta", 6).alias("delta"), "pct", "incomplete", "alike")


def compared(rows: DataFrame, today: str) -> DataFrame:
    """Shown rows of two spans (``now`` or not) to ``tool, delta, pct, incomplete, alike, open, unpriced``.

    A change is told only if both spans have a value, nothing unknown, nothing
    unpriced, no day still in progress, and the same sources and date bases; its
    percentage only of a value other than 0.
    """
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    a = rows.groupBy("tool", "now").agg(F.sum("value").alias("v"), F.bool_or(F.col("status") == "unknown").alias("u"), listed("source").alias("s"), listed("date_basis").alias("b"), (F.sum("unpriced") > 0).alias("p"), F.bool_or(F.col("date") == today).alias("o"))
    n, p = (a.where("now") if k else a.where("NOT now") for k in (1, 0))
    n, p = (t.select("tool", *[F.col(c).alias(f"{k}_{c}") for c in "vusbpo"]) for t, k in ((n, "n"), (p, "p")))
    either = lambda c: F.col(f"n_{c}") | F.col(f"p_{c}")
    alike = (F.col("n_s") == F.col("p_s")) & (F.col("n_b") == F.col("p_b"))
    whole, delta = ~either("u") & ~either("p") & ~either("o") & alike, F.col("n_v") - F.col("p_v")
    return n.join(p, "tool").select("tool", F.when(whole, delta).alias("delta"), F.when(whole, share(delta, F.col("p_v"))).alias("pct"), either("u").alias("incomplete"), alike.alias("alike"), either("o").alias("open"), either("p").alias("unpriced"))
