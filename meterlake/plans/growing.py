"""Streaks, growth points, comebacks and team axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_days, week
from ..functions.pricing import seed_prices
from ..functions.semantics import ratio
from ..operators import streaks
from ..operators.growth_days import growth_days as combined
from ..operators.maturity import AXES, stages
from ..operators.scan import facts_of, report_facts
from ..sources.telemetry import daily_usage, roster, usage_events
from .registry import CTES, FAMILY_SQL, query
from .reviewed import reports
from .scorecards import card
from .totals import adoption_rate, facts, lead_days, tool_summary

LAST = "2024-01-30"
# Days with gaps, nothing left out: what falls on a member's rest days, by their number and the day of the month, is booked on the day before.
_REST = "(day(CAST(date AS DATE)) * 7 + member_id) % 9 = 0 OR (day(CAST(date AS DATE)) * 5 + member_id) % 13 = 1"
_OWN = [("input_tokens", "i", "source = 'poller' AND tool = 'copilot'"), ("output_tokens", "o", "source = 'poller' AND tool = 'copilot'"), ("cache_creation_tokens", "w", "source = 'poller' AND tool = 'copilot'"), ("requests", "q", "source = 'poller' AND (tool = 'copilot' OR (tool = 'cursor' AND model <> ''))")]
CTES["gall"] = (
    f"SELECT * EXCLUDE (date), strftime(CAST(date AS DATE) - CASE WHEN {_REST} THEN 1 ELSE 0 END, '%Y-%m-%d') AS date FROM (SELECT member_id, date, tool, model, false AS reported, "
    + ", ".join(f"CASE WHEN {no} THEN 0 ELSE coalesce({c}, 0) END AS {n}" for c, n, no in _OWN)
    + ", CASE WHEN source = 'poller' AND tool = 'copilot' THEN 0 ELSE coalesce(cache_read_tokens, 0) END AS r FROM ev UNION ALL SELECT member_id, date, tool, model, true, i, o, w, q, r FROM rep_facts) WHERE member_id IS NOT NULL AND i + o + w + q + r > 0"
)
CTES["price_any"] = """SELECT m.model, m.tool, p.family, p.input_rate, p.output_rate, p.cache_write_rate FROM (SELECT DISTINCT model, tool FROM gall) m, prices p, unnest(p.patterns) AS u(pat)
  WHERE (p.provider = '' OR p.provider = m.tool) AND CASE WHEN pat LIKE '=%' THEN lower(m.model) = substr(pat, 2) WHEN pat LIKE '/%/' THEN regexp_matches(lower(m.model), substr(pat, 2, length(pat) - 2)) ELSE contains(lower(m.model), pat) END
  QUALIFY row_number() OVER (PARTITION BY m.model, m.tool ORDER BY p.priority, p.family, p.provider) = 1"""
CTES["gside"] = "SELECT g.*, CASE WHEN g.tool <> 'claude_code' THEN 'other' WHEN reported THEN 'report' ELSE 'local' END AS side, coalesce(i * p.input_rate / 2 + o * p.output_rate / 10 + w * p.cache_write_rate / 2.5::DOUBLE, 0) AS t, " + FAMILY_SQL.format(model="g.model", priced="p.family") + " AS family FROM gall g LEFT JOIN price_any p ON p.model = g.model AND p.tool = g.tool"
_SIDES = ", ".join(f"coalesce(sum({c}) FILTER (side = '{s}'), 0) AS {s}_{c}" for s in ("other", "local", "report") for c in "tq")
CTES["gday"] = f"SELECT *, other_t + greatest(local_t, report_t) AS tokens, other_q + greatest(local_q, report_q) AS requests, CASE WHEN abs(local_t - report_t) > 1e-6 THEN local_t > report_t ELSE local_q >= report_q END AS mine FROM (SELECT member_id, date, count(DISTINCT tool) AS tools, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tool_names, {_SIDES} FROM gside GROUP BY ALL)"
CTES["gfam"] = """SELECT member_id, date, family FROM gside JOIN gday USING (member_id, date) WHERE family IS NOT NULL AND (side = 'other' OR (side = 'local') = mine)
  GROUP BY member_id, date, family, tokens HAVING CASE WHEN tokens > 0 THEN sum(t) > 0 AND sum(t) + 1e-6 >= tokens * 0.1 ELSE sum(q) > 0 END"""
CTES["gdays"] = "SELECT d.member_id, d.date, any_value(tokens) AS tokens, any_value(requests) AS requests, any_value(tools) AS tools, any_value(tool_names) AS tool_names, count(family) AS families, coalesce(string_agg(family, ',' ORDER BY family), '') AS family_names FROM gday d LEFT JOIN gfam f ON f.member_id = d.member_id AND f.date = d.date GROUP BY d.member_id, d.date"
CTES["act"] = "SELECT member_id, CAST(date AS DATE) AS date FROM gdays"


def growth_days(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d)
    facts = facts_of(usage_events(spark, d)).unionByName(report_facts(r.rows, r.addresses))
    n = F.dayofmonth(F.to_date("date"))
    rest = ((n * 7 + F.col("member_id")) % 9 == 0) | ((n * 5 + F.col("member_id")) % 13 == 1)
    return combined(facts.withColumn("date", F.when(rest, add_days(F.col("date"), -1)).otherwise(F.col("date"))), seed_prices(spark))


@query("growth_days", "SELECT member_id, date, round(tokens, 4) AS tokens, requests::BIGINT AS requests, family_names, tool_names FROM gdays")
def growth_days_listed(spark: SparkSession, d: str) -> DataFrame:
    """Every person's days as growth counts them."""
    named = [F.array_join(c, ",").alias(c) for c in ("family_names", "tool_names")]
    return growth_days(spark, d).select("member_id", "date", F.round("tokens", 4).alias("tokens"), "requests", *named)


@query("streak_calendar", f"WITH i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY member_id ORDER BY date) AS INT) AS g FROM act), r AS (SELECT member_id, g, count(*) AS n, max(date) AS last FROM i GROUP BY ALL) SELECT member_id, max(n) AS best, coalesce(max(n) FILTER (last >= DATE '{LAST}' - 1), 0) AS current, strftime(max(last), '%Y-%m-%d') AS last_date, concat_ws(',', CASE WHEN max(n) >= 3 THEN '3' END, CASE WHEN max(n) >= 7 THEN '7' END, CASE WHEN max(n) >= 14 THEN '14' END, CASE WHEN max(n) >= 30 THEN '30' END) AS achievements FROM r GROUP BY member_id")
def streak_calendar(spark: SparkSession, d: str) -> DataFrame:
    return streaks.calendar_streaks(growth_days(spark, d), LAST)


# A day's streak by definition: active days after the latest pair of misses under seven days apart, whose earlier miss is the barrier.
CTES["spine"] = f"SELECT m.member_id, CAST(x.d AS DATE) AS date FROM (SELECT member_id, min(date) AS first FROM act GROUP BY 1) m, generate_series(m.first::TIMESTAMP, TIMESTAMP '{LAST}', INTERVAL 1 DAY) x(d)"
CTES["marked"] = "SELECT s.*, a.date IS NOT NULL AS active FROM spine s LEFT JOIN act a ON a.member_id = s.member_id AND a.date = s.date"
CTES["barriers"] = "SELECT a.member_id, a.date AS barrier, min(b.date) AS at_ FROM marked a JOIN marked b ON a.member_id = b.member_id AND b.date > a.date AND b.date <= a.date + 6 WHERE NOT a.active AND NOT b.active GROUP BY ALL"
CTES["tolerant"] = "SELECT e.member_id, e.date, e.active, (SELECT count(*) FROM act x WHERE x.member_id = e.member_id AND x.date <= e.date AND x.date > coalesce((SELECT max(barrier) FROM barriers b WHERE b.member_id = e.member_id AND b.at_ <= e.date), DATE '1970-01-01')) AS streak FROM marked e"


@query("streak_tolerant", "SELECT member_id, strftime(date, '%Y-%m-%d') AS date, active, streak FROM tolerant")
def streak_tolerant(spark: SparkSession, d: str) -> DataFrame:
    s = streaks.tolerant_streaks(growth_days(spark, d), LAST)
    return s.select("member_id", F.date_format("date", "yyyy-MM-dd").alias("date"), (F.col("active") == 1).alias("active"), "streak")


_STEP = "greatest(" + " + ".join(f"(tokens >= {s})::INT" for s in streaks.TOKEN_STEPS) + ", " + " + ".join(f"(requests >= {s})::INT" for s in streaks.REQUEST_STEPS) + ")"
_MULT = "CASE " + " ".join(f"WHEN streak >= {a} THEN {b}::DOUBLE" for a, b in streaks.MULTIPLIERS) + " ELSE 1 END"
CTES["gp"] = f"""SELECT t.member_id, t.date, floor(10 * {_MULT} + 0.5) + least(5, [0, 0, 1, 2, 3, 4][{_STEP} + 1] + least(2, greatest(0, families - 1))) AS points
  FROM tolerant t JOIN gdays g ON g.member_id = t.member_id AND g.date = strftime(t.date, '%Y-%m-%d')"""


@query("growth_points", "SELECT member_id, sum(points)::BIGINT AS gp, floor(sqrt(sum(points) / 10.0::DOUBLE) + 1e-12)::BIGINT + 1 AS level, (" + " + ".join(f"(sum(points) >= {s})::BIGINT" for s in streaks.STAGES) + ") AS stage, count(*) AS active_days FROM gp GROUP BY member_id")
def growth_points(spark: SparkSession, d: str) -> DataFrame:
    return streaks.growth(growth_days(spark, d), LAST).select("member_id", "gp", "level", "stage", "active_days")


@query("growth_full")
def growth_full(spark: SparkSession, d: str) -> DataFrame:
    g = streaks.growth(growth_days(spark, d), LAST, heal=True)
    listed = [F.array_join(c, ",").alias(c) for c in ("milestones", "ornaments")]
    return g.select(*[c for c in g.columns if c not in ("milestones", "ornaments", "next_milestone", "ember")], *listed, F.col("next_milestone.axis").alias("next_axis"), F.col("next_milestone.remaining").alias("next_remaining"), F.col("ember.kind").alias("ember_kind"), F.col("ember.length").alias("ember_length"))


@query("revival")
def revival(spark: SparkSession, d: str) -> DataFrame:
    r = streaks.revivals(growth_days(spark, d), LAST)
    return r.select("member_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("since", "until", "grace")], "needed", "have", "how", "extra")


@query("activity_calendar", "SELECT member_id, date, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM daily WHERE member_id IS NOT NULL AND NOT (source = 'poller' AND tool = 'copilot') AND (input_tokens > 0 OR output_tokens > 0 OR cache_read_tokens > 0 OR cache_creation_tokens > 0 OR (requests > 0 AND NOT (source = 'poller' AND tool = 'cursor' AND model <> ''))) GROUP BY ALL")
def activity_calendar(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.semantics import METRICS, any_positive

    f = daily_usage(spark, d).where(F.col("member_id").isNotNull() & any_positive([*METRICS, "requests"]))
    return f.groupBy("member_id", "date").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


OPEN_DAYS = ("2024-01-29",)


_AXES = f"""WITH w AS (SELECT strftime(DATE '2024-01-01' + CAST(range AS INT), '%Y-%m-%d') AS date, strftime(date_trunc('week', DATE '2024-01-01' + CAST(range AS INT)), '%Y-%m-%d') AS week FROM range(30)),
  c AS (SELECT week, count(*) FILTER (date NOT IN ('{OPEN_DAYS[0]}')) AS counted_days FROM w GROUP BY week),
  p AS (SELECT member_id, week, count(*) AS n, median({_STEP}) AS v FROM gdays JOIN w USING (date) WHERE date NOT IN ('{OPEN_DAYS[0]}') GROUP BY ALL),
  q AS (SELECT member_id, week, count(DISTINCT family) AS fam FROM gfam JOIN w USING (date) WHERE date NOT IN ('{OPEN_DAYS[0]}') GROUP BY ALL)
  SELECT week, counted_days, counted_days = 7 AS complete, count(*) AS members, count(n) AS active_members, round(median(coalesce(n, 0)), 6) AS frequency, round(median(v), 6) AS volume, round(median(fam), 6) AS diversity
  FROM c CROSS JOIN roster r LEFT JOIN p USING (member_id, week) LEFT JOIN q USING (member_id, week) GROUP BY week, counted_days"""
CTES["axes"] = _AXES


@query("team_axes", _AXES)
def team_axes(spark: SparkSession, d: str) -> DataFrame:
    """Weekly medians over the roster, one of the last days not yet confirmed."""
    return streaks.team_axes(roster(spark, d), growth_days(spark, d), "2024-01-01", LAST, OPEN_DAYS)


@query("latest_weeks", "SELECT week, frequency, volume, diversity, (SELECT count(*) FROM axes y WHERE y.complete AND y.week > x.week) = 0 AS latest FROM axes x WHERE complete ORDER BY week DESC LIMIT 2")
def latest_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The team's latest complete week and the one before."""
    return streaks.latest_complete(team_axes(spark, d)).select("week", "frequency", "volume", "diversity", "latest")


@query("unconfirmed_days", "SELECT member_id, strftime(CAST(max(date) AS DATE) + CAST(x.range AS INT), '%Y-%m-%d') AS date FROM daily, range(1, 4) x WHERE member_id IS NOT NULL GROUP BY member_id, x.range HAVING CAST(max(date) AS DATE) + CAST(x.range AS INT) <= DATE '2024-01-31'")
def unconfirmed_days(spark: SparkSession, d: str) -> DataFrame:
    """Up to three days after the latest report, which may yet fill."""
    last = daily_usage(spark, d).where("member_id IS NOT NULL").groupBy("member_id").agg(F.to_date(F.max("date")).alias("last"))
    open_ = last.select("member_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.date_add(F.col("last"), i))).alias("day"))
    return open_.where("day <= DATE'2024-01-31'").select("member_id", F.date_format("day", "yyyy-MM-dd").alias("date"))


@query("business_days", "SELECT r.member_id, strftime((SELECT min(d) FROM (SELECT CAST(r2.onboarded_at AS DATE) + CAST(range AS INT) AS d FROM range(1, 20), (SELECT r.onboarded_at) r2) x WHERE isodow(d) < 6 AND (SELECT count(*) FROM range(1, 20) y WHERE CAST(r.onboarded_at AS DATE) + CAST(y.range AS INT) <= d AND isodow(CAST(r.onboarded_at AS DATE) + CAST(y.range AS INT)) < 6) = 5), '%Y-%m-%d') AS fifth FROM roster r")
def business_days(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.calendar import add_business_days

    return roster(spark, d).select("member_id", add_business_days(F.col("onboarded_at"), 5).alias("fifth"))


_HIT = "SELECT week, CASE WHEN i + r > 0 THEN r / (i + r) END AS x FROM card"
_AXIS = lambda a, c: f"(SELECT count(*) + 1 FROM (VALUES {', '.join(f'({n})' for n in AXES[a])}) t(n) WHERE {c} >= n)"


@query("maturity", f"""WITH v AS (SELECT (SELECT arg_max(a, week) FROM (SELECT week, count(DISTINCT member_id) * 100.0::DOUBLE / (SELECT count(*) FROM roster) AS a FROM f GROUP BY week)) AS habit,
  (SELECT median(x) * 100 FROM ({_HIT}) WHERE week = (SELECT max(week) FROM card)) AS efficiency,
  (SELECT median(CASE WHEN s > 0 THEN c / s END) FROM card WHERE week = (SELECT max(week) FROM card WHERE c IS NOT NULL) AND c IS NOT NULL) AS skill,
  (SELECT count(*) FROM (SELECT tool FROM f GROUP BY tool HAVING sum(tokens) > 0 OR sum(reqs) > 0)) AS breadth,
  (SELECT min(date_diff('day', CAST(g AS DATE), CAST(first AS DATE))) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY first) AS place, min(first) OVER (PARTITION BY model) AS g FROM (SELECT model, member_id, min(date) AS first FROM f WHERE member_id IS NOT NULL AND model NOT IN ('', 'unknown', 'default') GROUP BY ALL)) WHERE place = (SELECT ceil(count(*) / 2.0)::BIGINT FROM roster)) AS lead),
  s AS (SELECT {_AXIS("habit", "habit")} AS h, {_AXIS("efficiency", "efficiency")} AS e, {_AXIS("skill", "skill")} AS k, CASE WHEN lead < 7 THEN 5 WHEN lead < 14 THEN 4 ELSE 3 END AS cap, {_AXIS("breadth", "breadth")} AS b FROM v),
  a AS (SELECT h, e, least(k, cap) AS k, b, cap < k AS capped FROM s), z AS (SELECT *, least(h, e, k, b) AS stage FROM a),
  y AS (SELECT *, CASE stage WHEN h THEN 'habit' WHEN e THEN 'efficiency' WHEN k THEN 'skill' ELSE 'breadth' END AS bottleneck FROM z)
  SELECT h::BIGINT AS habit, e::BIGINT AS efficiency, k::BIGINT AS skill, b::BIGINT AS breadth, stage::BIGINT AS stage, bottleneck, capped AND bottleneck = 'skill' AS by_lead_days,
  CASE WHEN stage = 5 THEN NULL WHEN bottleneck = 'skill' AND capped THEN CASE WHEN stage >= 4 THEN 7 ELSE 14 END ELSE (CASE bottleneck {" ".join(f"WHEN '{a}' THEN {list(n)}" for a, n in AXES.items())} END)[stage] END::BIGINT AS target FROM y""")
def maturity(spark: SparkSession, d: str) -> DataFrame:
    """The team's stage from its latest week: share of active members, cache hits, depth of sessions, tools, and the lead time of new models."""
    c = card(spark, d)
    latest = lambda x, rows: rows.groupBy("week").agg(F.percentile(x, F.lit(0.5)).alias("m")).agg(F.max_by("m", "week"))
    parts = {
        "habit": adoption_rate(spark, d).agg(F.max_by("active_pct", "week")),
        "efficiency": latest(ratio(F.col("r"), F.col("i") + F.col("r")) * 100, c),
        "skill": latest(ratio(F.col("c"), F.col("s")), c.where("c IS NOT NULL")),
        "breadth": tool_summary(spark, d).where("tokens > 0 OR requests > 0").agg(F.count(F.lit(1))),
        "lead_days": lead_days(spark, d).agg(F.min("lead_days")),
    }
    out = None
    for name, part in parts.items():  # a row each
        part = part.toDF(name)
        out = part if out is None else out.join(F.broadcast(part))
    return stages(out)


def weekly_first(spark: SparkSession, d: str) -> DataFrame:
    """First active week of every member."""
    f = facts(spark, d).where("member_id IS NOT NULL")
    return f.groupBy("member_id").agg(F.min(week(F.col("date"))).alias("cohort"))


@query("cohort_retention", "WITH c AS (SELECT member_id, min(week) AS cohort FROM f WHERE member_id IS NOT NULL GROUP BY 1) SELECT cohort, date_diff('week', CAST(cohort AS DATE), CAST(week AS DATE))::BIGINT AS age, count(DISTINCT member_id) AS members FROM f JOIN c USING (member_id) GROUP BY ALL")
def cohort_retention(spark: SparkSession, d: str) -> DataFrame:
    own = F.min("week").over(Window.partitionBy("member_id"))
    w = facts(spark, d).where("member_id IS NOT NULL").select("member_id", "week").distinct().withColumn("cohort", own)
    return w.groupBy("cohort", F.floor(F.datediff(F.to_date("week"), F.to_date("cohort")) / 7).alias("age")).agg(F.count_distinct("member_id").alias("members"))
