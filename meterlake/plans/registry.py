"""The catalogue's register: a Spark query by name and, where SQL can say it, the same in SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import FAMILIES, NO_MODEL
from ..functions.pricing import SEED, SINCE
from ..sources.telemetry import AS_OF, MODELS, TOOLS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _case(c: str, pairs) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {a!r} THEN {b!r}" for a, b in pairs) + " END"


#: A model's family in SQL, with places for the model and the family of its price.
FAMILY_SQL = (
    "CASE WHEN trim(lower({model})) IN (" + ", ".join(f"'{m}'" for m in NO_MODEL) + ") THEN NULL "
    + " ".join(f"WHEN contains(lower({{model}}), '{w}') THEN '{f}'" for w, f in FAMILIES)
    + " WHEN lower({priced}) LIKE 'gpt%' THEN 'gpt' WHEN {priced} <> 'cursor-default' THEN lower({priced}) ELSE coalesce(nullif(regexp_extract(trim(lower({model})), '[a-z]+'), ''), trim(lower({model}))) END"
)

#: The adapter in SQL: events to facts, then days, hours, members, limit readings, reports, prices.
CTES = {
    "raw_e": f"""SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, value,
  {_case("event_type", TOOLS.items())} AS tool,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H') AS hour FROM events""",
    "src_e": f"""SELECT *, CASE WHEN k % 25 = 24 THEN 'manual' WHEN tool IN ('cursor', 'copilot') THEN 'poller' ELSE 'uploader' END AS source,
  {_case("k % 8", enumerate(MODELS))} AS raw_model FROM raw_e""",
    "ev": """SELECT event_id, ts, k, user_id, date, hour, tool, raw_model, source,
  CASE WHEN lower(raw_model) = 'opus-5' THEN 'claude-opus-5' ELSE raw_model END AS model,
  CASE WHEN user_id % 17 <> 0 THEN user_id END AS member_id, 'u' || user_id || '@example.test' AS external_id,
  CASE WHEN source = 'uploader' THEN 'dev-' || (event_id % 3) ELSE '' END AS machine_id,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  CASE WHEN k % 10 <> 0 THEN CAST(k AS BIGINT) * 1000 END AS cache_read_tokens,
  CASE WHEN tool NOT IN ('codex', 'gemini') THEN CAST(k AS BIGINT) * 10 END AS cache_creation_tokens,
  CAST(1 AS BIGINT) AS requests, user_id || '-' || date || '-' || tool AS session_id, CAST(event_id % 3 + 1 AS INT) AS parser_version,
  CASE WHEN tool IN ('codex', 'gemini') THEN 'unsupported' END AS ev_cache_creation,
  CASE source WHEN 'poller' THEN 'UTC' WHEN 'manual' THEN 'unknown' ELSE 'KST' END AS date_basis FROM src_e""",
    "daily": """SELECT date, tool, model, external_id, machine_id, source, member_id, date_basis, ev_cache_creation,
  sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read_tokens,
  sum(cache_creation_tokens) AS cache_creation_tokens, sum(requests) AS requests FROM ev GROUP BY ALL""",
    "hourly": """SELECT hour, tool, model, external_id, machine_id, source, member_id, date_basis, ev_cache_creation,
  sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read_tokens,
  sum(cache_creation_tokens) AS cache_creation_tokens, sum(requests) AS requests FROM ev GROUP BY ALL""",
    "members": """SELECT u.user_id AS member_id, coalesce(c_name, '?') AS name, 'u' || user_id || '@example.test' AS email, user_id % 50 = 49 AS hidden,
  strftime(DATE '2024-01-01' + CAST(user_id % 28 AS INT), '%Y-%m-%d') AS onboarded_at
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = u.user_id""",
    "roster": "SELECT * FROM members WHERE NOT hidden",
    "f": """SELECT *, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens,
  CASE WHEN member_id IS NULL THEN 'x' || external_id ELSE 'm' || member_id END AS person,
  CASE WHEN tool = 'copilot' AND source = 'poller' THEN 0 ELSE coalesce(requests, 0) END AS reqs,
  strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS week FROM daily""",
    "limits": """SELECT date, member_id, external_id AS account_email, CASE WHEN k % 3 > 0 THEN 'org' || (k % 3) END AS organization, tool AS window_, least(120.0::DOUBLE, k * 1.2::DOUBLE) AS utilization_pct, event_id AS arrival
  FROM ev WHERE member_id IS NOT NULL""",
    "reports": """SELECT date, CASE WHEN user_id % 17 <> 0 THEN user_id END AS member_id, 'u' || user_id || '@example.test' AS external_id, product,
  sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM (SELECT strftime(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT), '%Y-%m-%d') AS date, o_custkey % 150 AS user_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'Claude Code' WHEN o_orderpriority LIKE '2%' THEN 'Cowork' ELSE 'Chat' END AS product,
  CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM orders) GROUP BY date, user_id, product""",
    "prices": "SELECT * FROM (VALUES "
    + ", ".join(f"({p}, '{f}', {m!r}, '{pr}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, '{SINCE}')" for p, f, m, pr, a, b, c, d in SEED)
    + ") p(priority, family, patterns, provider, input_rate, output_rate, cache_read_rate, cache_write_rate, effective_from)",
    "price_hits": """SELECT DISTINCT d.model, d.tool, d.date, p.* FROM (SELECT DISTINCT model, tool, date FROM daily) d, prices p, unnest(p.patterns) AS u(pat)
  WHERE p.effective_from <= d.date AND (p.provider = '' OR p.provider = d.tool)
  AND CASE WHEN pat LIKE '=%' THEN lower(d.model) = substr(pat, 2) WHEN pat LIKE '/%/' THEN regexp_matches(lower(d.model), substr(pat, 2, length(pat) - 2)) ELSE contains(lower(d.model), pat) END""",
    "price_of": """SELECT model, tool, date, family, input_rate, output_rate, cache_read_rate, cache_write_rate FROM price_hits
  QUALIFY row_number() OVER (PARTITION BY model, tool, date ORDER BY priority, effective_from DESC, family, provider) = 1""",
    "pf": """SELECT f.*, family, input_rate, output_rate, cache_read_rate, cache_write_rate,
  coalesce(input_tokens, 0)::DOUBLE AS i0, coalesce(output_tokens, 0)::DOUBLE AS o0, coalesce(cache_read_tokens, 0)::DOUBLE AS r0, coalesce(cache_creation_tokens, 0)::DOUBLE AS w0
  FROM f LEFT JOIN price_of USING (model, tool, date)""",
}


def query(name: str, sql: str | None = None):
    """Register a query; its SQL sees the adapter's tables."""

    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            prefix = ",\n".join(f"{k} AS ({v})" for k, v in CTES.items())
            body = sql.strip().replace("{as_of}", AS_OF)
            head = "WITH RECURSIVE " if body[:15].upper() == "WITH RECURSIVE " else "WITH "
            rest = body[len(head) :] if body[: len(head)].upper() == head else ""
            ORACLES[name] = f"{head}{prefix}" + (f",\n{rest}" if rest else f"\n{body}")
        return run

    return keep
