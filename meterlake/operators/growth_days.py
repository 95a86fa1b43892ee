"""What a person's day counts for growth: collected usage and vendors' reports in one yardstick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import family_of
from ..functions.lineage import settled
from ..functions.pricing import convert, match_prices, reference_rates
from ..functions.semantics import measured
from .scan import FACT, FIELDS

# The share of a day's tokens from which a family counts, the reports' source, the tool that both sides cover.
FAMILY_SHARE, REPORT, SHARED_TOOL = 0.1, "claude-spend-csv", "claude_code"


def growth_days(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """Facts to ``member_id, date, tokens, requests, family_names, tool_names, families, tools``, a row per active day.

    Only what was measured counts: neither unsupported fields nor billing units. Tokens
    are those of the reference family without cache reads; unpriced rows add none, their
    requests count. Products of reports are added; of the tool that both sides cover, the
    day takes the larger of collected and reported, tokens and requests each for
    itself, and the families of the side that gave its tokens. A family counts from a
    tenth of the day's tokens on, or by requests on a day without tokens. Unlinked rows
    are none's. Facts are summed by tool and model before anything of a day meets, and
    a day's sums meet in one shuffle. Facts are read once: their sums are settled, and so are the days, which streaks,
    comebacks and points each start from.
    """
    rows = facts.where("member_id IS NOT NULL").select(*FACT).withColumns({f: measured(f, F.col(f"ev_{f}")) for f in FIELDS})
    rows = rows.groupBy("member_id", "date", "tool", "model", (F.col("source") == REPORT).alias("reported")).agg(*[F.sum(f).alias(f) for f in FIELDS])
    # none is negative, so sums tell who was active; on the facts the filter would move into the scan and work out every rule anew for each use
    rows = settled(rows.where(F.greatest(*FIELDS) > 0))  # prices look at them twice
    rows = reference_rates(match_prices(rows, prices), prices)
    side = F.when(F.col("tool") != SHARED_TOOL, "other").when(F.col("reported"), "report").otherwise("local")
    name = family_of(F.col("model"), F.col("family"))
    parts = rows.select("member_id", "date", "tool", side.alias("side"), name.alias("name"), convert("no_cache_read", "ref")["value"].alias("t"), F.col("requests").alias("q"))

    of = lambda c, s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0))
    sums = [of(c, s).alias(f"{s}_{c}") for s in ("other", "local", "report") for c in "tq"]
    shares = F.collect_list(F.when(F.col("name").isNotNull() & ((F.col("t") > 0) | (F.col("q") > 0)), F.struct("side", "name", "t", "q")))
    days = parts.groupBy("member_id", "date").agg(*sums, shares.alias("shares"), F.array_sort(F.collect_set("tool")).alias("tool_names"))
    tokens = F.col("other_t") + F.greatest("local_t", "report_t")
    requests = F.col("other_q") + F.greatest("local_q", "report_q")
    local = F.when(F.col("local_t") != F.col("report_t"), F.col("local_t") > F.col("report_t")).otherwise(F.col("local_q") >= F.col("report_q"))
    days = days.select("member_id", "date", "tool_names", tokens.alias("tokens"), requests.cast("long").alias("requests"), F.when(local, "local").otherwise("report").alias("won"), "shares")
    days = _counted(days).select("member_id", "date", "tokens", "requests", "family_names", "tool_names")
    return settled(days.select("*", F.size("family_names").alias("families"), F.size("tool_names").alias("tools")))


def _counted(days: DataFrame) -> DataFrame:
    """``days`` with ``family_names``, the families that hold enough of a day; a day has a handful."""
    amount = lambda s: F.when(F.col("tokens") > 0, s["t"]).otherwise(s["q"].cast("double"))
    own = F.filter("shares", lambda s: (s["side"] == "other") | (s["side"] == F.col("won")))
    days = days.withColumn("own", F.transform(own, lambda s: F.struct(s["name"].alias("name"), amount(s).alias("x"))))
    total = lambda name: F.aggregate("own", F.lit(0.0), lambda a, s: a + F.when(s["name"] == name, s["x"]).otherwise(0.0))
    each = F.transform(F.array_distinct(F.transform("own", lambda s: s["name"])), lambda n: F.struct(n.alias("name"), total(n).alias("x")))
    # the small amount keeps an exact share from failing on rounding
    enough = F.filter(each, lambda s: (s["x"] > 0) & (s["x"] + 1e-6 >= F.col("tokens") * FAMILY_SHARE))
    return days.withColumn("family_names", F.array_sort(F.transform(enough, lambda s: s["name"])))
