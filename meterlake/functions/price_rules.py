"""Rules for entering and removing prices, over tables: what is asked for meets the price table by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import valid_date
from .pricing import RATES

# How far back a price may begin, the least letters of a pattern, the longest family and note, the priority of new families.
BACKDATE_DAYS, PATTERN_LEAST, FAMILY_MOST, NOTE_MOST, NEW_PRIORITY, LONGEST = 90, 3, 64, 500, 600, 100
SEEDED = "seed"


def _letters(p: Column) -> Column:
    return F.length(p) - F.when(p.startswith("="), 1).otherwise(0)


def _regex(p: Column) -> Column:
    return p.rlike("^/.*/$")


def _clean(patterns: Column) -> Column:
    """Patterns trimmed, without blank ones, in small letters unless they are regular expressions."""
    own = F.transform(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.trim(p))
    return F.transform(F.filter(own, lambda p: p != ""), lambda p: F.when(_regex(p), p).otherwise(F.lower(p)))


def entered(asked: DataFrame, prices: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """What is asked for as new versions of the price table, and what is refused with ``error``, the first field that is wrong.

    ``asked`` has ``family, patterns, provider, effective_from, source, note, registered_by``
    and the rates. A known family keeps its patterns and priority: others may not be
    given, and a provider only if it has one by it; without one, it is that for all tools
    or its only one. A new family's patterns are literal and of three letters at least
    unless exact, by default its name; the longer the longest, the earlier it is tried.
    """
    a = asked.withColumns({"family": F.trim("family"), "patterns": _clean(F.col("patterns")), "provider": F.lower(F.trim(F.coalesce("provider", F.lit("")))), "source": F.trim(F.coalesce("source", F.lit("")))})
    # a family has a handful of versions
    version = F.struct("effective_from", "patterns", "priority")
    scopes = prices.groupBy("family", "provider").agg(F.max_by(version, "effective_from").alias("latest"), F.collect_set("effective_from").alias("starts"))
    known = scopes.groupBy("family").agg(F.collect_list(F.struct("provider", "latest", "starts")).alias("scopes"))
    a = a.join(known, "family", "left")
    by = lambda provider: F.element_at(F.filter("scopes", lambda s: s["provider"] == provider), 1)
    has = lambda provider: F.exists("scopes", lambda s: s["provider"] == provider)
    a = a.withColumn("scope", F.when(F.col("provider") != "", F.when(has(F.col("provider")), by(F.col("provider")))).when(has(F.lit("")), by(F.lit(""))).when(F.size("scopes") == 1, F.element_at("scopes", 1)))
    old, given = F.col("scopes").isNotNull(), F.size("patterns") > 0
    fresh = F.when(given, F.col("patterns")).otherwise(F.array(F.lower("family")))
    others = F.size(F.array_except("patterns", "scope.latest.patterns")) + F.size(F.array_except("scope.latest.patterns", "patterns")) > 0
    short = F.exists(fresh, lambda p: (~p.startswith("=") & (F.length(p) < PATTERN_LEAST)) | (p == "="))
    right_rate = lambda r: F.coalesce((F.col(r) >= 0) & (F.col(r) < float("inf")), F.lit(False))
    error = F.when(~F.coalesce(F.col("family").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & (F.length("family") <= FAMILY_MOST), F.lit(False)), "family")
    error = error.when(~valid_date(F.col("effective_from")) | (F.col("effective_from") < F.date_format(F.date_sub(F.lit(today).cast("date"), BACKDATE_DAYS), "yyyy-MM-dd")), "effective_from")
    for r in RATES:
        error = error.when(~right_rate(r), r)
    error = error.when(~F.col("source").rlike(r"^https://[^/\s?#]+"), "source").when(F.length(F.trim(F.coalesce("note", F.lit("")))) > NOTE_MOST, "note")
    error = error.when(old & F.col("scope").isNull(), "provider").when(old & given & others, "patterns").when(~old & (F.exists(fresh, _regex) | short), "patterns")
    error = error.when(old & F.array_contains("scope.starts", F.col("effective_from")), "effective_from")
    a = a.withColumn("error", error)
    longest = F.array_max(F.transform(fresh, _letters))
    new = a.where("error IS NULL").select(
        F.when(old, F.col("scope.latest.priority")).otherwise(NEW_PRIORITY - F.least(longest, F.lit(LONGEST))).cast("int").alias("priority"), "family", F.when(old, F.col("scope.latest.patterns")).otherwise(fresh).alias("patterns"),
        F.when(old, F.col("scope.provider")).otherwise(F.col("provider")).alias("provider"), *[F.col(r).cast("double").alias(r) for r in RATES], "effective_from", "registered_by",
    )
    return new, a.where("error IS NOT NULL").select("family", "provider", "effective_from", "registered_by", "error")


def removal(keys: DataFrame, prices: DataFrame) -> DataFrame:
    """``keys`` (``provider, family, effective_from, viewer``) with ``outcome``: removed, or why not: unknown, seed, or another's."""
    own = prices.select("provider", "family", "effective_from", "registered_by")
    j = keys.join(own, ["provider", "family", "effective_from"], "left")
    return j.withColumn("outcome", F.when(F.col("registered_by").isNull(), "unknown").when(F.col("registered_by") == SEEDED, "seed").when(~F.col("registered_by").eqNullSafe(F.col("viewer")), "another's").otherwise("removed")).drop("registered_by")


def without_removed(prices: DataFrame, keys: DataFrame) -> DataFrame:
    """The price table without what may be removed."""
    gone = removal(keys, prices).where("outcome = 'removed'").select("provider", "family", "effective_from")
    return prices.join(gone, ["provider", "family", "effective_from"], "left_anti").select(*prices.columns)
