"""Vendor reports as landed JSON or CSV: usage rows, billing items, activities, spend sheets, manual sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import valid_date
from .pages import pages

ROW = "date string, tool string, model string, external_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, requests long, sessions long"


def cursor_usage(activity: DataFrame, events: DataFrame, *, hourly: bool = False) -> DataFrame:
    """Daily activity (model blank, requests alone) and token events summed by bucket, address and model; buckets are UTC.

    Requests stand on the activity rows only, and an event without a model's name never
    takes their blank one.
    """
    width = "yyyy-MM-dd'T'HH" if hourly else "yyyy-MM-dd"
    at = F.date_format(F.timestamp_millis("timestamp"), width)
    none = F.lit(None).cast("long")
    e = events.groupBy(at.alias("date"), F.lower("email").alias("external_id"), F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("unknown")).alias("model"))
    tokens = e.agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]).withColumn("requests", none)
    if hourly:
        return tokens.withColumn("tool", F.lit("cursor"))
    a = activity.groupBy(F.col("day").alias("date"), F.lower("email").alias("external_id")).agg(F.sum("requests").alias("requests"))
    a = a.select("date", "external_id", F.lit("").alias("model"), *[none.alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")], "requests")
    return tokens.unionByName(a).withColumn("tool", F.lit("cursor"))


#: What counts as a request of a day's activity.
ASKED = ("composerRequests", "chatRequests", "agentRequests", "cmdkUsages")


def cursor_pages(spark: SparkSession, path: str, since: str | None = None, *, hourly: bool = False) -> DataFrame:
    """Usage from landed pages: ``path/daily`` (items ``data``) and ``path/events`` (items ``usageEvents``), in windows of 30 days.

    Days that weren't active, and those without an address or any count, are none;
    events without token usage, an address or an instant neither.
    """
    schema = "day string, date bigint, email string, isActive boolean, " + ", ".join(f"{c} bigint" for c in ASKED)
    a = pages(spark, f"{path}/daily", since=since).select(F.from_json("item", schema).alias("j")).select("j.*")
    named = F.coalesce(F.when(F.length("day") >= 10, F.substring("day", 1, 10)), F.date_format(F.timestamp_millis("date"), "yyyy-MM-dd"))
    some = F.when(F.coalesce(*ASKED).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in ASKED), F.lit(0)))
    a = a.where(F.coalesce("isActive", F.lit(True))).select(named.alias("day"), "email", some.alias("requests")).where("day IS NOT NULL AND email != '' AND requests IS NOT NULL")
    schema = "timestamp string, userEmail string, model string, tokenUsage struct<inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint>"
    e = pages(spark, f"{path}/events", items="usageEvents", since=since).select(F.from_json("item", schema).alias("j")).select("j.*")
    t = lambda c: F.coalesce(f"tokenUsage.{c}", F.lit(0))
    e = e.select(F.col("timestamp").try_cast("bigint").alias("timestamp"), F.col("userEmail").alias("email"), "model", F.col("tokenUsage").isNotNull().alias("told"), t("inputTokens").alias("input_tokens"), t("outputTokens").alias("output_tokens"), t("cacheReadTokens").alias("cache_read_tokens"), t("cacheWriteTokens").alias("cache_creation_tokens"))
    return cursor_usage(a, e.where("told AND timestamp IS NOT NULL AND email != ''"), hourly=hourly)


def anthropic_usage(days: DataFrame) -> DataFrame:
    """One record per person and UTC day with a breakdown by model; sessions are told on the first model row."""
    who = F.coalesce("actor.email_address", "actor.api_key_name")
    r = days.select(F.substring("date", 1, 10).alias("date"), who.alias("external_id"), F.col("num_sessions"), F.posexplode("model_breakdown").alias("pos", "m"))
    t = lambda f: F.col(f"m.tokens.{f}")
    return r.select(
        "date", F.lit("claude_code").alias("tool"), F.col("m.model").alias("model"), "external_id", t("input").alias("input_tokens"), t("output").alias("output_tokens"),
        t("cache_read").alias("cache_read_tokens"), t("cache_creation").alias("cache_creation_tokens"), F.when(F.col("pos") == 0, F.col("num_sessions")).alias("sessions"),
    )


def copilot_billing(reports: DataFrame) -> DataFrame:
    """Per account and day the items by model; a report with an item of another period or unit is refused whole."""
    items = reports.select("account", "date", "time_period", F.explode("usage_items").alias("i"))
    right = (F.format_string("%04d-%02d-%02d", "time_period.year", "time_period.month", "time_period.day") == F.col("date")) & (F.lower("i.unit_type") == "requests") & (F.col("i.gross_quantity") >= 0)
    refused = items.where(~F.coalesce(right, F.lit(False))).select("account", "date").distinct()
    good = items.join(refused, ["account", "date"], "left_anti")
    return good.groupBy("account", "date", F.col("i.model").alias("model")).agg(F.sum("i.gross_quantity").alias("requests")).withColumn("tool", F.lit("copilot"))


#: Categories of an activity that count as use.
ACTIVE = ("active_generate", "active_summarize", "active_conversations")


def gemini_activity(activities: DataFrame) -> DataFrame:
    """Workspace activities once by event id, active categories alone, counted by person, day and app."""
    a = activities.dropDuplicates(["id"]).select("time", "email", F.explode("events").alias("e"))
    p = F.map_from_entries(F.transform("e.parameters", lambda x: F.struct(x["name"], x["value"])))
    a = a.select(F.substring("time", 1, 10).alias("date"), F.lower("email").alias("external_id"), p["app_name"].alias("model"), p["event_category"].alias("category"))
    return a.where(F.col("category").isin(*ACTIVE)).groupBy("date", "external_id", "model").agg(F.count(F.lit(1)).alias("requests")).withColumn("tool", F.lit("gemini_workspace"))


# Spellings of the spend sheet's columns.
SPEND = {
    "email": ("user_email", "email", "user"),
    "product": ("product", "product_name"),
    "model": ("model", "model_name"),
    "channel": ("channel", "account_type"),
    "requests": ("total_requests", "requests"),
    "prompt_tokens": ("total_prompt_tokens", "prompt_tokens"),
    "uncached_input": ("uncached_input_tokens", "uncached_input"),
    "cache_read": ("cache_read_tokens", "cache_read_input_tokens"),
    "cache_write_5m": ("cache_write_5m_tokens", "cache_creation_5m_tokens"),
    "cache_write_1h": ("cache_write_1h_tokens", "cache_creation_1h_tokens"),
    "output": ("total_completion_tokens", "output_tokens"),
}


def spend_csv(spark: SparkSession, path: str) -> DataFrame:
    """A spend sheet: quoted fields may hold line breaks; the two cache-write columns add up; lines split by channel merge.

    A channel that repeats for one person, product and model makes the read fail.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    have = {c.lower().strip().lstrip("﻿"): c for c in raw.columns}
    col = lambda name: next((F.col(f"`{have[a]}`") for a in SPEND[name] if a in have), F.lit(None).cast("string"))
    numbers = ("requests", "prompt_tokens", "uncached_input", "cache_read", "cache_write_5m", "cache_write_1h", "output")
    r = raw.select(F.lower(F.trim(col("email"))).alias("external_id"), F.trim(col("product")).alias("product"), F.trim(col("model")).alias("model"), F.coalesce(col("channel"), F.lit("")).alias("channel"), *[F.try_to_number(F.regexp_replace(col(n), ",", ""), F.lit("999999999999999")).cast("long").alias(n) for n in numbers])
    keys = ["external_id", "product", "model"]
    write = lambda: F.when(F.coalesce("cache_write_5m", "cache_write_1h").isNotNull(), F.coalesce("cache_write_5m", F.lit(0)) + F.coalesce("cache_write_1h", F.lit(0)))
    broken = F.coalesce("cache_read", "cache_write_5m", "cache_write_1h").isNotNull()
    r = r.withColumn("cache_write", write()).withColumn("input", F.when(broken, F.col("uncached_input")).otherwise(F.col("prompt_tokens")))
    g = r.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("requests", "input", "output", "cache_read", "cache_write")], F.count(F.lit(1)).alias("n"), F.count_distinct("channel").alias("c"))
    once = F.when(F.col("n") == F.col("c"), True).otherwise(F.raise_error(F.lit("spend sheet: a channel repeats"))).cast("boolean")
    return g.where(once).drop("n", "c")


def manual_csv(lines: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``date,tool,model,email,input,output,requests`` to rows and, with the reason, refused lines."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    p = lines.withColumn("p", parts)
    n = lambda i: F.try_element_at("p", F.lit(i))
    number = lambda i: F.when(n(i).rlike(r"^\d+$"), n(i).cast("long"))
    mail = roster.groupBy(F.lower("email").alias("mail")).agg(F.min("member_id").alias("member_id"))
    p = p.join(mail, F.lower(n(4)) == F.col("mail"), "left")
    bad = F.when(F.size("p") != 7, "columns").when(~valid_date(n(1)), "date").when(n(2) == "", "tool").when(F.col("member_id").isNull(), "member")
    bad = bad.when(F.exists(F.slice("p", 5, 3), lambda x: (x != "") & ~x.rlike(r"^\d+$")), "number")
    p = p.withColumn("error", bad)
    good = p.where("error IS NULL").select(n(1).alias("date"), n(2).alias("tool"), n(3).alias("model"), "member_id", number(5).alias("input_tokens"), number(6).alias("output_tokens"), number(7).alias("requests"))
    return good, p.where("error IS NOT NULL").select("value", "error")
