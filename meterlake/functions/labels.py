"""Labels that queries group or order by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_label(window: Column) -> Column:
    """A plan-limit window in words: a name after the tool, or its length in days, hours or minutes."""
    minutes = F.regexp_extract(window, r"_(\d+)m$", 1)
    n = F.when(minutes != "", minutes.cast("int"))
    of = lambda unit, each: F.concat((n / each).cast("int").cast("string"), F.lit(unit))
    named = F.when(n % 1440 == 0, of("d", 1440)).when(n % 60 == 0, of("h", 60)).when(n.isNotNull(), of("min", 1))
    return F.coalesce(named, F.when(window == "five_hour", "5h").when(window == "seven_day", "7d"), F.replace(window, F.lit("_"), F.lit(" ")))


def few(rows: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """One row: the distinct values of a column as an array, to be broadcast; more than ``most`` are an error, not a larger broadcast."""
    n = F.size(column)
    return rows.agg(F.sort_array(F.collect_set(column)).alias(column)).select(F.when(n <= most, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"too many values of {column}: "), n.cast("string")))).alias(column))


def device_label(keys: list[str], order: str) -> Column:
    """Device 1, 2, … of a person, by the order given."""
    return F.concat(F.lit("Device "), F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)).cast("string"))


def report_tool(product: Column) -> Column:
    """A product's name as a tool's; one without letters or digits is another product."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(product), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    own = F.regexp_replace(slug, "^claude_", "")
    return F.when(product == "Claude Code", "claude_code").otherwise(F.concat(F.lit("claude_"), F.when(own != "", own).otherwise("other")))


#: What names of models hold that tells their family, the first that fits, and names that are no model's.
FAMILIES = (("opus", "opus"), ("sonnet", "sonnet"), ("haiku", "haiku"), ("fable", "fable"), ("mythos", "fable"), ("codex", "gpt"), ("gpt", "gpt"), ("gemini", "gemini"), ("grok", "grok"), ("deepseek", "deepseek"), ("qwen", "qwen"))
NO_MODEL = ("default", "premium", "auto", "unknown", "composer", "")


def family_of(model: Column, priced: Column | None = None) -> Column:
    """A model's family, null for what names no model: by a word in its name, else that of its price, else the first run of letters."""
    name = F.trim(F.lower(model))
    out = F.when(name.isin(*NO_MODEL), F.lit(None).cast("string"))
    for word, family in FAMILIES:
        out = out.when(F.contains(name, F.lit(word)), family)
    run = F.regexp_extract(name, "[a-z]+", 0)
    own = F.lower(priced) if priced is not None else F.lit(None).cast("string")
    own = F.when(own.startswith("gpt"), "gpt").when(own != "cursor-default", own)
    return out.otherwise(F.coalesce(own, F.when(run != "", run), name))
