"""Local logs of coding tools: lines of JSON to usage events.

A reader takes lines, ``file, pos, value``, so the same code serves files and
streams. Every file's lines keep their order in ``pos``; what depends on it (the
model in force, what a running total added) is a window over the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import day, hour, kst
from ..operators.ledger import snapshot_deltas

EVENT = ["tool", "session_id", "ts", "date", "hour", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def lines(spark: SparkSession, path: str | list[str], *, modified_after: str | None = None) -> DataFrame:
    """Lines of all files under a path, or of those named, split at line feeds alone, a trailing carriage return stripped.

    ``modified_after`` (an instant) skips files not touched since.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    order = F.struct("at", F.monotonically_increasing_id().alias("id"))
    return raw.select("file", order.alias("pos"), F.regexp_replace("value", "\r$", "").alias("value"))


def newest_lines(spark: SparkSession, path: str, files: int = 5) -> DataFrame:
    """Lines of the files touched last, a handful chosen by their metadata before any content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    chosen = [r["path"] for r in listed.orderBy(F.desc("modificationTime"), "path").limit(files).collect()]
    return lines(spark, chosen) if chosen else spark.createDataFrame([], "file string, pos struct<at:long,id:long>, value string")


def since(events: DataFrame, first: str | None) -> DataFrame:
    """Events of the days from the first on: a file touched since may hold older lines."""
    return events if first is None else events.where(F.col("date") >= first)


def _long(path: str) -> Column:
    """A whole non-negative number of the line, else null."""
    return F.when(F.get_json_object("value", path).rlike(r"^\d{1,15}$"), F.get_json_object("value", path).cast("long"))


def _text(path: str) -> Column:
    return F.get_json_object("value", path)


def _events(df: DataFrame, tool: str) -> DataFrame:
    at = kst(F.col("ts").cast("timestamp_ntz"))
    return df.select(F.lit(tool).alias("tool"), "session_id", "ts", day(at).alias("date"), hour(at).alias("hour"), *EVENT[5:])


def claude_events(rows: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Assistant messages with usage; of one message and request the first counts, for the smallest session that has it.

    ``pins`` (key digest, session) hold earlier attributions; a pin wins while its
    session still has a file. Synthetic models don't count.
    """
    usage = "$.message.usage."
    m = rows.where(_text("$.type") == "assistant").select(
        "file", "pos", _text("$.sessionId").alias("session_id"), F.to_timestamp_ntz(F.substring(_text("$.timestamp"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"), _text("$.message.model").alias("model"),
        _text("$.message.id").alias("id"), _text("$.requestId").alias("request"), _text("$.message.usage").alias("usage"),
        _long(usage + "input_tokens").alias("input_tokens"), _long(usage + "output_tokens").alias("output_tokens"),
        _long(usage + "cache_read_input_tokens").alias("cache_read_tokens"), _long(usage + "cache_creation_input_tokens").alias("cache_creation_tokens"),
    ).where("usage IS NOT NULL AND model != '<synthetic>' AND ts IS NOT NULL")
    key = F.coalesce(F.concat_ws("|", "id", "request"), F.concat("file", F.lit("#"), F.col("pos").cast("string")))
    m = m.withColumn("key", F.when(F.col("id").isNotNull(), key).otherwise(F.concat("file", F.lit("#"), F.col("pos").cast("string"))))
    same = Window.partitionBy("key")
    m = m.withColumn("session", F.min("session_id").over(same)).withColumn("place", F.row_number().over(same.orderBy("file", "pos"))).where("place = 1")
    if pins is not None:
        on_disk = rows.select(_text("$.sessionId").alias("pinned")).distinct()
        live = pins.select(F.col("key").alias("digest"), F.col("session_id").alias("pinned")).join(on_disk, "pinned", "left_semi")
        m = m.join(live, F.sha1("key") == F.col("digest"), "left").withColumn("session", F.coalesce("pinned", "session"))
    return _events(m.withColumn("session_id", F.col("session")), "claude_code")


def _iso(path: str = "$.timestamp") -> Column:
    return F.to_timestamp_ntz(F.substring(_text(path), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def codex_events(rows: DataFrame) -> DataFrame:
    """Token counts are running totals of a file; the model is that of the last turn; input leaves out cached tokens."""
    total = "$.payload.info.total_token_usage."
    r = rows.select(
        "file", "pos", _iso().alias("ts"), F.when(_text("$.type") == "turn_context", _text("$.payload.model")).alias("turn"),
        (_text("$.payload.type") == "token_count").alias("counts"), _long(total + "input_tokens").alias("i"), _long(total + "cached_input_tokens").alias("c"), _long(total + "output_tokens").alias("o"),
    )
    along = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("model", F.coalesce(F.last("turn", ignorenulls=True).over(along), F.lit(""))).where("counts AND ts IS NOT NULL")
    d = snapshot_deltas(r, ["file"], "pos", ["i", "c", "o"])
    fresh = F.when(F.col("d_i").isNotNull(), F.greatest(F.lit(0), F.col("d_i") - F.coalesce("d_c", F.lit(0))))
    session = F.regexp_extract("file", r"([0-9a-fA-F-]{36})\.jsonl$", 1)
    d = d.select(F.when(session != "", session).otherwise(F.col("file")).alias("session_id"), "ts", "model", fresh.alias("input_tokens"), F.col("d_o").alias("output_tokens"), F.col("d_c").alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_creation_tokens"))
    return _events(d, "codex")


def gemini_events(rows: DataFrame) -> DataFrame:
    """Messages with running token totals; a message repeated by its id counts once; thoughts are output."""
    r = rows.select("file", "pos", _text("$.sessionId").alias("head"), _iso().alias("ts"), _text("$.id").alias("id"), _text("$.model").alias("model"), *[_long(f"$.tokens.{f}").alias(f[0]) for f in ("input", "output", "cached", "thoughts")])
    r = r.withColumn("session_id", F.coalesce(F.first("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col("file")))
    nth = F.row_number().over(Window.partitionBy("file", "id").orderBy("pos"))
    r = r.withColumn("nth", F.when(F.col("id").isNull(), 1).otherwise(nth)).where("nth = 1 AND ts IS NOT NULL AND coalesce(i, o, c, t) IS NOT NULL")
    d = snapshot_deltas(r, ["file"], "pos", ["i", "o", "c", "t"])
    out = F.when(F.coalesce("d_o", "d_t").isNotNull(), F.coalesce("d_o", F.lit(0)) + F.coalesce("d_t", F.lit(0)))
    d = d.select("session_id", "ts", F.coalesce("model", F.lit("")).alias("model"), F.when(F.col("d_i").isNotNull(), F.greatest(F.lit(0), F.col("d_i") - F.coalesce("d_c", F.lit(0)))).alias("input_tokens"), out.alias("output_tokens"), F.col("d_c").alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_creation_tokens"))
    return _events(d, "gemini")


def device_tag(machine_id: Column) -> Column:
    """The short name of a device inside a session's identifier; none for an unknown device."""
    return F.when(machine_id != "", F.substring(F.sha1(machine_id), 1, 8))


def grok_events(rows: DataFrame) -> DataFrame:
    """One call per line; instants in seconds or milliseconds. A line without a session's identifier belongs to that of its device's day.

    ``rows`` may have ``machine_id``; without it devices can't be told apart.
    """
    ts = _text("$.ts").try_cast("double")
    at = F.timestamp_millis(F.when(ts < 1e12, ts * 1000).otherwise(ts).cast("long")).cast("timestamp_ntz")
    named = [F.nullif(_text(f"$.{f}"), F.lit("")) for f in ("session_id", "sessionId", "conversation_id", "conversationId")]
    device = device_tag(F.col("machine_id")) if "machine_id" in rows.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("long")
    r = rows.where(ts.isNotNull() & ~F.isnan(ts)).select(
        F.coalesce(*named, F.concat_ws("-", F.lit("grok"), device, day(kst(at)))).alias("session_id"), at.alias("ts"), F.coalesce(F.nullif(_text("$.model"), F.lit("")), F.lit("grok")).alias("model"),
        _long("$.prompt_tokens").alias("input_tokens"), _long("$.completion_tokens").alias("output_tokens"), none.alias("cache_read_tokens"), none.alias("cache_creation_tokens"),
    )
    return _events(r, "grok")


def opencode_events(messages: DataFrame, since_ms: int = 0) -> DataFrame:
    """The message table (``id, session_id, time_created, data``) by JDBC or exported; reasoning is output."""
    n = lambda p: F.get_json_object("data", p).cast("long")
    m = messages.where(F.col("time_created") >= since_ms).where(F.get_json_object("data", "$.role") == "assistant")
    m = m.select(
        "session_id", F.timestamp_millis("time_created").cast("timestamp_ntz").alias("ts"), F.coalesce(F.get_json_object("data", "$.modelID"), F.lit("")).alias("model"), n("$.tokens.input").alias("input_tokens"),
        (F.coalesce(n("$.tokens.output"), F.lit(0)) + F.coalesce(n("$.tokens.reasoning"), F.lit(0))).alias("output_tokens"), n("$.tokens.cache.read").alias("cache_read_tokens"), n("$.tokens.cache.write").alias("cache_creation_tokens"),
    )
    return _events(m, "opencode")


def rolled_up(events: DataFrame, bucket: str = "date") -> DataFrame:
    """Days or hours of events; the day's sessions are told on its first model row only."""
    keys = ["tool", bucket]
    sums = events.groupBy(*keys, "model").agg(*[F.sum(c).alias(c) for c in EVENT[6:]], F.count(F.lit(1)).alias("requests"))
    n = events.groupBy(*keys).agg(F.count_distinct("session_id").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("model")) == 1
    return sums.join(n, keys).withColumn("sessions", F.when(first, F.col("n"))).drop("n")


def codex_limits(rows: DataFrame, now: Column) -> DataFrame:
    """The newest rate-limit reading of all files, its windows that still run."""
    r = rows.select(F.struct(_iso(), "pos").alias("at"), _iso().alias("ts"), _text("$.payload.rate_limits").alias("limits")).where("limits IS NOT NULL")
    last = r.agg(F.max_by(F.struct("ts", "limits"), "at").alias("x")).select("x.*")
    kinds = F.from_json("limits", "map<string,struct<used_percent:double,window_minutes:long,resets_at:long>>")
    w = last.select("ts", F.explode(kinds).alias("name", "w")).select("ts", F.concat(F.lit("codex_"), F.col("w.window_minutes").cast("string"), F.lit("m")).alias("window"), F.col("w.used_percent").alias("utilization_pct"), F.col("w.resets_at").alias("resets_at"), "w.window_minutes")
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60
    return w.where((F.col("resets_at") > F.unix_timestamp(now)) & (age <= F.col("window_minutes"))).drop("window_minutes")


def claude_limits(rows: DataFrame) -> DataFrame:
    """Every top-level object with a numeric utilization, a percentage, rounded, not below 0."""
    kinds = F.from_json("value", "map<string,string>")
    w = rows.select(F.explode(kinds).alias("window", "body"))
    pct = F.get_json_object("body", "$.utilization").cast("double")
    return w.where(pct.isNotNull()).select("window", F.greatest(F.lit(0.0), F.round(pct)).alias("utilization_pct"), F.get_json_object("body", "$.resets_at").alias("resets_at"))
