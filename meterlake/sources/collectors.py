"""Collectors of ledger records: what five tools leave behind, with what could not be read kept aside.

A collector takes lines (``file, pos, value``; for one tool the rows of its message
table) and gives every line that tells usage as a record, and every line that should
have but can't with a ``reason``. Lines that tell something else are passed over. A
line is parsed once, against the fields that a collector needs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import FIELDS

#: An account's name where none is configured; its records identify nothing.
NO_ACCOUNT = "unverified:default"
RECORD = ["tool", "account_id", "record_id", "session_id", "kind", "occurred_at", "model", "provider", "parser_version", "revision", "completeness", "identity_quality", *FIELDS, *[f"ev_{f}" for f in FIELDS]]


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Lines with ``j``, their fields, and ``broken`` for those that aren't JSON. A field of another kind is null."""
    p = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where("value != ''").withColumn("j", p)
    return rows.withColumn("broken", F.col("j._bad").isNotNull() & F.try_parse_json("value").isNull())


def _whole(c: Column) -> Column:
    return F.when(c >= 0, c)


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _digest(*parts: Column) -> Column:
    """The digest of a text, or of several as one array."""
    return F.sha2(F.to_json(F.array(*parts)) if len(parts) > 1 else parts[0], 256)


def _instant(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _iso(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _records(rows: DataFrame, tool: str, account: str, *, kind: str, revision: Column | None = None, provider: Column | None = None, unsupported: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``at, record_id, session_id, model, quality, complete`` and the metrics as records; one that has ``reason`` keeps it."""
    none = F.lit(None).cast("long")
    metric = {f: F.col(f).cast("long") if f in rows.columns else none for f in FIELDS}
    quality = F.lit("unverified") if account == NO_ACCOUNT else F.col("quality")
    evidence = [F.when(F.lit(f in unsupported) | (F.col("no_requests") if f == "requests" and "no_requests" in rows.columns else F.lit(False)), "unsupported").when(metric[f].isNull(), "unknown").otherwise("known").alias(f"ev_{f}") for f in FIELDS]
    return rows.select(
        "file", "value", "reason", F.lit(tool).alias("tool"), F.lit(account).alias("account_id"), "record_id", "session_id", F.lit(kind).alias("kind"), F.col("at").alias("occurred_at"), F.coalesce(_some(F.col("model")), F.lit("unknown")).alias("model"),
        (F.lit(None).cast("string") if provider is None else provider).alias("provider"), F.lit(1).alias("parser_version"), (F.unix_millis("at") if revision is None else revision).alias("revision"),
        F.when(F.col("complete"), "final").otherwise("partial").alias("completeness"), quality.alias("identity_quality"), *[m.alias(f) for f, m in metric.items()], *evidence,
    )


def _reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.when(F.col("broken"), "not json").when(F.col("at").isNull(), "no instant"))


def claude(lines: DataFrame, account: str) -> DataFrame:
    """Assistant messages with usage. A message and its request are one event wherever they are copied, and its session is the event's own."""
    schema = "type string, timestamp string, requestId string, uuid string, message struct<id:string,model:string,stop_reason:string,stopReason:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
    r = _parsed(lines, schema)
    told = (F.col("j.type") == "assistant") & F.col("j.message.usage").isNotNull() & ~F.coalesce(F.col("j.message.model") == "<synthetic>", F.lit(False))
    r = r.where(F.col("broken") | told).withColumn("at", _instant(F.col("j.timestamp")))
    message, request = _some(F.col("j.message.id")), _some(F.col("j.requestId"))
    native = message.isNotNull() & request.isNotNull()
    said = F.to_json(F.struct(_iso(F.col("at")).alias("at"), F.col("j.message.model").alias("model"), F.col("j.message.usage").alias("usage")))
    own = F.when(native, F.concat(F.lit("native:"), _digest(message, request))).otherwise(F.concat(F.lit("unverified:"), _digest(F.coalesce(_some(F.col("j.uuid")), said))))
    usage = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens"}
    r = _reason(r).select("*", own.alias("record_id"), F.col("j.message.model").alias("model"), F.when(native, "native").otherwise("unverified").alias("quality"), F.coalesce("j.message.stop_reason", "j.message.stopReason").isNotNull().alias("complete"), *[_whole(F.col(f"j.message.usage.{c}")).alias(m) for m, c in usage.items()], F.when(native, 1).alias("requests"))
    return _records(r.withColumn("session_id", F.concat(F.lit("event:"), F.col("record_id"))), "claude_code", account, kind="event")


def codex(lines: DataFrame, account: str) -> DataFrame:
    """Running totals of a file; the instant identifies a reading, the model is that of the last turn."""
    schema = "type string, timestamp string, payload struct<type:string,model:string,info:struct<total_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>>>"
    r = _parsed(lines, schema)
    along = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("model", F.last(F.when(F.col("j.type") == "turn_context", _some(F.col("j.payload.model"))), ignorenulls=True).over(along))
    total = F.col("j.payload.info.total_token_usage")
    told = (F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count") & total.isNotNull()
    r = r.where(F.col("broken") | told).withColumn("at", _instant(F.col("j.timestamp")))
    stem = F.regexp_extract("file", r"([^/]*)\.jsonl$", 1)
    uuid = F.regexp_extract(stem, "([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$", 1)
    session = F.coalesce(_some(uuid), stem)
    r = _reason(r).select("*", session.alias("session_id"), F.concat(F.lit("snapshot:"), _digest(session, _iso(F.col("at")))).alias("record_id"), F.lit("derived").alias("quality"), F.lit(False).alias("complete"), _whole(total["input_tokens"]).alias("input_tokens"), _whole(total["output_tokens"]).alias("output_tokens"), _whole(total["cached_input_tokens"]).alias("cache_read_tokens"))
    return _records(r, "codex", account, kind="cumulative", unsupported=("cache_creation_tokens", "requests"))


def gemini(lines: DataFrame, account: str) -> DataFrame:
    """Messages with running totals, thoughts counted as output; one without an identifier is told by its place among them."""
    schema = "type string, timestamp string, id string, sessionId string, model string, finishReason string, completed boolean, tokens struct<input:bigint,output:bigint,cached:bigint,thoughts:bigint,model:string>"
    r = _parsed(lines, schema)
    whole = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = r.withColumn("head", F.first(_some(F.col("j.sessionId")), ignorenulls=True).over(whole)).where(F.col("broken") | ((F.col("j.type") == "gemini") & F.col("j.tokens").isNotNull()))
    r = r.withColumn("at", _instant(F.col("j.timestamp")))
    nth = F.sum(F.when(F.col("at").isNotNull(), 1)).over(Window.partitionBy("file").orderBy("pos"))
    session = F.concat(F.lit("session:"), _digest(F.coalesce("head", F.regexp_extract("file", r"([^/]*)\.jsonl$", 1))))
    native = _some(F.col("j.id"))
    own = F.when(native.isNotNull(), F.concat(F.lit("native:"), _digest(native))).otherwise(F.concat("session_id", F.lit(":snapshot:"), nth.cast("string")))
    t = lambda f: _whole(F.col(f"j.tokens.{f}"))
    r = _reason(r).withColumn("session_id", session)
    r = r.select("*", own.alias("record_id"), F.coalesce(_some(F.col("j.model")), F.col("j.tokens.model")).alias("model"), F.when(native.isNotNull() & F.col("head").isNotNull(), "native").otherwise("unverified").alias("quality"), (F.coalesce(_some(F.col("j.finishReason")).isNotNull(), F.lit(False)) | F.coalesce("j.completed", F.lit(False))).alias("complete"), t("input").alias("input_tokens"), (t("output") + t("thoughts")).alias("output_tokens"), t("cached").alias("cache_read_tokens"))
    return _records(r, "gemini", account, kind="cumulative", unsupported=("cache_creation_tokens", "requests"))


def grok(lines: DataFrame, account: str) -> DataFrame:
    """One call a line, its instant in seconds or milliseconds; one without an identifier is told by its line's number."""
    schema = "ts double, id string, request_id string, requestId string, session_id string, sessionId string, conversation_id string, conversationId string, model string, prompt_tokens bigint, completion_tokens bigint"
    r = _parsed(lines, schema)
    ms = F.when(F.col("j.ts") < 1e12, F.col("j.ts") * 1000).otherwise(F.col("j.ts"))
    r = r.withColumn("at", F.when((ms >= 0) & (ms <= 8.64e15) & (ms == F.floor(ms)), F.timestamp_millis(ms.cast("long"))))
    number = F.sum(F.when(~F.col("broken"), 1)).over(Window.partitionBy("file").orderBy("pos"))
    first = lambda *names: F.coalesce(*[_some(F.col(f"j.{n}")) for n in names])
    native, session = first("id", "request_id", "requestId"), first("session_id", "sessionId", "conversation_id", "conversationId")
    own = F.when(native.isNotNull(), F.concat(F.lit("native:"), _digest(native))).otherwise(F.concat(F.lit("unverified:line:"), number.cast("string")))
    day = F.concat(F.lit("unverified:day:"), F.substring(_iso(F.col("at")), 1, 10))
    r = _reason(r).select("*", own.alias("record_id"), F.when(session.isNotNull(), F.concat(F.lit("session:"), _digest(session))).otherwise(day).alias("session_id"), F.col("j.model").alias("model"), F.when(native.isNotNull(), "native").otherwise("unverified").alias("quality"), F.lit(True).alias("complete"), _whole(F.col("j.prompt_tokens")).alias("input_tokens"), _whole(F.col("j.completion_tokens")).alias("output_tokens"), F.when(native.isNotNull(), 1).alias("requests"), native.isNull().alias("no_requests"))
    return _records(r, "grok", account, kind="event", unsupported=("cache_read_tokens", "cache_creation_tokens"))


def opencode(messages: DataFrame, account: str) -> DataFrame:
    """Rows of the message table: ``id, session_id, time_created, time_updated, data``; only counters and names are taken from ``data``."""
    schema = "role string, modelID string, providerID string, time struct<created:bigint,completed:bigint>, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>"
    rows = messages.select(F.lit("messages").alias("file"), F.col("data").alias("value"), *[F.col(c).alias(f"m_{c}") for c in ("id", "session_id", "time_created", "time_updated")])
    r = _parsed(rows, schema)
    t = lambda f: F.col(f"j.tokens.{f}")
    told = (F.col("j.role") == "assistant") & F.coalesce(t("input"), t("output"), t("reasoning"), t("cache.read"), t("cache.write")).isNotNull()
    r = r.where(F.col("broken") | told)
    ms = F.coalesce(F.when(F.col("j.time.created") != 0, F.col("j.time.created")), F.col("m_time_created"))
    r = r.withColumn("at", F.when(ms.between(0, 8_640_000_000_000_000) & _some(F.col("m_id")).isNotNull() & _some(F.col("m_session_id")).isNotNull(), F.timestamp_millis(ms)))
    positive = lambda c: F.when(c > 0, c)
    revision = F.coalesce(positive(F.col("m_time_updated")), positive(F.col("j.time.completed")), positive(F.col("m_time_created")), F.unix_millis("at"))
    r = _reason(r).select("*", F.concat(F.lit("native:"), _digest(F.col("m_id"))).alias("record_id"), F.concat(F.lit("session:"), _digest(F.col("m_session_id"))).alias("session_id"), F.col("j.modelID").alias("model"), F.lit("native").alias("quality"), (F.coalesce("j.time.completed", F.lit(0)) != 0).alias("complete"), _whole(t("input")).alias("input_tokens"), (_whole(t("output")) + _whole(t("reasoning"))).alias("output_tokens"), _whole(t("cache.read")).alias("cache_read_tokens"), _whole(t("cache.write")).alias("cache_creation_tokens"), F.lit(1).alias("requests"))
    return _records(r, "opencode", account, kind="event", revision=revision, provider=_some(F.col("j.providerID")))


COLLECTORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"claude_code": claude, "codex": codex, "gemini": gemini, "grok": grok, "opencode": opencode}


def collect(tool: str, rows: DataFrame, account: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tool's records, the lines it could not use (``file, value, reason``), and its health as one row.

    Records that say the same twice count once; versions that differ all go on, the
    ledger decides between them. Without an account's name nothing is identified.
    The health row has the parser, its account, whether that was configured, files and
    lines read, lines not recognised and records.
    """
    if account is not None and not re.fullmatch(r"[A-Za-z0-9._:-]{1,128}", account):
        raise ValueError(f"invalid account namespace for {tool}")
    name = account or NO_ACCOUNT
    marked = COLLECTORS[tool](rows, name)
    records = marked.where("reason IS NULL").select(*RECORD).dropDuplicates()
    refused = marked.where("reason IS NOT NULL").select("file", "value", "reason")
    read = rows.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("lines")) if "file" in rows.columns else rows.agg(F.lit(1).cast("long").alias("files"), F.count(F.lit(1)).alias("lines"))
    parts = [read, refused.agg(F.count(F.lit(1)).alias("unrecognized")), records.agg(F.count(F.lit(1)).alias("records"))]  # a row each
    health = parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))
    return records, refused, health.select(F.lit(tool).alias("parser"), F.lit(name).alias("account_id"), F.lit(account is not None).alias("namespace_configured"), "files", "lines", "unrecognized", "records")

