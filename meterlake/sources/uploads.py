"""Landed uploads of other kinds than usage: plan limits, ledger records, posts.

Each reader takes ``member_id, arrival, body`` (who sent it, in which order, the JSON
text) and gives what it holds and what was refused, with a reason. Whoever sent a body
is the person of what it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import FIELDS
from .payloads import MOST

# Names of a record's counts on the wire, and what its fields may be.
COUNTS = dict(zip(FIELDS, ("inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens", "requests")))
TOOLS = ("claude_code", "codex", "gemini", "grok", "opencode")
EVIDENCE = ("known", "unknown", "unsupported")


def _at(x: Column, path: str) -> Column:
    return F.try_variant_get(x, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    """What JSON kind a value is: number, string, boolean, array, object, null; null where there is none."""
    s = F.schema_of_variant(v)
    number = s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    return F.when(v.isNull(), None).when(number, "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("null")


def _string(x: Column, path: str) -> Column:
    return F.when(_kind(_at(x, path)) == "string", F.try_variant_get(x, f"$.{path}", "string"))


def _number(x: Column, path: str) -> Column:
    return F.when(_kind(_at(x, path)) == "number", F.try_variant_get(x, f"$.{path}", "double"))


def _none(x: Column, path: str) -> Column:
    """Whether a field is left out or null."""
    return F.coalesce(_kind(_at(x, path)) == "null", F.lit(True))


def _whole(x: Column, path: str, least: int = 0) -> Column:
    v = _number(x, path)
    return F.when((v >= least) & (v <= 2**53 - 1) & (v == F.floor(v)), F.try_variant_get(x, f"$.{path}", "bigint"))


def _long(c: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(c).between(least, most), F.lit(False))


def _bodies(uploads: DataFrame, items: str, most: int) -> DataFrame:
    """``member_id, arrival, b, items, error``: the body, its list's entries, and why it is refused whole."""
    u = uploads.select("member_id", "arrival", F.try_parse_json("body").alias("b"))
    listed = F.when(_kind(_at(F.col("b"), items)) == "array", F.try_variant_get("b", f"$.{items}", "array<variant>"))
    u = u.withColumn("items", listed)
    return u.withColumn("error", F.when(F.col("b").isNull(), "json").when(F.col("items").isNull(), items).when(F.size("items") > most, f"{items}: too many"))


def _refused(u: DataFrame) -> DataFrame:
    return u.where("error IS NOT NULL").select("member_id", "arrival", "error")


def limit_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots of plan limits, and refused bodies; one bad snapshot refuses its body, and so does none.

    The address is what the sender calls the account; a missing organisation is one.
    """
    u = _bodies(uploads, "snapshots", MOST["snapshots"])

    def bad(x: Column) -> Column:
        pct = _number(x, "utilizationPct")
        optional = [F.coalesce(_kind(_at(x, f)), F.lit("null")).isin("null", "string") for f in ("subscriptionType", "rateLimitTier", "resetsAt")]
        organization = F.coalesce(_kind(_at(x, "organization")), F.lit("string")) == "string"
        right = _string(x, "date").rlike(r"^\d{4}-\d{2}-\d{2}$") & _long(_string(x, "accountEmail"), 1, 1 << 20) & _long(_string(x, "window"), 1, 1 << 20) & (pct >= 0) & organization
        for o in optional:
            right = right & o
        return ~F.coalesce(right, F.lit(False))

    u = u.withColumn("error", F.coalesce("error", F.when(F.size("items") == 0, "snapshots").when(F.exists("items", bad), "snapshots")))
    x = F.col("x")
    rows = u.where("error IS NULL").select("member_id", "arrival", F.posexplode("items").alias("pos", "x"))
    named = {"date": "date", "account_email": "accountEmail", "window": "window", "subscription_type": "subscriptionType", "rate_limit_tier": "rateLimitTier", "resets_at": "resetsAt"}
    return rows.select("member_id", "arrival", "pos", *[_string(x, w).alias(n) for n, w in named.items()], F.coalesce(_string(x, "organization"), F.lit("")).alias("organization"), _number(x, "utilizationPct").alias("utilization_pct")), _refused(u)


def _record_error(x: Column) -> Column:
    """The field by which a record is invalid, null if by none."""
    opaque = lambda f: _long(_string(x, f), 1, 256) & ~F.coalesce(_string(x, f).rlike(r"[\\/\r\n\x00]"), F.lit(True))
    one_of = lambda f, names: F.coalesce(_string(x, f).isin(*names), F.lit(False))
    rules = [
        ("tool", one_of("tool", TOOLS)), ("accountId", opaque("accountId")), ("recordId", opaque("recordId")), ("sessionId", opaque("sessionId")), ("kind", one_of("kind", ("event", "cumulative"))),
        ("occurredAt", F.coalesce(_string(x, "occurredAt").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), F.lit(False)) & F.try_to_timestamp(_string(x, "occurredAt")).isNotNull()),
        ("model", _long(_string(x, "model"), 0, 256)), ("provider", _none(x, "provider") | _long(_string(x, "provider"), 0, 256)), ("parserVersion", _whole(x, "parserVersion", 1).isNotNull()), ("revision", _whole(x, "revision").isNotNull()),
        ("completeness", one_of("completeness", ("partial", "final"))), ("identityQuality", one_of("identityQuality", ("native", "derived", "unverified"))),
    ]
    for w in COUNTS.values():
        evidence = F.coalesce(_kind(_at(x, f"fieldEvidence.{w}")).isNull() | _string(x, f"fieldEvidence.{w}").isin(*EVIDENCE), F.lit(False))
        known = F.coalesce(_string(x, f"fieldEvidence.{w}") == "known", F.lit(False))
        rules.append((w, evidence & F.when(_none(x, w), ~known).otherwise(known & _whole(x, w).isNotNull())))
    out = F.when(_kind(x) != "object", "record")
    for name, right in rules:
        out = out.when(~right, name)
    return out


def record_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger records in order of ``arrival`` and ``pos``, records rejected one by one (``pos, error``), and bodies refused whole.

    A body has to be of protocol 3 and name its device. Evidence left out is unknown; a
    value stands exactly where its evidence is known.
    """
    u = _bodies(uploads, "records", MOST["records"])
    b = F.col("b")
    device = _long(_string(b, "device.machineId"), 1, 256) & _long(_string(b, "device.uploaderVersion"), 1, 128)
    u = u.withColumn("error", F.coalesce("error", F.when(~F.coalesce(_number(b, "protocolVersion") == 3, F.lit(False)), "protocolVersion").when(~device, "device")))
    rows = u.where("error IS NULL").select("member_id", "arrival", _string(b, "device.machineId").alias("machine_id"), F.posexplode("items").alias("pos", "x")).withColumn("error", _record_error(F.col("x")))
    x = F.col("x")
    named = {"tool": "tool", "account_id": "accountId", "record_id": "recordId", "session_id": "sessionId", "kind": "kind", "model": "model", "provider": "provider", "completeness": "completeness", "identity_quality": "identityQuality"}
    records = rows.where("error IS NULL").select(
        "member_id", "arrival", "pos", "machine_id", *[_string(x, w).alias(n) for n, w in named.items()], F.try_to_timestamp(_string(x, "occurredAt")).alias("occurred_at"), _whole(x, "parserVersion").cast("int").alias("parser_version"), _whole(x, "revision").alias("revision"),
        *[_whole(x, w).alias(n) for n, w in COUNTS.items()], *[F.coalesce(_string(x, f"fieldEvidence.{w}"), F.lit("unknown")).alias(f"ev_{n}") for n, w in COUNTS.items()],
    )
    return records, rows.where("error IS NOT NULL").select("member_id", "arrival", "pos", "error"), _refused(u)


def post_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts ``member_id, arrival, title, body, link, tags``, and refused bodies.

    A post needs a title and a text or a link by http(s). The latest upload of a
    member's link replaces the ones before; posts without a link all stay.
    """
    u = uploads.select("member_id", "arrival", F.try_parse_json("body").alias("b"))
    b = F.col("b")
    text = lambda f: F.coalesce(F.trim(_string(b, f)), F.lit(""))
    u = u.select("member_id", "arrival", "b", text("title").alias("title"), text("bodyMarkdown").alias("text"), F.nullif(text("link"), F.lit("")).alias("link"))
    tags = F.when(_kind(_at(b, "tags")) == "array", F.try_variant_get("b", "$.tags", "array<string>"))
    tags = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    error = F.when(F.coalesce(_kind(b), F.lit("")) != "object", "json").when(F.col("title") == "", "title").when((F.col("text") == "") & F.col("link").isNull(), "bodyMarkdown").when(~F.lower("link").rlike("^https?://"), "link")
    u = u.withColumn("tags", tags).withColumn("error", error)
    newest = F.row_number().over(Window.partitionBy("member_id", "link").orderBy(F.desc("arrival")))
    good = u.where("error IS NULL").withColumn("place", F.when(F.col("link").isNull(), 1).otherwise(newest)).where("place = 1")
    return good.select("member_id", "arrival", "title", F.col("text").alias("body"), "link", "tags"), _refused(u)

