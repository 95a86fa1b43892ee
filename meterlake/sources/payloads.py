"""Landed JSON uploads: bodies to usage rows, hourly rows, session rows, health readings and devices.

A body with a bad usage field is refused whole, with a reason. Diagnostics never
refuse a body: bad readings are dropped, long strings clipped, an unusable device
counts as none.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import valid_date
from ..functions.semantics import clip

# How many entries a body may hold of each kind.
MOST = {"rows": 10_000, "hourly": 20_000, "sessions": 50_000, "snapshots": 200, "records": 1_000}
_COUNTS = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens", "requests")
_NAMES = {"inputTokens": "input_tokens", "outputTokens": "output_tokens", "cacheReadTokens": "cache_read_tokens", "cacheCreationTokens": "cache_creation_tokens", "requests": "requests", "sessions": "sessions"}
SOURCES = ("poller", "uploader", "manual")


def _field(x: Column, name: str) -> Column:
    return F.get_json_object(x, f"$.{name}")


def _count(x: Column, name: str) -> Column:
    v = _field(x, name)
    return F.when(v.rlike(r"^\d{1,15}$"), v.cast("long"))


def _bad_count(x: Column, names: tuple[str, ...]) -> Column:
    bad = F.lit(False)
    for n in names:
        v = _field(x, n)
        bad = bad | F.coalesce(~v.rlike(r"^\d{1,15}$"), F.lit(False))
    return bad


def _bad_hour(x: Column) -> Column:
    h = _field(x, "hour")
    return F.coalesce(~h.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}$"), F.lit(True))


def _bad_text(x: Column, name: str, least: int, most: int) -> Column:
    n = F.length(_field(x, name))
    return F.coalesce((n < least) | (n > most), F.lit(least > 0))


def _bad_common(x: Column) -> Column:
    return _bad_text(x, "tool", 1, 1 << 20) | _bad_text(x, "machineId", 0, 64) | ~F.coalesce(_field(x, "source").isin(*SOURCES), F.lit(False))


def _bad(kind: str, x: Column) -> Column:
    if kind == "rows":
        return _bad_common(x) | ~F.coalesce(valid_date(_field(x, "date")), F.lit(False)) | _bad_count(x, (*_COUNTS, "sessions"))
    if kind == "hourly":
        return _bad_common(x) | _bad_hour(x) | _bad_count(x, _COUNTS)
    version = _field(x, "parserVersion")
    return (
        _bad_text(x, "tool", 1, 40) | _bad_text(x, "sessionId", 1, 200) | _bad_text(x, "model", 0, 200) | _bad_text(x, "provider", 0, 60) | _bad_text(x, "machineId", 0, 64)
        | _bad_hour(x) | _bad_count(x, _COUNTS) | ~F.coalesce(version.rlike(r"^[1-9]\d{0,8}$"), F.lit(False))
    )


def checked(payloads: DataFrame) -> DataFrame:
    """``external_id, arrival, body`` with the entries of each kind as JSON texts, and ``error``: why a body is refused, else null."""
    p = payloads.withColumn("b", F.from_json("body", "rows string, hourly string, sessions string, health string, device string", {"mode": "PERMISSIVE"}))
    kinds = ("rows", "hourly", "sessions")
    p = p.select("external_id", "arrival", F.get_json_object("body", "$").isNull().alias("broken"), *[F.from_json(f"b.{k}", "array<string>").alias(k) for k in (*kinds, "health")], *[F.col(f"b.{k}").alias(f"{k}_text") for k in kinds], F.col("b.device").alias("device"))
    error = F.when(F.col("broken"), "json")
    for k in kinds:
        error = error.when(F.col(f"{k}_text").isNotNull() & F.col(k).isNull(), k).when(F.size(k) > MOST[k], f"{k}: too many").when(F.exists(k, partial(_bad, k)), k)
    some = F.coalesce(F.size("rows") > 0, F.lit(False)) | F.coalesce(F.size("sessions") > 0, F.lit(False)) | _device_ok()
    return p.withColumn("error", error.when(~some, "empty")).drop("broken", *[f"{k}_text" for k in kinds])


def _device_ok() -> Column:
    machine, version = F.trim(_field(F.col("device"), "machineId")), F.trim(_field(F.col("device"), "uploaderVersion"))
    return F.coalesce(F.length(machine).between(1, 64) & (F.length(version) > 0), F.lit(False))


def _entries(good: DataFrame, kind: str) -> DataFrame:
    return good.select("external_id", "arrival", F.explode(kind).alias("x"))


def _numbers(names: tuple[str, ...]) -> list[Column]:
    return [_count(F.col("x"), n).alias(_NAMES[n]) for n in names]


def _said(name: str, other: str = "") -> Column:
    return F.coalesce(_field(F.col("x"), name), F.lit(other))


def parsed(payloads: DataFrame) -> dict[str, DataFrame]:
    """Tables ``rows, hourly, sessions, health, devices, refused`` of ``external_id, arrival, body``.

    Whoever sent the body is the person of its rows, whatever identifier they name.
    """
    c = checked(payloads)
    good = c.where("error IS NULL")
    common = [_said("tool").alias("tool"), _said("model").alias("model"), "external_id", _said("machineId").alias("machine_id"), _said("source").alias("source")]
    health = _entries(good, "health").withColumn("parser", F.trim(_field(F.col("x"), "parser")))
    counts = {n: _count(F.col("x"), n) for n in ("filesScanned", "linesUnrecognized", "sessionsEmitted")}
    for n in counts.values():
        health = health.where(n.isNotNull())
    device = good.where(_device_ok())
    return {
        "rows": _entries(good, "rows").select(_said("date").alias("date"), *common, *_numbers((*_COUNTS, "sessions")), "arrival"),
        "hourly": _entries(good, "hourly").select(_said("hour").alias("hour"), *common, *_numbers(_COUNTS), "arrival"),
        "sessions": _entries(good, "sessions").select(
            "external_id", _said("tool").alias("tool"), _said("sessionId").alias("session_id"), _said("hour").alias("hour"), _said("model").alias("model"), _count(F.col("x"), "parserVersion").cast("int").alias("parser_version"),
            _said("machineId").alias("machine_id"), _field(F.col("x"), "accountOrg").alias("account_org"), _field(F.col("x"), "accountEvidence").alias("account_evidence"), *_numbers(_COUNTS), "arrival",
        ),
        "health": health.where("parser != ''").select("external_id", "arrival", clip(F.col("parser"), 40).alias("parser"), *[c.alias(n) for n, c in zip(("files", "odd", "sessions"), counts.values(), strict=True)], clip(_field(F.col("x"), "error"), 200).alias("error")),
        "devices": device.select(
            "external_id", "arrival", F.trim(_field(F.col("device"), "machineId")).alias("machine_id"), F.trim(clip(F.trim(_field(F.col("device"), "label")), 32)).alias("label"), clip(F.trim(_field(F.col("device"), "uploaderVersion")), 40).alias("uploader_version"),
        ),
        "refused": c.where("error IS NOT NULL").select("external_id", "arrival", "error"),
    }
