"""The register of connectors: a name, and how its landed data become usage rows of the days from a first one on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import logs, vendors

Connector = Callable[[SparkSession, str, str | None], DataFrame]
CONNECTORS: dict[str, Connector] = {}


def connector(name: str, run: Connector) -> None:
    """Add a connector; a name taken is an error."""
    if name in CONNECTORS:
        raise ValueError(f"connector {name} exists")
    CONNECTORS[name] = run


def _log(read: Callable[[DataFrame], DataFrame]) -> Connector:
    """Files not touched since the day before the first are skipped, then lines of earlier days."""

    def run(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
        touched = None if since is None else f"{since}T00:00:00"
        return logs.since(read(logs.lines(spark, path, modified_after=touched)), since)

    return run


def _report(read: Callable[[SparkSession, str], DataFrame]) -> Connector:
    def run(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
        return logs.since(read(spark, path), since)

    return run


def _cursor(spark: SparkSession, path: str) -> DataFrame:
    return vendors.cursor_usage(spark.read.json(f"{path}/activity"), spark.read.json(f"{path}/events"))


connector("claude_code", _log(logs.claude_events))
connector("codex", _log(logs.codex_events))
connector("gemini", _log(logs.gemini_events))
connector("grok", _log(logs.grok_events))
connector("opencode", _report(lambda spark, path: logs.opencode_events(spark.read.parquet(path))))
connector("claude_spend", lambda spark, path, since=None: vendors.spend_csv(spark, path))
connector("cursor", _report(_cursor))
connector("cursor_pages", lambda spark, path, since=None: logs.since(vendors.cursor_pages(spark, path, since), since))
connector("anthropic", _report(lambda spark, path: vendors.anthropic_usage(spark.read.json(path))))
connector("copilot", _report(lambda spark, path: vendors.copilot_billing(spark.read.json(path))))
connector("gemini_workspace", _report(lambda spark, path: vendors.gemini_activity(spark.read.json(path))))
