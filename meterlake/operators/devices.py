"""Devices: parser health kept in samples, receipts counted, the state of synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import METRICS, clip

#: Fixed value: readings of one upload.
HEALTH_MOST = 50
#: Seconds between kept samples, days and number of them, days and number of parsers shown.
APART, HISTORY_DAYS, HISTORY_MOST, PARSER_DAYS, PARSER_MOST = 12 * 3600, 7, 14, 30, 20


def spaced(times: Column, apart: int = APART) -> Column:
    """Of an array of instants in seconds, in order, those kept when each must lie so far behind the one kept before."""
    step = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= apart), F.concat(kept, F.array(t))).otherwise(kept)
    return F.aggregate(F.array_sort(times), F.array().cast("array<bigint>"), step)


def health_samples(reports: DataFrame, now: int) -> DataFrame:
    """``external_id, machine_id, parser, at`` of the samples kept of a device's reports (``at`` in seconds).

    The fold runs over one parser's week on one device.
    """
    keys = ["external_id", "machine_id", "parser"]
    recent = reports.where(F.col("at") >= now - HISTORY_DAYS * 86400)
    kept = recent.groupBy(*keys).agg(spaced(F.collect_list(F.col("at").cast("long"))).alias("kept"))
    return kept.select(*keys, F.explode(F.slice("kept", F.greatest(F.lit(1), F.size("kept") - HISTORY_MOST + 1), F.lit(HISTORY_MOST))).alias("at"))


def latest_health(reports: DataFrame, now: int) -> DataFrame:
    """The last report of each parser in a month, the most recent parsers of a device."""
    keys = ["external_id", "machine_id"]
    last = reports.where(F.col("at") >= now - PARSER_DAYS * 86400).groupBy(*keys, "parser").agg(F.max("at").alias("at"), F.max_by("files", "at").alias("files"), F.max_by("emitted", "at").alias("emitted"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at"), "parser"))).where(F.col("place") <= PARSER_MOST).drop("place")


def receipts(acknowledged: DataFrame) -> DataFrame:
    """Acknowledgements counted by device and source, with the last instant of any and of a stored one."""
    n = lambda what: F.count_if(F.col("receipt").startswith(what)).alias(what)
    g = acknowledged.groupBy("external_id", "machine_id", "tool")
    return g.agg(*[n(x) for x in ("stored", "unchanged", "superseded", "conflict", "rejected")], F.max("at").alias("last_at"), F.max(F.when(F.col("receipt") == "stored", F.col("at"))).alias("last_stored_at"))


def sync_since(runs: DataFrame, *, first: str, lookback: int, as_of: str, asked: str | None = None, full: DataFrame | None = None) -> DataFrame:
    """``tool, since``: from which day a connector fetches next, by the first that holds of five.

    A day that is asked for; an unfinished retry's start, which the latest run tells
    whatever its outcome; ``first`` for connectors whose reports come whole (``full``, a
    table of ``tool``); the day of the latest run that went well or in part, less the
    look-back; ``first``. Never after ``as_of``.
    """
    fine = F.col("status").isin("ok", "partial")
    g = runs.groupBy("tool").agg(F.max_by(F.when(fine, F.struct(F.col("date").alias("day"))), F.when(fine, F.col("run_id"))).alias("good"), F.max_by(F.struct("retry_since"), "run_id").alias("last"))
    whole = F.lit(False)
    if full is not None:
        g = g.join(full.select("tool", F.lit(True).alias("whole")), "tool", "left")
        whole = F.coalesce("whole", F.lit(False))
    cursor = F.date_format(F.date_sub(F.to_date("good.day"), lookback), "yyyy-MM-dd")
    since = F.coalesce(F.lit(asked), F.col("last.retry_since"), F.when(whole, F.lit(first)), cursor, F.lit(first))
    return g.select("tool", F.least(since, F.lit(as_of)).alias("since"))


def ran(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log of runs with those that ``outcomes`` (``tool, run_id, since, rows, newest, empty_scopes, error``) tell of.

    A failed run keeps the day it began from, to be tried again; one without rows is
    empty and moves nothing; others go on to the newest day that was returned or had
    been before, and count as partial if a scope of theirs was empty.
    """
    before = runs.where(F.col("status").isin("ok", "partial")).groupBy("tool").agg(F.max_by("date", "run_id").alias("reached"))
    failed, nothing = F.col("error").isNotNull(), F.coalesce("rows", F.lit(0)) == 0
    status = F.when(failed, "error").when(nothing, "empty").when(F.coalesce("empty_scopes", F.lit(0)) > 0, "partial").otherwise("ok")
    new = outcomes.join(before, "tool", "left").select("tool", F.when(failed | nothing, F.lit(None).cast("string")).otherwise(F.greatest("newest", "reached")).alias("date"), "run_id", status.alias("status"), F.when(failed, F.col("since")).alias("retry_since"))
    return runs.select(*new.columns).unionByName(new)


def cutover_report(legacy: DataFrame, derived: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A dry run's comparison: keys missing, different, unexpected or the same, and how many."""
    a = legacy.groupBy(*keys).agg(F.sum(value).alias("a"))
    b = derived.groupBy(*keys).agg(F.sum(value).alias("b"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return a.join(b, keys, "full").groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def member_status(members: DataFrame, health: DataFrame, now: Column, *, odd_lines: int = 5) -> DataFrame:
    """``member_id, name, seen, label``: the first that holds of an error signal, never seen, silent for a day, received.

    ``health`` is each device's parsers as last reported (``external_id, at,
    unrecognized``); identifiers match addresses whatever their case.
    """
    own = health.groupBy(F.lower("external_id").alias("mail")).agg(F.max("at").alias("seen"), F.bool_or(F.col("unrecognized") >= odd_lines).alias("bad"))
    silent = F.col("seen") < now - F.expr("INTERVAL 1 DAY")
    label = F.when(F.coalesce("bad", F.lit(False)), "error signal").when(F.col("seen").isNull(), "unknown").when(silent, "nothing lately").otherwise("received")
    return members.join(own, F.lower("email") == F.col("mail"), "left").select("member_id", "name", "seen", label.alias("label"))


def health_warnings(readings: DataFrame) -> DataFrame:
    """Readings ``machine_id, parser, date, files, sessions, odd`` to the latest of each parser, with the week before and ``warn``.

    A parser warns if it read as many files as usual and gave no session, or if it
    met five or more odd lines, a fifth more than usual. Without a reading in the
    seven days before there is no usual, and no warning.
    """
    own = Window.partitionBy("machine_id", "parser")
    before = own.orderBy(F.unix_date(F.to_date("date"))).rangeBetween(-7, -1)
    h = readings.select("*", F.avg("files").over(before).alias("files_before"), F.avg("odd").over(before).alias("odd_before"), F.max("date").over(own).alias("last"))
    silent = (F.col("files") > 0) & (F.col("files") >= F.col("files_before")) & (F.col("sessions") == 0)
    jump = (F.col("odd") >= 5) & (F.col("odd") / F.greatest(F.lit(1.0), "odd_before") > 1.2)
    return h.where("date = last").withColumn("warn", F.col("odd_before").isNotNull() & (silent | jump)).drop("last")


def tool_status(tools: DataFrame, sources: DataFrame, earlier: DataFrame) -> DataFrame:
    """Every tool with its records, conflicts and a label, gravest first.

    ``sources`` has by tool ``records, conflicts, unverified, error``; ``earlier``
    names tools with rows from before records were kept. No row of a tool is no
    proof of no use, so it is unknown.
    """
    s = tools.join(sources.withColumn("source", F.lit(True)), "tool", "left").join(earlier.select("tool").distinct().withColumn("earlier", F.lit(True)), "tool", "left")
    none = F.coalesce("records", F.lit(0)) == 0
    label = F.when(F.col("conflicts") > 0, "conflict").when(F.col("error"), "read error").when(none & F.col("earlier"), "earlier records")
    label = label.when(F.col("source").isNull(), "unknown").when(none, "check source").when(F.col("unverified") > 0, "received, to be compared").otherwise("received")
    return s.select("tool", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), label.alias("label"))


def machines(sessions: DataFrame, older: DataFrame, as_of: str, *, days: int = 14) -> DataFrame:
    """Each device's last day, its recent tokens and requests, and whether it has fallen silent.

    ``sessions`` carry ``machine_ids`` and count for every device of theirs;
    ``older`` are daily rows with one ``machine_id``. The two must not overlap.
    """
    t = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    rows = sessions.select("external_id", F.explode("machine_ids").alias("machine_id"), "date", t.alias("t"), "requests")
    rows = rows.unionByName(older.select("external_id", "machine_id", "date", t.alias("t"), "requests"))
    edge = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    recent = lambda c: F.sum(F.when(F.col("date") > edge, F.col(c)).otherwise(0)).cast("long")
    stale = F.max("date") < F.date_format(F.date_sub(F.lit(as_of).cast("date"), 1), "yyyy-MM-dd")
    return rows.groupBy("external_id", "machine_id").agg(F.max("date").alias("last_date"), recent("t").alias("recent_tokens"), recent("requests").alias("recent_requests"), stale.alias("stale"))


def email_index(members: DataFrame, identities: DataFrame) -> DataFrame:
    """``email, member_id``: a member's own address first, then identities shaped like one, the first registered winning."""
    own = members.select(F.lower("email").alias("email"), "member_id", F.lit(0).alias("rank_of"), F.lit(0).cast("long").alias("arrival"))
    other = identities.where(F.col("external_id").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).select(F.lower("external_id").alias("email"), "member_id", F.lit(1).alias("rank_of"), F.col("arrival").cast("long").alias("arrival"))
    return own.unionByName(other).groupBy("email").agg(F.min_by("member_id", F.struct("rank_of", "arrival")).alias("member_id"))


def clipped_health(items: Column) -> Column:
    """The first well-formed readings of an array of struct(parser, files, unrecognized, emitted, error), texts clipped.

    A reading without a parser's name or with a missing or negative count is left
    out and never makes the whole fail; a null array stays null.
    """
    counted = lambda c: c.isNotNull() & (c >= 0)
    good = F.filter(items, lambda h: (F.length(F.trim(h["parser"])) > 0) & counted(h["files"]) & counted(h["unrecognized"]) & counted(h["emitted"]))
    one = lambda h: F.struct(clip(F.trim(h["parser"]), 40).alias("parser"), h["files"].alias("files"), h["unrecognized"].alias("unrecognized"), h["emitted"].alias("emitted"), clip(h["error"], 200).alias("error"))
    return F.transform(F.slice(good, 1, HEALTH_MOST), one)


def valid_sessions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session buckets fit to be merged, and, with the column at fault, the others."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    bad = F.when(~holds(F.length("tool").between(1, 40)), "tool").when(~holds(F.length("session_id").between(1, 200)), "session_id")
    bad = bad.when(~holds(F.col("hour").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}$")), "hour").when(holds(F.length("model") > 200), "model")
    for m in (*METRICS, "requests"):
        bad = bad.when(holds((F.col(m) < 0) | (F.col(m).cast("double") % 1 != 0)), m)
    marked = rows.withColumn("error", bad.when(~holds(F.col("parser_version") >= 1), "parser_version"))
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def sessions_together(rows: DataFrame, batches: int) -> DataFrame:
    """The rows in so many batches, a partition each, no session split between two."""
    return rows.repartition(batches, "tool", "session_id")


def packed_sessions(rows: DataFrame, most: int = 5000, order: str = "arrival") -> DataFrame:
    """Rows with ``batch``, per person from 1 on: sessions in order of first appearance, packed whole into batches of at most ``most`` rows.

    A batch takes sessions until the next one doesn't fit; a session over ``most``
    makes a batch of its own. Only sizes of sessions, one row each, are put in order;
    a batch's start depends on the one before, so each person's sizes are folded in turn.
    """
    session = ["external_id", "tool", "session_id"]
    sizes = rows.groupBy(*session).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    listed = sizes.groupBy("external_id").agg(F.sort_array(F.collect_list(F.struct("at", "tool", "session_id", "n"))).alias("all"))
    zero = F.struct(F.lit(1).cast("long").alias("batch"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<tool:string,session_id:string,batch:bigint>>").alias("out"))

    def step(s, x):
        opens = (s["held"] > 0) & (s["held"] + x["n"] > most)
        batch = s["batch"] + opens.cast("long")
        return F.struct(batch.alias("batch"), (F.when(opens, F.lit(0)).otherwise(s["held"]) + x["n"]).alias("held"), F.concat(s["out"], F.array(F.struct(x["tool"].alias("tool"), x["session_id"].alias("session_id"), batch.alias("batch")))).alias("out"))

    placed = listed.select("external_id", F.explode(F.aggregate("all", zero, step)["out"]).alias("x")).select("external_id", "x.*")
    return rows.join(placed, session)


def upload_window(cursors: DataFrame, now: Column, parser_version: int, floor: str | None = None) -> DataFrame:
    """``cursors`` (``last_success, last_full, parser_version``, instants in UTC) with ``mode, since``: what a device sends next.

    All of it without an earlier success or whole sending, a week after the last whole
    one, or after another parser; else from the day before the last success in Korea. A
    floor is a lower end of the window and no mode.
    """
    whole = F.col("last_success").isNull() | F.col("last_full").isNull() | ~F.col("parser_version").eqNullSafe(F.lit(parser_version)) | (F.col("last_full") < now - F.expr("INTERVAL 7 DAYS"))
    day = F.date_format(F.date_sub((F.col("last_success") + F.expr("INTERVAL 9 HOURS")).cast("date"), 1), "yyyy-MM-dd")
    since = F.when(~whole, day)
    return cursors.withColumn("mode", F.when(whole, "full").otherwise("incremental")).withColumn("since", F.greatest(since, F.lit(floor)) if floor else since)


def valid_records(records: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records whose values stand exactly where their evidence is known, and, with the reason, the others."""
    bad = F.when(~F.col("record_id").rlike(r"^[\x21-\x7e]{1,200}$"), "record_id").when(~F.col("kind").isin("event", "cumulative"), "kind")
    for m in metrics:
        known = F.coalesce(F.col(f"ev_{m}") == "known", F.lit(False))
        bad = bad.when(known != F.col(m).isNotNull(), m).when(F.coalesce(F.col(m) < 0, F.lit(False)), m)
    marked = records.withColumn("error", bad)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def to_records(events: DataFrame, metrics: list[str], *, parser_version: int) -> DataFrame:
    """Log events as ledger records, told apart by a digest of what they say."""
    said = F.sha2(F.to_json(F.struct("tool", "session_id", "ts", "model", *metrics), {"ignoreNullFields": "false"}), 256)
    return events.select("*", F.substring(said, 1, 32).alias("record_id"), F.lit("event").alias("kind"), F.col("ts").alias("occurred_at"), F.lit(parser_version).alias("parser_version"), *[F.when(F.col(m).isNull(), "unknown").otherwise("known").alias(f"ev_{m}") for m in metrics])
