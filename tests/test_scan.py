"""The composed display scan: filters on every branch, reviewed days, reports, on literal fixtures."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from meterlake.operators import scan
from meterlake.operators.scan import Match
from meterlake.plans import display

FACTS = "date string, hour string, tool string, model string, member_id long, external_id string, machine_id string, source string, date_basis string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, requests long"
RECORDS = "member_id long, tool string, account_id string, session_id string, record_id string, kind string, occurred_at timestamp_ntz, model string, provider string, parser_version int, revision int, completeness string, identity_quality string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, requests long, ev_input_tokens string, ev_output_tokens string, ev_cache_read_tokens string, ev_cache_creation_tokens string, ev_requests string"
SHEET = "account_id string, period_start string, period_end string, collected_at long, product string, model string, external_id string, " + ", ".join(f"{c} long" for c in scan.SHEET)


def fact(date="2024-01-10", tool="claude_code", member=1, external="a@x.test", source="uploader", machine="m", i=10, o=5, q=1, hour=None):
    return (date, hour, tool, "m", member, external, machine, source, "KST", i, o, 0, 0, q)


def record(n, at="2024-01-10 03:00:00", member=1, tool="claude_code", kind="event", i=7, o=3, r=0, w=0, session="s", completeness="final", quality="native", ev="known", account="acct", model="m"):
    return (member, tool, account, session, f"r{n}", kind, dt.datetime.fromisoformat(at), model, "", 1, 0, completeness, quality, i, o, r, w, 1, *["known"] * 4, ev)


def row_of_report(product="Claude Code", mail="a@x.test", day="2024-01-10", at=1, end=None, account="org", **sheet):
    return (account, day, end or day, at, product, "", mail, *[sheet.get(c) for c in scan.SHEET])


def reviewed(spark, records, day="2024-01-10", member=1, tool="claude_code", **change):
    """A scope as a review of these records leaves it."""
    frame = spark.createDataFrame(records, RECORDS)
    key = spark.createDataFrame([(member, tool, day)], "member_id long, tool string, date string")
    seen = scan.scope_state(scan.dated(frame), key).first()
    scope = {"accounts": seen.seen_accounts if seen else ["acct"], "expected": seen.n if seen else 1, "ledger_digest": seen.digest if seen else "", "conflicts": 0} | change
    return frame, spark.createDataFrame([(member, tool, day, scope["accounts"], scope["expected"], scope["ledger_digest"], scope["conflicts"])], scan.REVIEWED)


def book(spark, *rows):
    return spark.createDataFrame(list(rows) or [("a@x.test", 1)], "email string, member_id long")


def told(rows):
    return sorted(str((r.date, r.tool, r.source, r.member_id, r.input_tokens, r.requests)) for r in rows.collect())


def listed(*rows):
    return sorted(map(str, rows))


def test_reviewed_day_and_larger_report(spark):
    """One day is the ledger's, one the report's, a third stays as it was collected; a product of its own is added."""
    local = spark.createDataFrame([
        fact(i=1000), fact(i=500, machine="n"), fact(i=40, source="manual", machine=""), fact("2024-01-11", i=10), fact("2024-01-12", i=900), fact("2024-01-10", member=2, external="b@x.test", i=60), fact("2024-01-11", member=None, external="C@x.test", i=3), fact(tool="codex", i=8),
    ], FACTS)
    records, scopes = reviewed(spark, [record(1), record(2, i=20), record(3, at="2024-01-08 00:00:00", i=99)])
    sheet = spark.createDataFrame([
        row_of_report(day="2024-01-10", uncached_input_tokens=20, prompt_tokens=900), row_of_report(day="2024-01-11", prompt_tokens=77, completion_tokens=0, reported_requests=4), row_of_report(day="2024-01-12", prompt_tokens=100),
        row_of_report(day="2024-01-11", mail="c@x.test", prompt_tokens=300), row_of_report("Claude in Chrome", day="2024-01-10", prompt_tokens=6), row_of_report("Cowork", day="2024-01-11", end="2024-01-12", prompt_tokens=6), row_of_report("Cowork", day="2024-01-11", prompt_tokens=0),
    ], SHEET)
    review, reports = scan.Review(records, scopes, "2024-02-01"), scan.Reports(sheet, book(spark))
    out = scan.display_scan(local, Match(), review=review, reports=reports)
    day = "2024-01-10"
    assert told(out) == listed(
        (day, "claude_code", "uploader-records", 1, 27, 2), (day, "claude_code", "manual", 1, 40, 1), ("2024-01-11", "claude_code", "claude-spend-csv", 1, 77, 4), ("2024-01-12", "claude_code", "uploader", 1, 900, 1),
        (day, "claude_code", "uploader", 2, 60, 1), ("2024-01-11", "claude_code", "claude-spend-csv", None, 300, None), (day, "claude_in_chrome", "claude-spend-csv", 1, 6, None), (day, "codex", "uploader", 1, 8, 1),
    )
    seen = {(r.date, r.source): (r.value, r.o_output_tokens.status) for r in display.shown(spark, out, "raw").where("tool = 'claude_code' AND member_id = 1").collect()}
    assert seen["2024-01-11", "claude-spend-csv"] == (77.0, "known")  # a reported 0 is a measurement
    assert seen["2024-01-10", "uploader-records"] == (33.0, "known")


def test_filters_decide_on_branches(spark):
    local = spark.createDataFrame([fact(i=1000), fact(tool="codex", i=8), fact("2024-01-09", i=70)], FACTS)
    records, scopes = reviewed(spark, [record(1), record(2, at="2024-01-09 03:00:00", i=5)])
    review = scan.Review(records, scopes, "2024-02-01")
    reports = scan.Reports(spark.createDataFrame([row_of_report(prompt_tokens=5000), row_of_report("Cowork", prompt_tokens=6)], SHEET), book(spark))
    source = lambda m, **more: sorted({(r.tool, r.source) for r in scan.display_scan(local, Match(m), review=review, reports=reports, **more).collect()})
    assert source({"date": "2024-01-10"}) == [("claude_code", "claude-spend-csv"), ("claude_cowork", "claude-spend-csv"), ("codex", "uploader")]
    assert source({"tool": {"in": ["claude_code"]}, "date": "2024-01-10"}) == [("claude_code", "uploader-records")]  # no reports under a filter on tools
    assert source({"machine_id": "m", "date": "2024-01-10"}) == [("claude_code", "uploader"), ("codex", "uploader")]  # and no ledger under one on devices
    assert source({"member_id": 2}) == []
    assert source({"date": "2024-01-09"}) == [("claude_code", "uploader")]  # the day before the scope
    assert source({"hour": {"gte": "2024-01-10T12"}}, grain="hour") == [("claude_code", "uploader-records")]
    assert source({"hour": {"gte": "2024-01-10T13"}}, grain="hour") == []


def test_deltas_count_from_the_ledgers_beginning(spark):
    """A running total's first day of a filter is still told by what came before it."""
    records, scopes = reviewed(spark, [record(1, at="2024-01-08 01:00:00", kind="cumulative", tool="codex", i=100, o=10), record(2, kind="cumulative", tool="codex", i=130, o=15)], tool="codex")
    out = scan.display_scan(spark.createDataFrame([fact(tool="codex", i=8)], FACTS), Match({"date": {"gte": "2024-01-10", "lte": "2024-01-20"}}), review=scan.Review(records, scopes, "2024-02-01"))
    assert told(out) == listed(("2024-01-10", "codex", "uploader-records", 1, 30, 0))


@pytest.mark.parametrize(
    "records,change,today,blockers",
    [
        ([record(1)], {}, "2024-01-11", []),
        ([record(1)], {}, "2024-01-10", ["open_or_future_day"]),
        ([record(1)], {"expected": 2}, "2024-02-01", ["ledger_changed_or_incomplete"]),
        ([record(1)], {"ledger_digest": "0"}, "2024-02-01", ["ledger_changed_or_incomplete"]),
        ([record(1)], {"accounts": ["acct", "more"]}, "2024-02-01", ["account_scope_mismatch"]),
        ([record(1), record(2, at="2024-01-07 00:00:00", completeness="partial")], {}, "2024-02-01", ["unverified_source"]),
        ([record(1, ev="unknown")], {}, "2024-02-01", ["source_metrics_unknown"]),
        ([record(1), record(2, at="2024-01-07 00:00:00", ev="unknown")], {}, "2024-02-01", []),  # an event of another day
        ([record(1)], {"conflicts": 1}, "2024-02-01", ["unresolved_conflicts"]),
        ([record(1, at="2024-01-07 00:00:00")], {}, "2024-02-01", ["target_day_unobserved"]),
        ([record(1, kind="cumulative", i=9), record(2, at="2024-01-10 04:00:00", kind="cumulative", i=2)], {}, "2024-02-01", ["unresolved_conflicts", "unverified_derived"]),
        ([record(1, kind="cumulative", i=9), record(2, kind="cumulative", i=8)], {}, "2024-02-01", ["unresolved_conflicts", "target_day_unobserved"]),
    ],
)
def test_blockers(spark, records, change, today, blockers):
    ledger, scopes = reviewed(spark, records, **change)
    assert scan.cutover_facts(ledger, scopes, today=today)[1].first().blockers == blockers
    look = lambda: scan.display_scan(spark.createDataFrame([fact()], FACTS), Match(), review=scan.Review(ledger, scopes, today)).collect()
    if blockers:
        with pytest.raises(Exception, match="requires reconciliation: " + ",".join(blockers)):
            look()
    else:
        assert {r.source for r in look()} == {"uploader-records"}


def test_a_ledger_that_grew_is_noticed(spark):
    _, scopes = reviewed(spark, [record(1)])
    for grown in ([record(1), record(2)], [record(1, i=8)], []):
        later = spark.createDataFrame(grown, RECORDS)
        assert "ledger_changed_or_incomplete" in scan.cutover_facts(later, scopes, today="2024-02-01")[1].first().blockers
    again = scan.cutover_facts(spark.createDataFrame([record(1, at="2024-01-10 03:00:00"), record(9, at="2024-01-11 00:00:00")], RECORDS), scopes, today="2024-02-01")[1]
    assert again.first().blockers == []  # what comes after the day is no matter


def test_of_two_snapshots_the_later_counts(spark):
    sheet = spark.createDataFrame([row_of_report(prompt_tokens=50, at=1), row_of_report("Chat", prompt_tokens=9, at=1), row_of_report(prompt_tokens=30, at=2), row_of_report(prompt_tokens=4, at=1, account="other")], SHEET)
    assert sorted(r.input_tokens for r in scan.report_facts(sheet, book(spark)).collect()) == [4, 30]


@pytest.mark.parametrize(
    "terms,kept",
    [
        ({}, "abcd"), ({"n": 1}, "a"), ({"n": None}, "d"), ({"n": {"ne": None}}, "abc"), ({"n": {"ne": 1}}, "bcd"), ({"n": {"gte": 2}}, "bc"), ({"n": {"gt": 1, "lt": 3}}, "b"), ({"n": {"in": [1, None]}}, "ad"), ({"n": {"in": []}}, ""), ({"n": {"lte": 2}, "s": {"gt": "a"}}, "b"),
    ],
)
def test_match(spark, terms, kept):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "s string, n int")
    assert "".join(sorted(r.s for r in Match(terms).on(rows).collect())) == kept


def test_unknown_bounds_are_refused():
    with pytest.raises(ValueError, match="bounds are"):
        Match({"date": {"regex": "x"}})


def test_filters_reach_every_scan(spark, tmp_path):
    """Stored facts, records and reports each see the filter's days; a ledger only their upper end."""
    records, scopes = reviewed(spark, [record(1)])
    for name, frame in (("facts", spark.createDataFrame([fact()], FACTS)), ("records", scan.dated(records)), ("scopes", scopes), ("reports", spark.createDataFrame([row_of_report(prompt_tokens=5)], SHEET))):
        frame.write.parquet(f"{tmp_path}/{name}")
    t = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    out = scan.display_scan(t("facts"), Match({"date": {"gte": "2024-01-05", "lt": "2024-01-20"}, "member_id": 1}), review=scan.Review(t("records"), t("scopes"), "2024-02-01"), reports=scan.Reports(t("reports"), book(spark)))
    assert out.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = {}
    for line in plan.splitlines():
        if m := re.search(r"FileScan parquet.*?/(facts|records|scopes|reports)\b.*?PushedFilters: \[(.*?)\], ReadSchema", line):
            pushed.setdefault(m[1], []).append(m[2])
    assert set(pushed) == {"facts", "records", "scopes", "reports"}
    for name, column in (("facts", "date"), ("scopes", "date"), ("reports", "period_start")):
        assert all(f"GreaterThanOrEqual({column},2024-01-05)" in f and f"LessThan({column},2024-01-20)" in f for f in pushed[name]), (name, pushed[name])
    assert all("LessThan(date,2024-01-20)" in f and "GreaterThanOrEqual" not in f and "EqualTo(member_id,1)" in f for f in pushed["records"]), pushed["records"]
    assert all("EqualTo(member_id,1)" in f for f in pushed["facts"] + pushed["scopes"])
