"""Landed pages, newest files, windows of runs and uploads, packing and identities, on literal fixtures and plain versions."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import devices, merge
from meterlake.sources import connectors, logs, pages, vendors


def land(root, windows, items):
    for start, answers in windows.items():
        os.makedirs(f"{root}/start={start}")
        for n, answer in enumerate(answers, 1):
            with open(f"{root}/start={start}/page={n}.json", "w") as f:
                json.dump({items: answer, "pagination": {"hasNextPage": n < len(answers)}}, f)


def test_pages(spark, tmp_path):
    root = str(tmp_path / "api")
    land(root, {"2024-01-01": [[1, 2], [3], []], "2024-01-31": [[{"a": "x"}]], "2024-03-01": [[4]]}, "data")
    os.makedirs(f"{root}/other")
    whole = pages.pages(spark, root)
    assert whole.rdd.getNumPartitions() == 3
    assert sorted((r.start, r.page, r.item) for r in whole.collect()) == [("2024-01-01", 1, "1"), ("2024-01-01", 1, "2"), ("2024-01-01", 2, "3"), ("2024-01-31", 1, '{"a": "x"}'), ("2024-03-01", 1, "4")]
    for since, n in (("2024-01-30", 3), ("2024-01-31", 2), ("2024-03-01", 1), ("2024-03-30", 1), ("2024-03-31", 0)):
        some = pages.pages(spark, root, since=since)
        assert (some.rdd.getNumPartitions() if n else some.count()) == n
    with open(f"{root}/start=2024-03-01/page=1.json", "w") as f:
        json.dump({"data": [], "pagination": {"hasNextPage": True}}, f)
    with pytest.raises(Exception, match="page=2.json"):
        whole.collect()


def test_filters_leave_windows_out(spark, tmp_path):
    root = str(tmp_path / "api")
    land(root, {"2024-01-01": [[1]], "2024-01-31": [[2]], "2024-03-01": [[4]]}, "data")
    some = pages.pages(spark, root).where("start >= '2024-01-31'")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 2
    assert pages.pages(spark, root).where("start > '2024-01-31' AND page = 1").collect()[0].item == "4"


def test_vendor_pages_are_the_usage_rows(spark, tmp_path):
    day = lambda day, email="A@x", **more: {"day": day, "email": email, "composerRequests": 2, "chatRequests": 1} | more
    event = lambda at, model="m", email="a@x", **use: {"timestamp": str(at), "userEmail": email, "model": model, "tokenUsage": {"inputTokens": 5} | use}
    ms = lambda s: int(dt.datetime.fromisoformat(s + "+00:00").timestamp() * 1000)
    root = str(tmp_path)
    land(f"{root}/daily", {"2024-01-01": [[day("2024-01-02"), day("2024-01-02", "b@x", isActive=False)], [{"date": ms("2024-01-03T00:00:00"), "email": "a@x", "cmdkUsages": 4}, {"day": "2024-01-04", "email": "a@x"}, day("2024-01-05", "")]], "2024-02-01": [[day("2024-02-02")]]}, "data")
    land(f"{root}/events", {"2024-01-01": [[event(ms("2024-01-02T01:00:00"), outputTokens=1)], [event(ms("2024-01-02T23:59:00")), event(ms("2024-01-03T00:00:00"), ""), event("soon"), {"timestamp": "1", "userEmail": "a@x"}]], "2024-02-01": [[event(ms("2024-02-03T00:00:00"))]]}, "usageEvents")
    out = connectors.CONNECTORS["cursor_pages"](spark, root, None)
    got = sorted(str((r.date, r.external_id, r.model, r.input_tokens, r.output_tokens, r.requests)) for r in out.collect())
    assert got == sorted(map(str, [("2024-01-02", "a@x", "", None, None, 3), ("2024-01-03", "a@x", "", None, None, 4), ("2024-02-02", "a@x", "", None, None, 3), ("2024-01-02", "a@x", "m", 10, 1, None), ("2024-01-03", "a@x", "unknown", 5, 0, None), ("2024-02-03", "a@x", "m", 5, 0, None)]))
    later = connectors.CONNECTORS["cursor_pages"](spark, root, "2024-02-03")
    assert [(r.date, r.model) for r in later.collect()] == [("2024-02-03", "m")]
    assert sorted(r.date for r in vendors.cursor_pages(spark, root, hourly=True).collect()) == ["2024-01-02T01", "2024-01-02T23", "2024-01-03T00", "2024-02-03T00"]


def test_newest_files_alone_are_read(spark, tmp_path):
    for i in range(9):
        path = tmp_path / f"d{i % 2}" / f"{i}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"line {i}\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    rows = logs.newest_lines(spark, str(tmp_path))
    assert sorted(r.value for r in rows.collect()) == [f"line {i}" for i in range(4, 9)]
    assert len(rows.inputFiles()) == 5
    os.makedirs(tmp_path / "none")
    assert logs.newest_lines(spark, str(tmp_path / "none")).collect() == []


RUNS = "tool string, date string, run_id long, status string, retry_since string"


@pytest.mark.parametrize(
    "runs,more,since",
    [
        ([("2024-01-10", 1, "ok", None)], {"asked": "2024-01-20"}, "2024-01-20"),
        ([("2024-01-10", 1, "ok", None), (None, 2, "error", "2024-01-05")], {}, "2024-01-05"),
        ([("2024-01-10", 1, "ok", None), (None, 2, "error", "2024-01-05")], {"full": True}, "2024-01-05"),
        ([("2024-01-10", 1, "ok", None)], {"full": True}, "2023-12-01"),
        ([("2024-01-10", 1, "ok", None)], {}, "2024-01-07"),
        ([("2024-01-10", 1, "ok", None), ("2024-01-12", 2, "partial", None), (None, 3, "empty", None)], {}, "2024-01-09"),
        ([(None, 1, "error", "2024-01-05"), ("2024-01-10", 2, "ok", None)], {}, "2024-01-07"),
        ([(None, 1, "empty", None)], {}, "2023-12-01"),
        ([("2024-03-10", 1, "ok", None)], {}, "2024-01-31"),
        ([("2024-01-20", 1, "ok", None), (None, 2, "ok", None)], {}, "2023-12-01"),
    ],
)
def test_five_ways_to_a_first_day(spark, runs, more, since):
    log = spark.createDataFrame([("t", *r) for r in runs], RUNS)
    full = spark.createDataFrame([("t",)], "tool string") if more.pop("full", False) else None
    assert devices.sync_since(log, first="2023-12-01", lookback=3, as_of="2024-01-31", full=full, **more).first().since == since


def test_runs_are_logged(spark):
    log = spark.createDataFrame([(t, "2024-01-10", 1, "ok", None) for t in "abcd"], RUNS)
    schema = "tool string, run_id long, since string, rows long, newest string, empty_scopes long, error string"
    out = devices.ran(log, spark.createDataFrame([("a", 2, "2024-01-07", 5, "2024-01-09", 0, None), ("b", 2, "2024-01-07", 5, "2024-01-12", 1, None), ("c", 2, "2024-01-07", 0, None, 3, None), ("d", 2, "2024-01-07", None, None, None, "timeout"), ("e", 2, "2023-12-01", 1, "2024-01-02", 0, None)], schema))
    got = {r.tool: (r.status, r.date, r.retry_since) for r in out.where("run_id = 2").collect()}
    assert got == {"a": ("ok", "2024-01-10", None), "b": ("partial", "2024-01-12", None), "c": ("empty", None, None), "d": ("error", None, "2024-01-07"), "e": ("ok", "2024-01-02", None)}
    since = {r.tool: r.since for r in devices.sync_since(out, first="2023-12-01", lookback=3, as_of="2024-01-31").collect()}
    assert since == {"a": "2024-01-07", "b": "2024-01-09", "c": "2024-01-07", "d": "2024-01-07", "e": "2023-12-30"}


@pytest.mark.parametrize(
    "success,full,version,floor,window",
    [
        (None, None, 3, None, ("full", None)),
        ("2024-01-20 10:00:00", None, 3, None, ("full", None)),
        ("2024-01-20 10:00:00", "2024-01-18 00:00:00", 2, None, ("full", None)),
        ("2024-01-20 10:00:00", "2024-01-18 00:00:00", None, None, ("full", None)),
        ("2024-01-20 10:00:00", "2024-01-13 00:00:00", 3, None, ("full", None)),
        ("2024-01-20 10:00:00", "2024-01-18 00:00:00", 3, None, ("incremental", "2024-01-19")),
        ("2024-01-20 15:00:00", "2024-01-18 00:00:00", 3, None, ("incremental", "2024-01-20")),
        ("2024-01-20 10:00:00", "2024-01-18 00:00:00", 3, "2024-01-25", ("incremental", "2024-01-25")),
        (None, None, 3, "2024-01-25", ("full", "2024-01-25")),
    ],
)
def test_upload_windows(spark, success, full, version, floor, window):
    at = lambda s: s and dt.datetime.fromisoformat(s)
    cursors = spark.createDataFrame([(at(success), at(full), version)], "last_success timestamp_ntz, last_full timestamp_ntz, parser_version int")
    out = devices.upload_window(cursors, F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"), 3, floor).first()
    assert (out.mode, out.since) == window


def packed(rows, most):
    """One person's batches by a plain loop over whole sessions."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1:3], []).append(r)
    batches, held = [], []
    for g in groups.values():
        if held and len(held) + len(g) > most:
            batches.append(held)
            held = []
        held = held + g
        if len(held) >= most:
            batches.append(held)
            held = []
    return batches + [held] * bool(held)


@pytest.mark.parametrize("most", [1, 4, 9, 1000])
def test_sessions_are_packed_whole(spark, most):
    r = random.Random(most)
    rows = [(f"u{r.randrange(3)}", r.choice("tw"), f"s{int(r.random() ** 2 * 9)}", i) for i in range(150)]
    out = devices.packed_sessions(spark.createDataFrame(rows, "external_id string, tool string, session_id string, arrival long"), most).collect()
    assert len(out) == len(rows)
    for u in {x[0] for x in rows}:
        want = [sorted(b) for b in packed([x for x in rows if x[0] == u], most)]
        mine = [x for x in out if x.external_id == u]
        assert [sorted((x.external_id, x.tool, x.session_id, x.arrival) for x in mine if x.batch == b + 1) for b in range(max(x.batch for x in mine))] == want


def test_identities_link_facts(spark):
    facts = spark.createDataFrame([("t", "A@x", None, 1), ("t", "b@x", None, 2), ("w", "a@x", None, 3), ("t", "A@x", 9, 4), ("w", "zz", None, 5)], "tool string, external_id string, member_id long, n int")
    known = spark.createDataFrame([("t", "A@x", 5), ("t", "A@x", 6), ("t", "b@x", None)], "tool string, external_id string, member_id long")
    people = spark.createDataFrame([("a@X", 1), ("b@x", 2)], "email string, member_id long")
    of = lambda df: {r.n: r.member_id for r in df.collect()}
    assert of(merge.linked(facts, known)) == {1: 5, 2: None, 3: None, 4: 9, 5: None}
    assert of(merge.linked(facts, known, people)) == {1: 5, 2: 2, 3: 1, 4: 9, 5: None}
    later = known.unionByName(spark.createDataFrame([("w", "zz", 7)], known.schema))
    assert of(merge.linked(merge.linked(facts, known), later)) == {1: 5, 2: None, 3: None, 4: 9, 5: 7}  # linked again when more is registered
