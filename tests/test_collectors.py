"""Collectors of ledger records on literal lines, good and bad."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from meterlake.operators import ledger
from meterlake.sources import collectors

AT = "2024-01-10T03:00:00.000Z"


def sha(*x):
    return hashlib.sha256((json.dumps(list(x), separators=(",", ":")) if len(x) > 1 else x[0]).encode()).hexdigest()


def lines(spark, files):
    rows = [(f, (0, i), v if isinstance(v, str) else json.dumps(v)) for f, values in files.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file string, pos struct<at:long,id:long>, value string")


def run(spark, tool, files, account="acct"):
    records, refused, health = collectors.collect(tool, lines(spark, files) if isinstance(files, dict) else files, account)
    assert records.columns == collectors.RECORD
    return sorted(records.collect(), key=lambda r: (r.occurred_at, r.record_id, r.completeness)), sorted((r.file, r.reason) for r in refused.collect()), health.first()


def assistant(i, request="q", at=AT, stop=None, model="claude-opus-5", uuid=None, **usage):
    return {"type": "assistant", "timestamp": at, "requestId": request, "uuid": uuid, "message": {"id": i, "model": model, "stop_reason": stop, "usage": {"input_tokens": 5, "output_tokens": 7} | usage}}


def test_claude(spark):
    good = assistant("m1", stop="end", cache_read_input_tokens=3)
    files = {
        "a.jsonl": [good, assistant("m1"), "{broken", "[1, 2]", {"type": "user"}, assistant("m2", model="<synthetic>"), assistant("m3", at="soon"), ""],
        "b.jsonl": [good, assistant("m4", request=None, uuid="u", input_tokens=-2, output_tokens="9")],
    }
    records, refused, health = run(spark, "claude_code", files)
    assert refused == [("a.jsonl", "no instant"), ("a.jsonl", "not json")]
    assert (health.parser, health.account_id, health.namespace_configured, health.files, health.lines, health.unrecognized, health.records) == ("claude_code", "acct", True, 2, 10, 2, 3)
    by = {(r.record_id, r.completeness): r for r in records}
    one = "native:" + sha("m1", "q")
    final, partial, odd = by[one, "final"], by[one, "partial"], by["unverified:" + sha("u"), "partial"]
    assert (final.session_id, final.kind, final.revision, final.input_tokens, final.cache_read_tokens, final.cache_creation_tokens, final.requests, final.identity_quality) == (f"event:{one}", "event", 1704855600000, 5, 3, None, 1, "native")
    assert (final.ev_cache_read_tokens, final.ev_cache_creation_tokens, partial.ev_cache_read_tokens) == ("known", "unknown", "unknown")
    assert (odd.input_tokens, odd.output_tokens, odd.requests, odd.identity_quality) == (None, None, None, "unverified")


def test_codex(spark):
    count = lambda i, c, o, at=AT: {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    session = "0a1b2c3d-0000-1111-2222-333344445555"
    turn = {"type": "turn_context", "payload": {"model": "gpt-5.5"}}
    files = {f"/x/rollout-2024-{session}.jsonl": [count(9, 0, 1, "2024-01-10T01:00:00Z"), turn, count(100, 20, 10), count(100, 20, 10), {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, count(1, 1, 1, None)], "/y/rollout-old.jsonl": [count(4, 0, 0)]}
    records, refused, health = run(spark, "codex", files)
    assert [(r.session_id, r.model, r.input_tokens, r.cache_read_tokens, r.kind, r.identity_quality, r.completeness) for r in records] in (
        [(session, "unknown", 9, 0, "cumulative", "derived", "partial"), *x] for x in ([(session, "gpt-5.5", 100, 20, "cumulative", "derived", "partial"), ("rollout-old", "unknown", 4, 0, "cumulative", "derived", "partial")], [("rollout-old", "unknown", 4, 0, "cumulative", "derived", "partial"), (session, "gpt-5.5", 100, 20, "cumulative", "derived", "partial")])
    )
    assert {r.record_id for r in records} == {"snapshot:" + sha(session, AT), "snapshot:" + sha(session, "2024-01-10T01:00:00.000Z"), "snapshot:" + sha("rollout-old", AT)}
    assert all((r.ev_cache_creation_tokens, r.ev_requests, r.requests) == ("unsupported", "unsupported", None) for r in records)
    assert refused == [(f"/x/rollout-2024-{session}.jsonl", "no instant")] and health.records == 3


def test_gemini(spark):
    m = lambda i=None, at=AT, **x: {"type": "gemini", "timestamp": at, "id": i, "model": "gemini-3", "tokens": {"input": 10, "output": 2, "thoughts": 3, "cached": 1}} | x
    files = {"/g/session-1.jsonl": [{"sessionId": "S"}, m("i1"), m("i1", finishReason="stop"), m(), m(at=""), m(tokens={"input": 1, "output": 4, "model": "inner"}, model="")], "/g/session-2.jsonl": [m("i2", completed=True)]}
    records, refused, _ = run(spark, "gemini", files)
    one, two = "session:" + sha("S"), "session:" + sha("session-2")
    got = {(r.record_id, r.completeness): r for r in records}
    assert set(got) == {("native:" + sha("i1"), "partial"), ("native:" + sha("i1"), "final"), (f"{one}:snapshot:3", "partial"), (f"{one}:snapshot:4", "partial"), ("native:" + sha("i2"), "final")}
    first, last = got["native:" + sha("i1"), "partial"], got[f"{one}:snapshot:4", "partial"]
    assert (first.session_id, first.output_tokens, first.identity_quality, first.kind) == (one, 5, "native", "cumulative")
    assert (last.output_tokens, last.ev_output_tokens, last.model, last.identity_quality) == (None, "unknown", "inner", "unverified")
    assert (got["native:" + sha("i2"), "final"].session_id, got["native:" + sha("i2"), "final"].identity_quality) == (two, "unverified") and refused == [("/g/session-1.jsonl", "no instant")]


def test_grok(spark):
    files = {"g.jsonl": [{"ts": 1704855600, "id": "c", "session_id": "s", "model": "grok-4", "prompt_tokens": 5, "completion_tokens": 6}, "nope", {"ts": 1704855600500, "prompt_tokens": 1}, {"ts": None}, {"ts": 1704855600.0001}, {"ts": "x"}]}
    records, refused, health = run(spark, "grok", files)
    a, b = records
    assert (a.record_id, a.session_id, a.revision, a.requests, a.ev_requests, a.ev_cache_read_tokens) == ("native:" + sha("c"), "session:" + sha("s"), 1704855600000, 1, "known", "unsupported")
    assert (b.record_id, b.session_id, b.revision, b.requests, b.ev_requests, b.model, b.ev_output_tokens) == ("unverified:line:2", "unverified:day:2024-01-10", 1704855600500, None, "unsupported", "unknown", "unknown")
    assert [x for _, x in refused] == ["no instant", "no instant", "no instant", "not json"] and health.unrecognized == 4


def test_opencode(spark):
    data = lambda **x: json.dumps({"role": "assistant", "modelID": "m", "providerID": "p", "time": {"created": 1704855600000, "completed": 1704855601000}, "tokens": {"input": 4, "output": 2, "reasoning": 1, "cache": {"read": 8, "write": 9}}} | x)
    rows = [("a", "s", 1, 77, data()), ("b", "s", 1704855600000, None, data(time={}, tokens={"input": 3})), ("c", "s", 1, 1, data(role="user")), ("d", "s", 1, 1, data(tokens={})), ("e", "", 1, 1, data()), ("f", "s", 1, 1, "{")]
    table = spark.createDataFrame(rows, "id string, session_id string, time_created long, time_updated long, data string")
    records, refused, health = run(spark, "opencode", table)
    by = {r.record_id: r for r in records}
    a, b = by["native:" + sha("a")], by["native:" + sha("b")]
    assert (a.revision, a.completeness, a.provider, a.output_tokens, a.cache_creation_tokens, a.requests) == (77, "final", "p", 3, 9, 1)
    assert (b.revision, b.completeness, b.output_tokens, b.ev_output_tokens) == (1704855600000, "partial", None, "unknown")
    assert sorted(x for _, x in refused) == ["no instant", "not json"] and health.records == 2


def test_accounts(spark):
    records, _, health = run(spark, "claude_code", {"a": [assistant("m", stop="end")]}, None)
    assert (records[0].account_id, records[0].identity_quality, health.namespace_configured) == (collectors.NO_ACCOUNT, "unverified", False)
    with pytest.raises(ValueError, match="namespace"):
        collectors.collect("grok", lines(spark, {"a": ["x"]}), "a b")


@pytest.mark.parametrize("tool", sorted(set(collectors.COLLECTORS) - {"opencode"}))
def test_nothing_to_read(spark, tool):
    records, refused, health = run(spark, tool, lines(spark, {"a": [""]}).where("false"))
    assert (records, refused, health.files, health.records) == ([], [], 0, 0)


def test_records_go_into_the_ledger(spark):
    """A partial and a final version of one message: the ledger takes the final one."""
    records = collectors.collect("claude_code", lines(spark, {"a": [assistant("m", stop="end", output_tokens=9), assistant("m")]}), "acct")[0]
    order = F.when(F.col("completeness") == "partial", 1).otherwise(2)
    decided = ledger.classify(records.withColumn("member_id", F.lit(1)).withColumn("arrival", order.cast("long"))).orderBy("arrival").collect()
    assert [r.decision for r in decided] == ["stored", "stored"]
