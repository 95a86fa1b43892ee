"""Streams: sessions merged and days derived anew, against a plain fold of the same batches."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.streaming import ingest, sessions

COLS = "external_id string, tool string, session_id string, hour string, model string, parser_version int, machine_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, requests long, arrival long"
VALUES = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "requests")


def batches(seed, n=4, rows=25):
    """Sessions that cross midnight, sent again by newer parsers that drop or rename buckets, and late by older ones."""
    r = random.Random(seed)
    out, arrival = [], 0
    for b in range(n):
        batch = []
        for _ in range(rows):
            arrival += 1
            day, hour = r.choice([(1, 22), (1, 23), (2, 0), (2, 1), (3, 5)])
            v = lambda: r.choice([None, 0, r.randrange(100)])
            batch.append((r.choice("uv"), r.choice(["t", "w"]), f"s{r.randrange(3)}", f"2024-01-0{day}T{hour:02d}", r.choice("ab"), 1 + r.randrange(b + 1), r.choice(["", "d", "e"]), v(), v(), v(), v(), 1, arrival))
        out.append(batch)
    return out


def folded(all_batches):
    """The same by a plain loop: a batch's rows in order of arrival, newer parses first dropping what they lack."""
    key = lambda x: x[:5]
    def into(kept, x):
        was = kept.get(key(x))
        if was is None or x[5] > was[0]:
            kept[key(x)] = [x[5], list(x[7:12]), ({x[6]} | (was[2] if was else set())) - {""}]
        elif x[5] == was[0]:
            was[1] = [b if a is None else a if b is None else max(a, b) for a, b in zip(was[1], x[7:12])]
            was[2] |= {x[6]} - {""}
    state = {}
    for batch in all_batches:
        own = {}
        for x in sorted(batch, key=lambda x: x[12]):
            into(own, x)
        newest = {}
        for k, v in own.items():
            top, since = newest.get(k[:3], (0, "9"))
            newest[k[:3]] = (max(top, v[0]), min(since, k[3]))
        for k in [k for k, v in state.items() if k[:3] in newest and v[0] < newest[k[:3]][0] and k[3] >= newest[k[:3]][1] and k not in own]:
            del state[k]
        for x in sorted(batch, key=lambda x: x[12]):
            into(state, x)
    return state


def told(state):
    """Days and hours of a state."""
    days, hours, ids = {}, {}, {}
    for (u, t, s, h, m), (_, v, _) in state.items():
        for table, k in ((days, (u, t, h[:10], m)), (hours, (u, t, h, m))):
            was = table.get(k, [None] * 5)
            table[k] = [b if a is None else a if b is None else a + b for a, b in zip(was, v)]
        ids.setdefault((u, t, h[:10]), set()).add(s)
    first = {}
    for k in sorted(days):
        first.setdefault(k[:3], k)
    return {k: [*v, len(ids[k[:3]]) if first[k[:3]] == k else None] for k, v in days.items()}, hours


def read(spark, root):
    t = lambda name: spark.read.parquet(f"{root}/{name}")
    state = {tuple(r[c] for c in ("external_id", "tool", "session_id", "hour", "model")): [r.parser_version, [r[c] for c in VALUES], set(r.machine_ids)] for r in t("sessions").collect()}
    days = {(r.external_id, r.tool, r.date, r.model): [*(r[c] for c in VALUES), r.sessions] for r in t("daily").collect()}
    hours = {(r.external_id, r.tool, r.hour, r.model): [r[c] for c in VALUES] for r in t("hourly").collect()}
    return state, days, hours


@pytest.mark.parametrize("seed", [1, 2])
def test_touched_days_are_derived_anew(spark, tmp_path, seed):
    root, taken = str(tmp_path / "root"), []
    for b in batches(seed):
        frame = spark.createDataFrame(b, COLS)
        sessions.apply_batch(spark, frame, root)
        taken.append(b)
        want = folded(taken)
        for _ in range(2 if len(taken) == 3 else 1):  # once the batch comes again
            state, days, hours = read(spark, root)
            assert state == want and (days, hours) == told(want)
            sessions.apply_batch(spark, frame, root) if len(taken) == 3 else None


def test_a_newer_parse_empties_a_day(spark, tmp_path):
    """The day that loses its last bucket has no row and no folder left, and the batch had no row of it."""
    root = str(tmp_path / "root")
    row = lambda hour, v, n, a, model="m": ("u", "t", "s", hour, model, v, "d", n, 1, None, None, 1, a)
    sessions.apply_batch(spark, spark.createDataFrame([row("2024-01-01T23", 1, 5, 1), row("2024-01-02T00", 1, 7, 2)], COLS), root)
    assert {r.date for r in spark.read.parquet(f"{root}/daily").collect()} == {"2024-01-01", "2024-01-02"}
    sessions.apply_batch(spark, spark.createDataFrame([row("2024-01-01T23", 2, 6, 3, "renamed")], COLS), root)
    left = spark.read.parquet(f"{root}/daily").collect()
    assert [(r.date, r.model, r.input_tokens, r.sessions) for r in left] == [("2024-01-01", "renamed", 6, 1)]
    assert not ingest.exists(spark, f"{root}/sessions/tool=t/day=2024-01-02")


def test_only_touched_days_are_written(spark, tmp_path):
    root = str(tmp_path / "root")
    row = lambda day, a: ("u", "t", f"s{day}", f"2024-01-0{day}T10", "m", 1, "d", 5, 1, None, None, 1, a)
    sessions.apply_batch(spark, spark.createDataFrame([row(1, 1), row(2, 2)], COLS), root)
    files = lambda: {f for f in spark.read.parquet(f"{root}/daily").inputFiles() if "day=2024-01-01" in f}
    before = files()
    sessions.apply_batch(spark, spark.createDataFrame([row(2, 3)], COLS), root)
    assert before and files() == before
    sessions.apply_batch(spark, spark.createDataFrame([], COLS), root)
    assert files() == before


def test_stream_takes_each_landing_once(spark, tmp_path):
    land, root, mark = (str(tmp_path / x) for x in ("land", "root", "mark"))
    taken = []
    for b in batches(7, n=2):
        spark.createDataFrame(b, COLS).coalesce(1).write.mode("append").parquet(land)
        sessions.start(spark.readStream.schema(COLS).parquet(land), root, mark).awaitTermination()
        taken.append(b)
    sessions.start(spark.readStream.schema(COLS).parquet(land), root, mark).awaitTermination()
    state, days, hours = read(spark, root)
    want = folded(taken)
    assert state == want and (days, hours) == told(want)


def test_hourly_view(spark, tmp_path):
    """Hours behind the watermark are told; a row that comes later than it is left out."""
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    schema = "ts timestamp, tool string, input_tokens long, output_tokens long"
    def run(rows):
        frame = spark.createDataFrame(rows, "ts string, tool string, input_tokens long, output_tokens long").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(land)
        hours = ingest.hourly(spark.readStream.schema(schema).parquet(land))
        hours.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    run([("2024-01-01 10:05:00", "t", 5, 1), ("2024-01-01 10:50:00", "t", 7, 1)])
    run([("2024-01-01 14:00:00", "t", 1, 1)])
    run([("2024-01-01 10:55:00", "t", 100, 1), ("2024-01-01 18:00:00", "t", 1, 1)])
    got = sorted((str(r.hour), r.tool, r.input_tokens, r.output_tokens, r.requests) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 10:00:00", "t", 12, 2, 2), ("2024-01-01 14:00:00", "t", 1, 1, 1)]


RECORD_COLS = "member_id long, tool string, account_id string, record_id string, session_id string, kind string, occurred_at timestamp, model string, provider string, parser_version int, revision int, completeness string, identity_quality string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, ev_input_tokens string, ev_output_tokens string, ev_cache_read_tokens string, ev_cache_creation_tokens string, arrival long"


def arrivals(seed, n=260):
    """Versions of a few records that differ in a field or two, so that every rule has its turn."""
    import datetime as dt

    r = random.Random(seed)
    one = lambda *x: r.choice([x[0]] * 5 + list(x))
    out = []
    for i in range(n):
        values = [one(10, 12, 9, None), one(1, 2), one(0, 2**60 + 1), one(None, 4)]
        out.append((1, "t", "a", f"r{r.randrange(25)}", one("s", "z"), one("event", "cumulative"), dt.datetime(2024, 1, one(1, 2)), one("m", "unknown"), one("p", None), one(1, 2), one(1, 2), r.choice(["final", "partial", "partial"]), one("native", "guess"), *values, *["known" if v is not None and r.random() < 0.9 else "unknown" for v in values], i))
    return out


def test_streamed_decisions_are_those_of_the_batch(spark, tmp_path):
    from meterlake.operators import ledger
    from meterlake.streaming import records

    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    rows = arrivals(3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", records.PROVIDER)
    try:
        for part in (rows[:90], rows[90:200], rows[200:]):
            part = random.Random(1).sample(part, len(part))  # within a batch they come in any order
            spark.createDataFrame(part, RECORD_COLS).coalesce(1).write.mode("append").parquet(land)
            stream = records.classified(spark.readStream.schema(RECORD_COLS).parquet(land))
            stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out)
    want = {r.arrival: r.decision for r in ledger.classify(spark.createDataFrame(rows, RECORD_COLS)).collect()}
    assert {r.arrival: r.decision for r in got.collect()} == want and len(set(want.values())) > 10
    touched = {s: sum(want[x[-1]] in ("stored", "unchanged") for x in rows if x[4] == s) for s in "sz"}
    assert {r.session_id: r.generation for r in records.generations(got).collect()} == touched


def test_plain_rules_are_those_of_the_fold(spark):
    """Many random versions through both forms of the rules."""
    from meterlake.operators import ledger
    from meterlake.streaming import records

    rows = [x for seed in range(8) for x in [(seed, *a[1:]) for a in arrivals(seed, 400)]]
    names = [c.split()[0] for c in RECORD_COLS.split(", ")]
    kept, want = {}, {}
    for x in sorted(rows, key=lambda x: x[-1]):
        n = dict(zip(names, x))
        key = (n["member_id"], n["record_id"])
        want[n["member_id"], n["arrival"]], kept[key] = records.decide(kept.get(key), {f: n[f] for f in ledger.RECORD})
    got = {(r.member_id, r.arrival): r.decision for r in ledger.classify(spark.createDataFrame(rows, RECORD_COLS)).collect()}
    assert got == want
