"""The registered queries, whole, against plain versions over the smallest tables."""

import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import bpe, imatch, quality, queries

from test_operators import EDGES, plain_fingerprint, plain_layers, plain_secrets, roots, table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, D).collect()}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    out = rows(spark, "op2_bpe")
    assert out.keys() == docs.keys()
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert out[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_op3(spark, docs):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    size = {i: len(t.encode().split()) for i, t in docs.items()}
    out = rows(spark, "op3_mixing")
    whole = collections.Counter()
    for i in docs:
        whole[source[i]] += size[i]
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(whole.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * whole[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * whole[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for i, r in out.items():
        assert (r.size, r.source_size) == (size[i], whole[source[i]]) and r.target == pytest.approx(target[source[i]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[i]] += r.taken
    assert out.keys() == docs.keys() and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert {i: r.taken for i, r in rows(spark, "op3_mixing").items()} == {i: r.taken for i, r in out.items()}


def test_op4(spark, docs):
    out = rows(spark, "op4_lm_scores")
    lower = {i: t.encode().lower().split() + [b""] for i, t in docs.items()}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2}
    count = collections.Counter(w for i in train for w in lower[i])
    n, v = sum(count.values()), len(count)
    assert out.keys() == docs.keys()
    for i, r in out.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(lower[i]), sum(count[w] > 0 for w in lower[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in lower[i]))
        assert -1000 * r.n_tokens < r.score < 0
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _hash(numbers):
    """Spark's hash of an array of longs: each with the one before as its seed."""
    h = 42
    for x in numbers:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def plain_prints(texts, band=imatch.BAND):
    """Level, hashes at two densities, and the hash of all terms, of every text, the lexicon being that of ``texts`` values."""
    signed = lambda w: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)))[0]
    terms = lambda t: {signed(w) for w in t.lower().replace("\x0b", " ").split() if w}
    df = collections.Counter(x for t in texts.values() for x in terms(t))
    n = len(texts)
    known = {x for x, c in df.items() if n * math.exp(-band[1]) <= c <= n * math.exp(-band[0])}

    def one(text):
        own = terms(text)
        level = max(4, math.floor(math.log2(max(len(own), 1) / 2)))
        sides = []
        for which in (0, 1):
            parts = 2 ** (level + which)
            chosen = [sorted(x for x in own & known if x % parts == r) for r in range(16)]
            sides.append([_hash(c) if c else None for c in chosen])
        none = not any(h is not None for s in sides for h in s)
        return level, sides, (_hash(sorted(own)) if own else 0) if none else None

    return one


def plain_shown(p):
    level, sides, plain = p
    hexed = lambda h: "-" if h is None else f"{h & (1 << 64) - 1:X}".lower()
    return f"plain;{hexed(plain)}" if plain is not None else ";".join([str(level), *[",".join(map(hexed, s)) for s in sides]])


def plain_likeness(a, b):
    if a[2] is not None or b[2] is not None:
        return float(a[2] == b[2])
    pairs = {0: [(0, 0), (1, 1)], 1: [(1, 0)], -1: [(0, 1)]}.get(b[0] - a[0], [])
    both = [(x, y) for i, j in pairs for x, y in zip(a[1][i], b[1][j]) if x is not None or y is not None]
    return sum(x == y for x, y in both) / len(both) if both else 0.0


def test_op6(spark, docs):
    out = rows(spark, "op6_imatch")
    one, order = plain_prints(docs), sorted(docs)
    own = {i: one(t) for i, t in docs.items()}
    assert out.keys() == docs.keys() and sum(p[2] is None for p in own.values()) > len(docs) / 2
    for i, after in zip(order, order[1:] + order[:1]):
        k = len(docs[i]) // 4
        edited = docs[i][: len(docs[i]) - k] + docs[after][:k]
        r = out[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(docs[i]), sha(edited), plain_shown(own[i]), plain_shown(one(edited)))
        assert (r.near_edited, r.near_next) == (pytest.approx(plain_likeness(own[i], one(edited))), pytest.approx(plain_likeness(own[i], own[after])))


def test_op7(spark, docs):
    out, order = rows(spark, "op7_simhash"), sorted(docs)
    prints = [plain_fingerprint(docs[i]) for i in order]
    assert [out[i].fingerprint for i in order] == [f"{p:016x}" for p in prints]
    assert [out[i].component_id for i in order] == [order[r] for r in roots(prints, 3)]


def test_op8(spark, docs):
    out, first = rows(spark, "op8_suffix_dedup"), {}
    for i in sorted(docs):
        t = docs[i].encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) != i:
                gone[p : p + 50] = True
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == (len(t), int(gone.sum()), runs, sha(left))


def test_op9(spark, docs):
    out = rows(spark, "op9_secret_scan")
    assert out.keys() == docs.keys()
    for i, t in docs.items():
        base = plain_secrets(t)
        count = collections.Counter(kind for kind, _, _ in base)
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == (count["assign"], count["access"], count["hex"])
        assert out[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        if len(t) < 20_000 and "%" not in t:
            kinds = ("assign", "access", "hex")
            assert out[i].spans == ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in plain_layers(t))


def test_op10(spark, docs):
    """Scores from the model's dictionaries by hand; held-out labels and other columns don't move them."""
    import zstandard

    out = rows(spark, "op10_quality")
    assert {i: r.held_out for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    frame, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(frame, labels)
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(frame.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), other) == model
    pack = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for i, t in docs.items():
        raw = t.encode()
        good, bad = (sum(len(c.compress(raw[a : a + 512])) for a in range(0, len(raw), 512)) for c in pack)
        z = model.curve[0] + model.curve[1] * (bad - good) / max(good, bad, 1)
        assert out[i].score == pytest.approx(1 / (1 + math.exp(-z)))


def test_stages_on_odd_rows(spark, monkeypatch):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and an empty table, through every stage."""
    odd = table(spark, EDGES, {2: None, 5: None, 6: "z"})
    monkeypatch.setattr(corpus_pipeline.quality, "fit", lambda *a, **k: quality.Model(b"\0" * 8, b"\0" * 8, (1.0, 0.0)))
    monkeypatch.setattr(corpus_pipeline, "read", lambda *a: None)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, D)
        got = out.collect()
        assert stage(spark, odd.limit(0), D).count() == 0
        if name != "bpe":
            rest = lambda r: (r.lang, r.source, r.salt, r.digest, r.bits, r.part)
            assert out.columns == odd.columns and set(map(rest, got)) <= set(map(rest, odd.collect()))
        if name == "quality":
            assert len(got) == len(EDGES)  # a score of 0.73 throughout
        if name == "exact_dedup":
            assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t in EDGES})
        if name == "simhash":
            kept = collections.Counter((r.doc_id, r.text or "") for r in got)
            assert all(n <= EDGES.count((i, t)) + EDGES.count((i, None)) * (t == "") for (i, t), n in kept.items())
            assert {"b c d e", "b c d f", "other"} & {r.text for r in got} and any(not (r.text or "").strip() for r in got)
        if name == "bpe":
            codec = bpe.Codec(bpe.read_vocabulary(queries.vocabulary_path()))
            assert sorted((str(r.doc_id), r.ids_sha256) for r in got) == sorted((str(i), sha(codec.encode(t or ""))) for i, t in EDGES)
