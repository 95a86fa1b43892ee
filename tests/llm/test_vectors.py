"""Whitening, hard negatives and exact top-k search against plain versions, odd rows included."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import hard_negatives as mining
from meterlake.llm import queries, top_products as search, whitening

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, x string, block int"  # the last two clash with names inside


def frame(spark, rows):
    doubles = lambda e: None if e is None else [None if v is None else float(v) for v in e]
    return spark.createDataFrame([(i, doubles(e), l, "t", 1) for i, e, l in rows], SCHEMA)


def odd_rows(seed, n=240, d=6):
    """Ties, copies, repeated rows, null ids and labels, short, empty, broken and zero vectors."""
    r = random.Random(seed)
    rows = [(i, [r.choice([-2.0, -0.5, 0.0, 0.25, 1.0, 3.0]) * r.random() for _ in range(d)], r.randrange(3)) for i in range(n)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.25, 1.0], i % 2) for i in range(60)]  # one common vector
    rows += [rows[0]] * 4 + [rows[100]] * 3 + [(50, [9.0] * d, 1)]  # repeated rows, an id with two vectors
    rows += [(None, [1.0, 0.5, 0.0, 0.0, 0.25, 1.0], 1), (None, [2.0] * d, 2), (2000, None, 0), (2050, [1.0, None, 0, 0, 0, 0.0], 1)]
    rows += [(2100, [math.nan] * d, 1), (2150, [math.inf] + [0.0] * (d - 1), 1), (2200, [0.0] * d, 1), (2250, [1.5, -1.0], 2), (2300, [], 0), (2350, [0.5] * d, None), (2400, [1e300] * d, 1)]
    return rows


def whole(e, scale, d):
    if e is None or any(v is None or not math.isfinite(v) or abs(v) > 1e6 for v in e):
        return None
    return [math.floor(scale * v) for v in e] + [0] * (d - len(e))


def dot(a, b):
    return sum(p * q for p, q in zip(a, b))


def tie(row):
    return (-row[1], row[0] is None, row[0] or 0)


def plain_top(rows, chosen, k, scale, d):
    valid = [(i, x) for i, e, _ in rows if (x := whole(e, scale, d)) is not None]
    out = []
    for q, x in {(i, tuple(x)) for i, x in valid if i is not None and chosen(i)}:
        best = sorted([(i, dot(x, y)) for i, y in valid if i != q], key=tie)[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(best)]
    return out


def plain_negatives(rows, chosen, scale, d, positives=5, negatives=3):
    valid = [(i, x, l) for i, e, l in rows if l is not None and (x := whole(e, scale, d)) is not None]
    out = []
    for a, x, label in {(i, tuple(x), l) for i, x, l in valid if i is not None and chosen(i)}:
        mine = sorted([(i, dot(x, y)) for i, y, l in valid if l == label and i != a], key=tie)[:positives]
        for p, s in mine:
            inside = [(i, t) for i, y, l in valid if l != label and 50 * s <= 100 * (t := dot(x, y)) <= 95 * s]
            out += [(a, p, n + 1, i, s, t) for n, (i, t) in enumerate(sorted(inside, key=tie)[:negatives])]
    return out


def listed(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("seed,each,many", [(1, 8192, 2048), (2, 16, 3)])
def test_top_products(spark, seed, each, many):
    rows = odd_rows(seed)
    got = search.top_products(frame(spark, rows), F.col("vec_id") % 50 == 0, 7, each=each, many=many)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert listed(got.collect()) == listed(plain_top(rows, lambda i: i % 50 == 0, 7, 1024, 6))


def test_top_products_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, -2.0], 0), (100, [0.0, 0.0], 1)]
    got = search.top_products(frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert listed(got.collect()) == listed(plain_top(rows, lambda i: i % 100 == 0, 10, 1024, 2))
    assert search.top_products(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert search.top_products(frame(spark, [(0, None, 1)]), F.col("vec_id") % 100 == 0).collect() == []
    assert search.top_products(frame(spark, [(1, [1.0], 1)]), F.col("vec_id") % 100 == 0).collect() == []
    assert listed(search.top_products(frame(spark, [(0, [], 1), (1, [], 0)]), F.col("vec_id") % 100 == 0).collect()) == ["(0, 1, 1, 0)"]


def test_coordinate_lists_lose_no_candidate():
    """Steep thresholds, where candidates come from sorted coordinates, against all products."""
    r = np.random.default_rng(5)
    middle = r.normal(size=(12, 8)) * 300
    x = np.floor(np.concatenate([middle[r.integers(12, size=600)] + r.normal(size=(600, 8)) * 8, np.zeros((2, 8)), -middle, np.eye(8) * 512])).astype(np.int64)
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    bucket, steep = search.Bucket(x, norm), 0
    for q, n in zip(x[::7], norm[::7]):
        score = bucket.x @ q
        for least in np.sort(score)[-40::6]:
            got = set(bucket.candidates(q, n, int(least)).tolist())
            assert set(np.nonzero(score >= least)[0].tolist()) <= got
            steep += len(got) < 200
    assert steep > 100


@pytest.mark.parametrize("seed,cells,each,many", [(1, 64, 8192, 2048), (2, 4, 16, 3), (3, 256, 40, 2)])
def test_hard_negatives(spark, seed, cells, each, many):
    rows = odd_rows(seed)
    got = mining.hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0, cells=cells, each=each, many=many)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda i: i % 25 == 0, 256, 6)
    assert len(want) > 50 and listed(got.collect()) == listed(want)


def test_hard_negatives_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.5], 0), (2, [0.9, 0.0], 1), (3, [0.5, 0.0], 1), (4, [0.4, 0.0], 1), (50, [-1.0, 0.0], 7)]
    got = mining.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert listed(got.collect()) == listed(plain_negatives(rows, lambda i: i % 50 == 0, 256, 2)) != []
    for few in ([], [(0, None, 1)], [(0, [1.0], None)], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1)]):
        assert mining.hard_negatives(frame(spark, few), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_hold_every_score():
    r = np.random.default_rng(3)
    x = r.integers(-90, 90, (300, 5)) * r.integers(0, 2, (300, 5))
    for cells in (2, 7, 64):
        edges = [list(np.quantile(x[:, j], np.arange(1, cells) / cells, method="inverted_cdf").astype(int)) for j in range(5)]
        c = mining.Cells(edges, [(x[:, j].min(), x[:, j].max()) for j in range(5)])
        low, high = c.bounds(x[:50], c.codes(x))
        score = x[:50] @ x.T
        assert (low <= score).all() and (score <= high).all()
        assert (high - low).mean() < (score.max() - score.min()) * 4 / cells


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_top_products"])
def test_rows_by_brute_force(spark, name):
    rows = [(r.vec_id, [float(v) for v in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    want = plain_top(rows, lambda i: i % 100 == 0, 10, 1024, 64) if name.startswith("op13") else plain_negatives(rows, lambda i: i % 50 == 0, 256, 64)
    assert listed(queries.QUERIES[name](spark, D).collect()) == listed(want) != []


# Whitening


def exact_scatter(xs):
    n, d = len(xs), len(xs[0])
    total = [sum(x[j] for x in xs) for j in range(d)]
    y = [[n * x[j] - total[j] for j in range(d)] for x in xs]
    return n, total, y, [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]


def test_remainders_give_back_numbers():
    for bound in (1, 10**6, 10**18, 10**40):
        ps = whitening.primes(bound)
        assert len(set(ps)) == len(ps) and all(p < 2**20 for p in ps) and math.prod(ps) > 2 * bound
        for v in (0, 1, -1, bound, -bound, bound // 3, -bound // 7):
            assert whitening.remainder([v % p for p in ps], ps) == v


@pytest.mark.parametrize("scale,size", [(64, 1.0), (64, 3e9), (64, 2e14)])
def test_scatter_is_exact(spark, scale, size):
    """Entries so large that doubles, and then longs, can't hold what is summed."""
    r = random.Random(4)
    vectors = [[r.uniform(-size, size) for _ in range(4)] for _ in range(57)]
    xs = [[math.floor(scale * v) + 1_000_000 for v in e] for e in vectors]
    n, total, y, want = exact_scatter(xs)
    rows = whitening.whole_vectors(frame(spark, [(i, e, 0) for i, e in enumerate(vectors)]).repartition(5), scale, bits=62, offset=1_000_000)
    bound = n * max(abs(v) for row in y for v in row) ** 2
    assert whitening._scatter(rows, n, total, bound) == want
    out = whitening.whiten(frame(spark, [(i, e, 0) for i, e in enumerate(vectors)])).collect()
    far = {i: sum(v * v for v in row) for i, row in enumerate(y)}
    assert all((r.deviation is None) == (far[r.vec_id] >= 10**38) and (r.deviation is None or int(r.deviation) == far[r.vec_id]) for r in out)
    assert max(r.identity_error for r in out) < 1e-6


def test_whitened_rows(spark):
    r = random.Random(9)
    valid = [(i, [r.gauss(0, 0.2 * (j + 1)) for j in range(5)], 0) for i in range(200)]
    valid += [valid[3]] * 5 + [(None, [0.5] * 5, 1), (300, [0.25, 1.0], 1), (301, [], 1)] + [(400 + i, [1.0, 0, 0, 1.0, 2.0], 2) for i in range(60)]
    broken = [(500, None, 0), (501, [1.0, None, 0, 0, 0.0], 0), (502, [math.nan] * 5, 0), (503, [-math.inf] * 5, 0)]
    out = whitening.whiten(frame(spark, valid + broken), components=3).collect()
    xs = [[math.floor(64 * v) + 1_000_000 for v in e + [0.0] * (5 - len(e))] for _, e, _ in valid]
    n, total, y, scatter = exact_scatter(xs)
    assert len(out) == 3 * n and {r.n for r in out} == {n} and {r.component for r in out} == {1, 2, 3}
    value, vector = np.linalg.eigh(np.array([[float(Fraction(v, n**3)) for v in row] for row in scatter]))
    value, vector = value[::-1], vector[:, ::-1]
    w = np.array([[float(Fraction(v, n)) for v in row] for row in y]) @ vector[:, :3] / np.sqrt(value[:3])
    for c in (1, 2, 3):
        mine = [r for r in out if r.component == c]
        assert all(abs(r.explained - value[c - 1] / value.sum()) < 1e-12 for r in mine)
        key = lambda rows: sorted((str(i), int(f)) for i, f in rows)
        assert key((r.vec_id, r.deviation) for r in mine) == key((v[0], sum(t * t for t in row)) for v, row in zip(valid, y))
        got, want = (sorted((str(i), round(s * v, 7) + 0.0) for i, v in rows) for s, rows in ((1, [(r.vec_id, r.whitened) for r in mine]), (1, [(v[0], t) for v, t in zip(valid, w[:, c - 1])])))
        flipped = sorted((i, round(-v, 7) + 0.0) for i, v in want)
        close = lambda a, b: all(i == j and abs(p - q) < 1e-6 for (i, p), (j, q) in zip(a, b))
        assert close(got, want) or close(got, flipped)


def test_whitening_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 0), (2, [], 0)])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(1, None, None, None, 0), (2, None, None, None, 0)]
    flat = whitening.whiten(frame(spark, [(1, [1.0, 5.0], 0), (2, [-1.0, 5.0], 0)])).collect()
    assert sorted((r.vec_id, r.component, r.whitened and abs(r.whitened), r.explained) for r in flat) == [(1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]
    assert all(r.identity_error < 1e-12 for r in flat)


def test_op11(spark):
    out = queries.op11_whitening(spark, D).collect()
    e = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r.embedding for r in e], float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    far = dict(zip([r.vec_id for r in e], ((n * x - total) ** 2).sum(1).tolist()))
    assert len(out) == 32 * n and all(r.deviation == far[r.vec_id] for r in out) and all(r.identity_error < 1e-9 for r in out)
    w = np.zeros((n, 32))
    place = {r.vec_id: i for i, r in enumerate(e)}
    for r in out:
        w[place[r.vec_id], r.component - 1] = r.whitened
    y = x - total / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    want = y @ vector[:, ::-1][:, :32] / np.sqrt(value[::-1][:32])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-6
    share = {r.component: r.explained for r in out}
    assert all(abs(share[c + 1] / (value[::-1][c] / value.sum()) - 1) < 1e-9 for c in range(32))
