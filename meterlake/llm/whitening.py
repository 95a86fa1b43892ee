"""Whitening of vectors from an exact scatter matrix by residue numbers.

Entries are whole numbers ``x``. One pass gives the number of vectors ``n`` and the
sums ``S``; the second takes ``y = n*x - S``, which is centred without rounding, and
its scatter modulo several primes below 2**20. A modular product of at most 2**15
rows is a product of doubles that loses nothing, since residues lie within half a prime
of zero. Sums of residues over all partitions are put together by Chinese remaindering
to the exact scatter of ``y``; there are as many primes as its bound asks for.
``eigh`` in doubles then gives the components. Only sums of the size of the matrix
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, whole_vectors

#: Residues are below this; ROWS products of two of them, halved, stay exact in a double.
PRIME = 2**20
ROWS = 2**15


def primes(bound: int) -> list[int]:
    """The largest primes below PRIME, as many as tell apart all numbers from -bound to bound."""
    out, product, p = [], 1, PRIME
    while product <= 2 * bound:
        p -= 1
        while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        out.append(p)
        product *= p
    return out


def remainder(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to zero that has these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def _sums(rows: DataFrame) -> list:
    """For each position: how many vectors have it, the exact sum (in two parts), least and largest; at -1 the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, vectors = np.zeros(0, np.int64), 0
        high, low, least, most = n, n, n, n
        for b in batches:
            lists = b.column("x")
            x, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            d, vectors = int(size.max(initial=0)), vectors + len(size)
            if d > len(n):
                grow = lambda a, fill=0: np.concatenate([a, np.full(d - len(a), fill, np.int64)])
                n, high, low, least, most = grow(n), grow(high), grow(low), grow(least, 2**62), grow(most, -(2**62))
            np.add.at(n, at, 1)
            np.add.at(high, at, x >> 31)
            np.add.at(low, at, x & (2**31 - 1))
            np.minimum.at(least, at, x)
            np.maximum.at(most, at, x)
        whole = [np.append(a, v) for a, v in ((np.arange(len(n)), -1), (n, vectors), (high, 0), (low, 0), (least, 0), (most, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in whole], ["at", "n", "high", "low", "least", "most"])

    parts = rows.select("x").mapInArrow(run, "at long, n long, high long, low long, least long, most long")
    return parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()


def _triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _scatter(rows: DataFrame, n: int, total: list[int], bound: int) -> list[list[int]]:
    """The exact scatter of ``n*x - S``."""
    d, moduli = len(total), primes(bound)
    pair = _triangle(d)
    names = [f"r{i}" for i in range(len(moduli))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((d, d), np.int64) for _ in moduli]
        for b in batches:
            whole = matrix(b.column("x"), d)
            for i in range(0, len(whole), ROWS):
                for k, p in enumerate(moduli):
                    y = ((whole[i : i + ROWS] % p) * (n % p) - np.array([s % p for s in total], np.int64)) % p
                    y = np.where(y > p // 2, y - p, y).astype(float)
                    sums[k] = (sums[k] + (y.T @ y).astype(np.int64)) % p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pair[0]))), *[pa.array(s[pair]) for s in sums]], ["cell", *names])

    parts = rows.select("x").mapInArrow(run, "cell long, " + ", ".join(f"{c} long" for c in names))
    out = [[0] * d for _ in range(d)]
    for r in parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).collect():
        i, j = int(pair[0][r["cell"]]), int(pair[1][r["cell"]])
        out[i][j] = out[j][i] = remainder([int(r[c]) % p for c, p in zip(names, moduli)], moduli)
    return out


def _centred(x: np.ndarray, n: int, total: list[int], fits: bool) -> np.ndarray:
    """``n*x - S``, in Python's numbers where longs are too short."""
    return x * n - np.array(total, np.int64) if fits else x.astype(object) * n - np.array(total, object)


def _identity_error(rows: DataFrame, n: int, project) -> float | None:
    """The largest entry of the covariance of whitened rows, less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = 0.0, 0.0
        for b in batches:
            w = project(b.column("x"))[1]
            first, second = first + w.sum(0), second + w.T @ w
        if np.ndim(second):
            sums = np.concatenate([first, second[_triangle(len(first))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["cell", "v"])

    got = rows.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    m = int(((8 * len(got) + 9) ** 0.5 - 3) / 2 + 0.5)  # m sums and m*(m+1)/2 products
    if not m:
        return None
    v = np.array([r["v"] for r in got]) / n
    i, j = _triangle(m)
    return float(np.abs(v[m:] - v[i] * v[j] - (i == j)).max())


def whiten(vectors: DataFrame, *, scale: int = 64, offset: int = 1_000_000, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows ``vec_id, component, n, deviation, whitened, explained, identity_error``, one per vector and component.

    ``x`` is ``floor(scale*c) + offset``. ``deviation`` (a decimal, exact) is the sum of
    ``(n*x - S)**2`` over the dimensions; ``explained`` the component's share of the
    variance; ``identity_error`` how far the whitened rows' covariance is from the
    identity. A null vector, or one with an entry that is null, not finite or
    over 2**62 after scaling, has no rows. A shorter vector counts as followed by zeros, an
    empty one too while any other has entries; repeated rows and null ids count as any
    other. A component without variance (fewer vectors than components, a constant
    dimension) has a null ``whitened`` and is left out of ``identity_error``; where there
    is none with variance, ``explained`` and ``identity_error`` are null. No valid
    vector, or only empty ones: no rows.
    """
    rows = whole_vectors(vectors, scale, bits=62, offset=offset, embedding=embedding, vec_id=F.col(vec_id))
    sums = _sums(rows)
    n, sums = int(sums[0]["n"]) if sums else 0, sums[1:]
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), w array<double>"
    if not sums:
        none = rows.sparkSession.createDataFrame([], schema)
        return none.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    d = len(sums)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(d) - F.size("x"))))
    pad = lambda r: n - int(r["n"])
    total = [(int(r["high"]) << 31) + int(r["low"]) + pad(r) * offset for r in sums]
    ends = [[int(r["least"]), int(r["most"])] + [offset] * (pad(r) > 0) for r in sums]
    most = max(abs(n * x - s) for xs, s in zip(ends, total) for x in xs)
    fits = max(n * max(abs(x) for x in xs) + abs(s) for xs, s in zip(ends, total)) < 2**62
    short = fits and d * most * most < 2**63

    scatter = _scatter(rows, n, total, max(1, n * most * most))
    covariance = np.array([[v / n**3 for v in row] for row in scatter])
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:components]
    trace = sum(scatter[i][i] for i in range(d)) / n**3
    value, vector = value[order], vector[:, order]
    vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    alive = value > d * np.finfo(float).eps * max(value[0], 0)
    onto = vector[:, alive] / np.sqrt(value[alive]) / n

    def project(column) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(matrix(column, d), n, total, fits)
        return y, y.astype(float) @ onto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, w = project(b.column("x"))
            far = (y * y).sum(1) if short else [sum(int(v) ** 2 for v in row) for row in y]
            out = np.full((len(y), len(order)), np.nan)
            out[:, alive] = w
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * len(order), pa.array(out.reshape(-1), from_pandas=True))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, lists], ["vec_id", "deviation", "w"])

    error = _identity_error(rows, n, project)
    share = [float(max(v, 0) / trace) if trace else None for v in value]
    flat = rows.mapInArrow(run, schema).select("vec_id", "deviation", F.posexplode("w").alias("component", "whitened"))
    return flat.select(
        "vec_id",
        (F.col("component") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("component") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
