"""Exact search for the largest inner products, by buckets of vectors of like length.

Vectors are grouped by length (their norm): ranges between sampled-over-all-rows
quantiles, each dealt into blocks of a bounded number of rows. Stated queries, in blocks as
well, meet a block of the longest vectors first; the k-th product found there is a
query's threshold. A range whose longest vector cannot reach it is not visited.
Inside a block the threshold, divided by the query's and the longest vector's
length, is the cosine that a vector must reach. Where that is steep, candidates come from
the sorted lists of the query's largest coordinates, between the bounds that the cosine
sets them; else they are those of the block that are long enough. Exact products in
whole numbers decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .vectors import by_id, first_of_equal, looked_up, matrix, numbers, parts_of, product_vectors, products

#: Ranges of length; each is cut into as many blocks as it needs.
RANGES = 64
#: From this cosine on candidates come from coordinates, FOCUS of them.
STEEP, FOCUS = 0.8, 3
#: Bounds in doubles give way by this much.
SLACK = 1e-9


class Bucket:
    """A block of vectors, the longest first, and its sorted coordinates, made when first asked for."""

    def __init__(self, x: np.ndarray, norm: np.ndarray):
        self.order = np.argsort(-norm, kind="stable")
        self.x, self.norm = x[self.order], norm[self.order]
        self.unit = self.x / np.maximum(self.norm, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j not in self.lists:
            order = np.argsort(self.unit[:, j], kind="stable")
            self.lists[j] = order, self.unit[order, j]
        return self.lists[j]

    def candidates(self, q: np.ndarray, length: float, least: float) -> np.ndarray:
        """Places of all vectors whose product with ``q`` may reach ``least``."""
        if least <= 0 or not length or not len(self.norm) or not self.norm[0]:
            return np.arange(len(self.norm) if least <= 0 else 0)
        enough = np.searchsorted(-self.norm, -(least / length) * (1 - SLACK), "right")
        cosine = least / (length * self.norm[0]) * (1 - SLACK)
        if cosine > 1 or not enough:
            return np.arange(0)
        if cosine < STEEP:
            return np.arange(enough)
        unit = q / length
        found = None
        for j in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            wide = np.sqrt(max(0.0, 1 - unit[j] ** 2) * max(0.0, 1 - cosine**2)) + SLACK
            low = -1.0 if -unit[j] >= cosine else unit[j] * cosine - wide
            high = 1.0 if unit[j] >= cosine else unit[j] * cosine + wide
            order, values = self.coordinate(int(j))
            inside = order[np.searchsorted(values, low) : np.searchsorted(values, high + SLACK, "right")]
            found = inside if found is None else np.intersect1d(found, inside, assume_unique=True)
        return found[found < enough]


FOUND = "query long, vec_id long, score long"


def _search(k: int, length: int):
    """The k best of a block for each query, of those that reach its threshold."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "vec_id", "score")})
        ids, absent = numbers(block.column("vec_id"))
        order = np.lexsort((ids, absent))  # ties fall by place
        ids, absent = ids[order], absent[order]
        bucket = Bucket(matrix(block.column("x"), length)[order], block.column("norm").to_numpy()[order])
        least = queries.column("least").to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        for query, own, q, norm, at in zip(queries.column("query").to_numpy(), queries.column("own").to_numpy(), matrix(queries.column("x"), length), queries.column("norm").to_numpy(), least):
            places = np.arange(len(bucket.norm)) if at is None else bucket.candidates(q, norm, at)
            score, place = products(bucket.x[places], q), bucket.order[places]
            right = (ids[place] != own) | absent[place]
            if at is not None:
                right &= score >= at
            score, place = score[right], place[right]
            best = np.lexsort((place, -score))[:k]
            out.append((np.full(len(best), query), place[best], score[best]))
        query, place, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query": query, "vec_id": pa.array(ids[place], mask=absent[place]), "score": score})

    return run


def _meet(queries: DataFrame, blocks: DataFrame, k: int, length: int) -> DataFrame:
    """Both sides' rows of a tile (``block``, ``part``) meet in one group of bounded size."""
    new = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  both sides come from one table
    left = new(queries, "block", "part", "query", "own", "x", "norm", "least").groupBy("block", "part")
    right = new(blocks, "block", "part", "vec_id", "x", "norm").groupBy("block", "part")
    return left.cogroup(right).applyInArrow(_search(k, length), FOUND)


def top_products(
    vectors: DataFrame, queries: Column, k: int = 10, *, scale: int = 1024, each: int = 8192, many: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` largest inner products of each row where ``queries`` holds with all rows but its own.

    Entries are ``floor(scale * x)``; ties go to the smaller id, null last. A query's own
    rows are those with its id; a row with a null id is no query but may be found.
    Repeated queries (equal id and vector) are answered once, repeated rows are found as
    often as they stand there. Left out are vectors that are null or have an entry that
    is null, not finite or so large that products don't fit in a long. A shorter
    vector counts as followed by zeros; one without entries has product 0 with
    any. Fewer than ``k`` others: all of them. No valid row, or no query: no rows.
    ``each`` and ``many`` are rows of a block and queries of a block.
    """
    rows, length = product_vectors(vectors, scale, embedding=embedding, vec_id=F.col(vec_id).cast("long"), asked=F.coalesce(queries, F.lit(False)) & F.col(vec_id).isNotNull())
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = rows.withColumn("norm", norm)
    data = first_of_equal(rows.select("vec_id", "x", "norm"), k)
    cuts = rows.agg(F.percentile_approx("norm", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    longer = sum((F.col("norm") < c).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)
    data = durable(data.withColumn("range", longer))
    ranges = {r["range"]: r for r in data.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}
    parts = parts_of({r: v["n"] for r, v in ranges.items()}, each)
    first = {r: sum(n for s, n in parts.items() if s < r) for r in ranges}  # blocks before those of a range
    spread = F.pmod(F.xxhash64("vec_id", "x"), looked_up(F.col("range"), parts)).cast("long")
    blocks = data.select("vec_id", "x", "norm", (looked_up(F.col("range"), first) + spread).alias("block"))

    asked = rows.where("asked").groupBy("vec_id", "x").agg(F.first("norm").alias("norm"))
    asked = durable(asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("own"), "x", "norm"))
    sides = -(-max(asked.count(), 1) // many)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(sides)))
    start = blocks.where("block = 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))
    found = durable(_meet(asked.select("*", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("least")), start, k, length))
    least = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = asked.join(least, "query", "left")
    reach = lambda r: F.col("least").isNull() | (F.col("norm") * (ranges[r]["longest"] * (1 + SLACK)) >= F.col("least"))
    spans = {r: (max(first[r], 1), first[r] + parts[r] - 1) for r in sorted(ranges) if first[r] + parts[r] > 1}  # all but the first block
    if spans:
        none = F.array().cast("array<long>")
        visited = F.flatten(F.array(*[F.when(reach(r), F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))).otherwise(none) for r, (a, b) in spans.items()]))
        rest = rest.withColumn("block", F.explode(visited))
        found = found.unionByName(_meet(rest, blocks.join(rest.select("block", "part").distinct(), "block"), k, length))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), by_id())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", F.col("own").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
