"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Links that a task holds at once, and links of a partition at least; no more than these are one partition's work.
EACH = 1 << 17


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of n points to as few that connect the same: every point to the first it can reach."""
    root = np.arange(n)
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]


def _thinned(links: DataFrame, each: int) -> DataFrame:
    """As few links as connect the same, of each ``each`` links or so of a partition: every node to the smallest it reaches over them."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts)
        kinds, of = np.unique(np.concatenate([held.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        a, b = forest(*of.reshape(2, -1), len(kinds))
        return pa.RecordBatch.from_arrays([pa.array(kinds[x], held.schema.field("a").type) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch)
            if held > each:
                yield stars(parts)
                parts, held = [], 0
        if held:
            yield stars(parts)

    return links.mapInArrow(run, links.schema)


def _rounds_alike(a: DataFrame) -> tuple:
    return tuple(a.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links of non-null nodes to ``node, root``: the smallest node that each can reach.

    Every task first thins the links it has, so that what is left are as many as it
    has nodes. If these are ``EACH`` or fewer they are one partition, and thinning that
    is all there is to do: no round of many stages and tasks, whose records the driver
    would keep. More take rounds of large-star and small-star in turn: every node links
    its larger neighbours, then its smaller ones, to the smallest it knows, until nothing
    changes; this takes about the logarithm of the longest path in rounds, each of two
    aggregations and joins on the links, which never outgrow the first table. Each
    round is checkpointed. Links of a node to itself are left out, so nodes without
    another link have no row.
    """
    jvm, each = links.sparkSession.sparkContext._jvm, EACH
    e = durable(_thinned(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), each))
    n = e.count()
    jvm.System.gc()  # what was shuffled stays on the executors' disks until the driver lets go of it
    e = _thinned(e.coalesce(max(1, -(-n // each))), each)
    if n > each:
        e = _stars(durable(e.distinct()), each)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(e: DataFrame, each: int) -> DataFrame:
    """Distinct links of nodes to smaller ones, in rounds, until each node that has a smaller one is linked to the smallest it can reach."""
    jvm, mark = e.sparkSession.sparkContext._jvm, _rounds_alike(e)
    while mark[0]:
        e = e.coalesce(-(-mark[0] // each))  # never more than it has
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        smaller = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))  # once for each node, not for each of its links
        e = durable(smaller.unionAll(own).where("a != b").distinct())
        del both, least, large, smaller, own
        jvm.System.gc()  # as above
        if mark == (mark := _rounds_alike(e)):
            break
    return e
