"""Hard-negative mining over a vector-approximation file.

Every dimension is cut into cells between quantiles of all its values; a vector's
approximation is the cell number of each dimension, a byte each. For an anchor a
table gives the least and the largest product of its entry with a cell's values:
``middle * entry`` less or more ``half width * |entry|``. Summed up over dimensions these
are the bounds of a score. Anchors in blocks meet the approximations, not the vectors;
only rows whose bounds may enter the anchor's positives, or the window of scores that a
positive opens, are scored exactly, from their vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .vectors import EXACT, by_id, first_of_equal, looked_up, matrix, numbers, parts_of, product_vectors

#: Label hashes; each is cut into as many blocks as it needs.
GROUPS = 64
#: Anchors whose bounds are worked out at once.
AT_ONCE = 128


class Cells:
    """Edges of the cells of each dimension, and the middle and half width of each cell."""

    def __init__(self, edges: list[list[int]], ends: list[tuple[int, int]]):
        self.edges = [np.array(sorted(set(e)), np.int64) for e in edges]
        most = max((len(e) for e in self.edges), default=0) + 1
        self.middle, self.half = np.zeros((len(edges), most)), np.zeros((len(edges), most))
        self.largest = max((abs(v) for pair in ends for v in pair), default=0)
        for j, (e, (least, largest)) in enumerate(zip(self.edges, ends)):
            low, high = np.concatenate([[least], e]), np.concatenate([e - 1, [largest]])
            high = np.maximum(low, high)  # a first cell below the least edge may be empty
            self.middle[j, : len(low)], self.half[j, : len(low)] = (low + high) / 2, (high - low) / 2

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.uint8) if self.edges else np.zeros(x.shape, np.uint8)

    def bounds(self, anchors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor (rows) with each approximation (columns)."""
        at = np.arange(codes.shape[1])
        about = anchors.astype(float) @ self.middle[at, codes].T
        off = np.abs(anchors).astype(float) @ self.half[at, codes].T
        most = codes.shape[1] * float(self.largest) * float(np.abs(anchors).max(initial=0))
        if 2 * most >= EXACT:  # doubles may round
            off += most * 2.0**-45
        return about - off, about + off


def fit_cells(rows: DataFrame, length: int, cells: int) -> Cells:
    """Quantiles of each dimension over all rows; ``length`` times ``cells`` numbers reach the driver."""
    if not 2 <= cells <= 256:
        raise ValueError("a cell number is a byte")
    each = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at")
    got = each.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 10 * cells).alias("edges"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
    by = {r["at"]: r for r in got}
    return Cells([by[j]["edges"] for j in range(length)] if by else [], [(by[j]["least"], by[j]["most"]) for j in range(length)] if by else [])


NEAR = "anchor long, row long, low double, high double"
INSIDE = "anchor long, ordinal int, row long, low double, high double, sure boolean"


def _sides(anchors: pa.Table, block: pa.Table, length: int) -> tuple:
    """Vectors, ids and labels of the anchors; codes, ids, labels and row numbers of the block, by id."""
    ids, absent = numbers(block.column("vec_id"))
    order = np.lexsort((ids, absent))
    codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(block.num_rows, length)[order]
    labels = block.column("label").to_numpy()[order]
    return matrix(anchors.column("x"), length), anchors.column("own").to_numpy(), anchors.column("label").to_numpy(), codes, np.where(absent, -1, ids)[order], absent[order], labels, block.column("row").to_numpy()[order]


def _nearest(k: int, cells: Cells, length: int):
    """Rows of an anchor's label that may be among its ``k`` best: those whose upper bound reaches the k-th lower bound of the block."""

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if anchors.num_rows and block.num_rows:
            x, own, label, codes, ids, absent, labels, rows = _sides(anchors, block, length)
            names = anchors.column("anchor").to_numpy()
            for i in range(0, len(x), AT_ONCE):
                part = slice(i, i + AT_ONCE)
                low, high = cells.bounds(x[part], codes)
                out_of = (labels[None, :] != label[part, None]) | (ids[None, :] == own[part, None]) & ~absent[None, :]
                low[out_of], high[out_of] = -np.inf, -np.inf
                at = max(len(codes) - k, 0)
                least = np.partition(low, at, axis=1)[:, at] if len(codes) > k else np.full(len(low), -np.inf)
                a, b = np.nonzero((high >= least[:, None]) & ~out_of)
                out.append((names[part][a], rows[b], low[a, b], high[a, b]))
        return pa.table(dict(zip(("anchor", "row", "low", "high"), (np.concatenate(c) for c in zip(*out)))))

    return run


def _windowed(k: int, cells: Cells, length: int):
    """Rows of other labels whose score may lie in a window and among its ``k`` best there."""

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        whole = np.zeros(0, np.int64)
        out: list[tuple[np.ndarray, ...]] = [(whole, whole.astype(np.int32), whole, np.zeros(0), np.zeros(0), np.zeros(0, bool))]
        if anchors.num_rows and block.num_rows:
            x, _, label, codes, _, _, labels, rows = _sides(anchors, block, length)
            names, windows = anchors.column("anchor").to_numpy(), anchors.column("windows").to_pylist()
            for i in range(0, len(x), AT_ONCE):
                low, high = cells.bounds(x[i : i + AT_ONCE], codes)
                for a, (name, own, opened) in enumerate(zip(names[i:], label[i:], windows[i : i + AT_ONCE])):
                    other = np.nonzero(labels != own)[0]
                    lo, hi = low[a, other], high[a, other]
                    for w in opened:
                        may = np.nonzero((hi >= w["least"]) & (lo <= w["most"]))[0]
                        sure = (lo[may] >= w["least"]) & (hi[may] <= w["most"])
                        if sure.sum() >= k:
                            inside = lo[may][sure]
                            keep = hi[may] >= np.partition(inside, len(inside) - k)[len(inside) - k]
                            may, sure = may[keep], sure[keep]
                        out.append((np.full(len(may), name), np.full(len(may), w["ordinal"], np.int32), rows[other[may]], lo[may], hi[may], sure))
        return pa.table(dict(zip(("anchor", "ordinal", "row", "low", "high", "sure"), (np.concatenate(c) for c in zip(*out)))))

    return run


def _new(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in names])


def _met(anchors: DataFrame, blocks: DataFrame, run, schema: str, *more: str) -> DataFrame:
    """Anchors and approximations of a tile meet in one group of bounded size."""
    left = _new(anchors, "block", "part", "anchor", "own", "label", "x", *more)
    right = _new(blocks.join(left.select("block", "part").distinct(), "block"), "block", "part", "row", "vec_id", "label", "code")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


def _reaching(found: DataFrame, k: int, bound: Column, *of: str) -> DataFrame:
    """Of candidates from all blocks, those whose upper bound reaches the k-th largest ``bound``."""
    order = Window.partitionBy(*of).orderBy(bound.desc_nulls_last())
    least = found.where(bound.isNotNull()).withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(*of, bound.alias("least"))
    return found.join(least, list(of), "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).drop("least")


def _scored(found: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """The exact scores of candidates."""
    x, a = rows.select("row", "vec_id", F.col("x").alias("b")), anchors.select("anchor", F.col("x").alias("a"))
    score = F.aggregate(F.zip_with("a", "b", lambda v, w: v * w), F.lit(0).cast("long"), lambda s, v: s + v)
    return found.join(x, "row").join(a, "anchor").withColumn("score", score).drop("a", "b")


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, label: Column | str = "label", positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, cells: int = 256, each: int = 8192, many: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows where ``anchors`` holds; an anchor's positives the ``positives``
    best other rows of its label by inner product of ``floor(scale * x)``, ties to the
    smaller id, null last. For each positive, the ``negatives`` best rows of another label
    whose score is between the ``window``'s hundredths of the positive's score. Left
    out are rows with a null label or a vector that is null or has an entry that is
    null, not finite or too large for a product to fit in a long. Labels are whole
    numbers. A shorter vector
    counts as followed by zeros. An anchor's own rows are those with its id; a null id
    is no anchor, but may be found. Repeated anchors (equal id, label and vector) count
    once; other repeated rows are found as often as they stand there. A positive with a
    score below zero, or without a row in its window, has no rows; nor has an empty
    table. ``cells`` (256 at most), ``each`` and ``many`` are cells of a dimension,
    rows of a block and anchors of a block; the result is the same whatever they are.
    """
    of = F.col(label) if isinstance(label, str) else label
    asked = F.coalesce(anchors, F.lit(False)) & F.col(vec_id).isNotNull()
    rows, length = product_vectors(vectors.where(of.isNotNull()), scale, embedding=embedding, vec_id=F.col(vec_id).cast("long"), label=of.cast("long"), asked=asked)
    fitted = fit_cells(rows, length, cells)
    data = first_of_equal(rows.select("vec_id", "label", "x"), max(positives, negatives), "label")
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    data = durable(data.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x", group.alias("group")))

    counts = {r["group"]: r["count"] for r in data.groupBy("group").count().collect()}
    parts = parts_of(counts, each)
    first = {g: sum(n for s, n in parts.items() if s < g) for g in parts}
    total = sum(parts.values())
    block = (looked_up(F.col("group"), first) + F.pmod(F.xxhash64("vec_id", "x"), F.greatest(looked_up(F.col("group"), parts), F.lit(1)))).cast("long")

    def approximate(batches):
        for b in batches:
            codes = fitted.codes(matrix(b.column("x"), length))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary())], ["row", "vec_id", "label", "block", "code"])

    file = data.select("row", "vec_id", "label", block.alias("block"), "x").mapInArrow(approximate, "row long, vec_id long, label long, block long, code binary")
    file = durable(file)

    chosen = rows.where("asked").groupBy("vec_id", "label", "x").count()
    chosen = durable(chosen.select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("own"), "label", "x"))
    part = F.pmod(F.xxhash64("anchor"), F.lit(-(-max(chosen.count(), 1) // many)))

    start = looked_up(group, first).cast("long")
    own = F.sequence(start, start + F.greatest(looked_up(group, parts), F.lit(1)) - 1)
    same = chosen.select("*", part.alias("part"), F.explode(own).alias("block"))
    near = _reaching(_met(same, file, _nearest(positives, fitted, length), NEAR), positives, F.col("low"), "anchor")
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), by_id(), "row")
    near = _scored(near, chosen, data).withColumn("ordinal", F.row_number().over(best)).where(F.col("ordinal") <= positives)
    near = durable(near.select("anchor", "ordinal", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    low, high = window
    opens = near.where("positive_score >= 0").selectExpr("anchor", "ordinal", f"(positive_score * {low} + 99) div 100 AS least", f"positive_score * {high} div 100 AS most")
    opens = opens.groupBy("anchor").agg(F.collect_list(F.struct("ordinal", "least", "most")).alias("windows"))  # at most `positives`
    others = chosen.join(opens, "anchor").select("*", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(total - 1, 0)).cast("long"))).alias("block"))
    inside = _met(others, file, _windowed(negatives, fitted, length), INSIDE, "windows")
    inside = _reaching(inside, negatives, F.when(F.col("sure"), F.col("low")), "anchor", "ordinal")
    scored = _scored(inside, chosen, data).join(near, ["anchor", "ordinal"])
    scored = scored.where((F.col("positive_score") * low <= F.col("score") * 100) & (F.col("score") * 100 <= F.col("positive_score") * high))
    best = Window.partitionBy("anchor", "ordinal").orderBy(F.col("score").desc(), by_id(), "row")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = ranked.join(chosen.select("anchor", F.col("own").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
