"""Vectors as whole numbers, and the tiles in which stated queries meet them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums of products stay below this, so that they and a hundred times a score fit in a long.
MOST_PRODUCT = 2**56
#: Up to here doubles hold every whole number.
EXACT = 2**53


def whole_vectors(vectors: DataFrame, scale: int, *, bits: int, offset: int = 0, embedding: str = "embedding", **keep: Column) -> DataFrame:
    """``keep`` and ``x``: ``floor(scale * entry) + offset`` as longs.

    Rows whose vector is null, or has an entry that is null, not finite or at least
    ``2**bits`` after scaling, are left out.
    """
    c = F.col(embedding).cast("array<double>")
    fits = F.forall(c, lambda v: F.coalesce(F.abs(v) < 2.0**bits / scale, F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v * float(scale)) + F.lit(offset).cast("long"))
    return vectors.where(fits).select(*[v.alias(k) for k, v in keep.items()], x.alias("x"))


def product_vectors(vectors: DataFrame, scale: int, *, embedding: str = "embedding", **keep: Column) -> tuple[DataFrame, int]:
    """``whole_vectors`` of one length, shorter ones followed by zeros, and that length.

    An entry whose square is over ``MOST_PRODUCT`` divided by the length counts like
    one that is not finite: inner products always fit in a long.
    """
    rows = whole_vectors(vectors, scale, bits=62, embedding=embedding, **keep)
    length = rows.agg(F.max(F.size("x"))).first()[0] or 0
    most = math.isqrt(MOST_PRODUCT // max(length, 1))
    rows = rows.where(F.forall("x", lambda v: F.abs(v) <= most))
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("x")))), length


def by_id(c: str = "vec_id") -> Column:
    """The order of ties: smaller ids first, null last."""
    return F.col(c).asc_nulls_last()


def first_of_equal(rows: DataFrame, k: int, *among: str) -> DataFrame:
    """Rows but those that ``k`` others with an equal vector always come before, for whichever id a query leaves out.

    Of equal vectors (and equal ``among``) the smallest ``k + 1`` ids stay, of each
    of them at most ``k`` repeated rows. However many copies a vector has, each task
    sends ``k`` times that at most.
    """
    again = Window.partitionBy(*among, "x", "vec_id").orderBy(F.lit(0))
    ids = Window.partitionBy(*among, "x").orderBy(by_id())
    rows = rows.withColumn("n", F.row_number().over(again)).where(F.col("n") <= k)
    return rows.withColumn("n", F.dense_rank().over(ids)).where(F.col("n") <= k + 1).drop("n")


def parts_of(counts: dict, each: int) -> dict:
    """Into how many blocks of about ``each`` rows every group goes."""
    return {g: max(1, -(-n // each)) for g, n in counts.items()}


def looked_up(key: Column, values: dict[int, int]) -> Column:
    """The value of a small number 0, 1, ...; 0 where there is none."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(int(values.get(i, 0))) for i in range(max(values, default=0) + 1)]), (key + 1).cast("int")), F.lit(0))


def matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """A column of long arrays of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of longs, and where it is null."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b`` of longs; in doubles wherever all sums stay within what these hold."""
    most = lambda m: int(np.abs(m).max(initial=0))
    if max(1, most(a)) * max(1, most(b)) * a.shape[-1] < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b
