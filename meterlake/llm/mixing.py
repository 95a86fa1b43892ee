"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are cut into
equal ranges of the hash, so the ranges hold alike many rows however large the
source is; sums by range, summed up along the ranges, give each range its offset
and a window inside the range gives each document its exact prefix sum of
tokens. The budget of the source then cuts the order at one token. A budget
over the source's size first takes whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, durable, tasks


def word_count(c: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    The weights repeat over the sources by code point, null last. The targets
    share ``share`` of all sizes by weight; none goes over ``most`` times its
    source, and what is over goes to the others by weight. That is
    ``min(most * size, level * weight)`` with one level, found by going through
    the sources in the order in which they fill up.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("left_w"),
    )
    s = s.withColumn("level", F.col("left") / F.col("left_w"))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.struct(F.col("left_w"), F.col("level")))).over(everything)["level"]
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def _base(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, n: int, *more: Column) -> DataFrame:
    """A row per input row with its size, random key and cell: its source and range of the key."""
    key, name = F.xxhash64(F.lit(seed), F.col(doc_id)), F.col(source).cast("string")
    span = F.floor((key.cast("double") + 2.0**63) / (2.0**64 / (4 * n))).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        name.alias("source"),
        word_count(F.col(text)).alias("size"),
        key.alias("key"),
        F.xxhash64(F.col(text)).alias("tie"),
        span.alias("range"),
        F.concat(F.coalesce(F.concat(F.lit("s"), name), F.lit("n")), F.lit(":"), span.cast("string")).alias("cell"),
        *more,
    )


def _place(base: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``base`` with source_size, target, epochs, part and taken."""
    ranges = base.groupBy("cell", "source", "range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(totals, weights=weights, share=share, most=most)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("cell", F.col("source").alias("of"), F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("before"))
    ranges = ranges.join(targets, F.col("of").eqNullSafe(F.col("source"))).select("cell", "before", "source_size", "target")
    within = Window.partitionBy("cell").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(ranges, "cell").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    placed = placed.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source, source_size, target, epochs, part, taken``.

    ``epochs`` is how often the whole document is taken and ``part`` how many of
    its first words besides: 0, all, or, at the source's cut, some. ``taken`` is
    the words of both; over a source it sums to the target rounded down. Rows with
    a null text have size 0 and are never taken. Documents of one identifier keep
    their own rows; ties of the random key fall to the identifier, then the text's
    hash. Rows alike in all of these are interchangeable. A source with no words
    has target 0; an empty table gives no rows. Runs agree, whatever the
    partitions. Other columns are ignored.
    """
    base = durable(_base(docs, doc_id, text, source, seed, tasks(docs)))
    placed = _place(base, weights, share, most)
    return placed.select("doc_id", "size", "source", "source_size", "target", "epochs", "part", "taken")


def first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word."""
    pieces = F.regexp_extract_all(text, F.lit(f"({SPACE}|{WORD})"), F.lit(1))
    lead = F.when(F.regexp_like(text, F.lit(f"^{SPACE}")), 0).otherwise(1)
    return F.array_join(F.slice(pieces, F.lit(1), (k * 2 - lead).cast("int")), "")


def mixed_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each copy taken, cases as in ``mix_sources``.

    The one document at a source's cut gives its first ``part`` words as its last
    copy; ``n_chars``, where there is such a column, then counts those.
    """
    base = _base(docs, doc_id, text, source, seed, tasks(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    placed = _place(base, weights, share, most).where("taken > 0")
    whole = F.col("epochs") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)
    some = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(some, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    placed = placed.select("row", F.explode(copies).alias("cut"))
    cut = F.when(F.col("cut") > 0, first_words(F.col("row")[text], F.col("cut"))).otherwise(F.col("row")[text])
    made = {text: cut}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("cut") > 0, F.length(cut)).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return placed.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
