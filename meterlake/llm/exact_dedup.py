"""Exact deduplication by content sort.

Sampled splitters over the leading characters cut the normalised texts into
ranges, and within a range whole texts are sorted, so equal texts are neighbours
and a run of equals is found by comparing whole neighbouring texts. Equal texts
begin alike, so they all lie in one range and their run is the whole group.

A beginning that would fill a good part of a range is hot: its texts are dealt over
several ranges by a salt drawn from the identifier, and only for them what the runs
of one text found is put together by the text's SHA-256, on rows without text, at
most one for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slim, tasks

#: Leading characters that splitters are made of; the driver gets a sample of these, never whole texts.
LEAD = 32
#: A beginning is hot if its texts have more than this part of what a range holds on average.
HOT = 1 / 4


def hot_leads(base: DataFrame, ranges: int) -> DataFrame:
    """``lead``: the hot beginnings of rows ``lead, body``, of which there can't be more than ranges / HOT."""
    weights = base.groupBy("lead").agg(F.sum(F.length("body") + LEAD).alias("weight"))
    return weights.join(F.broadcast(weights.agg(F.sum("weight").alias("all"))), F.col("weight") > F.col("all") * (HOT / ranges)).select("lead")


def exact_dedup(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` is ``smallest`` or ``largest``: which identifier of a group of equal
    normalised texts stays. A null text counts as empty, so nulls and empty texts
    are one group. Rows that repeat both identifier and text all count in
    ``group_size``; one of them is kept. A null identifier stays only if its group
    has no other. An empty table gives no rows. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.max if keep == "largest" else F.min
    n = tasks(docs)
    base = slim(docs, doc_id, text)
    base = base.select("doc_id", (normalise(F.col("text")) if normalise else F.col("text")).alias("body")).withColumn("lead", F.substring("body", 1, LEAD))
    hot = F.broadcast(hot_leads(base, n).withColumn("hot", F.lit(True)))  # a row for each, 4 to a range at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(n)) + 1).otherwise(0)
    run = Window.partitionBy("body", "salt", "lead")
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    runs = base.join(hot, "lead", "left").withColumn("salt", salt).repartitionByRange(n, "lead", "salt")
    runs = durable(
        runs.select(
            "doc_id",
            "salt",
            F.unhex(F.sha2("body", 256)).alias("digest"),
            F.row_number().over(run.orderBy(order)).alias("place"),
            best("doc_id").over(run).alias("keep_id"),
            F.count(F.lit(1)).over(run).alias("group_size"),
        )
    )
    group = Window.partitionBy("digest")  # a row for each salt at most
    heads = runs.where("salt > 0 AND place = 1").select(
        "digest", "salt", best("keep_id").over(group).alias("keep_id"), F.sum("group_size").over(group).alias("group_size")
    )
    stitched = runs.where("salt > 0").drop("keep_id", "group_size").join(heads, ["digest", "salt"])
    return runs.where("salt = 0").unionByName(stitched).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns; cases as in ``exact_dedup``."""
    gone = durable(exact_dedup(docs, doc_id=doc_id, text=text, keep=keep).where("not kept"))
    own = F.col("gone_id").eqNullSafe(F.col("keep_id"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), "keep_id", F.col("text_sha256").alias("gone_sha"))
    sha = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    left = docs.join(gone.where(~own), docs[doc_id].eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha")), "left_anti")
    if gone.where(own).isEmpty():
        return left
    row = F.struct(*[left[c] for c in docs.columns])  # rows that repeat identifier and text: any one of them
    rows = left.select(row.alias("row")).groupBy(F.col("row")[doc_id], F.sha2(F.coalesce(F.col("row")[text], F.lit("")), 256)).agg(F.first("row").alias("row"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
