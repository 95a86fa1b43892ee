"""Feeds: posts with their authors and reactions, pages by key, who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, size: int, *, after: tuple | None = None, boundary=None, time: str = "at", key: str = "id") -> DataFrame:
    """A page, newest first, and one row more that tells whether another follows.

    ``after`` is the (time, key) of the last row shown; ``boundary`` freezes what
    came later than the first page.
    """
    if boundary is not None:
        rows = rows.where(F.col(time) <= F.lit(boundary))
    if after is not None:
        rows = rows.where((F.col(time) < F.lit(after[0])) | ((F.col(time) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(size + 1)


def feed(posts: DataFrame, members: DataFrame, reactions: DataFrame, size: int = 100) -> DataFrame:
    """The newest posts with the author's name and counts of each reaction."""
    top = posts.orderBy(F.desc("at"), F.desc("id")).limit(size)
    counts = reactions.groupBy("post_id", "emoji").agg(F.count_distinct("member_id").alias("n")).groupBy("post_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("emoji", "n")))).alias("reactions"))
    out = top.join(members.select(F.col("member_id").alias("author"), "name"), top["member_id"] == F.col("author"), "left").drop("author")
    return out.join(counts, out["id"] == F.col("post_id"), "left").drop("post_id")


def latest_drafts(digests: DataFrame, since: str) -> DataFrame:
    """Each member's newest unresolved digest from a day on."""
    own = digests.where((F.col("status") == "draft") & (F.col("date") >= since))
    return own.groupBy("member_id").agg(F.max("date").alias("date"), F.max_by("items", "date").alias("items"))


def shared_digests(digests: DataFrame, members: DataFrame, since: str) -> DataFrame:
    """What members have shared from a day on, with their names; drafts and skipped ones never show."""
    out = digests.where((F.col("status") == "shared") & (F.col("date") >= since))
    return out.join(members.select("member_id", "name"), "member_id", "left").select("date", F.coalesce("name", F.lit("?")).alias("name"), "items")


def visible(viewer: Column | int, *, admin: bool = False) -> Column:
    """Whether a row with owner, audience (private, people, team) and people may be seen."""
    if admin:
        return F.lit(True)
    v = F.lit(viewer) if isinstance(viewer, int) else viewer
    return (F.col("owner") == v) | (F.col("audience") == "team") | ((F.col("audience") == "people") & F.coalesce(F.array_contains("people", v), F.lit(False)))
