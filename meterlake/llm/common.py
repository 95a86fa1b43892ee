"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def tasks(df: DataFrame) -> int:
    """Shuffle partitions the session asks for; salts and buckets follow it, so they grow with the cluster."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_over(df: DataFrame, size: Column, each: int) -> int:
    """Into how many parts rows go: one for so many bytes, at least as many as the session has shuffle partitions."""
    whole = df.agg(F.sum(size)).first()[0] or 0
    return max(tasks(df), -(-int(whole) // each))


def durable(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and cut the lineage there.

    The folder is the session's ``spark.checkpoint.dir``. A session of one machine
    that names none (tests) gets its own; a cluster's has to name one that all share.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only the two columns an operator works on, under names that no other column can clash with."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Words of a text, in order; an empty text has none."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")
