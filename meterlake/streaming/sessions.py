"""Micro-batches of session buckets: the stored sessions merged, and only the days that a batch touches derived anew.

``root`` holds three tables, each with a folder for every tool and day: ``sessions``
(one row per bucket), ``daily`` and ``hourly`` (what the dashboards read). A batch
changes the days it has rows of, and those where a newer parse of a session drops buckets
that it no longer has. These days are derived whole from their sessions and
overwritten, so rows that nothing supports any more are gone.

The derived tables are written before the sessions. A batch that fails on the way and
comes again finds the sessions as they were, or partly as they will be, and arrives
at the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import settled
from ..functions.semantics import METRICS, default_evidence, sum_merged
from ..operators.merge import BUCKET, derive_days, drop_superseded, merge_sessions
from .ingest import exists

STATE = ", ".join(["external_id string", "tool string", "session_id string", "hour string", "model string", "parser_version int", *[f"{m} long" for m in (*METRICS, "requests")], "machine_ids array<string>", "ev_input_tokens string", "day string"])
DAYS = ["tool", "day"]


def _table(spark: SparkSession, root: str) -> DataFrame:
    if exists(spark, f"{root}/sessions"):
        return spark.read.schema(STATE).parquet(f"{root}/sessions")
    return spark.createDataFrame([], STATE)


def merged_state(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions of all touched days after a batch, and those days (``tool, day``).

    ``stored`` has the columns of STATE; ``batch`` those of BUCKET with
    ``parser_version, machine_id, arrival`` and the metrics.
    """
    first = merge_sessions(batch)  # a batch counts as one arrival: its highest parse and earliest hour of each session
    of_batch = first.select(*BUCKET, "parser_version")
    mine = stored.join(of_batch.select("external_id", "tool", "session_id").distinct(), ["external_id", "tool", "session_id"], "left_semi")
    kept = drop_superseded(mine.select(*BUCKET, "parser_version"), of_batch).select(*BUCKET, F.lit(True).alias("kept"))
    gone = mine.join(kept, BUCKET, "left_anti")
    day = F.substring("hour", 1, 10).alias("day")
    touched = of_batch.select("tool", day).unionByName(gone.select(*DAYS)).distinct()
    near = stored.join(touched, DAYS, "left_semi").join(gone.select(*BUCKET), BUCKET, "left_anti")
    old = near.select(*BUCKET, "parser_version", *METRICS, "requests", F.explode_outer("machine_ids").alias("machine_id"), F.lit(-1).cast("long").alias("arrival"))
    both = old.unionByName(batch.select(*old.columns))
    out = merge_sessions(both).withColumn("machine_ids", F.filter("machine_ids", lambda m: m != "")).withColumn("day", day)
    return out, touched


def derive_hours(buckets: DataFrame) -> DataFrame:
    """Hours from session buckets."""
    g = buckets.groupBy("external_id", "tool", "hour", "model")
    return g.agg(*[F.sum(m).alias(m) for m in (*METRICS, "requests")], sum_merged(default_evidence(F.col("input_tokens"))).alias("ev_input_tokens"))


def _overwrite(spark: SparkSession, rows: DataFrame, touched: list, path: str) -> None:
    """Touched days' folders replaced by their rows, or removed where there are none left."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*DAYS).parquet(path)
    left = {(r["tool"], r["day"]) for r in rows.select(*DAYS).distinct().collect()}
    for r in touched:
        if (r["tool"], r["day"]) not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tool={r['tool']}/day={r['day']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def apply_batch(spark: SparkSession, batch: DataFrame, root: str) -> None:
    """One batch into the tables under ``root``. Tools and days, a few for a batch, are all that reaches the driver."""
    state, touched = merged_state(_table(spark, root), batch)
    state, days = settled(state), touched.collect()
    if not days:
        return
    daily = derive_days(state).withColumn("day", F.col("date"))
    hourly = derive_hours(state).withColumn("day", F.substring("hour", 1, 10))
    for rows, name in ((daily, "daily"), (hourly, "hourly"), (state, "sessions")):
        _overwrite(spark, settled(rows), days, f"{root}/{name}")


def start(source: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Take everything that has landed, then stop; the checkpoint remembers what was taken."""
    spark = source.sparkSession
    return source.writeStream.foreachBatch(lambda b, _: apply_batch(spark, b, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
