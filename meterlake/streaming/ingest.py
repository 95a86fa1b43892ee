"""Micro-batches: landed session rows merged into a log of observations, from which sessions can be told anew.

Late data are always taken, so there is no watermark: each batch touches whole
(person, tool) partitions of the session table, which are merged and overwritten
by partition. A batch that runs twice gives the same table, since the merge keeps
the arrival order and rows of one arrival once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_batch(spark: SparkSession, batch: DataFrame, table: str) -> None:
    """Rows of the batch into the observations at ``table``, one folder for each tool and day, only touched ones rewritten."""
    new = batch.withColumn("day", F.substring("hour", 1, 10))
    if exists(spark, table):
        touched = new.select("tool", "day").distinct()
        old = spark.read.parquet(table).join(touched, ["tool", "day"], "left_semi")
        new = old.select(*new.columns).unionByName(new)
    rows = new.dropDuplicates([*merge.BUCKET, "arrival"]).checkpoint()  # read before it is overwritten
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tool", "day").parquet(table)


def start(source: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge everything that has landed, then stop; the checkpoint remembers what was taken."""
    spark = source.sparkSession
    return source.writeStream.foreachBatch(lambda b, _: merge_batch(spark, b, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """A live hourly view for monitoring, where late data may be lost: tumbling windows behind a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "tool")
    return w.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests")).select(F.col("window.start").alias("hour"), "tool", "input_tokens", "output_tokens", "requests")
