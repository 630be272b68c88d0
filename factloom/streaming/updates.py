"""Streaming extensions: incremental updates of a knowledge base, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import diff, merge


def merged_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """The knowledge base after default decisions on the diff of two snapshots."""
    changes = diff.compare(old, new).withColumn("diff_id", F.concat_ws("-", F.col("side").cast("string"), F.col("ord").cast("string")))
    kept = merge.merged(merge.decided(changes)).select(F.col("item_id").alias("knowledge_id"))
    both = old.unionByName(new)
    return both.join(kept.distinct(), "knowledge_id", "left_semi").select(*old.columns)


def keep_updated(stream: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new items is compared with the snapshot before it under ``base`` and written as the next one.

    Snapshots are numbered by batch, so a batch that runs again overwrites its own result and nothing else.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{base}/{number:09d}")
        out = old if batch.isEmpty() else merged_items(old, batch)
        out.write.mode("overwrite").parquet(f"{base}/{number + 1:09d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window; those later than the watermark are left out. Works on tables and streams alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
