"""An extension: index maintenance and event counts as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import retrieval


def maintain_index(chunks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps postings of a stream of changed chunks (chunk_id, text, changed_at): each batch becomes a version, and readers take the newest of a chunk; of several in one batch the one changed last."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("chunk_id").agg(F.max_by("text", F.struct("changed_at", "text")).alias("text"))
        retrieval.postings(latest).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/postings/version={number}")
        latest.select("chunk_id", F.lit(number).alias("v")).write.mode("overwrite").parquet(f"{folder}/chunks/version={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_postings(spark, folder: str) -> DataFrame:
    """Postings of each chunk's newest version."""
    newest = spark.read.parquet(f"{folder}/chunks").groupBy("chunk_id").agg(F.max("v").alias("version"))
    return spark.read.parquet(f"{folder}/postings").join(newest, ["chunk_id", "version"], "left_semi").select("term", "chunk_id", "tf")


def event_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; late ones count until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
