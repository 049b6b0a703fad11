"""Incremental ingestion: files arrive, are cleaned and chunked, and each batch is upserted by chunk id; event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk
from tessera.sources.files import upserted

SCHEMA = "doc_id string, text string"


def stream_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, least: int = 600, most: int = 1200, overlap: int = 100):
    """Start a query that reads JSON lines of (doc_id, text) and keeps target (Parquet versions v=0, 1, ...) at one row for each chunk id. Each batch writes a new version, so a repeated batch replaces its own."""

    def merge(batch: DataFrame, epoch: int) -> None:
        new = chunk(batch, least, most, overlap).dropDuplicates(["chunk_id"])
        if epoch:
            new = upserted(spark.read.parquet(f"{target}/v={epoch - 1}"), new, ["chunk_id"])
        new.write.mode("overwrite").parquet(f"{target}/v={epoch}")

    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Tumbling windows of (ts, event_type, value); on a stream, rows later than the watermark are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
