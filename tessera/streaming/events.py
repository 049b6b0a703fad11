"""Event-time streams: first rows of keys, joins of two streams, and upserts that rewrite touched buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.stored_index import _exists

BUCKETS = 64


def first_within(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Rows whose keys no row of the last `delay` (in event time) had; rows later than the watermark are dropped. State holds keys for `delay` only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, within: str, delay: str) -> DataFrame:
    """Rows of both streams with equal keys where right's time is at left's or up to `within` later.

    Both sides have watermarks and the times bound each other, so state is dropped once no partner can come.
    by and the other column names of right must not occur in left, except for by itself.
    """
    other = right.withColumnRenamed(by, "_by").withWatermark(right_at, delay)
    when = (F.col(right_at) >= F.col(at)) & (F.col(right_at) <= F.col(at) + F.expr(f"interval {within}"))
    return left.withWatermark(at, delay).join(other, (F.col(by) == F.col("_by")) & when).drop("_by")


def drain(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived to Parquet files and stop; a later call with the same checkpoint goes on where this one ended."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def upsert(batch: DataFrame, path: str, key: str, version: str) -> None:
    """Merge a batch into the table at path, which keeps the row with the largest version of each key.

    Only the buckets that the batch touches (BUCKETS numbers at most) are read and overwritten. A batch
    that comes twice, or an older version that comes late, changes nothing. Null keys are a key like others;
    columns that are null stay so; of equal versions the row that is largest by its other columns counts.
    """
    spark = batch.sparkSession
    new = batch.withColumn("bucket", bucket_of(F.col(key)))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if not touched:
        return
    both = new
    if _exists(spark, path):
        both = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)).unionByName(new)
    columns = [c for c in batch.columns if c not in (key, version)]
    newest = both.groupBy("bucket", key).agg(F.max(F.struct(version, *columns)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in [version, *columns]], "bucket")
    newest.select(*batch.columns, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, version: str) -> None:
    """upsert for each batch of a stream; a batch that is run again after a failure gives the same table."""
    stream.writeStream.foreachBatch(lambda batch, _: upsert(batch, path, key, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
