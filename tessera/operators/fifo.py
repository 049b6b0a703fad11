"""A bounded cache that forgets what was inserted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 10_000
SCHEMA = "key string, batch int, place long"


def request(cache: DataFrame, batch: DataFrame, number: int, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Answers (key, place, hit) to one batch (key, place), and the cache (SCHEMA) after it.

    The whole batch is looked up first; then the keys that missed are inserted once each, in the order of their
    first places (numbers of batches rise), and all but the newest `size` entries are forgotten. A hit doesn't
    make an entry newer. Null keys are a key like others that is never kept.
    """
    answers = batch.join(cache.select("key", F.lit(True).alias("_in")), "key", "left").select("key", "place", F.coalesce("_in", F.lit(False)).alias("hit"))
    new = answers.where("not hit and key is not null").groupBy("key").agg(F.min("place").alias("place")).select("key", F.lit(number).alias("batch"), F.col("place").cast("long").alias("place"))
    # each task keeps its newest `size` rows, and those are merged: bounded by the cache's size
    return answers, cache.unionByName(new).orderBy(F.desc("batch"), F.desc("place"), "key").limit(size)
