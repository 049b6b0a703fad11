"""Vector arithmetic on arrays in double precision, and top-k by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, clip: bool = True) -> Column:
    """0 for zero vectors; clipped to 0..1 unless clip is off (a zero norm then counts as 1)."""
    size = norm(a) * norm(b)
    if not clip:
        return dot(a, b) / (F.when(norm(a) == 0, 1.0).otherwise(norm(a)) * F.when(norm(b) == 0, 1.0).otherwise(norm(b)))
    return F.when(size == 0, 0.0).otherwise(F.least(F.greatest(dot(a, b) / size, F.lit(0.0)), F.lit(1.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, double(a)).otherwise(F.transform(double(a), lambda x: x / n))


def valid(a: Column, dims: int | None = None) -> Column:
    ok = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok & (F.size(a) == dims) if dims else ok


def good_quality(a: Column) -> Column:
    """Finite, not all zero, and of a norm from 0.01 to 100."""
    return valid(a) & F.exists(a, lambda x: x != 0) & norm(a).between(0.01, 100.0)


def mean_vector(df: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """One row: the (weighted) mean by place, put together from one small group for each place."""
    w = weight if weight is not None else F.lit(1.0)
    parts = df.select(w.alias("w"), F.posexplode(double(F.col(column))).alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.3, block: int = 1024) -> DataFrame:
    """query_id, vec_id, score: each query's best k by cosine, if threshold or more.

    Queries (query_id, embedding) are dealt into blocks; each block's matrix meets each batch of
    vectors in one product, and a task passes on only its own best k for each query.
    """
    rows = queries.select("query_id", double(F.col("embedding")).alias("embedding")).collect() if queries.count() <= block else None
    if rows is None:  # more queries than one block: block by block, each bounded
        salted = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(-(-queries.count() // (block // 2)))))
        parts = [top_k(vectors, salted.where(F.col("_b") == r["_b"]).drop("_b"), k, threshold, 2**31) for r in salted.select("_b").distinct().collect()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

    def score(batches):
        qid, q = shared.value
        for batch in batches:
            vid = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(vid) or not len(qid):
                continue
            s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
            keep = s >= threshold - 1e-9
            if len(vid) > 4 * k:
                edge = np.partition(s, len(vid) - k, axis=1)[:, len(vid) - k][:, None]
                keep &= s >= edge - 1e-9
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(vid[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    found = vectors.select(F.col("vec_id").cast("long"), double(F.col("embedding"))).mapInArrow(score, "query_id long, vec_id long, score double")
    found = found.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
