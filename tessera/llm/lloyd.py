"""Centroid clustering by plain Lloyd rounds over whole-number vectors.

Centroids are broadcast (k x dims numbers). mapInPandas computes the whole-number squared differences
to each centroid in NumPy, and argmin takes the lowest number of equals. Each partition returns one sum
for each centroid and component, and a groupBy merges these; a round's result on the driver is k x dims
numbers, whatever the input. All arithmetic is exact, so neither partitions nor their order matter.

Defined results: vectors that are null, have other than `dims` components, or hold null, NaN or infinite
ones take no part and have no row. Whole numbers beyond +-2^27 (components beyond +-2^21 at scale 64) are
held at that bound, so every distance fits a long. Rows that repeat a vec_id are vectors of their own, each
with a row; a null vec_id starts a centroid only where too few others do. With fewer than k vectors
there are as many centroids as vectors; an empty table gives an empty result. A sum of distances beyond a long is null. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Whole-number components lie within +-BOUND: 64 squares of differences of twice that fit a long.
BOUND = 1 << 27
ORACLE_ROUNDS = 3


def whole_vectors(table: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and v (array<bigint>: floor(scale * x)) of the vectors that take part."""
    x = F.col("embedding")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    whole = lambda e: F.greatest(F.lit(-BOUND).cast("long"), F.least(F.lit(BOUND).cast("long"), F.floor(F.lit(float(scale)) * e.cast("double"))))
    return table.where(x.isNotNull() & (F.size(x) == dims)).where(~F.exists(x, bad)).select("vec_id", F.transform(x, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order (equal ids: by their components)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the lowest of equals) and squared distance of each row of v."""
    d = np.empty((len(centroids), len(v)), np.int64)
    for i, c in enumerate(centroids):
        diff = v - c
        d[i] = np.einsum("ij,ij->i", diff, diff)
    at = d.argmin(axis=0)
    return at, d[at, np.arange(len(v))]


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; those without vectors stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames):
        import pandas as pd

        now = shared.value
        total, n = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for f in frames:
            if len(f):
                v = np.stack(f["v"].to_numpy())
                at, _ = nearest(v, now)
                n += np.bincount(at, minlength=len(now))
                for c in np.unique(at):
                    total[c] += v[at == c].sum(axis=0)
        c, i = np.nonzero(np.broadcast_to(n[:, None] > 0, now.shape))
        yield pd.DataFrame({"cluster": c.astype(np.int32), "dim": i.astype(np.int32), "total": total[c, i], "n": n[c]})

    parts = vectors.select("v").mapInPandas(sums, "cluster int, dim int, total long, n long")
    merged = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in merged.collect():  # k x dims rows at most
        out[r.cluster, r.dim] = int(r.total) // r.n
    shared.unpersist()
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def rows(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                at, d = nearest(np.stack(f["v"].to_numpy()), shared.value)
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": at.astype(np.int32), "distance": d})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInPandas(rows, f"vec_id {kind}, cluster int, distance long")


def lloyd(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """The last assignment (vec_id, cluster, distance; written to the shared folder) and the centroids it is to."""
    vectors = whole_vectors(table, dims, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        moved = move(vectors, centroids)
        still = np.array_equal(moved, centroids)
        centroids = moved
        if still:  # further rounds would give the same centroids again
            break
    return materialize(assign(vectors, centroids), "lloyd"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256; the table joined has a row for each centroid."""
    import hashlib

    spark = assigned.sparkSession
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    total = total if total is not None and total < 1 << 63 else None
    rows = [(i, sums.get(i), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return with_inertia(assigned, centroids)


def _round(n: int) -> str:
    return f"""
), a{n} as (
  select vec_id, v, min(struct_pack(d := d, c := c)) as m
  from (select k.vec_id, k.v, c.c, cast(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) as bigint) as d from kept k cross join c{n} c)
  group by vec_id, v"""


def _moved(n: int) -> str:
    return f"""
), s{n} as (
  select m.c as c, i, cast(floor(cast(sum(v[i]) as double) / count(*)) as bigint) as x from a{n}, unnest(range(1, 65)) as r(i) group by m.c, i
), c{n + 1} as (
  select c.c, coalesce(s.v, c.v) as v from c{n} c left join (select c, list(x order by i) as v from s{n} group by c) s on s.c = c.c"""


ORACLE_SQL = (
    """
with kept as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v from kept qualify c < 16"""
    + "".join(_round(n) + _moved(n) for n in range(ORACLE_ROUNDS))
    + _round(ORACLE_ROUNDS)
    + f"""
)
select vec_id, cast(m.c as integer) as cluster, m.d as distance, cast(sum(m.d) over (partition by m.c) as bigint) as cluster_inertia,
       cast(sum(m.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ORACLE_ROUNDS} a join c{ORACLE_ROUNDS} c on c.c = a.m.c
"""
)
