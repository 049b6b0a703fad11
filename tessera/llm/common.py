"""Shared folder, materialisation and small numeric helpers of the training-text operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Ids up to this count may be broadcast (16 bytes each); beyond it the same join is shuffled.
BROADCAST_IDS = 1_000_000
#: Partitions of a shuffle by bucket, at most.
MOST_PARTITIONS = 20_000


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a folder of our own in a local session and one in the warehouse on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what is materialized inside: rows with arrays or long texts then need little memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(*dfs: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in dfs:
        path = getattr(df, "_shared_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows of df whose key is (or, with anti, isn't) in ids. ids is counted first and broadcast only up to BROADCAST_IDS rows."""
    how = "left_anti" if anti else "left_semi"
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def train_row(doc_id) -> object:
    """Column: labels of this row may be learnt from (crc32 of the id's text, modulo 3, is not 1)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1


def dealt_into(spark: SparkSession, groups: int) -> int:
    """Partitions for so many groups: the session's number at least; from MOST_PARTITIONS on a task takes several groups, one after the other."""
    return min(MOST_PARTITIONS, max(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values in an array (none in an empty one)."""
    if not len(keys):
        return []
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True))


def key_groups(batches, key: int = 0):
    """(key, list of record batches) for runs of equal keys in batches that come sorted by that column."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(keys)), strict=True):
            if held and keys[lo] != now:
                yield now, held
                held = []
            now = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held
