"""Exact dedup with a heavy-hitter split.

Texts are reduced to their SHA-256 digests once. Misra-Gries summaries of COUNTERS counters, one a partition,
are merged by a groupBy into the candidates for frequent digests. An exact count over the candidates' rows
(pre-aggregated where they lie) verifies them and gives each winner its kept document and its size. The
winners, COUNTERS rows at most, are broadcast: their documents are settled where they lie, so no group
that holds a large share of the rows is ever shuffled. All other digests are dealt over the shuffle.

Why the split is exact: a partition of m rows loses at most m / (COUNTERS + 1) of a digest's count in its summary, and as much
again by not reporting smaller counts. Candidates have a merged count over n / (COUNTERS + 1), hence they are at most
COUNTERS, and every digest with more than 3 n / (COUNTERS + 1) rows is one. Which digests are split changes
how rows travel, never what they get.

Defined results: null texts count as empty; of equal texts the row with the largest doc_id stays, null doc_ids count as
smallest (a group that has no other is kept whole, keep_id null); rows that repeat both doc_id and text
are one document: they are counted each and are kept or dropped together; a doc_id with two texts belongs to both groups. An empty table gives an
empty result; texts of any length are one digest. Other columns, whatever their names, stay in dedup().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, materialize

#: Counters of a partition's summary; a digest of more than 3 / (COUNTERS + 1) of all rows is always split off.
COUNTERS = 1023


def digest_of(text):
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def lower_to(held: dict, counters: int) -> dict:
    """Misra-Gries step on a full summary: take the (counters + 1)-th largest count from all, drop what is not above it."""
    if len(held) <= counters:
        return held
    least = sorted(held.values(), reverse=True)[counters]
    return {d: c - least for d, c in held.items() if c > least}


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be frequent: at most `counters` rows."""

    def summary(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, n = {}, 0
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for d, c in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
                held[d] = held.get(d, 0) + c
            n += batch.num_rows
            held = lower_to(held, counters)
        held = {d: c for d, c in held.items() if c * (counters + 1) > n}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    total = rows.count()
    merged = rows.select("digest").mapInArrow(summary, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.where((F.col("n") > 1) & (F.col("n") * (counters + 1) > total)).select("digest")


def groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of every row of docs."""
    rows = materialize(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    candidates = F.broadcast(frequent(rows, counters))
    counted = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = F.broadcast(materialize(counted, "frequent-digests"))  # as many rows as candidates at most
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    columns = ["doc_id", "digest", "keep_id", "group_size", kept]
    heavy = rows.join(winners, "digest").select(*columns)
    same = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").withColumn("keep_id", F.max("doc_id").over(same)).withColumn("group_size", F.count("*").over(same))
    return heavy.unionByName(rest.select(*columns))


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs without the rows whose text a document with a larger doc_id holds as well."""
    found = groups(docs.select("doc_id", "text"), counters).where("not kept").select(F.struct("doc_id", "digest").alias("k")).distinct()
    found = materialize(found, "dropped-digests")
    drop = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mine = F.struct(F.col("row.doc_id").alias("doc_id"), digest_of(F.col("row.text")).alias("digest"))
    left = rows.withColumn("k", mine).join(drop, "k", "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op13_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
