"""From documents to packed training sequences: toxicity, line dedup, n-gram Jaccard join, mixing, best-fit packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
run() writes each stage's result to the shared folder and reads it back as the next one's docs.
All stages but the last return the columns of documents; a docs table may have more columns, whatever
their names, which stay. Null texts count as empty (toxicity, n-gram join, packing) or stay null (line dedup,
mixing); rows without doc_id pass the first two stages, and an empty table gives an empty result everywhere. Rows that
repeat a doc_id are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linededup, mixing, ngramjoin, packing, toxicity
from tessera.llm.common import keep_ids, materialize, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the training folds of labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier document holds; n_chars follows the text (a text that is left empty keeps its row)."""
    out = linededup.line_dedup(docs, report=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are similar, directly or through others, the one with the smallest id; all others stay."""
    groups = ngramjoin.join_components(docs.select("doc_id", "text"))
    copies = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return keep_ids(docs, copies, "doc_id", anti=True).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of sources that the target weights ask for again in further epochs. The rows aren't put in the schedule's order, since packing deals them anew by length."""
    return mixing.mix(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the learnt, greedy and scheduled stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        new = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
