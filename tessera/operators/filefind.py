"""Stored files by a name that is only roughly theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import substrings
from tessera.sources import files

LEAST_LETTERS = 6


def _base(low: Column) -> Column:
    return F.replace(F.replace(low, F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(""))


def _letters(low: Column) -> Column:
    return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")


def find(searches: DataFrame, paths: DataFrame) -> DataFrame:
    """name, path, exact: for each distinct name of searches the stored path that is meant (column path), without case.

    The first path, in their order, that ends with the name; else the shortest that ends with the name without
    its leading number, or that is a PDF and contains the name without its ending and underscores or (from
    LEAST_LETTERS on) its letters and digits alone. Names that nothing is like have no row; names of which nothing is left match nothing.
    """
    names = files.written(searches.select("name").where("name is not null").distinct().withColumn("low", F.lower("name")), "names")
    stored = files.written(paths.select("path").distinct().withColumn("low", F.lower("path")), "paths")
    # (written files look small beside what they hold: the joins sort rather than broadcast)
    ends = lambda asked: substrings.matches(stored, asked, "path", "low").where(F.endswith(F.lower("path"), "needle"))
    exact = ends(names.select(F.col("low").alias("needle"))).groupBy("needle").agg(F.min("path").alias("path"))
    exact = files.written(names.join(exact.hint("merge"), F.col("low") == F.col("needle")).select("name", "path", F.lit(True).alias("exact")), "exact-names")

    rest = files.written(names.join(exact.hint("merge"), "name", "left_anti"), "other-names")
    documents = stored.where(F.endswith("low", F.lit(".pdf")))
    forms = [
        (F.regexp_extract("low", r"(?s)^\d+_(.*)$", 1), None),
        (_base(F.col("low")), documents.select("path", F.replace(_base(F.col("low")), F.lit("/"), F.lit("")).alias("low"))),
        (F.when(F.length(_letters(_base(F.col("low")))) >= LEAST_LETTERS, _letters(_base(F.col("low")))), documents.select("path", _letters(F.col("low")).alias("low"))),
    ]
    best = None
    for needle, texts in forms:
        asked = rest.select("name", needle.alias("needle"))
        hits = ends(asked) if texts is None else substrings.matches(texts, asked, "path", "low")
        shortest = hits.groupBy("needle").agg(F.min(F.struct(F.length("path").alias("size"), "path")).alias("e"))
        one = asked.join(shortest.hint("merge"), "needle").select("name", "e")
        best = one if best is None else best.unionByName(one)
    return exact.unionByName(best.groupBy("name").agg(F.min("e").alias("e")).select("name", F.col("e.path").alias("path"), F.lit(False).alias("exact")))
