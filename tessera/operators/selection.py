"""Choosing results so that categories are covered: a minimum for each predicted category, then a bonus or a growing penalty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cover_categories(df: DataFrame, k: int = 20, minimum: int = 1, weight: float = 0.4) -> DataFrame:
    """query_id, rank, chunk_id of k results of each query.

    df: query_id, chunk_id, score, vertical, predicted (the query's categories in order), assigned (those of them that
    the result belongs to). First `minimum` of the best results of each predicted category, each result once;
    then the others by (1 - weight) score + weight bonus, where each category of a result adds 0.3 if no chosen
    result has it as its vertical, 0.1 if one has. Queries without predicted categories keep the order of scores. Ties go to the smaller chunk_id.
    """
    by_score = [F.desc("score"), F.asc("chunk_id")]
    each = df.select("query_id", "chunk_id", "score", F.posexplode("predicted").alias("place", "category"), "assigned", F.size("predicted").alias("n")).where(F.array_contains("assigned", F.col("category")))
    # a category's own picks lie among its best: at most all categories' picks may be taken before it
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "place").orderBy(*by_score))).where(F.col("r") <= F.col("n") * minimum)

    # category by category, results that none before has taken
    none = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(-1).alias("place"), F.lit(0).alias("taken"))

    def take(s, e):
        taken = F.when(s["place"] == e["place"], s["taken"]).otherwise(0)
        fits = (taken < minimum) & (F.size(s["out"]) < k) & ~F.array_contains(s["out"], e["chunk_id"])
        return F.struct(F.when(fits, F.array_append(s["out"], e["chunk_id"])).otherwise(s["out"]).alias("out"), e["place"].alias("place"), F.when(fits, taken + 1).otherwise(taken).alias("taken"))

    entries = F.array_sort(F.collect_list(F.struct("place", "r", F.col("chunk_id").cast("long").alias("chunk_id"))))
    taken = best.groupBy("query_id").agg(entries.alias("entries")).select("query_id", F.aggregate("entries", none, take, lambda s: s["out"]).alias("out"))
    picks = taken.select("query_id", F.posexplode("out").alias("pick", "chunk_id")).withColumn("pick", F.col("pick") + 1)
    marked = df.join(picks, ["query_id", "chunk_id"], "left")
    chosen = F.collect_list(F.when(F.col("pick").isNotNull(), F.col("vertical"))).over(Window.partitionBy("query_id"))
    bonus = F.aggregate("assigned", F.lit(0.0), lambda s, c: s + F.when(F.size(F.filter("_chosen", lambda v: v == c)) == 0, 0.3).when(F.size(F.filter("_chosen", lambda v: v == c)) == 1, 0.1).otherwise(0.0))
    value = F.when(F.size("predicted") == 0, F.col("score")).otherwise((1.0 - weight) * F.col("score") + weight * bonus)
    # only the best k without bonus and, for each set of categories, the best k with it can follow
    near = F.row_number().over(Window.partitionBy("query_id", "assigned").orderBy(*by_score)) <= k
    cut = marked.withColumn("_near", near).where("_near or pick is not null").withColumn("_chosen", chosen).withColumn("_value", F.round(value, 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("pick"), F.desc("_value"), *by_score))
    return cut.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id")


def penalise_categories(df: DataFrame, k: int = 20, weight: float = 0.3, category: str = "vertical") -> DataFrame:
    """query_id, pick, chunk_id: k picks one after the other, each the highest score less `weight` for every earlier pick of its category (first of equals; the first one left when all are at -1 or below).

    Within a category picks follow the order of scores, so k results of each category are all that can be picked.
    """
    r = F.row_number().over(Window.partitionBy("query_id", category).orderBy(F.desc("score"), "chunk_id"))
    cut = df.select("query_id", "chunk_id", "score", F.coalesce(F.col(category), F.lit("unknown")).alias("category"), r.alias("r")).where(F.col("r") <= k)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = list(pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).itertuples())
        seen: dict = {}
        out = []
        while left and len(out) < k:
            at, best = 0, -1.0
            for i, row in enumerate(left):
                value = round(row.score - weight * seen.get(row.category, 0), 9)
                if value > best:
                    at, best = i, value
            row = left.pop(at)
            seen[row.category] = seen.get(row.category, 0) + 1
            out.append((row.query_id, len(out) + 1, row.chunk_id))
        return pd.DataFrame(out, columns=["query_id", "pick", "chunk_id"])

    return cut.groupBy("query_id").applyInPandas(pick, "query_id long, pick int, chunk_id long")


def prefer_domains(df: DataFrame, domains: list[str], everywhere) -> DataFrame:
    """Results of a query whose address holds one of the domains; all of them where there is none or where `everywhere` is true. The address is url, else source."""
    address = F.lower(F.coalesce(F.nullif("url", F.lit("")), F.nullif("source", F.lit("")), F.lit("")))
    good = F.exists(F.array(*map(F.lit, domains)), lambda x: address.contains(x))
    marked = df.withColumn("_good", good).withColumn("_any", F.max(good.cast("int")).over(Window.partitionBy("query_id")))
    return marked.where(everywhere | (F.col("_any") == 0) | F.col("_good")).drop("_good", "_any")
