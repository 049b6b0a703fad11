"""Rank fusion, normalisation, deduplication, reranking and diversity over (query_id, chunk_id, doc_id, vertical, score, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring

RRF_K = 60


def ranked(df: DataFrame, score: str, name: str = "rank", key: str = "chunk_id") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), key)))


def rrf(lists: list[DataFrame], k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """query_id, key, rrf: the sum of 1 / (k + rank) over ranked lists (query_id, key, rank)."""
    every = lists[0].select("query_id", key, "rank")
    for df in lists[1:]:
        every = every.unionByName(df.select("query_id", key, "rank"))
    return every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"))


def rrf_of_ranks(ranks: Column, k: int = RRF_K) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1.0 / (k + r))


def hybrid(vector: DataFrame, keyword: DataFrame, sections: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fused rank, score 1 / (rank + 1), then the section boosts above 1."""
    fused = ranked(rrf([vector, keyword], k), "rrf")
    boosted = fused.join(sections, ["query_id", "chunk_id"], "left")
    return boosted.withColumn("score", 1.0 / (F.col("rank") + 1) * F.greatest(scoring.section_boost(F.col("section_type")), F.lit(1.0))).select("query_id", "chunk_id", "rank", "score")


def normalize_scores(df: DataFrame, method: str = "minmax", by: str = "query_id") -> DataFrame:
    """norm_score within each query: min-max (1 where all are equal) or (z + 3) / 6 within 0..1."""
    w = Window.partitionBy(by)
    s = F.col("score")
    if method == "minmax":
        low, high = F.min(s).over(w), F.max(s).over(w)
        return df.withColumn("norm_score", F.when(high == low, 1.0).otherwise((s - low) / (high - low)))
    mean, sd = F.avg(s).over(w), F.stddev_samp(s).over(w)
    z = F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((s - mean) / sd)
    return df.withColumn("norm_score", scoring.clamp((z + 3) / 6, 0.0, 1.0))


def best_per(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The best-scored row of each query and key; with limit the best rows only."""
    w = Window.partitionBy("query_id", key).orderBy(F.desc("score"), "chunk_id")
    out = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return ranked(out, "score").where(F.col("rank") <= limit) if limit else out


def weighted(df: DataFrame, weights: dict, parts: dict[str, float]) -> DataFrame:
    """score by vertical weight, fused = normalised weighted sum of the parts' columns."""
    total = sum(parts.values())
    fused = sum((F.col(c) * (w / total) for c, w in parts.items()), F.lit(0.0))
    return df.withColumn("weighted_score", F.col("score") * scoring.lookup(F.col("vertical"), weights, 1.0)).withColumn("fused", fused)


def light_rerank(df: DataFrame, overlap: Column, metadata: Column, k: int) -> DataFrame:
    out = df.withColumn("rerank_score", F.round(0.7 * F.col("score") + 0.2 * overlap + 0.1 * metadata, 9))
    return ranked(out, "rerank_score").where(F.col("rank") <= k)


def policy_rerank(df: DataFrame, overlap: Column, metadata: Column, k: int, now: int = 2024, act_name: Column | None = None, court: Column | None = None) -> DataFrame:
    """0.4 similarity, 0.2 authority, 0.15 recency, 0.15 overlap, 0.1 metadata; the best k, with up to three verticals among them."""
    s = 0.4 * F.col("score") + 0.2 * scoring.authority(F.col("vertical"), act_name, court) + 0.15 * scoring.recency_steps(F.col("year"), now) + 0.15 * overlap + 0.1 * metadata
    return vertical_diversity(ranked(df.withColumn("rerank_score", F.round(s, 9)), "rerank_score"), k)


def vertical_diversity(df: DataFrame, k: int) -> DataFrame:
    """If the best k hold fewer than three verticals (or than there are), the best of each vertical comes first, then the rest by score."""
    q = Window.partitionBy("query_id")
    out = df.withColumn("_top", F.size(F.collect_set(F.when(F.col("rank") <= k, F.col("vertical"))).over(q))).withColumn("_all", F.size(F.collect_set("vertical").over(q)))
    out = out.withColumn("_v", F.row_number().over(Window.partitionBy("query_id", "vertical").orderBy("rank")))
    first = (F.col("_top") < F.least(F.lit(3), F.col("_all"))) & (F.col("_v") == 1)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(first.cast("int")), "rank")))
    return out.where(F.col("rank") <= k).drop("_top", "_all", "_v")


def brainstorm_rerank(df: DataFrame, k: int = 15, now: int = 2024) -> DataFrame:
    """query_id, pick, chunk_id: 0.3 score, 0.25 innovation, 0.2 recency (a null year counts as 2000), then picks by 0.75 of that and 0.25 of how little their words overlap with those before.

    df (query_id, chunk_id, text, score, year) holds what a search returned, so a query's rows are as many as that search's k.
    """
    text = F.coalesce("text", F.lit(""))
    base = 0.3 * F.col("score") + 0.25 * scoring.innovation(text) + 0.2 * scoring.recency_steps(F.coalesce("year", F.lit(2000)), now)
    return greedy(df.select("query_id", "chunk_id", base.alias("score"), scoring.word_set(text).alias("words")), k, 0.75, None, "words")


def greedy(df: DataFrame, k: int, relevance: float, most: int | None, kind: str) -> DataFrame:
    """Sequential picks within each query over its best `most` candidates (all without it): kind mmr (cosine of embedding) or words (Jaccard of word sets in words)."""
    import numpy as np

    cut = ranked(df, "score").where(F.col("rank") <= most) if most else df

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        if kind == "mmr":
            x = np.array(pdf["embedding"].tolist(), float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            every = x @ x.T
            near = lambda i: every[:, i]
        else:
            ids: dict = {}
            sets = [np.unique(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)) for words in pdf["words"]]
            x = np.zeros((len(sets), len(ids)))
            for row, own in zip(x, sets, strict=True):
                row[own] = 1
            size = x.sum(axis=1)

            def near(i):
                both = x @ x[i]
                return both / np.maximum(1, size + size[i] - both)

        # only rows next to what is chosen are compared, once for each pick
        score, free, close, chosen = pdf["score"].to_numpy(), np.arange(len(pdf)), None, []
        while len(free) and len(chosen) < k:
            value = relevance * score[free] - (1 - relevance) * (np.zeros(len(free)) if close is None else close[free])
            best = int(free[np.argmax(np.round(value, 9))])
            chosen.append(best)
            free = free[free != best]
            close = near(best) if close is None else np.maximum(close, near(best))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[chosen].to_numpy(), "pick": np.arange(1, len(chosen) + 1), "chunk_id": pdf["chunk_id"].iloc[chosen].to_numpy()})

    return cut.groupBy("query_id").applyInPandas(pick, "query_id long, pick int, chunk_id long")


def by_priority(sources: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """Rows (query_id, chunk_id, score) of several sources, those of higher priority first, each source in its own order, with numbers from 1, 101, 201, ..."""
    out = None
    for i, (name, weight, df) in enumerate(sources):
        part = ranked(df, "score", "place").select("query_id", "chunk_id", "score", F.lit(name).alias("source"), F.lit(weight).alias("priority"), (F.col("place") + 100 * i).alias("number"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("priority"), "number")))


# fixed values: weights of stored and of web results, addresses of the government and what they count
LOCAL_WEIGHT, WEB_WEIGHT, GOVERNMENT_HOSTS, GOVERNMENT_FACTOR = 0.7, 0.3, ["gov.in", "nic.in"], 1.5


def merge_web(local: DataFrame, web: DataFrame, k: int) -> DataFrame:
    """query_id, rank, origin, item, score: the best k of stored results (query_id, item, score) and web results (query_id, item, rank, source) together.

    A stored result counts LOCAL_WEIGHT of its score, a web result WEB_WEIGHT / rank, more from the government.
    Null scores count 0, null ranks 1; of equal scores stored results come first, then smaller items.
    """
    source = F.coalesce("source", F.lit(""))
    ours = F.when(F.exists(F.array(*map(F.lit, GOVERNMENT_HOSTS)), lambda h: source.contains(h)), GOVERNMENT_FACTOR).otherwise(1.0)
    stored = local.select("query_id", F.lit("local").alias("origin"), F.lit(0).alias("side"), "item", (F.coalesce("score", F.lit(0.0)) * LOCAL_WEIGHT).alias("score"))
    found = web.select("query_id", F.lit("web").alias("origin"), F.lit(1).alias("side"), "item", (1.0 / F.coalesce("rank", F.lit(1)) * ours * WEB_WEIGHT).alias("score"))
    both = stored.unionByName(found).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "side", "item"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "origin", "item", "score")


def reorder_by_ids(df: DataFrame, orders: DataFrame) -> DataFrame:
    """df (query_id, chunk_id, score) with place: results that a query's ids (query_id, ids array) name come first, in that order, then the others by score.

    An id named twice counts where it stands first, ids of no result are passed over, and a query without ids keeps its order.
    """
    named = orders.select("query_id", F.posexplode("ids").alias("_at", "chunk_id")).groupBy("query_id", "chunk_id").agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_at").asc_nulls_last(), F.desc("score"), "chunk_id"))
    return df.join(named, ["query_id", "chunk_id"], "left").withColumn("place", place).drop("_at")


def interleave(a: DataFrame, b: DataFrame, n: int, m: int) -> DataFrame:
    """n of a, m of b, and so on, by rank."""
    left = a.select("query_id", "chunk_id", F.lit(0).alias("side"), F.floor((F.col("rank") - 1) / n).alias("turn"), "rank")
    right = b.select("query_id", "chunk_id", F.lit(1).alias("side"), F.floor((F.col("rank") - 1) / m).alias("turn"), "rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "side", "rank"))
    return left.unionByName(right).withColumn("place", place).select("query_id", "chunk_id", "side", "place")


def early_exit(df: DataFrame) -> DataFrame:
    """query_id, stop: the best score over 0.8 and the mean of the best three over 0.75."""
    top = ranked(df, "score").where("rank <= 3")
    return top.groupBy("query_id").agg(((F.max("score") > 0.8) & (F.avg("score") > 0.75)).alias("stop"))
