"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

#: Edges that a task contracts at a time.
HELD = 100_000


def _stars(pairs, loops: bool = False) -> tuple[list[int], list[int]]:
    """The ids of some edges and the smallest id that each reaches; with loops, also those that are their own."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = [(x, r) for x in parent if (r := root(x)) != x or loops]
    return [x for x, _ in out], [r for _, r in out]


def _contract(batches):
    """Edges (u, v) of a partition as stars around the smallest id that they reach among themselves, HELD edges at a time."""

    def stars(pairs):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(pairs)], names=["u", "v"])

    held: list = []
    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= HELD:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def _settle(batches):
    """id, component of every id in a partition that holds a whole graph of up to HELD edges."""
    held = [e for batch in batches for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(held, loops=True)], names=["id", "component"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component (the smallest id that can be reached) of every id in edges (a, b: long). The result is materialized.

    Tasks first contract the edges that they hold, about HELD each, so a graph of up to HELD edges
    is one task's share and needs no more. Both steps are a grouped minimum (combined
    before the shuffle) and a join that may split hot ids; no neighbourhood is ever held in one
    place. It ends when every edge leads from an id with one edge to an id that is nobody's first.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    n = e.count()
    if n <= HELD:
        out = materialize(e.coalesce(1).mapInArrow(_settle, "id long, component long"), "components")
        release(e)
        return out
    first = materialize(e.coalesce(-(-n // HELD)).mapInArrow(_contract, "u long, v long").distinct(), "contracted")
    release(e)
    e = first
    for _ in range(most):
        settled = e.groupBy("u").agg(F.count("*").alias("n")).withColumnRenamed("u", "x")
        loose = e.join(settled, F.col("v") == F.col("x"), "left_semi").limit(1).unionByName(settled.where("n > 1").select(F.col("x").alias("u"), F.col("x").alias("v")).limit(1))
        if loose.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.mapInArrow(_contract, "u long, v long").distinct(), "small-star")
        release(e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = materialize(out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    release(e)
    return out
