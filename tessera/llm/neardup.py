"""Near-duplicate embeddings by NN-descent.

Equal vectors are one node with a count. A neighbour graph starts from groups of a few random
hyperplane codes and is refined: neighbours of a node become candidates of each other (half
precision, for the search only), and each node keeps its best. Nodes whose list is full of near
duplicates get a longer one. Edges above the threshold are proved in double precision and kept;
an audit compares a sample of vectors, another one each time and with a share from components over
LONGEST, with all others. Links that it finds missing are kept, and a further round starts from other
codes. If the audit after ROUNDS rounds still finds some, every pair of vectors is compared, so no link
between components is left out; else what the last audit did not sample is not proved. Recall is logged.

All links lie inside components of the kept edges, so the numbers of links come from exact block
products inside each component, in tiles of a set size; no pair is emitted for them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different dimensions don't link; rows without vec_id are left out; of rows that
repeat a vec_id the one with the smallest fingerprint counts; an empty table gives no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import key_groups, materialize, release
from tessera.llm.components import components

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Neighbours kept, and the longest list that a saturated node may grow to before its component's exact count takes over.
NEIGHBOURS, LONGEST = 8, 64
#: Hyperplane codes in a round, and vectors in a code's group on average.
CODES, LEAF = 3, 96
#: Rounds of refinement from one set of codes; a round ends sooner when fewer than this share of lists change.
REFINE, SETTLED = 4, 0.01
#: Vectors that are compared with all others in an audit (as many again from components over LONGEST), and rounds of codes before every pair is compared.
AUDIT, ROUNDS = 256, 3
#: Vectors on a side of a tile of exact counts.
TILE = 512
#: What half precision may lose of a cosine.
SLACK = 0.01


def unit(values) -> np.ndarray | None:
    """The vector in double precision at length 1, or None if it has no direction."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    v = np.asarray(values, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every vector, node null for those that link with nothing; and (id, copies, dims, unit, half) of each node."""
    fp = F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json("embedding"), 256))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    rows = rows.withColumn("fp", fp).groupBy("vec_id").agg(F.min_by("embedding", "fp").alias("embedding"), F.min("fp").alias("fp"))
    schema = pa.schema([("vec_id", pa.int64()), ("fp", pa.string()), ("unit", pa.binary())])

    def units(batches):
        for batch in batches:
            made = [None if (u := unit(v)) is None else u.tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(made, pa.binary())], schema=schema)

    every = materialize(rows.select("vec_id", "fp", "embedding").mapInArrow(units, "vec_id long, fp string, unit binary"), "vectors")
    good = every.where("unit is not null")
    first = materialize(good.groupBy("fp").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "first-copies")
    table = good.join(first, (good["vec_id"] == first["id"]) & (good["fp"] == first["fp"])).select("id", "copies", F.expr("octet_length(unit) div 8").alias("dims"), "unit")
    member = every.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("fp")).alias("fp")).join(first.select("fp", F.col("id").alias("node")), "fp", "left")
    return member.select("vec_id", "node"), materialize(table, "nodes")


def _halves(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b.as_py(), np.float16) for b in blobs]).astype(np.float32)


def coded(table: DataFrame, n: int, seed: int) -> DataFrame:
    """(code, id, half): each node under CODES hyperplane codes of its vector."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))

    def codes(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([np.frombuffer(batch.column(2)[int(k)].as_py(), np.float64) for k in at])
                half = [r.tobytes() for r in x.astype(np.float16)]
                if d not in planes:
                    planes[d] = np.random.RandomState(seed * 1009 + int(d)).standard_normal((CODES, int(d), depth))
                for t in range(CODES):
                    bits = (x @ planes[d][t] > 0).astype(np.int64) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(at), np.int64)
                    code = (bits * CODES + t) * 65_536 + int(d)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(ids[at]), pa.array(half, pa.binary())], names=["code", "id", "half"])

    return table.select("id", "dims", "unit").mapInArrow(codes, "code long, id long, half binary")


def _best_edges(ids: np.ndarray, sims: np.ndarray, most: int):
    """Each row's `most` best others as (u, v, s)."""
    np.fill_diagonal(sims, -2)
    k = min(most, len(ids) - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(sims, at, 1).ravel()


EDGES = "u long, v long, s float"


def first_edges(table: DataFrame, n: int, seed: int) -> DataFrame:
    """Edges inside the groups of each code; groups over four leaves are split by a hash of the id, another one in each code table and round."""
    rows = coded(table, n, seed)
    sizes = rows.groupBy("code").agg(F.ceil(F.count("*") / (4 * LEAF)).cast("int").alias("parts"))
    rows = rows.join(sizes, "code").withColumn("group", F.xxhash64("code", F.pmod(F.xxhash64(F.lit(seed), F.pmod("code", F.lit(65_536 * CODES)), "id"), F.col("parts")))).select("group", "id", "half")

    def link(batches):
        for _, part in key_groups(batches):
            t = pa.Table.from_batches(part)
            if t.num_rows < 2:
                continue
            ids, x = t.column(1).to_numpy(), _halves(t.column(2))
            u, v, s = _best_edges(ids, x @ x.T, NEIGHBOURS)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s, pa.float32())], names=["u", "v", "s"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(link, EDGES)


def best_lists(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Each node's best distinct neighbours: NEIGHBOURS of them, or as many as sizes (u, size) says."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    flat = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    ranked = flat.withColumn("r", rank).where(F.col("r") <= LONGEST)
    if sizes is None:
        return ranked.where(F.col("r") <= NEIGHBOURS).drop("r")
    return ranked.join(sizes, "u", "left").where(F.col("r") <= F.coalesce("size", F.lit(NEIGHBOURS))).select("u", "v", "s")


def neighbours_join(graph: DataFrame, table: DataFrame) -> DataFrame:
    """Candidate edges between the neighbours of each node: those it lists, and the best that list it."""
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "s")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "x"))).where(F.col("r") <= NEIGHBOURS).select("w", "x")
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("x")).unionByName(back).distinct()
    half = table.mapInArrow(_to_half, "x long, half binary")

    def local(batches):
        for _, part in key_groups(batches):
            t = pa.Table.from_batches(part)
            if t.num_rows < 2:
                continue
            ids, x = t.column(1).to_numpy(), _halves(t.column(2))
            u, v, s = _best_edges(ids, x @ x.T, NEIGHBOURS // 2)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s, pa.float32())], names=["u", "v", "s"])

    return around.join(half, "x").select("w", "x", "half").repartition("w").sortWithinPartitions("w").mapInArrow(local, EDGES)


def _to_half(batches):
    for batch in batches:
        ids, blobs = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("unit"))
        half = [np.frombuffer(b.as_py(), np.float64).astype(np.float16).tobytes() for b in blobs]
        yield pa.RecordBatch.from_arrays([ids, pa.array(half, pa.binary())], names=["x", "half"])


def descend(table: DataFrame, n: int, seed: int, threshold: float) -> DataFrame:
    """The refined neighbour graph (u, v, s) from one set of codes."""
    graph = materialize(best_lists(first_edges(table, n, seed), None), "graph")
    sizes = None
    for _ in range(REFINE):
        # a list that is full of near duplicates may hide more: it doubles
        full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("worst"))
        full = full.where((F.col("worst") >= threshold - SLACK) & (F.col("n") >= NEIGHBOURS)).select("u", F.least(F.col("n") * 2, F.lit(LONGEST)).cast("int").alias("size"))
        sizes = materialize(full, "list-sizes")
        new = materialize(best_lists(graph.unionByName(neighbours_join(graph, table)), sizes), "graph")
        changed = new.join(graph, ["u", "v"], "left_anti").count()
        release(graph, sizes)
        graph = new
        if changed <= SETTLED * NEIGHBOURS * n:
            break
    return graph


def proved(edges: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose cosine in double precision is threshold or more."""
    side = lambda c: table.select(F.col("id").alias(c), F.col("dims").alias(f"d_{c}"), F.col("unit").alias(f"x_{c}"))
    near = edges.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def prove(batches):
        for batch in batches:
            ok = [float(np.frombuffer(x.as_py()) @ np.frombuffer(y.as_py())) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    joined = near.join(side("a"), "a").join(side("b"), "b").where("d_a = d_b").select("a", "b", "x_a", "x_b")
    return joined.mapInArrow(prove, "a long, b long")


def audit(table: DataFrame, labels: DataFrame, n: int, threshold: float, seed: int) -> tuple[float, DataFrame]:
    """Share of a sample's links that lie inside components, and the links that don't. The sample is compared with every vector."""
    mark = F.pmod(F.xxhash64(F.lit(5), F.lit(seed), "id"), F.lit(1_000_000))
    chosen = lambda of: mark < int(1_000_000 * min(1.0, AUDIT / max(1, of))) + 1
    sample = table.where(chosen(n)).select("id", "dims", "unit").limit(4 * AUDIT).collect()
    # components that lists can't hold whole are the ones that may be cut: they get a sample of their own
    large = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > LONGEST)
    inside = labels.join(large.select("component"), "component", "left_semi").select("id")
    sample += table.join(inside.where(chosen(inside.count())), "id", "left_semi").select("id", "dims", "unit").limit(4 * AUDIT).collect()
    sample = list({r["id"]: r for r in sample}.values())
    by_dims: dict[int, list] = {}
    for r in sample:
        by_dims.setdefault(r["dims"], []).append((r["id"], bytes(r["unit"])))
    shared = table.sparkSession.sparkContext.broadcast(by_dims)  # AUDIT vectors

    def compare(batches):
        mine = {d: (np.array([i for i, _ in rows]), np.stack([np.frombuffer(b) for _, b in rows])) for d, rows in shared.value.items()}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in set(dims.tolist()) & set(mine):
                at = np.flatnonzero(dims == d)
                x = np.stack([np.frombuffer(batch.column(2)[int(k)].as_py()) for k in at])
                p, q = np.nonzero(mine[d][1] @ x.T >= threshold)
                a, b = mine[d][0][p], ids[at][q]
                ok = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

    found = table.select("id", "dims", "unit").mapInArrow(compare, "a long, b long").distinct()
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    found = found.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("ok", F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False)))
    found = materialize(found.select("a", "b", "ok"), "audit")
    total, good = found.agg(F.count("*"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0))).first()
    return good / total if total else 1.0, found.where("not ok").select("a", "b")


def across(table: DataFrame, labels: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of components that some link joins, by block products of all vectors with all others."""
    parts = max(1, -(-n // (8 * TILE)))
    rows = table.join(labels, "id", "left").select(F.coalesce("component", "id").alias("component"), "dims", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "unit")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tile = F.least("part", "other").cast("long") * parts + F.greatest("part", "other")
    rows = rows.select(tile.alias("tile"), "component", "dims", (F.col("part") <= F.col("other")).alias("low"), (F.col("part") == F.col("other")).alias("same"), "unit")

    def tiles(batches):
        for _, group in key_groups(batches):
            t = pa.Table.from_batches(group)
            component, dims = (t.column(k).to_numpy() for k in (1, 2))
            low, same = (t.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (3, 4))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([np.frombuffer(t.column(5)[int(k)].as_py()) for k in at])
                own = component[at]
                left = np.flatnonzero(low[at])
                right = left if same[at].all() else np.flatnonzero(~low[at])
                found: set = set()
                for k in range(0, len(left), TILE):
                    p, q = np.nonzero(x[left[k : k + TILE]] @ x[right].T >= threshold)
                    a, b = own[left[k + p]], own[right[q]]
                    ok = a != b
                    found |= set(zip(np.minimum(a, b)[ok].tolist(), np.maximum(a, b)[ok].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(tiles, "a long, b long").distinct()


def count_links(table: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): linked vectors of other nodes, copies included, by block products inside each component."""
    rows = table.join(labels, "id").select("component", "id", "copies", "dims", "unit")
    parts = rows.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    rows = rows.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # tile (i, j) with i <= j: a vector of part p goes to (p, j) for j >= p and to (i, p) for i < p
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    tile = F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(tile.alias("tile"), "id", "copies", "dims", (F.col("part") <= F.col("other")).alias("low"), (F.col("part") == F.col("other")).alias("same"), "unit")

    def tiles(batches):
        for _, group in key_groups(batches):
            t = pa.Table.from_batches(group)
            ids, copies, dims = (t.column(k).to_numpy() for k in (1, 2, 3))
            low, same = (t.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (4, 5))
            linked = np.zeros(len(ids), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([np.frombuffer(t.column(6)[int(k)].as_py()) for k in at])
                if same[at].all():
                    near = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    linked[at] += near @ copies[at]
                else:
                    p, q = np.flatnonzero(low[at]), np.flatnonzero(~low[at])
                    near = x[p] @ x[q].T >= threshold
                    linked[at[p]] += near @ copies[at[q]]
                    linked[at[q]] += near.T @ copies[at[p]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked)], names=["id", "linked"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(tiles, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vec_id of df (vec_id, embedding)."""
    member, table = nodes(df)
    n = table.count()
    edges: list[DataFrame] = []

    def joined() -> DataFrame:
        union = edges[0]
        for e in edges[1:]:
            union = union.unionByName(e)
        return components(union)

    for seed in range(ROUNDS):
        graph = descend(table, n, seed, threshold)
        edges.append(materialize(proved(graph, table, threshold), "near-edges"))
        release(graph)
        labels = joined()
        recall, missed = audit(table, labels, n, threshold, seed)
        log.info("round %d: audited recall %.6f", seed + 1, recall)
        if recall >= 1.0:
            break
        edges.append(missed)
        release(labels)
        labels = joined()
    else:
        log.warning("audited recall %.6f after %d rounds: all %d vectors are compared with all others", recall, ROUNDS, n)
        edges.append(materialize(across(table, labels, n, threshold), "across"))
        release(labels)
        labels = joined()
    linked = count_links(table, labels, threshold)
    facts = table.select("id", "copies").join(labels, "id", "left").join(linked, "id", "left")
    facts = materialize(facts.select(F.col("id").alias("node"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "node-facts")
    out = member.join(facts, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
