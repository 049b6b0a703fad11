import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.components import components


def plain(rows, threshold=0.95):
    good = [(i, u) for i, v in rows if (u := neardup.unit(v)) is not None]
    parent = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u) in enumerate(good):
        for j, v in good[a + 1 :]:
            if len(u) == len(v) and u @ v >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, links[i], root(i), root(i) == i) for i, _ in rows)


def result(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int")
    return sorted(tuple(r) for r in neardup.near_duplicates(df).collect())


def test_clusters_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.RandomState(4)
    vecs = []
    for size in (90, 12, 5, 2):
        c = rng.standard_normal(24)
        vecs += [(c + rng.standard_normal(24) * 0.13).astype(np.float32).tolist() for _ in range(size)]
    vecs += [rng.standard_normal(24).astype(np.float32).tolist() for _ in range(150)]
    vecs += [vecs[0]] * 40 + [[2 * x for x in vecs[3]]] + [None, [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24, [], vecs[0][:12], vecs[0][:12]]
    order = rng.permutation(len(vecs))
    rows = [(int(k), v) for k, v in zip(order, vecs, strict=True)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert result(spark, rows) == plain(rows)


def test_empty_and_repeated(spark):
    assert result(spark, []) == []
    assert result(spark, [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.1])]) == [(3, 1, 3, True), (5, 1, 3, False)]


def test_recall_on_sample_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r[0]: r for r in (tuple(x) for x in neardup.near_duplicates(df).collect())}
    want = plain(rows)
    assert sum(got[i][1] for i, *_ in want) >= 0.99 * sum(w[1] for w in want)
    assert sum(got[i] == w for w in want for i in [w[0]]) >= 0.99 * len(want)


def test_code_tables_split_large_groups_differently(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    rng = np.random.RandomState(6)
    c = rng.standard_normal(24)
    rows = [(i, (c + rng.standard_normal(24) * 1e-4).tolist()) for i in range(90)]
    _, table = neardup.nodes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # groups of 90 are split in six; no part of one table may be a part of every other
    edges = neardup.first_edges(table, 90, 0).select(F.col("u").alias("a"), F.col("v").alias("b"))
    assert components(edges).where("component = 0").count() == 90


def test_links_that_the_rounds_miss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "AUDIT", 8)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    rng = np.random.RandomState(7)
    rows = []
    for size in (60, 9, 3):
        c = rng.standard_normal(16)
        rows += [(c + rng.standard_normal(16) * 0.02).tolist() for _ in range(size)]
    rows = [(i, v) for i, v in enumerate(rows + [rng.standard_normal(16).tolist() for _ in range(30)])]
    # a search that never links an even id with an odd one
    search = neardup.proved
    monkeypatch.setattr(neardup, "proved", lambda *a: search(*a).where("a % 2 = b % 2"))
    assert result(spark, rows) == plain(rows)
