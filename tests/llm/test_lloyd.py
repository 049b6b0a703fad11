import hashlib
import math
import random

import numpy as np

from tessera.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """The same rounds in whole numbers of Python: (vec_id, cluster, distance), centroids."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [max(-lloyd.BOUND, min(lloyd.BOUND, math.floor(scale * float(np.float32(x))))) for x in e]))
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(r[0]), r[1]))[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [near(v)[0] for _, v in kept]
        moved = []
        for c, old in enumerate(centroids):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            moved.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else old)
        centroids = moved
    return [(i, *near(v)) for i, v in kept], centroids


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def check(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, e, "x", 7) for i, e in rows], SCHEMA).repartition(parts)
    assigned, centroids = lloyd.lloyd(df, **options)
    want, want_centroids = plain(rows, **options)
    out = lloyd.with_inertia(assigned, centroids).collect() if len(centroids) else []
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=key) == sorted(want, key=key)
    assert [c.tolist() for c in centroids] == want_centroids
    total = sum(d for *_, d in want)
    for r in out:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.inertia == (total if total < 1 << 63 else None)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centroids[r.cluster])).encode()).hexdigest()
    return out


def test_against_whole_numbers(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres[: 1 if i % 3 else 9])]) for i in range(400)]  # a third to two thirds in one place
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(7, rows[1][1]), (None, rows[2][1])]
    out = check(spark, rows)
    assert len(out) == len(rows) and {r.vec_id for r in out} >= {None, 7}


def test_ties_go_to_the_lowest_number_and_empty_clusters_stay(spark):
    one = [(i, [0.5] * 64) for i in range(20)]
    out = check(spark, one)
    assert {r.cluster for r in out} == {0}
    check(spark, [(i, [1.0 if i % 2 else -1.0] + [0.0] * 63) for i in range(40)])


def test_vectors_that_take_no_part(spark):
    good = [(i, [i / 7.0 - 1] * 64) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] + [1.0] * 63), (55, [float("nan")] + [1.0] * 63), (56, [float("-inf")] + [1.0] * 63)]
    assert {r.vec_id for r in check(spark, good + bad)} == set(range(20))


def test_fewer_vectors_than_centroids_none_and_large_values(spark):
    assert len(check(spark, [(1, [0.1] * 64), (2, [-0.1] * 64)])) == 2
    assert check(spark, []) == []
    assert lloyd.with_inertia(*lloyd.lloyd(spark.createDataFrame([], SCHEMA))).collect() == []
    check(spark, [(i, [3e38 * (-1) ** i] * 64) for i in range(5)] + [(9, [0.0] * 64)], k=2)


def test_other_parameters(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(90)], k=4, rounds=6, dims=5, scale=1000)
