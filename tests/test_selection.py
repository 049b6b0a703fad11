"""Selection by category against plain loops over each query's results."""

import random
from collections import Counter

from tessera.operators import selection


def rows(seed, queries=6, n=80):
    rng = random.Random(seed)
    out = []
    for q in range(queries):
        predicted = rng.sample(["a", "b", "c", "d"], rng.randint(0, 3))
        for i in range(rng.choice([1, 5, n])):
            own = [c for c in predicted if rng.random() < 0.3] or predicted[:1]
            out.append((q, q * 1000 + i, round(rng.random(), 2), rng.choice(["a", "b", "x", None]), predicted, own))
    return out


def plain_cover(results, k, minimum, weight):
    results = sorted(results, key=lambda r: (-r[2], r[1]))
    predicted, chosen = results[0][4], []
    for c in predicted:
        chosen += [r for r in results if c in r[5] and r not in chosen][:minimum]
    chosen = chosen[:k]
    count = Counter(r[3] for r in chosen)
    value = lambda r: (1 - weight) * r[2] + weight * sum({0: 0.3, 1: 0.1}.get(count[c], 0) for c in r[5]) if predicted else r[2]
    rest = sorted((r for r in results if r not in chosen), key=lambda r: (-round(value(r), 9), -r[2], r[1]))
    return [r[1] for r in (chosen + rest)[:k]]


def test_minimum_for_each_category(spark):
    schema = "query_id long, chunk_id long, score double, vertical string, predicted array<string>, assigned array<string>"
    for seed, k, minimum in ((1, 20, 1), (2, 5, 2), (3, 3, 3)):
        data = rows(seed)
        out = selection.cover_categories(spark.createDataFrame(data, schema), k, minimum).orderBy("query_id", "rank").collect()
        for q in {r[0] for r in data}:
            assert [r.chunk_id for r in out if r.query_id == q] == plain_cover([r for r in data if r[0] == q], k, minimum, 0.4)


def plain_penalty(results, k, weight):
    left, seen, out = sorted(results, key=lambda r: (-r[2], r[1])), Counter(), []
    while left and len(out) < k:
        values = [round(r[2] - weight * seen[r[3]], 9) for r in left]
        at = values.index(max(values)) if max(values) > -1 else 0
        seen[left[at][3]] += 1
        out.append(left.pop(at)[1])
    return out


def test_penalty_grows_with_each_pick(spark):
    schema = "query_id long, chunk_id long, score double, vertical string"
    data = [r[:4] for r in rows(4)] + [(9, i, 0.9, "one") for i in range(30)]
    out = selection.penalise_categories(spark.createDataFrame(data, schema)).orderBy("query_id", "pick").collect()
    for q in {r[0] for r in data}:
        assert [r.chunk_id for r in out if r.query_id == q] == plain_penalty([r for r in data if r[0] == q], 20, 0.3)


def test_empty(spark):
    schema = "query_id long, chunk_id long, score double, vertical string, predicted array<string>, assigned array<string>"
    empty = spark.createDataFrame([], schema)
    assert selection.cover_categories(empty).collect() == [] and selection.penalise_categories(empty).collect() == []
