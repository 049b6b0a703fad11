import random

from tessera.llm import components as module


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in parent)


def test_components(spark, monkeypatch):
    monkeypatch.setattr(module, "HELD", 7)
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 200)]
    rng.shuffle(chain)
    star = [(5, 1000 + i) for i in range(300)] + [(1001, 2)]
    noise = [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(120)]
    for edges in ([], [(1, 1)], chain, star, noise, chain + star + noise + noise):
        df = spark.createDataFrame(edges, "a long, b long").repartition(5)
        assert sorted(tuple(r) for r in module.components(df).collect()) == plain(edges)


def test_small_graph_is_settled_at_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(module, "materialize", lambda df, name, write=module.materialize: written.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(100, 300)] + [(7, 7), (5, 300)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert sorted(tuple(r) for r in module.components(df).collect()) == plain(edges)
    assert written == ["edges", "components"]
