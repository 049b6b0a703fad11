import hashlib
import random
from collections import Counter, defaultdict

from tessera.llm import exactdedup


def plain(rows):
    ids, size = defaultdict(list), Counter()
    for d, t in rows:
        ids[t or ""] += [] if d is None else [d]
        size[t or ""] += 1
    keep = {t: max(v, default=None) for t, v in ids.items()}
    return sorted(((d, hashlib.sha256((t or "").encode()).digest(), keep[t or ""], size[t or ""], d == keep[t or ""]) for d, t in rows), key=repr)


def check(spark, rows, counters=exactdedup.COUNTERS, parts=5):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, digest string").repartition(parts)
    out = exactdedup.groups(df, counters).collect()
    assert sorted(((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in out), key=repr) == plain(rows)
    left = exactdedup.dedup(df, counters)
    assert left.columns == df.columns
    want = sorted(((d, t) for (d, t), k in ((r, p) for r in rows for p in plain(rows) if p[:2] == (r[0], hashlib.sha256((r[1] or "").encode()).digest())) if k[4]), key=repr)
    assert sorted({(r.doc_id, r.text) for r in left.collect()}, key=repr) == sorted(set(want), key=repr)


def corpus(seed=4, n=600):
    rng = random.Random(seed)
    texts = [f"text {i} é\n" * rng.randint(1, 4) for i in range(200)]
    pick = lambda i: "hot" if i % 3 == 0 else texts[0] if i % 7 == 0 else rng.choice(texts)
    return [(i, pick(i)) for i in rng.sample(range(10_000), n)]


def test_every_split_gives_the_same_groups(spark):
    rows = corpus()
    for counters in (1, 3, 20, exactdedup.COUNTERS):
        check(spark, rows, counters)


def test_nulls_repeated_rows_and_long_texts(spark):
    long = "y" * 2_000_000
    check(spark, [(1, None), (2, ""), (3, None), (None, "a"), (None, "a"), (4, "b"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (6, "d"), (7, long), (8, long), (9, long + "z"), (10, " a"), (11, "A")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exactdedup.groups(empty).collect() == [] and exactdedup.dedup(empty).collect() == []


def test_frequent_holds_every_heavy_digest_and_is_bounded(spark):
    rng = random.Random(1)
    for counters in (4, 16, 64):
        n = 4000
        heavy = [f"heavy {i}" for i in range(counters // 4)]
        texts = [rng.choice(heavy) if rng.random() < 0.9 and heavy else f"own {i}" for i in range(n)]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7).select("doc_id", exactdedup.digest_of(exactdedup.F.col("text")).alias("digest"))
        found = {bytes(r.digest) for r in exactdedup.frequent(rows, counters).collect()}
        count = Counter(hashlib.sha256(t.encode()).digest() for t in texts)
        assert len(found) <= counters and found >= {d for d, c in count.items() if c * (counters + 1) > 3 * n}


def test_heavy_digests_are_not_shuffled(spark):
    """The rows of a frequent digest meet only the broadcast winners."""
    rows = [(i, "hot" if i % 2 else f"own {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = exactdedup.groups(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "LeftAnti" in plan


def test_misra_gries_step():
    assert exactdedup.lower_to({"a": 5, "b": 2, "c": 2, "d": 1}, 2) == {"a": 3}
    assert exactdedup.lower_to({"a": 5}, 2) == {"a": 5}
