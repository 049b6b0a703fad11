import hashlib
import random

import numpy as np

from tessera.llm import deepshallow, suffixdedup
from tessera.llm.deepshallow import sort_strings


def plain(rows, span=50):
    texts = sorted((d, (t or "").encode()) for d, t in rows)
    owner = {}
    for d, t in texts:
        for i in range(len(t) - span + 1):
            owner.setdefault(t[i : i + span], d)
    out = []
    for d, t in texts:
        drop = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if owner[t[i : i + span]] < d:
                drop[i : i + span] = True
        kept = bytes(b for b, x in zip(t, drop, strict=True) if not x)
        out.append((d, len(t), int(drop.sum()), int((np.diff(drop.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    return sorted(tuple(r)[:5] for r in suffixdedup.dedup(df).collect())


def test_deep_shallow_sort():
    rng = np.random.RandomState(3)
    for alphabet in (2, 4, 256):
        rows = rng.randint(0, alphabet, (300, 29)).astype(np.uint8)
        rows[50:120] = rows[0]
        rows[100:110, 27] += 1
        for shallow in (0, 8, 16, 64):
            order, lcp = sort_strings(rows, shallow)
            got = [rows[k].tobytes() for k in order]
            assert got == sorted(r.tobytes() for r in rows)
            for k in range(1, 300):
                a, b = got[k - 1], got[k]
                assert lcp[k] == next((i for i in range(29) if a[i] != b[i]), 29)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "déjà", "x", "yy", "straße", "0", "in", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(40), prose(14)
    docs = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(passage) - 1)
            parts.append(rng.choice([passage, line, passage[cut : cut + rng.randint(40, 70)], line[:rng.randint(30, 60)]]))
            parts.append(prose(rng.randint(0, 12)))
        docs.append(rng.choice(["", " "]).join(parts))
    docs += [docs[3], docs[3], docs[5][:200], "", None, "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 100, "ab" * 60, "Z" + docs[7]]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        assert result(spark, rows) == plain(rows)


def test_sample_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(spark, rows) == plain(rows)


def test_empty_nulls_and_repeats(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, "no repeat " * 3 + "at all in this text, which is long enough")]) == plain([(1, "no repeat " * 3 + "at all in this text, which is long enough")])
    rows = [(1, "q" * 80), (1, "q" * 80), (2, "b" + "q" * 80), (None, "q" * 80)]
    assert [r[:4] for r in result(spark, rows)] == [(1, 80, 0, 0), (2, 81, 80, 1)]


def test_multikey_quicksort_against_sorted():
    rng = np.random.default_rng(5)
    for n, high in ((0, 3), (1, 3), (40, 3), (3000, 2), (3000, 50), (3000, 2**60)):
        words = rng.integers(0, high, (n, 3)).astype(np.uint64)
        order = deepshallow.multikey_quicksort(words)
        assert sorted(order.tolist()) == list(range(n))
        assert words[order].tolist() == sorted(words.tolist())
    same = np.ones((500, 2), np.uint64)
    assert sorted(deepshallow.multikey_quicksort(same).tolist()) == list(range(500))
