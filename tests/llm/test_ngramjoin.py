import random
import re

from tessera.llm import ngramjoin
from tessera.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(rows):
    sets, parent = [plain_set(t) for _, t in rows], {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for at in where.values():
        for j, a in enumerate(at):
            for b in at[j + 1 :]:
                seen.add((a, b))
    for a, b in seen:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(rows[a][0]), root(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True))


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, component string, n int")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join_components(df).collect())


def test_shingle_sets_match_plain_ones():
    texts = ["", None, "one", "One two", "a b c d", "a b c d e", "A b  c\td\ne f", " x y z x y z x y z x y z ", "É é \x0b\x0c ß 日本 語 a b c", "w " * 3000]
    got = list(shingle_sets(texts))
    assert [len(g) for g in got] == [len(plain_set(t)) for t in texts]
    same = list(shingle_sets(["q r s A B C D E t", "zz a b c d e"]))
    assert len(set(same[0].tolist()) & set(same[1].tolist())) == 1
    assert not set(next(shingle_sets(["a b c"])).tolist()) & set(next(shingle_sets(["a b c d"])).tolist())


def near_copies(seed):
    """Groups of near copies around the threshold, a passage that many share, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, at = [], 0
    for size, edits in ((60, 12), (25, 4), (6, 2), (3, 1), (2, 1), (2, 5)):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((at, " ".join(words)))
            at += 1
    for n in range(40):
        rows.append((at, " ".join(passage + [rng.choice(vocabulary) for _ in range(5 + 2 * n)])))
        at += 1
    rows += [(at, ""), (at + 1, None), (at + 2, "Same Short"), (at + 3, "same short"), (at + 4, "other"), (at + 5, rows[0][1]), (at + 6, rows[0][1].upper())]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = near_copies(seed)
        assert result(spark, rows) == plain_components(rows)


def test_small_tiles_force_splits(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "SIDE", 7)
    rows = near_copies(3)
    assert result(spark, rows) == plain_components(rows)


def test_groups_split_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "GROUP", 9)
    monkeypatch.setattr(ngramjoin, "BUCKET", 300)
    assert ngramjoin.class_parts(1.0)[8] > 1
    rows = near_copies(4)
    assert result(spark, rows) == plain_components(rows)


def test_sample_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join_components(df).collect())
    assert got == plain_components(rows)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert ngramjoin.join_components(spark.createDataFrame([], schema)).collect() == []
    out = ngramjoin.join_components(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "x y z q r s"), (5, "x y z q r s")], schema)).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in out) == [(0, 0), (4, 4), (4, 4), (5, 4)]


def test_open_tiles_deal_rows_once(spark):
    tiles = spark.createDataFrame([(7, d, 100 + d) for d in range(40)], "x long, y long, n long")
    labels = spark.createDataFrame([(d, 0) for d in range(30)], "id long, component long")
    bits = bytes(64)
    sigs = spark.createDataFrame([(d, 100 + d, bytearray(bits)) for d in range(40)], "doc_id long, n int, bits binary")
    pairs, held = ngramjoin.open_tiles(tiles, labels, sigs, False)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6
    got = {tuple(r) for r in pairs.collect()}
    assert got == {(a, b) for b in range(30, 40) for a in range(b) if (100 + a) * 4 >= (100 + b) * 3}
    ngramjoin.release(*held)
