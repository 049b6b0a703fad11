import random
import zlib

import pytest

from tessera.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_and_automaton_match_edit_distance():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = {word(rng.randint(3, 8)): (rng.random() + 0.1, rng.random() < 0.3) for _ in range(40)}
    trie = toxicity.Trie(entries)
    match = toxicity.Matcher(entries, set())
    for _ in range(2000):
        w = word(rng.randint(2, 10))
        exact = max((v for e, (v, stem) in entries.items() if w == e or stem and w.startswith(e)), default=0.0)
        near = max((v for e, (v, stem) in entries.items() if len(e) >= 5 and (edits(w, e) <= 1 or stem and any(edits(w[:k], e) <= 1 for k in range(len(w) + 1)))), default=0.0)
        assert trie.exact(w) == exact
        assert trie.fuzzy(w) == near
        assert match(w) == (exact or (-near if len(w) >= 4 else 0.0))


def corpus():
    rng = random.Random(4)
    plain = ["the", "house", "river", "walks", "green", "garden", "paper", "window", "stone", "bread", "quiet", "evening"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) + rng.choice(["", "s", str(i % 7)]) for _ in range(rng.randint(5, 40))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefoot", "snotlings", "wretchard"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def scores(spark, model, rows):
    return sorted((r.doc_id or -1, r.held_out, r.score, r.predicted) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect())


def test_held_out_and_misspelled(spark, model):
    rows, labels = corpus()
    got = {d: (h, p) for d, h, _, p in scores(spark, model, rows)}
    held = [d for d, (h, _) in got.items() if h]
    assert all(got[d][0] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got) and held
    assert sum(got[d][1] == labels[d][1] for d in held) >= 0.97 * len(held)
    new = [(1, "you grumblefot of the garden", "x"), (2, 'he said "grumblefoot" in the quiet evening by the river', "x"), (3, None, "x"), (4, "", "x"), (None, "snotlings", "x"), (5, "stone " * 50000 + "wretchard " * 3, "x"), (5, "bread", "x")]
    out = scores(spark, model, new)
    by = {}
    for d, _, s, p in out:
        by.setdefault(d, []).append((s, p))
        assert 0 <= s <= 1
    assert by[1][0][1] == 1 and by[-1][0][1] == 1 and by[3] == by[4] and by[3][0][1] == 0
    assert by[2][0][0] < by[1][0][0]


def test_filter_and_no_labels(spark, model):
    df = spark.createDataFrame([(1, "grumblefoot snotlings", 9), (2, "garden", 8), (3, None, 7)], "doc_id long, text string, predicted int")
    assert sorted(tuple(r) for r in toxicity.keep_clean(df, model).collect()) == [(2, "garden", 8), (3, None, 7)]
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none == {} and {r.score for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == []
