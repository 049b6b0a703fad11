"""Substring lookups, hops, chains, joins by time and the bounded cache against plain Python, with hot keys, ties, nulls and empty tables."""

import random
import re
from collections import OrderedDict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import clauses, fifo, filefind, hops, lexical, relations, stored_index, substrings, temporal


def test_substrings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda most: "".join(rng.choice("abcé \n😀") for _ in range(rng.randint(0, most)))
    texts = [(i, make(40)) for i in range(60)] + [(60, ""), (61, None), (62, "abc" * 20000), (63, "abc"), (63, "abc")]
    needles = [(make(6),) for _ in range(80)] + [("",), (None,), ("abc" * 19999,), ("zzz",), ("a",), ("😀",)]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "needle string")
    want = {(i, x) for i, s in texts for (x,) in needles if s is not None and x and x in s}
    assert {tuple(r) for r in substrings.matches(t, n, "id").collect()} == want
    monkeypatch.setattr(substrings, "BROADCAST_NEEDLES", 0)  # the other way beyond the bound
    shuffled = substrings.matches(t, n, "id")
    assert sorted(tuple(r) for r in shuffled.collect()) == sorted(want)
    assert "NestedLoop" not in shuffled._jdf.queryExecution().toString() and "CartesianProduct" not in shuffled._jdf.queryExecution().toString()
    assert substrings.matches(t, n.limit(0), "id").isEmpty() and substrings.matches(t.limit(0), n, "id").isEmpty()


def test_needles_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """Written files are much smaller than what they hold, so that Spark's own choice took needles without number to the driver."""
    monkeypatch.setattr(substrings, "BROADCAST_NEEDLES", 0)
    texts = spark.createDataFrame([(i, f"orders/{i * 37}_SE_MS{i}_E.PDF".lower()) for i in range(300)], "id long, text string")
    needles = spark.createDataFrame([(f"ms{i}_e.pdf",) for i in range(0, 600, 7)] + [("ms",), ("5_se_ms",)], "needle string")
    found = substrings.matches(texts, needles, "id")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    want = {(i, x) for i, s in ((r.id, r.text) for r in texts.collect()) for (x,) in needles.collect() if x in s}
    assert {tuple(r) for r in found.collect()} == want


def test_candidates_of_numbered_needles_grow_no_faster_than_texts(spark):
    """Names that differ in a number alone share every trigram with a tenth of the texts or more."""
    texts = spark.createDataFrame([(i, f"misc files/se_ms{i}_e.pdf") for i in range(20_000)], "key long, text string")
    wanted = texts.where("key % 10 = 0").select(F.concat(F.lit("se_ms"), F.col("key"), F.lit("_e.pdf")).alias("needle"))
    counts = spark.sparkContext.broadcast(substrings._counted(texts, [8]))
    anchors = substrings._anchored(wanted, [8], counts)
    words = spark.sparkContext.broadcast(substrings._looked_for(anchors))
    pairs = substrings._candidates(texts, [8], words).join(anchors, "gram")
    assert wanted.count() <= pairs.count() < 5 * texts.count()


def plain_index(docs):
    out = {}
    for doc_id, text in docs:
        low, mine = (text or "").lower(), {}
        act = next((name for words, name in clauses.ACTS if words in low), None)
        for kind, number in clauses.KEYED.items():
            for m in re.finditer(rf"\b{kind}\s+{number}", low):
                share = m.start() / len(low)
                around = low[max(0, m.start() - 100) : m.end() + 100]
                sure = 0.5 + (0.3 if act else 0) + (0.2 if share < 0.1 else 0.1 if share < 0.3 else 0) + min(0.2, 0.03 * sum(t in around for t in clauses.LEGAL_TERMS))
                clause = f"{kind} {m.group(1)}"
                mine[f"{act} {clause}" if act else clause] = (clause, doc_id, round(min(1.0, sure), 6))
        for key, e in mine.items():
            if key not in out or (-e[2], e[1]) < (-out[key][2], out[key][1]):
                out[key] = e
    return out


def test_clause_lookups_equal_plain_ones(spark):
    rng = random.Random(8)
    words = ["Section 12", "section 1", "RTE", "Rule 3(1)(a)", "article 21a", "sub-rule 4", "the Education Act", "shall", "hereby provided", "school and pupil " * 9, "clause 7(2)", "amendment 86", "\n", "section 12(1)(c)", "subsection 9"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(70)] + [(70, None), (71, ""), (72, "filler " * 20000 + "section 12 whereas"), (73, "section 12"), (74, "section 12")]
    queries = [(1, "what is Section 12 of the act"), (2, "rte section 12(1)(c)"), (3, "nothing here"), (4, "section 1"), (5, ""), (6, "SECTION 12"), (7, "Rule 3"), (8, "section 99 or rule 3"), (9, "12 pupils"), (10, "go no 45"), (11, "the rule of 12"), (12, "article 21 or amendment 8")]
    index = plain_index(docs)
    entries = clauses.index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.key: (r.clause, r.doc_id, round(r.confidence, 6)) for r in entries.collect()} == index
    asked = spark.createDataFrame(queries, "query_id int, query string")

    def best(keys):
        once = {}
        for k in sorted(keys, key=lambda k: (-index[k][2], k)):
            once.setdefault(index[k][:2], k)
        return sorted(once.values(), key=lambda k: (-index[k][2], k))[: clauses.MOST]

    every = clauses.lookup(asked, entries).collect()
    by_terms = clauses.lookup_terms(asked, entries).collect()
    fast = {r.query_id: r.fast for r in clauses.fast_path(asked, entries).collect()}
    for query_id, query in queries:
        low = query.lower()
        named = [f"{k} {x}" for k, n in clauses.KEYED.items() for x in re.findall(rf"\b{k}\s+{n}", low)]
        hits = best([k for k in index if k in low]) or best({k for k in index for x in named if x in k})
        assert [r.key for r in sorted(every, key=lambda r: r.rank) if r.query_id == query_id] == hits
        terms = [low] if low in index else [k for k in index if any(x in k for x in low.split())]
        assert [r.key for r in sorted(by_terms, key=lambda r: r.rank) if r.query_id == query_id] == sorted(terms, key=lambda k: (-index[k][2], k))[: clauses.MOST]
        about = re.search(clauses.ABOUT_CLAUSES, low) or (any(w in low for w in clauses.CLAUSE_WORDS) and re.search(r"\d", low))
        assert fast[query_id] == bool(about and len(hits) >= 2)


def test_files_by_rough_names(spark):
    paths = ["go/2025SE_MS26_E.PDF", "go/old/2025SE_MS26_E.PDF", "acts/SALIENT_FEATURES.PDF", "x/Salient Features of all.pdf", "a/b/report-2019.docx", "notes (final) v2.pdf"]
    names = ["2025se_ms26_e.pdf", "5294663_SALIENT_FEATURES.PDF", "salient_features_of", "report-2019.docx", "Report-2019.pdf", "notes final v2", "_", "", None, "nowhere"]
    got = {r.name: (r.path, r.exact) for r in filefind.find(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {
        "2025se_ms26_e.pdf": (paths[0], True), "5294663_SALIENT_FEATURES.PDF": (paths[2], False), "salient_features_of": (paths[3], False),
        "report-2019.docx": (paths[4], True), "notes final v2": (paths[5], False),
    }


def test_hops_equal_plain_ones(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, f"topic{i % 7} about pupils. See Section {(i * 3) % 17} and GO Ms No {(i * 5) % 11}, section {i % 4}; " + "word " * rng.randint(0, 9)) for i in range(60)] + [(60, None), (61, ""), (62, "topic3 " * 3000)]
    queries = [(1, "topic3 pupils"), (2, "topic3 pupils"), (3, "nowhere"), (4, None), (5, "section 3 word")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path / "index")
    stored_index.add(d, path)
    got = sorted(tuple(r) for r in hops.search(spark.createDataFrame(queries, "query_id int, query string"), d, path, hops=3, k=12).collect())
    texts = dict(docs)
    want = []
    for query_id, query in queries:
        seen = set()
        for hop in (1, 2, 3):
            if not query:
                break
            hits = lexical.search(d, spark.createDataFrame([(0, query)], "query_id int, query string"), 12).orderBy("rank").collect()
            new = [r for r in hits if r.doc_id not in seen]
            want += [(query_id, hop, r.rank, r.doc_id, r.score) for r in new]
            seen |= {r.doc_id for r in new}
            terms = []
            for r in new:
                if r.rank <= hops.DOCUMENTS:
                    for p in hops.REFERENCES:
                        terms += re.findall(p, texts[r.doc_id])[: hops.EACH]
            query = " ".join(list(dict.fromkeys(terms))[: hops.TERMS])
    assert got == sorted(want) and max(r[1] for r in got) == 3


def test_chains_of_a_thousand_and_loops(spark):
    rows = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 2001), (4000, 4000), (5000, 4000)] + [(10000 + i, 1000) for i in range(500)] + [(7, 8), (7, 3), (None, 1), (1, None)]
    got = {r.doc_id: (r.current, r.steps, r.looped) for r in relations.current_versions(spark.createDataFrame(rows, "doc_id long, superseded_by long")).collect()}
    want = {i: (1000, 1000 - i, False) for i in range(1000)} | {i: (None, None, True) for i in (2000, 2001, 2002, 3000, 4000, 5000)} | {10000 + i: (1000, 1, False) for i in range(500)}
    assert got == want
    assert relations.current_versions(spark.createDataFrame([], "doc_id long, superseded_by long")).isEmpty()


def test_a_type_and_a_target_must_be_of_one_element(spark):
    rows = [("a", [("supersedes", "X"), ("cites", "Y")]), ("b", [("cites", "X"), ("supersedes", "Y")]), ("c", []), ("d", None), ("e", [("supersedes", "X"), ("supersedes", "X")])]
    docs = spark.createDataFrame(rows, "doc_id string, relations array<struct<type:string,target:string>>")
    direct = {r.doc_id for r in docs.where(relations.has_relation(F.col("relations"), "supersedes", F.lit("X"))).collect()}
    listed = spark.createDataFrame([(1, 1, "r1", "X", 1.0), (1, 2, "r2", "Z", 0.9), (1, 11, "r3", "X", 0.1)], "query_id int, rank int, doc_id string, target string, score double")
    got = sorted((r.doc_id, round(r.score, 6), r.via, r.of) for r in relations.with_reverse_edges(listed, relations.inverted(docs)).collect())
    assert direct == {"a", "e"}
    assert got == [("a", 1.5, "supersedes", "r1"), ("e", 1.5, "supersedes", "r1"), ("r1", 0.3, None, None), ("r2", 0.9, None, None), ("r3", 0.1, None, None)]


def test_as_of_and_intervals_equal_brute_force(spark):
    rng = random.Random(11)
    zero = datetime(2024, 1, 1)
    when = lambda: zero + timedelta(minutes=rng.randint(0, 40000))
    key = lambda: 0 if rng.random() < 0.5 else rng.randint(1, 5)  # noqa: E731  half of all rows share a key
    left = [(i, key(), when()) for i in range(400)] + [(400, None, zero), (401, 0, None), (402, 9, zero), (403, 0, datetime(1960, 5, 5))]
    right = [(key(), when(), rng.randint(0, 9)) for _ in range(60)] + [(1, left[0][2], 3), (1, left[0][2], 7), (None, zero, 1), (2, None, 5)]
    got = {r.id: r.found_v for r in temporal.as_of(spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(right, "k int, rt timestamp, v int"), "k", "t", "rt", ["v"]).collect()}
    want = {}
    for i, k, t in left:
        past = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        want[i] = max(past)[1] if past else None
    assert got == want

    spans = []
    for i in range(150):
        s = when()
        spans.append((i, key(), s, rng.choice([None, s, s - timedelta(1), s + timedelta(seconds=1), s + timedelta(minutes=rng.randint(1, 300)), s + timedelta(days=rng.randint(1, 4000))])))
    spans += [(150, 0, None, zero), (151, None, zero, None), (152, 0, datetime(1950, 1, 1), None)]
    hits = temporal.during(spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(spans, "s int, k int, since timestamp, until timestamp"), "k", "t", "since", "until")
    pairs = [(r.id, r.s) for r in hits.collect()]
    assert sorted(pairs) == sorted((i, s) for i, k, t in left for s, sk, a, b in spans if k is not None and t is not None and a is not None and k == sk and a <= t and (b is None or t < b))


def test_cache_equals_a_plain_queue(spark):
    rng = random.Random(2)
    cache, queue = spark.createDataFrame([], fifo.SCHEMA), OrderedDict()
    for number in range(5):
        batch = [(rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", None]), i) for i in range(rng.choice([0, 3, 9]))]
        answers, cache = fifo.request(cache, spark.createDataFrame(batch, "key string, place long"), number, 4)
        assert sorted((r.place, r.hit) for r in answers.collect()) == [(i, k in queue) for k, i in batch]
        for k in [k for k, _ in batch if k is not None and k not in queue]:
            if k not in queue:
                queue[k] = True
        while len(queue) > 4:
            queue.popitem(last=False)
        assert {r.key for r in cache.collect()} == set(queue)
        cache = spark.createDataFrame(cache.collect(), fifo.SCHEMA)
