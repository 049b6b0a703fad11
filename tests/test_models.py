"""Chains of models row by row, pair scoring, web results, brainstorm picks and policy levels against plain Python."""

import hashlib
import math
import random
import re
import uuid

from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import answers, fusion, hierarchy, models
from tessera.sources import files


def chain_parts():
    """Models of a test; made here so that they are sent to the workers by value."""

    class Picky:
        name, dims = "picky", 4

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("a text that it can't read")
            return [[1.0, 0, 0, 0] if "short" not in t else [1.0] for t in texts]

    class Odd:
        name, dims = "odd", 4

        def embed(self, texts):
            return [[float("nan")] * 4 if "nan" in t else [0.0] * 4 if "zero" in t else None if "none" in t else [0, 2.0, 0, 0] for t in texts]

    class Down:
        name, dims = "down", 4

        def embed(self, texts):
            raise PermissionError("no access")

    class Few:
        name, dims = "few", 4

        def embed(self, texts):
            return [[0, 0, 1.0, 0]] * (len(texts) - 1)

    return Picky(), Odd(), Down(), Few()


def test_each_row_takes_the_first_good_vector(spark):
    picky, odd, down, few = chain_parts()
    texts = ["fine", "bad", "short", "bad nan", "bad zero", "bad none", None, "", " \n", "fine"] + ["fine"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.e for r in df.select("id", models.embed(F.col("text"), [down, picky, odd], 4).alias("e")).collect()}
    assert [got[i].backend if got[i] else None for i in range(10)] == ["picky", "odd", "odd", "lite", "lite", "lite", None, None, None, "picky"]
    assert got[0].value == [1.0, 0, 0, 0] and got[1].value == [0, 2.0, 0, 0] and all(got[i].backend == "picky" for i in range(10, 60))
    assert {r.b for r in df.select(models.embed(F.col("text"), [few], 4)["backend"].alias("b")).collect()} == {"lite", None}
    assert df.select(models.embed(F.col("text"), [], 4)["backend"].alias("b")).where("b = 'lite'").count() == 57
    assert df.limit(0).select(models.embed(F.col("text"), [picky], 4).alias("e")).isEmpty()


def test_a_model_that_is_down_is_asked_once():
    calls = []

    def dead(items):
        calls.append(len(items))
        raise ConnectionError("gone")

    down = set()
    chain = [("dead", dead, bool), ("alive", lambda xs: [x * 2 for x in xs], bool)]
    for _ in range(3):
        assert models.answers(chain, [1, None, 3], down) == ([2, None, 6], ["alive", None, "alive"])
    assert calls == [2] and down == {"dead"}


def plain_lite(text, dims):
    h, v = hashlib.sha256(text.encode()).hexdigest(), []
    for i in range(dims):
        s = hashlib.sha256(f"{h}:{i}".encode()).hexdigest()
        v.append(math.sqrt(-2 * math.log((int(s[:8], 16) + 1) / 2**32)) * math.cos(2 * math.pi * int(s[8:16], 16) / 2**32))
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_lite_vectors(spark):
    texts = ["a", "b", "ünï 😀", "long " * 30000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.e for r in df.select("id", models.lite(F.col("text"), 200).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(got[i], plain_lite(t, 200), strict=True))
    assert abs(sum(x * y for x, y in zip(got[0], got[1], strict=True))) < 0.3 and got[0] == got[4]
    # long texts are cut and marked before they are embedded
    cut = df.where("id = 3").select(models.embed(F.col("text"), [], 8)["value"].alias("e")).first().e
    want = plain_lite(("long " * 30000)[: models.LONGEST_TEXT] + "...", 8)
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(cut, want, strict=True))


def test_models_of_modes(spark):
    df = spark.createDataFrame([(1, "to read", "qa"), (2, "to think", "deep_think"), (3, "!!", "brainstorm"), (4, "a b", None), (5, None, "qa")], "query_id long, query string, mode string")
    chains = {m: ([models.WordHashing("words", n)], n) for m, n in (("fast", 8), ("deep", 16))}
    got = {r.query_id: (r.model, r.backend, len(r.embedding) if r.embedding else None) for r in models.embed_by_mode(df, "query", "mode", chains).collect()}
    assert got == {1: ("fast", "words", 8), 2: ("deep", "words", 16), 3: ("deep", "lite", 16), 4: ("fast", "words", 8), 5: ("fast", None, None)}


def results_of(seed, words):
    rng = random.Random(seed)
    rows = []
    for q in range(6):
        for i in range(rng.choice([1, 8, 60])):
            text = rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))])
            rows.append((q, " ".join(rng.sample(words, 3)) if q else None, q * 1000 + i, text, round(rng.random(), 1), "policy" if q % 2 else "qa"))
    return rows


SCHEMA = "query_id long, query string, chunk_id long, text string, score double, mode string"


def plain_rerank(rows, k, fails=lambda q, t: False):
    rows = sorted(rows, key=lambda r: (-r[4], r[2]))
    most = models.SCORED_RESULTS[rows[0][5]]
    first, rest, scored = rows[:most], rows[most:], []
    for r in first:
        q, t = r[1] or "", " ".join((r[3] or "").split()[: models.SCORED_WORDS])
        if fails(q, t):
            return [(r[2], r[4]) for r in rows[:k]]
        a, b = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", t.lower()))
        scored.append((r[2], len(a & b) / len(a | b) if a else 0.0))
    scored.sort(key=lambda x: -x[1])
    return (scored + [(r[2], r[4]) for r in rest])[:k]


def test_pairs_are_reranked_as_in_a_plain_loop(spark):
    rows = results_of(4, "act rule go school teacher order court fee".split())
    rows.append((9, "late", 9000, "early " * 500 + "late", 0.5, "qa"))  # the word stands after those that are read
    for k in (5, 40):
        got = models.rerank_pairs(spark.createDataFrame(rows, SCHEMA), [models.WordOverlap()], k).collect()
        for q in {r[0] for r in rows}:
            mine = [(r.chunk_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
            assert mine == plain_rerank([r for r in rows if r[0] == q], k)
    assert next(r.score for r in got if r.query_id == 9) == 0.0


def test_failed_scores_leave_the_query_as_it_was(spark):
    class Failing:
        name = "failing"

        def score(self, pairs):
            if any("fee" in t for _, t in pairs):
                raise RuntimeError("no score")
            return models.WordOverlap().score(pairs)

    rows = [(q, "act rule", q * 10 + i, t, 1.0 - i / 10, "qa") for q in (1, 2) for i, t in enumerate(["go", "fee" if q == 2 else "order", "act rule"])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = models.rerank_pairs(df, [Failing()], 3).collect()
    place = lambda q: [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
    assert place(1) == [12, 10, 11] and place(2) == [20, 21, 22]
    assert {r.score for r in got if r.query_id == 2} == {1.0, 0.9, 0.8}
    # a second scorer takes the pair that the first one can't score
    got = models.rerank_pairs(df, [Failing(), models.WordOverlap()], 3).collect()
    assert place(2) == [22, 20, 21] and {r.backend for r in got if r.query_id == 2} == {"failing", "overlap"}
    assert models.rerank_pairs(df.limit(0), [Failing()], 3).isEmpty()


def test_web_results_and_generated_texts(spark):
    class Web:
        name = "web"

        def search(self, queries):
            if any("broken" in q for q in queries):
                raise ValueError("no page")
            return [[] if "none" in q else [{"title": "t", "url": f"https://x/{i}" if i != 1 else None, "snippet": q} for i in range(5)] for q in queries]

    queries = spark.createDataFrame([(1, "school"), (2, "none"), (3, "broken"), (4, None), (5, " ")], "query_id long, query string")
    offline = spark.createDataFrame([(q, i, "o", f"https://o/{i}", "s") for q in (1, 2, 3, 4, 5) for i in (1, 2, 3)], "query_id long, rank int, title string, url string, snippet string")
    got = sorted((r.query_id, r["rank"], r.url, r.backend) for r in models.web_results(queries, [Web()], 2, offline).collect())
    assert got == [(1, 1, "https://x/0", "web"), (1, 2, "https://x/2", "web")] + [(q, i, f"https://o/{i}", "offline") for q in (2, 3) for i in (1, 2)]
    assert {r.query_id for r in models.web_results(queries, [Web()], 2).collect()} == {1}

    class Writer:
        name = "writer"

        def generate(self, prompts):
            return ["" if "none" in p else p.upper() for p in prompts]

    made = {r.query_id: r.g for r in queries.select("query_id", models.generated(F.col("query"), [Writer()], F.lit("rule")).alias("g")).collect()}
    assert [(made[i].value, made[i].backend) for i in (1, 2, 4)] == [("SCHOOL", "writer"), ("rule", "rules"), ("rule", "rules")]


def plain_brainstorm(rows, k):
    def base(r):
        low, age = (r[2] or "").lower(), 2024 - (r[4] or 2000)
        fresh = next((v for y, v in ((1, 1.0), (3, 0.9), (5, 0.8), (10, 0.6)) if age <= y), 0.3)
        return 0.3 * r[3] + 0.25 * min(sum(w in low for w in scoring.INNOVATION_WORDS) / 5, 1.0) + 0.2 * fresh

    sets = {r[1]: set(re.findall(r"\w+", (r[2] or "").lower())) for r in rows}
    left, chosen = sorted(rows, key=lambda r: (-base(r), r[1])), []
    while left and len(chosen) < k:
        near = lambda r: max((len(sets[r[1]] & sets[c]) / len(sets[r[1]] | sets[c]) for c in chosen if sets[r[1]] and sets[c]), default=0.0)
        best = max(left, key=lambda r: (round(0.75 * base(r) - 0.25 * near(r), 9), -left.index(r)))
        left.remove(best)
        chosen.append(best[1])
    return chosen


def test_brainstorm_picks_equal_a_plain_loop(spark):
    rng = random.Random(6)
    words = ["finland", "pilot", "novel", "school", "fee", "global", "model", "act", "case study", "oecd", "ünï"]
    rows = [(q, q * 1000 + i, rng.choice([None, "", "Pilot in Finland"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(9)]), round(rng.random(), 2), rng.choice([None, 2000, 2015, 2020, 2024])) for q in range(5) for i in range([1, 3, 30, 100, 300][q])]
    got = fusion.brainstorm_rerank(spark.createDataFrame(rows, "query_id long, chunk_id long, text string, score double, year int"), 15).collect()
    for q in range(5):
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pick)] == plain_brainstorm([r for r in rows if r[0] == q], 15)


def plain_levels(rows):
    rows = sorted(rows, key=lambda r: (-r["score"], r["chunk_id"]))
    of = lambda v: [r for r in rows if r["vertical"] == v]
    once = lambda rs, f: list(dict.fromkeys(r[f] for r in rs if r[f]))
    low = lambda r: (r["text"] or "").lower()
    legal, go, court, data = of("legal"), of("go"), of("judicial"), of("data")
    refs = [r["text"][:200] for r in legal if any(w in low(r) for w in hierarchy.CONSTITUTION)]
    acts, sections, orders = once(legal, "act_name"), once(legal, "section_number"), once(go, "go_number")
    recent = [r["go_number"] for r in go if r["go_number"] and r["year"] and r["year"] >= 2020]
    cases = [", ".join(str(x) for x in (r["case_number"], r["court_name"], r["year"]) if x is not None) for r in court if r["case_number"]]
    sources = once(data, "source")
    metrics = [r["text"][:150] for r in data if any(w in low(r) for w in hierarchy.METRICS)]
    join = " | ".join
    out = {
        "constitutional": (legal, len(refs), refs[:3], None, "strong" if len(refs) > 2 else "moderate"),
        "statutory": (legal, len(acts) + len(sections), acts[:5], sections[:10], "comprehensive" if len(acts) > 2 else "limited"),
        "administrative": (go, len(orders), recent, once(go, "department")[:5], "active" if recent else "historical"),
        "judicial": (court, len(cases), cases[:5], once(court, "court_name"), "strong" if len(cases) > 3 else "moderate"),
        "empirical": (data, len(sources), sources[:5], metrics[:3], "strong" if len(sources) > 2 else "moderate"),
    }
    return {k: (n > 0, n, join(a), None if b is None else join(b), g) if there else (False, 0, None, None, None) for k, (there, n, a, b, g) in out.items()}


def test_policy_levels_equal_plain_ones(spark):
    rng = random.Random(2)
    fields = "query_id chunk_id vertical score text act_name section_number go_number department case_number court_name source year".split()
    some = lambda p, n: rng.choice([None, "", *[f"{p}{i}" for i in range(n)]])
    rows = []
    for q in range(8):
        verticals = rng.sample(["legal", "go", "judicial", "data", "schemes"], rng.randint(1, 5))
        for i in range(rng.choice([1, 4, 60])):
            text = rng.choice([None, "", "Article 21 of the Constitution " * 9, "45% of pupils", "statistics " * 40, "plain"])
            rows.append((q, q * 1000 + i, rng.choice(verticals), round(rng.random(), 1), text, some("Act", 8), some("s", 14), some("g", 5), some("d", 7), some("c", 6), some("Court", 4), some("S", 7), rng.choice([None, 2012, 2020, 2023])))
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, vertical string, score double, text string, act_name string, section_number string, go_number string, department string, case_number string, court_name string, source string, year int")
    got = hierarchy.summary(df).collect()
    assert len(got) == 40
    for q in range(8):
        want = plain_levels([dict(zip(fields, r, strict=True)) for r in rows if r[0] == q])
        assert {r.level: (r.present, r.total, r["items"], r["more"], r.grade) for r in got if r.query_id == q} == want
    assert hierarchy.summary(df.limit(0)).isEmpty()


def test_generated_rewrites_are_parsed_or_made_by_rules(spark):
    class Writer:
        name = "writer"

        def generate(self, prompts):
            if any("broken" in p for p in prompts):
                raise TypeError("no text")
            return ["no blocks" if "plain" in p else f"\n\nDOMAIN: Teacher Policy\nREWRITE: first {p}\nREWRITE: {p} rules\nREASON: x\n \nDOMAIN: FLN\nREASON: none\n\nREWRITE: alone\n\n  DOMAIN:Academic \n REWRITE: books DOMAIN: of\n\n" for p in prompts]

    queries = spark.createDataFrame([(1, "transfers"), (2, "plain"), (3, "broken"), (4, None)], "query_id long, query string")
    got = {r.query_id: r for r in models.generated_rewrites(queries, [Writer()], F.concat(F.lit("ask "), "query")).collect()}
    assert [(x.domain, x.text) for x in got[1].rewrites] == [("teacher policy", "ask transfers rules"), ("academic", "books DOMAIN: of")] and got[1].backend == "writer"
    from tessera.functions import rewriting

    rules = {r.query_id: r.x for r in queries.select("query_id", rewriting.rewrites(F.col("query"), 3).alias("x")).collect()}
    assert all(got[i].rewrites == rules[i] and got[i].backend == "rules" for i in (2, 3, 4))
    assert len(models.generated_rewrites(queries.limit(1), [Writer()], F.col("query"), 1).first().rewrites) == 1


def test_merged_web_results_reordered_ids_and_bullets(spark):
    local = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.3), (1, 12, None), (2, 20, 0.5)], "query_id long, item long, score double")
    web = spark.createDataFrame([(1, 50, 1, "x.gov.in"), (1, 51, 1, "y.org"), (1, 52, 2, None), (1, 53, 3, "a.nic.in"), (3, 54, None, "z")], "query_id long, item long, rank int, source string")
    rows = sorted((r.query_id, r["rank"], r["item"], round(r.score, 6)) for r in fusion.merge_web(local, web, 5).collect())
    assert rows == [(1, 1, 10, 0.63), (1, 2, 50, 0.45), (1, 3, 51, 0.3), (1, 4, 11, 0.21), (1, 5, 52, 0.15), (2, 1, 20, 0.35), (3, 1, 54, 0.3)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.5, 0.5, 0.9])] + [(2, 7, 0.2), (2, 8, 0.4)], "query_id long, chunk_id long, score double")
    orders = spark.createDataFrame([(1, [2, 99, 0, 2]), (3, [1])], "query_id long, ids array<long>")
    got = fusion.reorder_by_ids(df, orders).collect()
    assert {q: [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)] for q in (1, 2)} == {1: [2, 0, 3, 1], 2: [8, 7]}
    docs = [(1, 1, "d", "T", " a\nb ", 0.9), (1, 2, "d2", "", "x" * 219 + " yz", 0.8), (1, 3, None, None, None, 0.7), (1, 4, "d4", "cut", "", 0.1)]
    out = answers.bullets(spark.createDataFrame(docs, "query_id long, chunk_id long, doc_id string, title string, text string, score double"), 3).first()
    assert out.answer == "\n".join([answers.NO_MODEL, "- [1] T: a b", "- [2] d2: " + "x" * 219 + "...", "- [3] Document 3: "]) and out.confidence == 0.2


def test_stable_ids_are_uuids_of_version_5(spark):
    names = ["a|b", "", "ünï|😀", "long" * 50000, None] + [f"{i}|{i * 7}" for i in range(200)]
    got = {r.i: r.u for r in spark.createDataFrame(list(enumerate(names)), "i int, name string").select("i", files.uuid5(F.col("name")).alias("u")).collect()}
    assert got == {i: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for i, n in enumerate(names)}
