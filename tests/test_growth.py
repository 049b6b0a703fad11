"""What must not grow faster than the input: joins by time, picks, written lines, searches for relations and entities, sets of words."""

import random
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import fusion, relations, temporal
from tessera.plans.catalog import QUERIES
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def test_keys_with_few_intervals_are_joined_whole(spark, monkeypatch):
    t = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    spans = [(k, f"{k}-{i}", t(i), t(i + 1 + i % 3) if i % 4 else None) for k in (1, 2) for i in range(3 if k == 1 else 30)] + [(None, "x", t(0), None)]
    points = [(k, i, t(i)) for k in (1, 2, 3) for i in range(0, 40, 3)] + [(None, 99, t(1)), (1, 98, None)]
    i = spark.createDataFrame(spans, "k int, name string, since timestamp, until timestamp")
    p = spark.createDataFrame(points, "k int, n int, at timestamp")
    want = sorted((k, n, name) for k, n, at in points for o, name, a, b in spans if k is not None and k == o and at is not None and a <= at and (b is None or at < b))
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "n", "name").collect())
    whole = temporal.during(p, i, "k", "at", "since", "until")
    assert rows(whole) == want
    assert "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()  # each point was made once for each level
    monkeypatch.setattr(temporal, "FEW", 5)
    assert rows(temporal.during(p, i, "k", "at", "since", "until")) == want
    monkeypatch.setattr(temporal, "FEW", 0)
    assert rows(temporal.during(p, i, "k", "at", "since", "until")) == want


def test_brainstorm_compares_with_what_is_chosen_only(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, i, round(rng.random(), 3), rng.sample(words, rng.randint(0, 30))) for i in range(3000)] + [(2, i, 0.5, ["a"]) for i in range(3)] + [(3, 1, 0.5, [])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, words array<string>")
    start = time.monotonic()
    got = [(r.query_id, r.chunk_id) for r in fusion.greedy(df, 15, 0.75, None, "words").orderBy("query_id", "pick").collect()]
    assert time.monotonic() - start < 12  # nine million pairs of sets took over 20 s
    want = []
    for q in (1, 2, 3):
        left, chosen = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])), []
        near = lambda a, b: len(set(a[3]) & set(b[3])) / max(1, len(set(a[3]) | set(b[3])))
        while left and len(chosen) < 15:
            best = max(left, key=lambda r: round(0.75 * r[2] - 0.25 * max((near(r, c) for c in chosen), default=0.0), 9))
            left.remove(best)
            chosen.append(best)
        want += [(q, r[1]) for r in chosen]
    assert got == want


def test_json_lines_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LINES", 20)
    df = spark.range(90).select("id", F.lit("é\n" * 1000).alias("text")).coalesce(1)
    files.write_jsonl(df, str(tmp_path / "x"))
    parts = list((tmp_path / "x").glob("part-*"))
    assert len(parts) == 5 and all(p.name.endswith(".json.gz") for p in parts)
    assert sum(p.stat().st_size for p in parts) < 90 * 100
    back = spark.read.schema("id long, text string").json(str(tmp_path / "x"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_relations_of_some_kinds_and_without_needless_searches(spark, monkeypatch):
    texts = ["It AMENDS G.O.Ms No. 5 and Rule 7 are hereby amended", "ſuperſedes GO No 9. vide 12", "in supersession of 4; in terms of Section 3; Rule 2 mandates", "governed by the Service Conduct Rule; under the Public Education Act", "gives effect to Section 8, implementing the Fee Policy", "", None, "In partial amendment of 66. As per Rule 5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    every = sorted(map(tuple, relations.extract(docs).drop("place").collect()))
    assert {r[1] for r in every} == set(relations.PATTERNS)
    for kind in relations.PATTERNS:
        assert sorted(map(tuple, relations.extract(docs, (kind,)).drop("place").collect())) == [r for r in every if r[1] == kind]
    monkeypatch.setattr(relations, "NEEDED", {k: [""] * len(ps) for k, ps in relations.PATTERNS.items()})
    assert sorted(map(tuple, relations.extract(docs).drop("place").collect())) == every


def test_only_the_kinds_that_are_counted_are_looked_for(spark):
    plan = QUERIES["E9_E12_entity_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Ministry" not in plan and "Abhiyan" not in plan


def test_categories_are_covered_without_python(spark):
    plan = QUERIES["F24_category_coverage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan


def test_word_sets_are_made_once(spark):
    plan = QUERIES["B24_term_overlap"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # five before


def test_texts_are_hashed_once_for_all_components(spark):
    plan = QUERIES["V1_V6_lite_embeddings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(sha2(" not in plan


def test_clause_index_is_dealt_by_document(spark, monkeypatch):
    from tessera.operators import clauses

    monkeypatch.setattr(clauses, "TEXTS", 2)
    texts = [(f"d{i:03}", f"Section {i % 7} of the RTE Act" if i % 2 else "nothing") for i in range(200)] + [("null", None), ("upper", "RULE 5 and sub-rule 6"), ("none", "a rule without number")]
    out = clauses.index(spark.createDataFrame(texts, "doc_id string, text string").coalesce(1))
    # one file's texts are read by 102 tasks, and the window and the grouping by document deal them no second time
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+?)#\d+\S*, (\d+)\)", plan).count(("doc_id", "102")) == 1
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    got = {r.key: r.doc_id for r in out.collect()}
    assert got == {"rte section 1": "d001", "rte section 3": "d003", "rte section 5": "d005", "rte section 0": "d007", "rte section 2": "d009", "rte section 4": "d011", "rte section 6": "d013", "rule 5": "upper", "rule 6": "upper", "sub-rule 6": "upper"}


def test_contexts_are_made_of_named_orders_only(spark, monkeypatch):
    from tessera.operators import expansion
    from tessera.plans import understanding_queries as understanding

    asked = understanding._with_context(spark, SF)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # every order's text was made, and went to the join
    assert plan.startswith("Repartition")
    ids = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    got = asked.select("query_id", F.col("context").isNotNull().alias("has")).collect()
    assert len(got) == understanding.questions(spark, SF).count()
    assert all(r.has == (r.query_id in ids) for r in got)
    # letters are lowered once, not for each sign
    one = spark.createDataFrame([("AI in the school curriculum",), (None,), ("a road",)], "query string")
    out = one.select(expansion.is_technology(F.col("query")).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.t for r in out.collect()] == [True, None, False]
