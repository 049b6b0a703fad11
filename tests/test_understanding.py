"""Normalisation, rewriting and expansion of questions against plain Python."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import normalizer, rewriting
from tessera.functions import vocabulary as words
from tessera.operators import expansion

QUESTIONS = [
    "What is GO 42?", "Explain   RTE  Section 12(1)(c)", "SHOW ME GO.Ms.No.54 details!!!", "Teacher transfer rules 2023", "What are CWSN provisions?", "a committe, l of O ; recieve  .", "", None, "go no 5 GO No 55 section 1 Section 12 2019 ꙮ x2020",
    "how to integrate ai in school curriculum", "list all education policies", "latest education policies", "article 21a", "12(1)(c)x of it", "rte section 13", "cce rule 7 for admission", "apsermc act 3", "must toilets and Drinking Water be free", "été à l'école tout seul", "naturally small", "TEACHER!",
]


def plain_normal(text):
    """Masks spans in order, works on what is between, puts them back."""
    clean = re.sub(r"([!?.]){2,}", r"\1", re.sub(r"\s+", " ", text or "").strip())
    spans = re.findall(r"(?:[gG][oO]\.?\s*(?:[mM][sS]\.?|[rR][tT]\.?)?\s*[nN][oO]\.?\s*\d+)|(?:[sS][eE][cC][tT][iI][oO][nN]\s+\d+(?:\([a-zA-Z0-9]+\))?)|\b(?:19|20)\d{2}\b", clean)
    rest = clean
    for i, s in enumerate(spans):
        rest = rest.replace(s, f"__{i}__", 1) if s in rest else rest
    out = []
    for w in rest.lower().split():
        bare = w.rstrip(".,!?;:")
        out.append(words.ABBREVIATIONS[bare] + w[len(bare) :] if bare in words.ABBREVIATIONS else w)
    rest = re.sub(r"\bo\b", "0", re.sub(r"\bl\b", "1", " ".join(out)))
    for wrong, right in words.SPELLINGS:
        rest = rest.replace(wrong, right)
    rest = re.sub(r"\s*([,;:.!?])\s*", r"\1 ", rest).strip()
    for i, s in enumerate(spans):
        rest = rest.replace(f"__{i}__", s, 1)
    return rest.strip()


def column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, query string")
    return [r.out for r in df.select("i", make(F.col("query")).alias("out")).orderBy("i").collect()]


def test_normalised_against_plain_python(spark):
    assert column(spark, QUESTIONS, normalizer.normalize_query) == [plain_normal(q) for q in QUESTIONS]


def test_known_forms(spark):
    got = column(spark, QUESTIONS[:6], normalizer.normalize_query)
    assert got[1] == "explain right to education Section 12(1)(c)" and got[2] == "show me GO.Ms.No.54 details!" and got[4] == "what are children with special needs provisions?" and got[5] == "a committee, 1 of 0; receive."


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["GO.Ms.No.5", "go no 12", "Section 3(a)", "SECTION 44", "1999", "2024", "rte", "l", "O", "goverment", ",", "?", "!!", "MDM.", "ꙮ", "é"]), max_size=9), min_size=1, max_size=30))
def test_protected_spans_survive_in_order(spark, lists):
    texts = [" ".join(x) for x in lists]
    for text, out in zip(texts, column(spark, texts, normalizer.normalize_query), strict=True):
        spans = re.findall(normalizer.PROTECTED, text)
        at = 0
        for s in spans:
            at = out.index(s, at) + len(s)
        assert out.count("ꙮ") == text.count("ꙮ")


def test_variants_are_distinct_and_start_with_the_normal_form(spark):
    for q, vs in zip(QUESTIONS, column(spark, QUESTIONS, normalizer.variants), strict=True):
        assert vs[0] == plain_normal(q) and len(vs) == len(set(vs)) <= 3


def plain_rewrites(q, most):
    q = q or ""
    low = q.lower()
    terms = " ".join([w for w in re.findall(r"\w+", low) if len(w) > 2 and w not in words.REWRITE_STOPWORDS][:5])
    legal = re.search(r"\b(?:section|clause|article|rule|sub-rule|amendment|act|regulation)\s+\d|\b(?:rte|cce|apsermc|education)\s+act\b|\b\d+\(\d+\)\(\w+\)\b", low)
    kinds = [("what_is", r"\bwhat\s+(is|are)\b"), ("how_to", r"\bhow\s+(to|do)\b"), ("requirements", r"\b(requirements?|must|should)\b"), ("list", r"\b(list|all|types?)\b")]
    kind = "legal_clause" if legal else next((k for k, p in kinds if re.search(p, low)), "general")
    broad = re.search(r"\b(?:current|latest|all|comprehensive|complete|overall)\s+(?:education\s+)?policies?\b|\beducation\s+(?:system|framework|structure|overview)\b|\b(?:list|overview|summary)\s+(?:of\s+)?(?:all\s+)?(?:education\s+)?(?:policies|initiatives|schemes)\b", low)
    scores = {d: sum(len(t.split()) for t in ts if t.lower() in low) for d, ts in words.DOMAINS.items()}
    domains = list(words.DOMAINS) if broad else [d for d in sorted(scores, key=lambda d: -scores[d]) if scores[d]] or words.DEFAULT_DOMAINS
    out = []
    for d in domains[:most]:
        name = d.replace("_", " ")
        made = {"what_is": f"{terms} {name} policy provisions", "how_to": f"Implementation of {terms} in {name}", "requirements": f"{terms} {name} requirements standards", "list": f"All {terms} related to {name}"}
        out.append((d, made.get(kind, f"{q} {' '.join(words.DOMAINS.get(d, [])[:3])}")) if kind != "legal_clause" else ("legal", None))
    return out + ([("comprehensive", f"{terms} comprehensive policy implementation")] if len(out) < most else [])


def test_rewrites_against_plain_python(spark):
    for most in (1, 3, 5, 8):
        for q, got in zip(QUESTIONS, column(spark, QUESTIONS, lambda c, m=most: rewriting.rewrites(c, m)), strict=True):
            want = plain_rewrites(q, most)
            assert [r.domain for r in got] == [d for d, _ in want]
            assert all(w is None or r.text == w for r, (_, w) in zip(got, want, strict=True))


def test_legal_clauses(spark):
    asked = ["RTE Section 12(1)(c)", "cce rule 7 for admission", "apsermc act 3", "right to education article 13", "education act clause 4(2)", "the act 9"]
    assert column(spark, asked, rewriting.legal_clause) == [
        "Right to Education Act 2009 Section 12(1)(c) responsibilities of schools", "AP CCE Rule 7 detailed provisions", "APSERMC Act Section 12 legal provisions",
        "Right to Education Act 2009 Section 13 responsibilities of schools no capitation fee admission procedures no screening", "Education Act Section 4(2) legal provisions", "Act Act Section 12 legal provisions",
    ]


def test_rewritten_is_a_lateral_join_in_order(spark):
    df = spark.createDataFrame([(1, "what is hostel food"), (2, None)], "query_id int, query string")
    out = rewriting.rewritten(df, most=2)
    assert [(r.query_id, r.place, r.domain) for r in out.orderBy("query_id", "place").collect()] == [(1, 0, "welfare_schemes"), (1, 1, "comprehensive"), (2, 0, "governance"), (2, 1, "academic")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


ENTRIES = [("phrase", "school infra", "buildings"), ("phrase", "school infra", "School infra works"), ("term", "teacher", "educator"), ("term", "Teacher", "teaching staff"), ("term", "l'école", "classe"), ("term", "c++", "compiler"), ("phrase", "é", "accent"), ("term", "", "nothing"), ("phrase", "x", "")]


def plain_found(q):
    low = (q or "").lower()
    hit = lambda kind, key: key.lower() in low if kind == "phrase" else re.search(r"\b" + re.escape(key.lower()) + r"\b", low)
    found = {e for kind, key, e in ENTRIES if key and e and hit(kind, key) and e.lower() not in low}
    return sorted(found, key=lambda e: (-len(e), e))


def test_expansions_against_plain_python(spark):
    asked = [*QUESTIONS, "School infrastructure for the teacher", "teachers", "teacher's school infra: buildings", "à l'école.", "c++ x", "c++x", "educator teacher", "schoolinfra", "teacher" * 50_000]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, query string")
    entries = spark.createDataFrame([(k, key, 1, e) for k, key, e in ENTRIES], expansion.ENTRY)
    for limit in (expansion.LIMIT, 30):  # one automaton; several
        out = {r.i: r.found for r in expansion.expansions(df, entries, limit=limit).collect()}
        assert out == {i: plain_found(q) for i, q in enumerate(asked)}
    assert expansion.expansions(df, entries.limit(0)).where("size(found) > 0").count() == 0
    assert expansion.expand_query(df.limit(0), entries).collect() == []


def test_cap_and_technology_questions(spark):
    df = spark.createDataFrame([(1, "teacher in school infra"), (2, "robotics at school"), (3, None)], "i int, query string")
    entries = spark.createDataFrame([(k, key, 1, e) for k, key, e in ENTRIES] + [("term", "robotics", 1, "atl")], expansion.ENTRY)
    out = {r.i: r.expanded for r in expansion.expand_query(df, entries, 2).collect()}
    assert out == {1: "teacher in school infra School infra works teaching staff", 2: "robotics at school atl atl nep 2020 stem education", 3: ""}


def test_first_version(spark):
    df = spark.createDataFrame([("coding for the teacher", "Section 12", "brainstorm"), ("nothing here", None, "qa")], "q string, e string, m string")
    got = [r[0] for r in df.select(expansion.enhance(F.col("q"), F.col("e"), F.col("m"))).collect()]
    assert got[0] == "coding for the teacher smart classroom digital infrastructure ICT lab computer lab technology lab innovation lab digital learning tools educational technology educator learning Section 12 innovative approaches solutions"
    assert got[1] == "nothing here"
