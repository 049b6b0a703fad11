"""Rewrites of queries by pattern and policy domain as Column expressions, and a table function of them for lateral joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalizer import SPACE, WORD
from tessera.functions.vocabulary import CROSS_DOMAIN, DEFAULT_DOMAINS, DOMAINS, REWRITE_STOPWORDS, SECTION_WORDS

_EDGE = f"(?:^|[^{WORD[1:-1]}])"


def bounded(pattern: str) -> str:
    """The pattern between ends of words, without look-around, so that any engine can run it."""
    return f"{_EDGE}(?:{pattern})(?:$|[^{WORD[1:-1]}])"


# fixed values: patterns of questions in the order of their tests, of legal clauses, and of questions over all domains
PATTERNS = {
    "what_is": bounded(f"what{SPACE}+(?:is|are)"),
    "how_to": bounded(f"how{SPACE}+(?:to|do)"),
    "requirements": bounded("requirements?|must|should"),
    "list": bounded("list|all|types?"),
}
LEGAL = [
    f"{_EDGE}(?:section|clause|article|rule|sub-rule|amendment|act|regulation){SPACE}+[0-9]",
    bounded(f"(?:rte|cce|apsermc|education){SPACE}+act"),
    rf"{_EDGE}[0-9]+\([0-9]+\)\({WORD}+\){WORD}",
]
BROAD = [
    bounded(f"(?:current|latest|all|comprehensive|complete|overall){SPACE}+(?:education{SPACE}+)?policies?"),
    bounded(f"education{SPACE}+(?:system|framework|structure|overview)"),
    bounded(f"(?:list|overview|summary){SPACE}+(?:of{SPACE}+)?(?:all{SPACE}+)?(?:education{SPACE}+)?(?:policies|initiatives|schemes)"),
    bounded(f"education{SPACE}+(?:in{SPACE}+)?(?:andhra{SPACE}+pradesh|ap)"),
    bounded(f"ap{SPACE}+education{SPACE}+(?:department|system|policies)"),
    bounded(f"state{SPACE}+education{SPACE}+policies?"),
]
CLAUSE = rf"{_EDGE}(?:section|clause|article|rule){SPACE}+([0-9]+(?:\([0-9]+\))?(?:\([a-z]\))?)"


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def pattern(query: Column) -> Column:

    def of(low: Column) -> Column:
        out = F.when(_any(low, LEGAL), "legal_clause")
        for name, p in PATTERNS.items():
            out = out.when(low.rlike(p), name)
        return out.otherwise("general")

    return bound(F.lower(query), of)


def is_broad(query: Column) -> Column:
    return bound(F.lower(query), lambda low: _any(low, BROAD))


def key_terms(query: Column, most: int = 5) -> Column:
    """The first words of three letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(query), F.lit(f"({WORD}+)"), F.lit(1))
    return F.slice(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*REWRITE_STOPWORDS)), 1, most)


def target_domains(query: Column) -> Column:
    """Domains by the words of their terms in the query, most first (earlier domain on ties); a fixed list where there are none."""

    def scored(low: Column) -> Column:
        entries = []
        for place, (name, terms) in enumerate(DOMAINS.items()):
            score = sum((F.when(low.contains(t.lower()), len(t.split())).otherwise(0) for t in terms), F.lit(0))
            entries.append(F.struct((-score).alias("order"), F.lit(place).alias("place"), F.lit(name).alias("domain")))
        return F.filter(F.array(*entries), lambda e: e["order"] < 0)

    names = lambda found: F.when(F.size(found) > 0, F.transform(F.array_sort(found), lambda e: e["domain"])).otherwise(F.array(*map(F.lit, DEFAULT_DOMAINS)))
    return bound(bound(F.lower(query), scored), names)


def legal_clause(query: Column) -> Column:
    """The clause that is asked for, in the words of its act or rules."""
    number = lambda low: F.coalesce(F.nullif(F.regexp_extract(low, CLAUSE, 1), F.lit("")), F.when(low.isNotNull(), "12"))
    return bound(F.lower(query), lambda low: bound(number(low), lambda n: _clause_text(low, n)))


def _clause_text(low: Column, number: Column) -> Column:
    rte = low.contains("rte") | low.contains("right to education")
    words = F.lit("")
    for section, more in SECTION_WORDS.items():
        words = F.when(number == section, " " + " ".join(more)).otherwise(words)
    rules = F.when(low.contains("rte"), "RTE").when(low.contains("cce"), "CCE").when(low.contains("admission"), "Admission").otherwise("Education")
    act = F.when(low.contains("cce"), "CCE").when(low.contains("apsermc"), "APSERMC").when(low.contains("education"), "Education").otherwise("Act")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(rte, text("Right to Education Act 2009 Section ", number, " responsibilities of schools", words))
        .when(low.contains("rule"), text("AP ", rules, " Rule ", number, " detailed provisions"))
        .otherwise(text(act, " Act Section ", number, " legal provisions"))
    )


def _turned(q: Column, domain: Column) -> Column:
    """struct(domain, text): the query, as struct(query, kind, terms, clause), turned to one domain by its pattern."""
    kind, terms, name = q["kind"], q["terms"], F.replace(domain, F.lit("_"), F.lit(" "))
    words = F.create_map(*[F.lit(x) for d, ts in DOMAINS.items() for x in (d, " ".join(ts[:3]))])
    text = (
        F.when(kind == "legal_clause", q["clause"])
        .when(kind == "what_is", F.concat(terms, F.lit(" "), name, F.lit(" policy provisions")))
        .when(kind == "how_to", F.concat(F.lit("Implementation of "), terms, F.lit(" in "), name))
        .when(kind == "requirements", F.concat(terms, F.lit(" "), name, F.lit(" requirements standards")))
        .when(kind == "list", F.concat(F.lit("All "), terms, F.lit(" related to "), name))
        .otherwise(F.concat(q["query"], F.lit(" "), F.coalesce(F.try_element_at(words, domain), F.lit(""))))
    )
    return F.struct(F.when(kind == "legal_clause", "legal").otherwise(domain).alias("domain"), text.alias("text"))


def rewrites(query: Column, most: int = 3, domains: Column | None = None) -> Column:
    """array<struct(domain, text)>: for broad questions one rewrite for each domain, else for each target domain; one over all domains if there is room. A null query is an empty one."""

    def known(query):
        chosen = F.when(is_broad(query), F.array(*map(F.lit, DOMAINS))).otherwise(target_domains(query) if domains is None else domains)
        clause = lambda kind: F.when(kind == "legal_clause", legal_clause(query))
        return bound(pattern(query), lambda kind: F.struct(
            query.alias("query"), kind.alias("kind"), F.array_join(key_terms(query), " ").alias("terms"), clause(kind).alias("clause"), F.slice(chosen, 1, most).alias("domains"),
        ))

    def all_of(q):
        each = F.transform(q["domains"], lambda d: _turned(q, d))
        whole = F.struct(F.lit("comprehensive").alias("domain"), F.concat(q["terms"], F.lit(" comprehensive " + " ".join(CROSS_DOMAIN))).alias("text"))
        return F.slice(F.concat(each, F.array(whole)), 1, most)

    return bound(bound(F.coalesce(query, F.lit("")), known), all_of)


def rewritten(queries: DataFrame, text: str = "query", most: int = 3) -> DataFrame:
    """queries joined laterally with their rewrites: place (from 0), domain and rewrite; one query in, at most `most` rows out, in order."""
    made = queries.withColumn("_rewrites", rewrites(F.col(text), most))
    # (no list is empty; without _outer Spark would add a filter that computes every list twice more)
    each = made.lateralJoin(queries.sparkSession.tvf.posexplode_outer(F.col("_rewrites").outer()).toDF("place", "_one"))
    return each.select(*queries.columns, "place", F.col("_one.domain").alias("domain"), F.col("_one.text").alias("rewrite"))
