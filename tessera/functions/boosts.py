"""Boosts, states and hints that read a result's text and payload, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import scoring

# fixed values: factors, words and domains of the boosts
COURTS = {"supreme court": 1.0, "high court": 0.9, "district court": 0.7, "tribunal": 0.6}
KEY_REPORTS = ["udise", "aser", "district information", "state education", "unified district", "annual report"]
INTERNATIONAL = ["finland", "singapore", "south korea", "japan", "oecd", "unesco", "world bank", "unicef", "global", "international"]
INTERNATIONAL_QUERY = ["international", "global", "world", "overseas", "singapore", "finland", "estonia", "uk", "usa", "us", "canada", "australia", "philippines", "japan", "korea", "germany", "france", "europe", "oecd", "unicef", "unesco"]
METRICS = [r"\d+\.?\d*%", r"\d+\.?\d*\s*(lakh|crore|thousand|million)", r"(enrollment|dropout|attendance|score).*\d+"]
GOVERNMENT = ["gov.in", "nic.in", "india.gov.in", "education.gov.in", "mhrd.gov.in"]
EDUCATION = ["ac.in", "edu.in", "ncert.nic.in", "ncte.gov.in", "ugc.ac.in"]
WORLD = ["unesco.org", "worldbank.org", "oecd.org", "unicef.org"]
SUPERSEDED_WORDS = ["superseded", "replaced by", "substituted by", "cancelled", "withdrawn", "modified by", "updated by"]
SUPERSEDING_WORDS = ["supersedes", "replaces", "substitutes", "hereby cancels"]
IMPORTANT = ["right to education", "rte", "education act", "constitution", "section", "rule", "article", "act", "g.o.ms.no", "government order", "notification", "apsermc", "ap education", "fundamental rights"]
ENTITY_WEIGHTS = {"go_numbers": 1.5, "sections": 1.4, "articles": 1.3, "acts": 1.2, "schemes": 1.1, "departments": 1.0, "dates": 0.8}
BRAINSTORM = {"schemes": (15, 1.2), "data": (15, 1.1), "go": (8, 0.9), "legal": (5, 0.7), "judicial": (5, 0.7)}
HINTS = {
    "legal": ["Check related sections", "Review amendments", "See judicial interpretations"], "go": ["Check implementation status", "Review related GOs", "See department circulars"],
    "judicial": ["Read full judgment", "Check if appealed", "See cited precedents"], "data": ["Download full report", "Compare year-over-year", "Check district-wise data"],
    "schemes": ["Check eligibility criteria", "Review implementation guidelines", "See similar schemes"],
}
TRIGGERS = [
    "government order", "go no", "ms no", "rt no", "notification", "section", "article", "rule", "act", "policy", "guidelines", "commissioner", "secretary", "director", "department",
    "infrastructure", "facility", "building", "construction", "nadu nedu", "classroom", "toilet", "laboratory", "scheme", "welfare", "benefit", "assistance", "amma vodi", "scholarship", "hostel", "transport", "nutrition",
    "safety", "security", "compliance", "standard", "audit", "technical", "specification", "procurement", "tender",
]
#: category: (factor, words)
BOOST_WORDS = {
    "government_orders": (1.8, [
        "go ms no", "go rt no", "go no", "government order", "ms no 1", "ms no 2", "ms no 3", "ms no 4", "ms no 5", "rt no 1", "rt no 2", "rt no 3", "rt no 4", "rt no 5", "orders issued", "hereby ordered", "notification", "circular",
        "policy guidelines", "implementation instructions", "directions", "subject approval", "sanctioned", "authorized", "constituted", "commissioner", "secretary", "director", "principal secretary", "government of andhra pradesh",
        "school education department", "higher education department", "finance department", "establishment", "appointment", "transfer", "posting", "budget allocation", "fund release", "scheme implementation", "monitoring committee", "review meeting",
    ]),
    "legal_clauses": (2.0, [
        "section 12", "section 13", "section 14", "section 15", "section 16", "article 21a", "article 45", "right to education", "rte act", "cce rules", "assessment rules", "examination rules", "admission criteria", "age criteria",
        "reservation quota", "free and compulsory education", "neighbourhood school", "special category", "economically weaker section", "private school", "government school", "aided school",
    ]),
    "infrastructure": (1.5, [
        "nadu nedu", "infrastructure", "building", "classroom", "toilet", "drinking water", "electricity", "boundary wall", "compound wall", "furniture", "bench", "desk", "blackboard", "laboratory", "library", "playground", "sports facility",
        "kitchen", "ramp", "accessibility", "construction", "renovation", "maintenance", "repair", "tmf", "cctv", "security", "fire safety", "emergency exit", "sanitation", "hygiene", "medical room", "first aid", "compound", "fencing",
    ]),
    "welfare_schemes": (1.4, [
        "amma vodi", "vidya kanuka", "vidya deevena", "gorumudda", "mid day meal", "midday meal", "school kit", "uniform", "scholarship", "financial assistance", "transport scheme", "hostel", "residential school", "welfare scheme", "benefit",
        "incentive", "allowance", "stipend", "nutrition program", "health checkup", "medical assistance", "free textbook", "bicycle scheme", "student welfare", "social security",
    ]),
    "safety_compliance": (1.3, [
        "fire safety", "emergency procedure", "evacuation plan", "safety drill", "accident prevention", "child protection", "safety audit", "compliance check", "safety standard", "security protocol", "cctv monitoring", "visitor management",
        "gate security", "boundary security", "staff verification", "background check", "child safety policy", "harassment prevention", "grievance",
    ]),
    "technical_specifications": (1.2, [
        "specification", "technical requirement", "standard", "norm", "measurement", "dimension", "capacity", "quantity", "quality", "procurement", "tender", "supplier", "vendor", "contract", "rate analysis", "cost estimation",
        "budget allocation", "financial provision", "expenditure", "utilization certificate",
    ]),
}


def holds(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in the (lower-cased) text."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def times(*factors: tuple[Column, float]) -> Column:
    """The product of the factors whose condition holds."""
    out = F.lit(1.0)
    for condition, x in factors:
        out = out * F.when(condition, x).otherwise(1.0)
    return out


def go_boost(year: Column, department: Column, go_number: Column, now: int) -> Column:
    age = F.when(year >= now - 3, 1.2).when(year >= now - 5, 1.1).otherwise(1.0)
    return age * times((holds(low(department), ["education", "school", "teacher"]), 1.15), (low(go_number) != "", 1.1))


def legal_boost(act: Column, section: Column) -> Column:
    named = F.when(low(act).contains("constitution"), 1.3).when(holds(low(act), ["right to education", "rte"]), 1.2).otherwise(1.0)
    return named * times((low(section) != "", 1.1))


def judicial_boost(court: Column, citations: Column, text: Column) -> Column:
    rank = F.when(F.lit(False), 1.0)
    for name, x in COURTS.items():
        rank = rank.when(low(court).contains(name), x)
    cited = F.when(citations > 10, 1.2).when(citations > 5, 1.1).otherwise(1.0)
    return rank.otherwise(1.0) * cited * times((holds(low(text), ["landmark", "precedent", "overruled", "binding"]), 1.15))


def contains_metrics(text: Column) -> Column:
    found = F.lit(False)
    for p in METRICS:
        found = found | F.coalesce(text, F.lit("")).rlike(f"(?i){p}")
    return found


def data_boost(source: Column, text: Column, year: Column) -> Column:
    fresh = F.when(year >= 2020, 1.2).when(year >= 2018, 1.1).otherwise(1.0)
    return times((holds(low(source), KEY_REPORTS), 1.2), (contains_metrics(text), 1.15)) * fresh


def schemes_boost(text: Column, source: Column, status: Column) -> Column:
    return times(
        (holds(low(text), INTERNATIONAL) | holds(low(source), INTERNATIONAL), 1.25), (holds(low(status), ["active", "ongoing"]), 1.15), (holds(low(text), ["success", "effective", "impact", "outcome"]), 1.1),
    )


def go_status(year: Column, now: int) -> Column:
    return F.when(year.isNull() | (year == 0), "unknown").when(year >= now - 2, "likely_active").when(year >= now - 5, "possibly_active").otherwise("historical")


def precedent_value(court: Column) -> Column:
    return F.when(low(court).contains("supreme court"), "binding").when(low(court).contains("high court"), "persuasive").otherwise("informative")


def scheme_type(text: Column, source: Column) -> Column:
    t = low(text)
    kinds = [("pilot", ["pilot", "experimental", "trial"]), ("central", ["central", "national", "india"]), ("state", ["state", "andhra pradesh", "ap"])]
    out = F.when(holds(t, INTERNATIONAL) | holds(low(source), INTERNATIONAL), "international")
    for kind, words in kinds:
        out = out.when(holds(t, words), kind)
    return out.otherwise("unknown")


def payload_year(*fields: Column) -> Column:
    """The first year that one of the fields names, 2000 if none does."""
    found = [F.try_to_number(F.nullif(F.regexp_extract(f.cast("string"), r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int") for f in fields]
    return F.coalesce(*found, F.lit(2000))


def filter_matches(values: dict[str, Column], filters: dict[str, list[str]]) -> Column:
    """The share of filters whose field has one of the wanted values; 0.5 without filters."""
    hits = sum((F.when(F.coalesce(values[k].cast("string"), F.lit("")).isin(*wanted), 1).otherwise(0) for k, wanted in filters.items()), F.lit(0))
    return scoring.metadata_relevance(hits, F.lit(len(filters)))


def hints(vertical: Column) -> Column:
    table = F.create_map(*[x for k, words in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    return F.coalesce(F.try_element_at(table, vertical), F.array().cast("array<string>"))


def related_hints(document: Column, section: Column, go_number: Column) -> Column:
    """What else to look at: the same document, sections nearby, orders of the same series; null where nothing is known."""
    some = lambda c: low(c) != ""
    parts = F.array_compact(F.array(
        F.when(some(document), F.concat(F.lit("same_document:"), document)),
        F.when(some(section), F.concat(F.lit("nearby_sections:"), section, F.lit(":Check adjacent sections for context"))),
        F.when(some(go_number), F.concat(F.lit("same_series:"), go_number, F.lit(":Check related GOs from same department"))),
    ))
    return F.when(F.size(parts) > 0, parts)


# ---- relations


def domain_relevant(query: Column, vertical: Column, content: Column) -> Column:
    """Queries of up to two words, those that name the vertical, or share two words with the first 200 characters."""
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    shared = F.size(F.array_intersect(words(query), words(F.substring(content, 1, 200))))
    return (F.size(words(query)) <= 2) | F.lower(query).contains(F.lower(vertical)) | (shared >= 2)


def is_superseded(types: Column, content: Column) -> Column:
    return F.array_contains(types, "superseded_by") | holds(low(content), SUPERSEDED_WORDS)


def supersedes_others(types: Column, content: Column) -> Column:
    return F.array_contains(types, "supersedes") | holds(low(content), SUPERSEDING_WORDS)


def cites_important(relations: Column) -> Column:
    """relations: an array of (relation_type, target)."""
    return F.exists(relations, lambda r: (r["relation_type"] == "cites") & holds(F.lower(r["target"]), IMPORTANT))


def final_factor(place: Column, current: Column, neighbour: Column) -> Column:
    return times(((place <= 5) & current, 1.05), ((place <= 3) & neighbour, 0.95))


# ---- entities


def entity_overlap(query: dict[str, Column], result: dict[str, Column]) -> Column:
    """Weighted overlap by type of entity: equal values count 1 and contained ones 0.5 of the union; a type that the result lacks (null) adds 1 to what was possible."""

    def shared(q: Column, r: Column) -> Column:
        same = F.array_intersect(q, r)
        alike = F.filter(q, lambda x: ~F.array_contains(same, x) & F.exists(r, lambda y: y.contains(x) | x.contains(y)))
        return (F.size(same) + 0.5 * F.size(alike)) / F.greatest(F.size(F.array_union(q, r)), F.lit(1))

    total, possible = F.lit(0.0), F.lit(0.0)
    for kind, values in query.items():
        weight = ENTITY_WEIGHTS.get(kind, 1.0)
        share = shared(*(F.array_distinct(F.transform(v, lambda x: F.lower(x))) for v in (values, result[kind])))
        asked, known = F.size(values) > 0, result[kind].isNotNull()
        total = total + F.when(asked & known, share * weight).otherwise(0.0)
        possible = possible + F.when(asked, F.when(known, weight).otherwise(1.0)).otherwise(0.0)
    return F.when(possible > 0, total / possible).otherwise(0.0)


def entity_boost(score: Column, overlap: Column, entities: Column, wants_recent: Column, time_score: Column) -> Column:
    density = F.when(entities >= 5, 1.1).when(entities >= 3, 1.05).otherwise(1.0)
    recent = F.when(time_score > 0.5, 1.0 + 0.5 * time_score).when(time_score < -0.5, 0.3).otherwise(1.0)
    return score * (1.0 + 0.3 * overlap) * density * F.when(wants_recent, recent).otherwise(1.0)


# ---- words of a query's categories


def boost_pattern(category: str, word: str) -> str:
    """Numbered orders may be written with or without blanks, as no, no. or number, and with a number after them."""
    parts = word.split(" ")
    if category == "government_orders" and "no" in parts:
        return r"\b" + r"\s*".join(r"(?:no\.?|number)" if p == "no" else p for p in parts) + r"\s*\d*"
    blank = r"\s+" if category in ("welfare_schemes", "safety_compliance") else " "
    return r"\b" + blank.join(parts) + r"\b"


def should_boost(query: Column) -> Column:
    return holds(low(query), TRIGGERS)


def boost_terms(query: Column) -> Column:
    """Map of category to what its words match in the query, repeats included; categories without a match are absent."""
    found = [F.struct(F.lit(c).alias("key"), F.flatten(F.array(*[F.regexp_extract_all(F.lower(query), F.lit(boost_pattern(c, w)), F.lit(0)) for w in words])).alias("value")) for c, (_, words) in BOOST_WORDS.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: F.size(e["value"]) > 0))


def boost_bm25(terms: Column, tokens: Column) -> Column:
    """BM25 of single-token terms in a text, for a mean length of 100 and terms in one of 1000 documents."""
    idf, size = math.log((1000 - 1 + 0.5) / 1.5 + 1.0), F.size(tokens)

    def one(acc, term):
        tf = F.size(F.filter(tokens, lambda t: t == term))
        return acc + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 100.0))

    return F.aggregate(terms, F.lit(0.0), one)


def category_boost(score: Column, terms: Column, content: Column, least: float = 0.5) -> Column:
    """score, raised for each category by its BM25 x factor x 0.1, up to 1; scores under `least` stay."""
    tokens = F.regexp_extract_all(F.lower(content), F.lit(r"(\w+)"), F.lit(1))
    factors = F.create_map(*[F.lit(x) for c, (f, _) in BOOST_WORDS.items() for x in (c, f)])
    gain = F.aggregate(F.map_entries(terms), F.lit(0.0), lambda s, e: s + boost_bm25(e["value"], tokens) * factors[e["key"]] * 0.1)
    return F.when((score >= least) & (gain > 0), F.least(score + gain, F.lit(1.0))).otherwise(score)


# ---- hybrid and web results


def term_hybrid(score: Column, terms: Column, content: Column) -> Column:
    """0.7 of the score and 0.3 of the share of the query's terms (repeats count) among the content's words."""
    words = F.split(F.lower(content), r"\s+")
    return 0.7 * score + 0.3 * F.size(F.filter(terms, lambda t: F.array_contains(words, t))) / F.greatest(F.size(terms), F.lit(1))


def web_authority(url: Column, source: Column) -> Column:
    at = lambda domains: holds(low(url), domains) | holds(low(source), domains)
    return F.when(at(GOVERNMENT), 1.5).when(at(EDUCATION), 1.3).when(at(WORLD), 1.2).otherwise(1.0)


def web_recency(title: Column, snippet: Column, now: int) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    last = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    return F.when(last == now, 1.2).when(last == now - 1, 1.1).otherwise(1.0)


def web_keeps(title: Column, snippet: Column) -> Column:
    return (low(title) != "") & (F.length(F.coalesce(snippet, F.lit(""))) > 50)


def official(url: Column, source: Column) -> Column:
    return holds(low(url), GOVERNMENT) | holds(low(source), GOVERNMENT)


# ---- answers


def claim_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def claim_confidence(claim: Column, snippets: Column) -> Column:
    """0.5 without numbers; else by the first pair of a claim's and one of the first three snippets' numbers that differ by under 10 % (0.9) or 30 % (0.7); 0.4 without such a pair."""
    mine = claim_numbers(claim)
    pairs = F.flatten(F.transform(F.slice(snippets, 1, 3), lambda s: F.flatten(F.transform(mine, lambda a: F.transform(claim_numbers(s), lambda b: F.abs(a - b) / F.greatest(a, b))))))
    near = F.filter(pairs, lambda r: r < 0.3)
    return F.when(F.size(mine) == 0, 0.5).when(F.size(near) == 0, 0.4).when(F.get(near, F.lit(0)) < 0.1, 0.9).otherwise(0.7)


def overall_confidence(initial: Column, checks: Column) -> Column:
    mean = F.aggregate(checks, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(checks), F.lit(1))
    return F.when(F.size(checks) == 0, initial).otherwise(0.6 * initial + 0.4 * mean)


def answer_confidence(answer: Column, citations: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.when(citations > 0, 0.3).otherwise(0.0) + F.when(F.length(F.coalesce(answer, F.lit(""))) > 200, 0.1).otherwise(0.0) + F.when(citations >= 3, 0.1).otherwise(0.0))


def dynamic_k(base: int, comprehensive: Column, verticals: Column) -> Column:
    k = F.when(comprehensive > 0.5, F.floor(F.lit(base * 3) / 2)).otherwise(base)
    return F.when(verticals > 3, F.floor(k * 6 / 5)).otherwise(k).cast("int")
