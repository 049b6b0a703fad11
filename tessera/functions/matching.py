"""Entities of queries and outside texts, for matching them with those of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: formal patterns (their first group), informal ones, words and names
FORMAL = {
    "go_numbers": r"(?:go|government order|govt order)[\s\.]?(?:ms|rt|p)?[\s\.]?(?:no\.?|number)?\s*(\d+)", "go_refs": r"(?:ms|rt)[\s\.]?(?:no[\s\.]?)?(\d+)",
    "sections": r"section[\s\.]?(\d+(?:\(\d+\))?(?:\([a-z]\))?)", "rules": r"rule[\s\.]?(\d+(?:\(\d+\))?(?:\([a-z]\))?)", "articles": r"article[\s\.]?(\d+[a-z]?)",
    "acts": r"(rte|right to education|apsermc|education|cce)[\s\.]?act", "schemes": r"(nadu[- ]nedu|amma vodi|vidya kanuka|gorumudda|midday meal)", "departments": r"(education|school education|higher education|finance|revenue)[\s\.]?department",
    "keywords": r"(teacher|transfer|recruitment|amendment|implementation|policy)", "dates": r"(\d{1,2}[-/]\d{1,2}[-/]\d{4})", "years": r"(20\d{2})",
    "hr_terms": r"(salary|payscale|recruitment|hiring|contract|private|appointment|vacancy|post|remuneration|staffing|service rules)",
}
INFORMAL = {
    "go_numbers": [r"\bgos?\b", r"\bgovernment\s+orders?\b", r"\bg\.?o\.?s?\b", r"\borders?\b.*\beducation\b"], "sections": [r"\bsections?\b", r"\bprovisions?\b", r"\brules?\b", r"\bclause\b"],
    "schemes": [r"\bschemes?\b", r"\bprograms?\b", r"\binitiatives?\b"], "departments": [r"\bschool\s+education\b", r"\beducation\s+department\b", r"\beducation\b"],
    "keywords": [r"\bteacher\b", r"\btransfer\b", r"\brecent(?:ly)?\b", r"\blatest\b", r"\bnew\b", r"\bcurrent\b"], "years": [r"\b202[0-9]\b", r"\b20\d{2}\b"],
}
WORDS = [
    "literacy", "education", "learning", "curriculum", "pedagogy", "teaching", "assessment", "examination", "evaluation", "training", "policy", "regulation", "guideline", "standard", "framework", "act", "rule", "provision", "mandate", "requirement", "compliance",
    "country", "countries", "nation", "state", "international", "global", "singapore", "finland", "japan", "korea", "india", "quality", "excellence", "performance", "achievement", "improvement", "development", "progress", "standards", "benchmarks",
]
SCHEMES = ["nadu nedu", "amma vodi", "vidya kanuka", "gorumudda", "midday meal"]
OUTSIDE = [(r"(?i)G\.?O\.?\s*(?:Ms\.?|Rt\.?|P\.?)?[\s\.]?(?:No\.?|Number)?\s*\d+", 0), (r"(?:The\s+)?([A-Z][a-zA-Z\s]+Act(?:,?\s+\d{4})?)", 1)]
# fixed values: the strict set
STRICT = {
    "departments": r"(?i)\b(education|finance|revenue|general administration|school education|higher education)\s+department\b", "acts": r"(?i)\b(RTE|Right to Education|APSERMC|CCE)\s+Act\b",
    "hr_terms": r"(?i)\b(salary|payscale|recruitment|hiring|contract|private|appointment|vacancy|post|remuneration|staffing|service rules)\b",
}
STRICT_GO = r"(?i)G\.O\.(Ms|Rt)\.No\.\s*(\d+)"
# fixed values: payload fields that a filter's field is looked up in, by vertical
FIELDS = {
    "sections": {"legal": ["section", "sections", "mentioned_sections"], "go": ["mentioned_sections"], "judicial": ["mentioned_sections"]},
    "go_number": {"go": ["go_number"], "legal": ["mentioned_gos"], "judicial": ["mentioned_gos"]},
    "year": {v: ["year"] for v in ("legal", "go", "judicial", "data", "schemes")},
    "department": {"go": ["department", "departments"], "data": ["departments"], "schemes": ["departments"]},
    "case_number": {"judicial": ["case_number"]},
}


def query_entities(query: Column) -> dict[str, Column]:
    """Distinct, sorted entities of a query by type: formal matches, then informal wording, words of four topics and names of schemes."""
    low = F.lower(query)
    found = {}
    for kind in {**FORMAL, **INFORMAL}:
        parts = [F.regexp_extract_all(low, F.lit(FORMAL[kind]), F.lit(1))] if kind in FORMAL else []
        parts += [F.when(low.rlike(p), F.array(F.regexp_extract(low, p, 0))).otherwise(F.array().cast("array<string>")) for p in INFORMAL.get(kind, [])]
        if kind == "keywords":
            parts.append(F.filter(F.regexp_extract_all(low, F.lit(r"\b([a-z]+)\b"), F.lit(1)), lambda w: w.isin(*WORDS)))
        if kind == "schemes":
            parts.append(F.filter(F.array(*map(F.lit, SCHEMES)), lambda s: low.contains(s)))
        found[kind] = F.array_sort(F.array_distinct(F.concat(*parts)))
    return found


def outside_entities(text: Column) -> Column:
    """Orders as written, and names of acts of 11 to 49 characters."""
    orders, acts = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(g)) for p, g in OUTSIDE)
    return F.array_sort(F.array_distinct(F.concat(orders, F.filter(acts, lambda a: (F.length(a) > 10) & (F.length(a) < 50)))))


def strict_entities(text: Column) -> dict[str, Column]:
    kinds, numbers = (F.regexp_extract_all(text, F.lit(STRICT_GO), F.lit(g)) for g in (1, 2))
    orders = F.zip_with(kinds, numbers, lambda k, n: F.concat(F.lit("G.O."), k, F.lit(".No."), n))
    return {"go_numbers": orders, **{k: F.regexp_extract_all(text, F.lit(p), F.lit(1)) for k, p in STRICT.items()}}


def mapped_fields(field: str, vertical: Column) -> Column:
    """Payload fields to look in; none where the vertical doesn't have it, the field itself where it isn't known."""
    none = F.array().cast("array<string>")
    if field not in FIELDS:
        return F.array(F.lit(field))
    out = F.when(F.lit(False), none)
    for v, names in FIELDS[field].items():
        out = out.when(vertical == v, F.array(*map(F.lit, names)))
    return out.otherwise(none)
