"""Classification of documents by keyword counts and ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: keywords of each vertical, in the order that breaks ties
VERTICAL_KEYWORDS = {
    "go": ["government order", "g.o.", "preamble", "order", "whereas", "now therefore", "annexure"],
    "legal": ["act", "rule", "section", "chapter", "clause", "amendment", "regulation", "statute"],
    "judicial": ["petitioner", "respondent", "judgment", "court", "honourable", "held that", "appeal", "writ", "case"],
    "data": ["table", "figure", "statistics", "data", "report", "survey", "analysis", "enrollment", "percentage"],
    "scheme": ["scheme", "eligibility", "beneficiary", "benefit", "implementation", "guidelines", "application", "assistance"],
}
# fixed values: patterns of document types
AMENDMENT = [r"Amendment", r"amends?\s+(?:the\s+)?(?:Act|Rules?)", r"in\s+(?:partial\s+)?amendment"]
ACT = [r"(?:The\s+)?([A-Z][A-Za-z\s,\(\)]+)\s+Act(?:,?\s+\d{4})?", r"An\s+Act\s+to", r"BE\s+IT\s+ENACTED"]
RULE = [r"(?:The\s+)?([A-Z][A-Za-z\s,\(\)]+)\s+Rules(?:,?\s+\d{4})?", r"In\s+exercise\s+of\s+the\s+powers", r"pursuant\s+to\s+Section"]
NOTIFICATION = [r"NOTIFICATION", r"(?:is|are)\s+hereby\s+notified"]
CIRCULAR = [r"CIRCULAR", r"for\s+information\s+and\s+(?:compliance|guidance)"]
JUDGMENT = [r"JUDGMENT", r"CORAM[:\s]", r"(?:Hon'ble|Honourable)\s+(?:Justice|Judge)", r"(?:Petitioner|Appellant)\s+(?:Vs?\.?|versus)\s+(?:Respondent|Defendant)"]
COURT_ORDER = [r"ORDER", r"the\s+(?:Court|Bench)\s+(?:orders?|directs?)"]
REPORT = [r"(?:Annual|Quarterly|Monthly)\s+Report", r"REPORT\s+(?:ON|OF)", r"Executive\s+Summary"]
BUDGET = [r"Budget\s+(?:Estimates?|Allocations?)", r"Financial\s+(?:Statement|Estimates?)"]
SCHEME = [r"Scheme\s+(?:for|of)", r"(?:Eligibility|Benefits?)\s+under\s+the\s+scheme", r"Implementation\s+of\s+(?:the\s+)?scheme"]
GUIDELINES = [r"GUIDELINES?", r"Standard\s+Operating\s+Procedures?", r"Instructions?\s+for"]
# fixed values: category of each document type
CATEGORIES = {
    "go_order": "government_order", "go_notification": "government_order", "go_circular": "government_order",
    "act": "legislation", "rule": "legislation", "regulation": "legislation", "amendment": "legislation",
    "notification": "notification", "judgment": "judicial", "order": "judicial", "interim_order": "judicial",
    "report": "data_report", "statistics": "data_report", "budget": "data_report", "scheme_document": "scheme", "guidelines": "scheme",
}


def occurrences(text: Column, word: str) -> Column:
    """How often word occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def vertical_scores(text: Column, file_name: Column | None = None) -> dict[str, Column]:
    low = F.lower(text)
    name = F.lower(file_name) if file_name is not None else None
    out = {}
    for vertical, words in VERTICAL_KEYWORDS.items():
        score = sum((occurrences(low, w) for w in words), F.lit(0))
        if name is not None:
            score = score + sum((F.when(name.contains(w), 5).otherwise(0) for w in words), F.lit(0))
        out[vertical] = score
    return out


def vertical(text: Column, file_name: Column | None = None) -> Column:
    """struct(vertical, confidence): the most hits (first on ties), data at 0.3 below three hits, confidence capped at 0.8."""
    scores = vertical_scores(text, file_name)
    best = F.greatest(*scores.values())
    total = sum(scores.values(), F.lit(0))
    name = F.when(best < 3, "data")
    for v, s in scores.items():
        name = name.when(s == best, v)
    share = F.when(best < 3, 0.3).otherwise(F.least(best / F.greatest(total, F.lit(1)), F.lit(0.8)))
    return F.struct(name.alias("vertical"), F.round(share, 6).alias("confidence"))


def any_of(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?i){p}")
    return out


def _pair(doc_type: str, confidence: float) -> Column:
    return F.struct(F.lit(doc_type).alias("doc_type"), F.lit(confidence).alias("confidence"))


def document_type(text: Column, vertical_: Column, file_name: Column | None = None) -> Column:
    """struct(doc_type, confidence) from the first 2000 characters and the vertical."""
    t = F.substring(text, 1, 2000)
    low = F.lower(F.substring(text, 1, 500))
    go = F.when(any_of(t, CIRCULAR), _pair("go_circular", 0.85)).when(any_of(t, NOTIFICATION), _pair("go_notification", 0.80)).otherwise(_pair("go_order", 0.75))
    legal = (
        F.when(any_of(t, AMENDMENT), _pair("amendment", 0.90)).when(any_of(t, ACT), _pair("act", 0.90)).when(any_of(t, RULE), _pair("rule", 0.85))
        .when(any_of(t, NOTIFICATION), _pair("notification", 0.80)).when(low.contains("regulation"), _pair("regulation", 0.75)).otherwise(_pair("unknown", 0.50))
    )
    judicial = F.when(any_of(t, JUDGMENT), _pair("judgment", 0.90)).when(any_of(t, COURT_ORDER), F.when(low.contains("interim"), _pair("interim_order", 0.85)).otherwise(_pair("order", 0.85))).otherwise(_pair("order", 0.70))
    dense = occurrences(t, "Table") + occurrences(t, "|") + occurrences(t, "\t") > 10
    data = F.when(any_of(t, BUDGET), _pair("budget", 0.85)).when(any_of(t, REPORT), _pair("report", 0.80)).when(dense, _pair("statistics", 0.75)).otherwise(_pair("report", 0.70))
    if file_name is not None:
        f = F.lower(file_name)
        data = F.when(f.contains("budget"), _pair("budget", 0.90)).when(f.rlike("report|annual|quarterly"), _pair("report", 0.85)).when(f.rlike("stats|statistics|data"), _pair("statistics", 0.85)).otherwise(data)
    scheme = F.when(any_of(t, GUIDELINES), _pair("guidelines", 0.85)).when(any_of(t, SCHEME), _pair("scheme_document", 0.80)).otherwise(_pair("scheme_document", 0.75))
    return (
        F.when(text.isNull() | (text == ""), _pair("unknown", 0.0)).when(vertical_ == "go", go).when(vertical_ == "legal", legal).when(vertical_ == "judicial", judicial)
        .when(vertical_ == "data", data).when(vertical_ == "scheme", scheme).otherwise(_pair("unknown", 0.5))
    )


def category(doc_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, doc_type), F.lit("unknown"))


def is_table_content(text: Column) -> Column:
    """Pipes and tabs over 5 % of the characters, or digits over 20 %."""
    n = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.regexp_replace(text, "[|\t]", ""))
    digits = F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))
    return (marks / n > 0.05) | (digits / n > 0.2)
