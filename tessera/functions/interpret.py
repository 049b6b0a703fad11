"""Query interpretation, routing and planning as Column expressions over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: votes for query types, in the order that breaks ties
TYPE_PATTERNS = {
    "qa": [r"\bwhat\s+is\b", r"\bwhat\s+are\b", r"\bwho\s+is\b", r"\bwhen\s+was\b", r"\bwhere\s+is\b", r"\bhow\s+many\b", r"\bdefine\b", r"\bexplain\b(?!\s+how\s+to)", r"\btell\s+me\s+about\b"],
    "framework": [r"\bdesign\b", r"\bcreate\s+a\s+framework\b", r"\bdevelop\s+a\s+plan\b", r"\bpropose\b", r"\bcomprehensive\s+(framework|plan|strategy)\b", r"\bhow\s+to\s+(implement|design|create|build)\b", r"\bstrategy\s+for\b", r"\bapproach\s+to\b"],
    "list": [r"\blist\s+(all|the)?\b", r"\benumerate\b", r"\bwhat\s+are\s+(all|the)\s+\w+\s+(for|in|of)\b", r"\bshow\s+me\s+all\b", r"\bgive\s+me\s+(all|the)\s+\w+\b", r"\btypes\s+of\b", r"\bcategories\s+of\b"],
    "compliance": [r"\bcheck\s+compliance\b", r"\bis\s+\w+\s+compliant\b", r"\bvalidate\b", r"\bverify\b", r"\bmeets?\s+requirements?\b", r"\badhere\s+to\b", r"\bfollows?\s+the\s+rules?\b"],
    "comparison": [r"\bcompare\b", r"\bdifference\s+between\b", r"\bvs\.?\b", r"\bversus\b", r"\bhow\s+does\s+\w+\s+differ\b", r"\bsimilarities\s+and\s+differences\b"],
    "history": [r"\bhistory\s+of\b", r"\bhow\s+has\s+\w+\s+changed\b", r"\bevolution\s+of\b", r"\bover\s+time\b", r"\bprevious\b", r"\bold\s+(version|rule|policy)\b", r"\bsuperseded\b", r"\bsuperseded\b", r"\bamended\b"],
    "hr": [r"\bhiring\b", r"\brecruitment\b", r"\bappointment\b", r"\bvacancy\b", r"\bpost\b", r"\bjob\b", r"\bsalary\b", r"\bpayscale\b", r"\bremuneration\b", r"\bcontract\s+teacher\b", r"\bprivate\s+sector\b", r"\boutsourcing\b", r"\bstaffing\b", r"\bhuman\s+resource\b", r"\bservice\s+rules\b", r"\bemployment\b"],
}
NARROW = [r"\bspecific\b", r"\bexact\b", r"\bsection\s+\d+\b", r"\bGO\.?\s*(?:Ms\.?|Rt\.?)?\s*No\.?\s*\d+\b", r"\bclause\s+\d+\b", r"\bparagraph\s+\d+\b", r"\bone\s+\w+\b"]
BROAD = [r"\ball\b", r"\bcomplete\b", r"\bcomprehensive\b", r"\bentire\b", r"\bfull\b", r"\beverything\s+about\b", r"\boverall\b", r"\bholistic\b", r"\bmultiple\b"]
INTERNET = [
    r"\blatest\b", r"\brecent\b", r"\bcurrent\b", r"\b202[4-9]\b", r"\b203\d\b", r"\bthis\s+year\b", r"\bnew\b", r"\bupdated\b", r"\btoday\b", r"\bnow\b", r"\bsingapore\b", r"\bfinland\b", r"\bestonia\b",
    r"\bsouth\s+korea\b", r"\bjapan\b", r"\binternational\b", r"\bglobal\b", r"\bworld-class\b", r"\bworld\s+leading\b", r"\bglobally\b", r"\bworld.*systems?\b",
]
BRAINSTORM_WORDS = ["ideas", "suggestions", "brainstorm", "innovate"]
KEYWORD_STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "what", "when", "where", "who", "how", "why", "which"]
FILLERS = ["tell", "me", "about", "what", "is", "are", "the", "a", "an", "please", "can", "you", "could", "would", "how", "why", "when", "where", "which", "who", "whom", "whose", "explain", "describe"]
V1_KEYWORDS = {
    "legal": ["act", "law", "legislation", "section", "article", "provision", "clause", "rule", "regulation", "rte", "constitution"],
    "go": ["go", "government order", "notification", "circular", "g.o", "order", "directive"],
    "judicial": ["judgment", "court", "case", "writ", "petition", "supreme court", "high court", "judicial"],
    "data": ["statistics", "data", "report", "survey", "udise", "enrollment", "dropout", "percentage", "ratio"],
    "schemes": ["scheme", "program", "initiative", "project", "mission", "mana badi", "naadu nedu", "infrastructure"],
}
CATEGORY_KEYWORDS = {
    "infrastructure": ["infrastructure", "building", "classroom", "toilet", "water", "electricity", "furniture", "playground", "library", "lab", "construction", "renovation", "maintenance", "facilities", "boundary wall", "compound", "ramp", "accessibility"],
    "safety": ["safety", "security", "cctv", "fire", "emergency", "fence", "guard", "watchman", "gate", "lighting", "first aid", "medical", "hygiene", "sanitation", "health"],
    "fln": ["fln", "literacy", "numeracy", "reading", "writing", "math", "mathematics", "foundational", "learning outcomes", "basic skills", "grade level", "competencies", "early grade"],
    "teacher": ["teacher", "educator", "faculty", "staff", "training", "recruitment", "transfer", "posting", "promotion", "appraisal", "tet", "qualification", "professional development", "headmaster", "principal", "subject teacher"],
    "academic": ["curriculum", "syllabus", "textbook", "tlm", "pedagogy", "assessment", "examination", "evaluation", "grades", "marks", "promotion", "academic", "subject", "timetable", "calendar"],
    "monitoring": ["monitoring", "supervision", "inspection", "udise", "data", "reporting", "compliance", "quality", "performance", "indicators", "metrics", "dashboard", "enrollment", "attendance", "dropout"],
    "welfare": ["midday meal", "mdm", "scholarship", "uniform", "bicycle", "hostel", "nutrition", "incentive", "stipend", "cwsn", "special needs", "inclusion", "sc/st", "minority", "girl"],
    "governance": ["smc", "smdc", "pta", "management", "committee", "community", "participation", "policy", "guideline", "rule", "regulation", "act", "government order", "circular"],
}
# fixed values: plan of each mode: rewrites, hops, k per vertical, k in all, k to rerank, diversity
MODES = {"qa": (2, 1, 20, 40, 10, 0.2), "policy": (3, 2, 30, 60, 15, 0.4), "framework": (5, 2, 40, 100, 20, 0.5), "deepthink": (5, 2, 50, 120, 25, 0.6), "compliance": (2, 1, 15, 30, 10, 0.1), "brainstorm": (5, 2, 40, 100, 20, 0.7)}
TYPE_TO_MODE = {"qa": "qa", "list": "qa", "policy": "policy", "comparison": "policy", "history": "policy", "framework": "framework", "compliance": "compliance", "brainstorm": "brainstorm"}
COLLECTIONS = {"legal": "legal_documents", "go": "government_orders", "judicial": "judicial_documents", "data": "data_reports", "schemes": "schemes"}
VERTICAL_ORDER = {"legal": 1, "go": 2, "judicial": 3, "schemes": 4, "data": 5}


def votes(query: Column, patterns: list[str]) -> Column:
    return sum((query.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))


def query_type(query: Column) -> Column:
    """struct(query_type, confidence): most votes, normalised; qa at 0.3 without any; brainstorm at 0.7 when the share is low and ideas are asked for."""
    v = {k: votes(query, ps) for k, ps in TYPE_PATTERNS.items()}
    total, best = sum(v.values(), F.lit(0)), F.greatest(*v.values())
    low = F.lower(query)
    ideas = F.lit(False)
    for w in BRAINSTORM_WORDS:
        ideas = ideas | low.contains(w)
    name = F.when(total == 0, "qa").when((best / total < 0.3) & ideas, "brainstorm")
    for k, x in v.items():
        name = name.when(x == best, k)
    share = F.when(total == 0, 0.3).when((best / total < 0.3) & ideas, 0.7).otherwise(best / F.greatest(total, F.lit(1)))
    return F.struct(name.alias("query_type"), F.round(share, 6).alias("confidence"))


def words(query: Column) -> Column:
    return F.filter(F.split(query, r"\s+"), lambda w: w != "")


def scope(query: Column) -> Column:
    n = F.size(words(query))
    narrow = votes(query, NARROW) + F.when(n <= 5, 1).otherwise(0)
    broad = votes(query, BROAD) + F.when(n > 15, 1).otherwise(0)
    return F.when(broad > narrow, "broad").when(narrow > broad, "narrow").otherwise("medium")


def needs_internet(query: Column) -> Column:
    return votes(query, INTERNET) > 0


def needs_deep_mode(kind: Column, scope_: Column) -> Column:
    return kind.isin("framework", "brainstorm") | (scope_ == "broad") | ((kind == "policy") & (scope_ == "medium"))


def keywords(query: Column) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.slice(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*KEYWORD_STOPWORDS)), 1, 10)


def normalize(query: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(out, r"\s+([.,!?;:])", "$1"), r"([.,!?;:])\s*$", "")


def remove_filler(query: Column) -> Column:
    alt = "|".join(FILLERS)
    out = F.regexp_replace(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), rf"^(?:(?:{alt})(?: |$))+", "")
    return F.regexp_replace(out, rf"(?:(?:^| )(?:{alt}))+$", "")


def clean_for_bm25(query: Column) -> Column:
    out = F.regexp_replace(remove_filler(normalize(query)), r"(?U)[^\w\s-]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def route_v1(query: Column) -> Column:
    """array of struct(vertical, confidence), best first: 0.3 for each keyword, 1 at most; legal 0.6 and go 0.4 without any."""
    low = F.lower(query)
    entries = []
    for i, (v, ws) in enumerate(V1_KEYWORDS.items()):
        score = F.least(sum((F.when(low.contains(w), 0.3).otherwise(0.0) for w in ws), F.lit(0.0)), F.lit(1.0))
        entries.append(F.struct((-F.round(score, 6)).alias("order"), F.lit(i).alias("place"), F.lit(v).alias("vertical"), F.round(score, 6).alias("confidence")))
    found = F.array_sort(F.filter(F.array(*entries), lambda e: e["confidence"] > 0))
    default = F.array(F.struct(F.lit("legal").alias("vertical"), F.lit(0.6).alias("confidence")), F.struct(F.lit("go").alias("vertical"), F.lit(0.4).alias("confidence")))
    return F.when(F.size(found) == 0, default).otherwise(F.transform(found, lambda e: F.struct(e["vertical"].alias("vertical"), e["confidence"].alias("confidence"))))


def categories(query: Column, most: int = 3, least: float = 0.1) -> Column:
    """Names of the categories whose keywords occur as words, weighted by the keywords' words, at a tenth of the best or more; three at most."""
    entries = []
    for i, (c, ws) in enumerate(CATEGORY_KEYWORDS.items()):
        score = sum((F.when(query.rlike(rf"(?i)\b{w}\b"), len(w.split())).otherwise(0) for w in ws), F.lit(0))
        entries.append(F.struct((-score).alias("order"), F.lit(i).alias("place"), F.lit(c).alias("category")))
    every = F.array_sort(F.array(*entries))
    best = -F.element_at(every, 1)["order"]
    kept = F.filter(every, lambda e: (best > 0) & (-e["order"] >= least * best))
    return F.transform(F.slice(kept, 1, most), lambda e: e["category"])


def plan(kind: Column, scope_: Column, verticals: Column) -> Column:
    """struct of plan parameters: the mode's, adjusted for scope and for the number of verticals."""
    mode = F.when(F.lit(False), "")
    for k, m in TYPE_TO_MODE.items():
        mode = mode.when(kind == k, m)
    mode = mode.otherwise("qa")

    def base(i: int) -> Column:
        out = F.when(F.lit(False), 0)
        for m, row in MODES.items():
            out = out.when(mode == m, row[i])
        return out

    narrow, broad = scope_ == "narrow", scope_ == "broad"
    # in thousandths, so that truncation is the same everywhere
    scaled = lambda x: F.when(narrow, F.floor(x * 7 / 10)).when(broad, F.floor(x * 13 / 10)).otherwise(x).cast("int")
    per = scaled(base(2))
    per = F.when(verticals == 1, F.floor(per * 15 / 10)).when(verticals >= 4, F.floor(per * 8 / 10)).otherwise(per).cast("int")
    total = scaled(base(3))
    total = F.when(verticals >= 4, F.floor(total * 12 / 10)).otherwise(total).cast("int")
    rewrites = F.when(narrow, F.greatest(F.lit(1), base(0) - 1)).when(broad, F.least(F.lit(5), base(0) + 1)).otherwise(base(0))
    diversity = F.when(narrow, base(5) * 0.5).when(broad, F.least(F.lit(0.9), base(5) * 1.3)).otherwise(base(5))
    return F.struct(
        mode.alias("mode"), rewrites.alias("rewrites"), base(1).alias("hops"), per.alias("k_vertical"), total.alias("k_total"), base(4).alias("k_rerank"), F.round(diversity, 6).alias("diversity"),
    )
