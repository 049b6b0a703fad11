"""Scores and boosts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rewriting import bound

# fixed values: weights and boosts
RELATION_WEIGHTS = {"amends": 0.7, "implements": 0.4, "cites": 0.2, "governed_by": 0.3, "supersedes": -1.0}
SECTION_BOOSTS = {"orders": 1.3, "order": 1.3, "content": 1.2, "annexure": 1.0, "preamble": 0.85, "table": 0.95}
VERTICAL_AUTHORITY = {"legal": 1.0, "judicial": 0.95, "go": 0.9, "data": 0.7, "schemes": 0.6}
GOVERNMENT_BOOST = {"gov": 1.5, "edu": 1.3, "world": 1.2}
INNOVATION_WORDS = ["finland", "singapore", "south korea", "japan", "oecd", "unesco", "world bank", "international", "global", "innovative", "novel", "creative", "experimental", "pilot", "best practice", "case study", "model"]
SOURCE_AUTHORITY = [("act", 1.0), ("rule", 0.9), ("go", 0.85), ("circular", 0.7), ("guideline", 0.6)]


def lookup(key: Column, table: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def time_score(issued: Column, superseded: Column, effective_to: Column, now: int) -> Column:
    """1 / (1 + log10 of the days since issue), less 0.9 if superseded and 0.7 if expired, within -1..1; 0 without a date."""
    days = F.greatest(F.lit(1.0), (F.lit(now) - issued) / 86400)
    score = 1.0 / (1.0 + F.log10(days)) - F.when(superseded, 0.9).otherwise(0.0) - F.when(effective_to < now, 0.7).otherwise(0.0)
    return F.when(issued.isNull() | (issued == 0), 0.0).otherwise(clamp(score, -1.0, 1.0))


def relation_bonus(types: Column) -> Column:
    """Weights of the distinct relation types, within -1..0.9."""
    return clamp(F.aggregate(F.array_distinct(types), F.lit(0.0), lambda s, t: s + lookup(t, RELATION_WEIGHTS, 0.0)), -1.0, 0.9)


def section_boost(section: Column) -> Column:
    return lookup(F.lower(F.coalesce(section, F.lit(""))), SECTION_BOOSTS, 1.0)


def recency_steps(year: Column, now: int = 2024) -> Column:
    age = F.lit(now) - year
    return F.when(age <= 1, 1.0).when(age <= 3, 0.9).when(age <= 5, 0.8).when(age <= 10, 0.6).otherwise(0.3)


def recency_of_text(text: Column, now: int) -> Column:
    """1 less a tenth for each year since the last one named, 0.5 if none is."""
    last = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    return F.when(last.isNull(), 0.5).otherwise(clamp(1.0 - 0.1 * (F.lit(now) - last), 0.0, 1.0))


def source_authority(source: Column) -> Column:
    low = F.lower(source)
    out = F.when(F.lit(False), 0.5)
    for word, v in SOURCE_AUTHORITY:
        out = out.when(low.contains(word), v)
    return out.otherwise(0.5)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1)))


def term_overlap(query: Column, text: Column) -> Column:
    """Jaccard of the word sets."""
    # (each set is made once; in a branch Spark would make it for each use)
    known = F.struct(word_set(query).alias("q"), word_set(text).alias("t"))
    sized = lambda s: F.struct(F.size(s["q"]).alias("q"), F.size(s["t"]).alias("t"), F.size(F.array_intersect(s["q"], s["t"])).alias("both"))
    share = lambda n: F.when(n["q"] == 0, 0.0).otherwise(n["both"] / (n["q"] + n["t"] - n["both"]))
    return bound(bound(known, sized), share)


def metadata_relevance(matched: Column, filters: Column) -> Column:
    return F.when(filters == 0, 0.5).otherwise(matched / filters)


def position_score(place: Column, total: Column) -> Column:
    return F.when(total <= 1, 1.0).otherwise(1.0 - place / total)


def authority(vertical: Column, act_name: Column | None = None, court: Column | None = None) -> Column:
    base = lookup(vertical, VERTICAL_AUTHORITY, 0.5)
    if act_name is not None:
        low = F.lower(F.coalesce(act_name, F.lit("")))
        base = F.when((vertical == "legal") & low.contains("constitution"), 1.0).when((vertical == "legal") & low.contains("act"), 0.95).otherwise(base)
    if court is not None:
        low = F.lower(F.coalesce(court, F.lit("")))
        base = F.when((vertical == "judicial") & low.contains("supreme"), 1.0).when((vertical == "judicial") & low.contains("high"), 0.95).otherwise(base)
    return base


def innovation(text: Column) -> Column:
    low = F.lower(text)
    hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in INNOVATION_WORDS), F.lit(0))
    return F.least(hits / 5.0, F.lit(1.0))


def relation_score(score: Column, types: Column, superseded: Column, relevant: Column) -> Column:
    """Superseded x0.4, superseding x1.15, then amends 1.08, implements, cites and governed_by 1.05 each, together 1.25 at most (1.03 for another domain)."""
    has = lambda t: F.array_contains(types, t)
    base = score * F.when(superseded, 0.4).otherwise(1.0) * F.when(has("supersedes"), 1.15).otherwise(1.0)
    boost = F.lit(1.0)
    for t, x in (("amends", 1.08), ("implements", 1.05), ("cites", 1.05), ("governed_by", 1.05)):
        boost = boost * F.when(has(t), x).otherwise(1.0)
    return base * F.least(boost, F.when(relevant, 1.25).otherwise(1.03))
