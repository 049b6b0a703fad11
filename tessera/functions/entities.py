"""Entities and references by pattern, as sorted distinct arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of references, (pattern, group)
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
GO = [r"G\.?O\.?\s*(?:MS|RT|Rt)\.?\s*No\.?\s*(\d+)", r"GO\s+No\.?\s*(\d+)", r"Government Order\s+No\.?\s*(\d+)"]
SECTION = [r"(?i)Section\s+(\d+[A-Z]?(?:\([a-z0-9]+\))?)", r"(?i)Sec\.?\s+(\d+[A-Z]?)", r"§\s*(\d+[A-Z]?)"]
RULE = r"Rule\s+(\d+[A-Z]?(?:\([a-z0-9]+\))?)"
RULES_OF = r"(Rules?,?\s+\d{4})"
DATE = [r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b", rf"\b(\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}[a-z]*\.?\s+\d{{2,4}})\b", rf"\b({MONTH}[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}})\b"]
DEPARTMENT = [r"(?:Department|Ministry|Directorate)\s+of\s+([A-Z][A-Za-z\s&,]+?)(?:\s+Department|\s+Ministry|\.|\,|$)", r"((?:[A-Z][a-z]+\s+)+(?:Department|Ministry|Directorate|Board|Commission))"]
SCHEME = [r"(Jagananna\s+[A-Z][A-Za-z\s]+(?:Scheme)?)", r"((?:[A-Z][a-z]+\s+){1,4}Scheme)", r"(Midday\s+Meal\s+Scheme)", r"(Sarva\s+Shiksha\s+Abhiyan)"]
ACT = [r"(?:The\s+)?([A-Z][A-Za-z\s,]+?\bAct\b,?\s+\d{4})", r"(?:The\s+)?([A-Z][A-Za-z\s,]+?\bAct\b)(?:,|:|\.)(?:\s|$)", r"([A-Z][A-Za-z\s,]+?\bAct\b\s+No\.?\s+\d+\s+of\s+\d{4})", r"under\s+(?:the\s+)?([A-Z][A-Za-z\s,]+?\bAct\b)(?:\s+of\s+\d{4}|,|:|\.)"]
NOT_ACTS = [r"officers.*for.*act", r"state.*for.*act", r"for\s+\w+\s+act", r"providing\s+\w+.*act", r"necessary\s+act", r"attract\w*", r"exact\w*", r"nutritious.*act"]
NOT_ACT_WORDS = ["necessary", "nutritious", "attract", "exact", "impact", "contact", "practical", "actual", "officers", "state", "providing"]


def every(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """First groups of all matches of all patterns."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p if p.startswith("(?i)") else flags + p), F.lit(1)) for p in patterns]))


def tidy(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def go_numbers(text: Column) -> Column:
    return tidy(F.transform(every(text, GO), lambda x: F.concat(F.lit("GO.MS.No."), x)))


def sections(text: Column) -> Column:
    found = F.concat(every(text, SECTION[:2]), every(text, SECTION[2:], ""))
    return tidy(F.transform(found, lambda x: F.concat(F.lit("Section "), x)))


def rules(text: Column) -> Column:
    found = every(text, [RULE, RULES_OF])
    return tidy(F.transform(found, lambda x: F.when(x.startswith("Rule"), x).otherwise(F.concat(F.lit("Rule "), x))))


def dates(text: Column) -> Column:
    return tidy(every(text, DATE))


def _stripped(values: Column) -> Column:
    return F.transform(values, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^,+|,+$", ""), r"^\.+|\.+$", ""))


def departments(text: Column) -> Column:
    return F.slice(tidy(F.filter(_stripped(every(text, DEPARTMENT)), lambda x: F.length(x) > 5)), 1, 10)


def schemes(text: Column) -> Column:
    trimmed = F.transform(every(text, SCHEME), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.slice(tidy(F.filter(trimmed, lambda x: F.length(x) > 5)), 1, 10)


def years(text: Column) -> Column:
    """Whole years from 1900 to 2099."""
    return tidy(every(text, [r"\b((?:19|20)\d{2})\b"]))


def acts(text: Column) -> Column:
    """Names that end in Act, with two words of substance, a capital and none of the known false friends; ten at most."""

    def good(a: Column) -> Column:
        low = F.lower(a)
        before = F.filter(F.split(F.regexp_replace(a, r"(?i)\s+act\s*$", ""), r"\s+"), lambda w: w != "")
        ok = (F.length(a) > 10) & low.rlike(r"\bact\s*$")
        for p in NOT_ACTS:
            ok = ok & ~low.rlike(p)
        for w in NOT_ACT_WORDS:
            ok = ok & ~low.contains(w)
        substance = F.size(F.filter(before, lambda w: (F.length(w) > 2) & ~F.lower(w).isin("the", "and", "of", "for", "in", "to", "a", "an")))
        return ok & (substance >= 2) & F.exists(before, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}"))

    return F.slice(tidy(F.filter(_stripped(every(text, ACT)), good)), 1, 10)


KINDS = {"go_numbers": go_numbers, "sections": sections, "rules": rules, "dates": dates, "departments": departments, "schemes": schemes, "years": years, "acts": acts}


def all_entities(text: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """map of entity type to values, of these types, those without values left out."""
    whole = F.create_map(*[x for k in kinds for x in (F.lit(k), KINDS[k](text))])
    return F.map_filter(whole, lambda k, v: F.size(v) > 0)


def merge_entities(a: Column, b: Column) -> Column:
    """Values of both maps; those of a first."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))


def key_entities(entities: Column, content: Column) -> Column:
    """Document entities that the chunk mentions: three orders, three sections, two departments, two schemes."""
    limit = {"go_numbers": 3, "sections": 3, "departments": 2, "schemes": 2}

    def here(kind: str) -> Column:
        values = F.coalesce(F.try_element_at(entities, F.lit(kind)), F.array().cast("array<string>"))
        number = lambda e: F.regexp_extract(e, r"(\d+)$", 1)
        test = (lambda e: F.array_contains(go_numbers(content), e) | (number(e) == "") & content.contains(e)) if kind == "go_numbers" else (lambda e: content.contains(e))
        return F.slice(F.filter(values, test), 1, limit[kind])

    return F.map_filter(F.create_map(*[x for k in limit for x in (F.lit(k), here(k))]), lambda k, v: F.size(v) > 0)
