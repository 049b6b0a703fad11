"""Query normalisation as Column expressions: protected references are masked, the rest is normalised, and they return by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vocabulary import ABBREVIATIONS, PROTECTED, SPELLINGS

#: White space and word characters over all scripts, the same in every engine.
SPACE, WORD = r"[\t-\r\x1c-\x20\x85\p{Z}]", r"[\p{L}\p{N}_]"
#: A letter that stands for a protected span (where a text has it, it is a protected span itself).
MASK = "ꙮ"
SPANS = f"({PROTECTED}|{MASK})"


def basic_clean(text: Column) -> Column:
    """White space to single blanks, none at the ends; runs of ! ? . to their last one."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), r"([!?.]){2,}", "$1")


def expand_abbreviations(text: Column) -> Column:
    """Words that are abbreviations, but for marks at their end, in full."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])

    def one(word):
        bare = F.regexp_replace(word, r"[.,!?;:]+$", "")
        return F.coalesce(F.concat(F.try_element_at(table, bare), F.substring(word, F.length(bare) + 1, F.length(word))), word)

    return F.array_join(F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), one), " ")


def fix_spelling(text: Column) -> Column:
    """A lone l is a one, a lone o a zero, and some words are put right."""
    for letter, digit in (("l", "1"), ("o", "0")):
        text = F.regexp_replace(text, f"(?<!{WORD})(?i:{letter})(?!{WORD})", digit)
    for wrong, right in SPELLINGS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def space_marks(text: Column) -> Column:
    """One blank behind , ; : . ! ? and none before; single blanks elsewhere."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\t\n\r ]+", " "), r" *([,;:.!?]) *", "$1 "))


def restore(masked: Column, spans: Column) -> Column:
    """Each mask replaced by the span of its number."""
    rest = F.split(masked, MASK)
    return F.array_join(F.transform(rest, lambda part, i: F.concat(part, F.coalesce(F.get(spans, i), F.lit("")))), "")


def normalize_query(text: Column) -> Column:
    """The normalised query; null gives an empty one. Orders, sections and years stay as they are written."""
    clean = basic_clean(F.coalesce(text, F.lit("")))
    spans = F.regexp_extract_all(clean, F.lit(SPANS), F.lit(1))
    masked = F.lower(F.regexp_replace(clean, SPANS, MASK))
    return F.trim(restore(space_marks(fix_spelling(expand_abbreviations(masked))), spans))


def variants(text: Column) -> Column:
    """Distinct forms for searching: normalised, only cleaned and lower case, normalised with abbreviations expanded once more."""
    full = normalize_query(text)
    plain = space_marks(F.lower(basic_clean(F.coalesce(text, F.lit("")))))
    return F.array_distinct(F.array(full, plain, expand_abbreviations(full)))
