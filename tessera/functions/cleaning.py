"""Text cleaning and normalisation as Column expressions (one pandas UDF, for NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: corrections of common recognition errors
OCR_FIXES = [(r"\bGovemment\b", "Government"), (r"\bEducalion\b", "Education"), (r"\bAndhra\s+Pradcsh\b", "Andhra Pradesh"), (r"\b0rder\b", "Order"), (r"\bSec[il]on\b", "Section")]
# fixed values: characters that mark a garbled line, and references that excuse one
GARBAGE_SYMBOLS = "~•@_{}[]<>|\\^°±§¶"
REFERENCE_MARKS = ["no.", "dt.", "dated", "memo", "govt", "rc.", "procs."]


def sub(col: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(col, pattern, to)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def remove_ocr_garbage(col: Column) -> Column:
    """Lines that are mostly garbled go; blank lines and lines that are 70 % ASCII or more stay."""
    share = lambda n, total: n / F.greatest(total, F.lit(1))
    symbols = "[" + "".join(f"\\{c}" if c in "[]{}^|\\" else c for c in GARBAGE_SYMBOLS) + "]"

    def keep(line: Column) -> Column:
        total = F.length(F.trim(line))
        ascii_ = share(F.length(line) - F.length(sub(line, "[\\x20-\\x7e]", "")), total)
        alpha = F.length(line) - F.length(sub(line, "\\p{L}", ""))
        special = share(F.length(line) - F.length(sub(line, symbols, "")), total)
        refers = F.lit(False)
        for mark in REFERENCE_MARKS:
            refers = refers | F.lower(line).contains(mark)
        return (
            F.when(total == 0, True).when(ascii_ >= 0.7, True).when(special > 0.15, False).when((ascii_ < 0.4) & (alpha < 5), False)
            .when((total < 10) & (ascii_ < 0.5), False).when(alpha < total * 0.3, refers).otherwise(True)
        )

    return F.array_join(F.filter(F.split(col, "\n", -1), keep), "\n")


def normalize_unicode(col: Column) -> Column:
    out = nfkc(col)
    out = F.translate(out, "“”‘’–—−", "\"\"''---")
    for old, new in (("…", "..."), ("Â", ""), ("â€™", "'"), ("â€œ", '"'), ("â€", '"')):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = sub(out, "[\\u200b-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\ufeff\\ufffe]", "")
    return remove_ocr_garbage(F.translate(out, "  ", "  "))


def fix_hyphenation(col: Column) -> Column:
    return sub(col, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")


def remove_page_markers(col: Column) -> Column:
    out = sub(col, r"\n\s*[-–—]\s*\d+\s*[-–—]\s*\n", "\n")
    out = sub(out, r"(?i)\nPage\s+\d+\s*\n", "\n")
    out = sub(out, r"(?i)\n\d+\s+of\s+\d+\s*\n", "\n")
    return sub(out, r"(?i)\n\s*[-–—]{1,}\s*Page\s+\d+\s*[-–—]{1,}\s*\n", "\n")


def remove_artifacts(col: Column) -> Column:
    out = col
    for pattern, to in ((r"(?i)\[Image:.*?\]", ""), (r"(?i)\[Chart:.*?\]", ""), (r"<.*?>", ""), (r"\n\s*&{2,}.*?\n", "\n"), (r"\n\s*#{2,}.*?\n", "\n"), (r"\n\s*\*{3,}.*?\n", "\n"), (r"[©®™]+", "")):
        out = sub(out, pattern, to)
    return out


def normalize_whitespace(col: Column) -> Column:
    out = sub(sub(col, " +", " "), r"\n\s*\n\s*\n+", "\n\n")
    return sub(sub(sub(out, r"(?m)^ +", ""), r"(?m) +$", ""), r"^\s+|\s+$", "")


def fix_ocr_errors(col: Column) -> Column:
    for pattern, to in OCR_FIXES:
        col = sub(col, f"(?i){pattern}", to)
    return col


def clean(col: Column) -> Column:
    """unicode, hyphens, page markers, artifacts, white space, recognition errors, trim."""
    return sub(fix_ocr_errors(normalize_whitespace(remove_artifacts(remove_page_markers(fix_hyphenation(normalize_unicode(col)))))), r"^\s+|\s+$", "")


def standardize_go_references(col: Column) -> Column:
    for pattern, to in ((r"G\.O\.(Ms|MS)\.?No\.?(\d+)", "G.O.Ms.No. $2"), (r"G\.O\.(Rt|RT)\.?No\.?(\d+)", "G.O.Rt.No. $2"), (r"GO\s+(MS|Ms)\.?\s*No\.?\s*(\d+)", "G.O.Ms.No. $2"), (r"GO\s+(RT|Rt)\.?\s*No\.?\s*(\d+)", "G.O.Rt.No. $2")):
        col = sub(col, f"(?i){pattern}", to)
    return col


def standardize_section_references(col: Column) -> Column:
    return sub(sub(col, r"(?i)Sec\.?\s*(\d+)", "Section $1"), r"§\s*(\d+)", "Section $1")


def standardize_dates(col: Column) -> Column:
    return sub(col, r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})", "$1-$2-$3")


def standardize(col: Column) -> Column:
    return standardize_dates(standardize_section_references(standardize_go_references(col)))


def match_form(col: Column) -> Column:
    """Lower case, hyphen breaks joined, white space collapsed: the form in which snippets are compared."""
    return F.trim(sub(sub(F.lower(col), r"-\s*\n\s*", ""), r"\s+", " "))


def stem_to_doc_id(col: Column) -> Column:
    return F.lower(F.translate(col, " -", "__"))


def filename_to_doc_id(col: Column) -> Column:
    return F.lower(sub(col, r"\.[^.]*$", ""))


def word_count(col: Column) -> Column:
    return F.size(F.filter(F.split(col, r"\s+"), lambda w: w != ""))


def needs_ocr(text: Column, pages: Column) -> Column:
    return F.coalesce(word_count(text), F.lit(0)) / F.greatest(pages, F.lit(1)) < 10
