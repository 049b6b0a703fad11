"""Fields and lists that document headers and bodies hold, by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of fields, in the first so many characters
FIELDS = {
    "department": (500, r"(?:Department|Ministry|Directorate)\s+of\s+([A-Z][A-Za-z &]+)"),
    "proceedings": (2000, r"(?i)Procs?\.?\s*Rc?\.?\s*No\.?\s*([\w/.-]+)"),
    "go_number": (2000, r"(?i)G\.?O\.?(?:MS|RT)?\.?\s*No\.?\s*(\d+)"),
    "act_name": (500, r"(?:The\s+)?([A-Z][A-Za-z ]+ Act),?\s*(?:\d{4})?"),
    "case_number": (1000, r"(?i)(?:Petition|Appeal|Case)\s+No\.?\s*(\d+)"),
    "court": (1000, r"(?i)(Supreme Court|High Court|District Court)"),
    "scheme_name": (500, r"((?:[A-Z][a-z]+ ){1,4}Scheme)"),
}
LISTS = {
    "orders": r"(?m)^\s*\d+\.\s+([^\n]+)",
    "chapters": r"(?im)^chapter\s+([ivxlc\d]+)",
    "captions": r"(?i)Table\s+(\d+)\s*:",
    "bullets": r"(?m)^\s*[-•*]\s+([^\n]+)",
    "parts": r"(?m)^\((\d+)\)",
}


def field(text: Column, name: str) -> Column:
    size, pattern = FIELDS[name]
    return F.nullif(F.regexp_extract(F.substring(text, 1, size), pattern, 1), F.lit(""))


def listed(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(LISTS[name]), F.lit(1))


def is_table_line(line: Column) -> Column:
    """Two cells or more between pipes, tabs or runs of blanks, or numbers in three columns."""
    return line.rlike(r"\|.*\||\t.*\t|\S\s{2,}\S+\s{2,}\S") & (F.length(F.trim(line)) > 0) | (F.size(table_row(line)) >= 3)


def table_row(line: Column) -> Column:
    """Cells by pipes, else tabs, else two blanks or more."""
    split = F.when(line.contains("|"), F.split(line, r"\|")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"\s{2,}"))
    return F.filter(F.transform(split, lambda c: F.trim(c)), lambda c: c != "")


def order_start(text: Column) -> Column:
    """Place (from 1) of the first numbered order, else of the ORDER heading; null without either."""
    numbered = F.regexp_instr(text, F.lit(r"(?m)^\s*1\.\s"))
    heading = F.regexp_instr(text, F.lit(r"(?im)^ORDERS?\s*:?\s*$"))
    return F.coalesce(F.when(numbered > 0, numbered), F.when(heading > 0, heading))
