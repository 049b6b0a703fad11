"""Metadata of chunks by vertical, as structs of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of the fields
GO_NUMBER = r"(?i)G\.?O\.?(?:MS|RT)?\.?\s*No\.?\s*(\d+)"
SECTION = r"(?i)Section\s+(\d+(?:\([a-z]\))?)"
YEAR = r"\b(19\d{2}|20\d{2})\b"
TABLE = r"(?i)Table\s+(\d+(?:\.\d+)?)"
SCHEME = r"(?i)(Jagananna\s+[A-Za-z\s]+)"


def first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def year(text: Column) -> Column:
    return first(text, YEAR).cast("int").alias("year")


def go(text: Column, number: Column, department: Column) -> Column:
    """The text's own order number, else the document's."""
    return F.struct(F.coalesce(first(text, GO_NUMBER), number).alias("go_number"), year(text), department.alias("department"))


def legal(text: Column, act_name: Column) -> Column:
    """The first section, and the first five if there are several."""
    found = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))
    return F.struct(F.get(found, F.lit(0)).alias("section"), F.when(F.size(found) > 1, F.slice(found, 1, 5)).alias("sections"), year(text), act_name.alias("act_name"))


def judicial(text: Column, case_number: Column, court: Column) -> Column:
    return F.struct(case_number.alias("case_number"), court.alias("court"), year(text))


def data(text: Column, columns: Column) -> Column:
    """Up to ten columns, their number, and up to five tables that are named."""
    named = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TABLE), F.lit(1)))), 1, 5)
    return F.struct(F.slice(columns, 1, 10).alias("columns"), F.size(columns).alias("column_count"), year(text), named.alias("references_tables"))


def scheme(text: Column, name: Column) -> Column:
    return F.struct(F.coalesce(name, F.regexp_replace(first(text, SCHEME), r"^\s+|\s+$", "")).alias("scheme_name"), year(text))


def key_entities(found: dict[str, Column], content: Column) -> dict[str, Column]:
    """A document's entities that the chunk itself holds: up to three orders and sections (as written), two departments and schemes (without case)."""
    low = F.lower(content)
    held = {
        "mentioned_gos": F.slice(F.filter(found["go_numbers"], lambda x: content.contains(x)), 1, 3), "mentioned_sections": F.slice(F.filter(found["sections"], lambda x: content.contains(x)), 1, 3),
        "departments": F.slice(F.filter(found["departments"], lambda x: low.contains(F.lower(x))), 1, 2), "schemes": F.slice(F.filter(found["schemes"], lambda x: low.contains(F.lower(x))), 1, 2),
    }
    return held
