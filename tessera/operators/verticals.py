"""Sections of orders, acts, judgments, schemes and reports, and chunks that keep them together, as array expressions.

Every chunker takes texts of 50 characters or more (after trimming; others give no chunk), cuts them
into sections, keeps a section that fits as one chunk, packs the numbered or bulleted points of a
longer one where its kind has them (what stands before the first point is left out), and packs
paragraphs otherwise. Chunks are numbered through a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rewriting import bound
from tessera.operators.chunking import SIZES, pack, paragraphs

# fixed values: markers of sections, points and tables
ORDER_LINE = r"^ORDERS?[ \t]*:?[ \t]*$"
JUDICIAL = {"facts": r"^(?:FACTS?|BACKGROUND)[:\s]", "arguments": r"^(?:ARGUMENTS?|SUBMISSIONS?)[:\s]", "ratio": r"^(?:RATIO|REASONING|ANALYSIS)[:\s]", "judgment": r"^(?:JUDGMENT|DECISION|ORDER)[:\s]"}
SCHEME = {"eligibility": r"^(?:ELIGIBILITY|ELIGIBLE|WHO CAN APPLY)[:\s]", "benefits": r"^(?:BENEFITS?|ASSISTANCE|FINANCIAL AID)[:\s]", "application": r"^(?:HOW TO APPLY|APPLICATION|PROCEDURE)[:\s]", "implementation": r"^(?:IMPLEMENTATION|EXECUTION|MONITORING)[:\s]"}
SECTION = r"^(?:Section|Sec\.?)[ \t]+\d+[A-Z]?"
SUBSECTION = r"^[ \t]*\((?:\d+|[a-z]|[ivx]+)\)\s+"
POINT = r"^(?:\d+\.|\([ivxIVX]+\)|\([a-z]\))\s+"
BULLET = r"^(?:[•*-]|\d+\.|\([a-z]\))\s+"
CAPTION = r"(?:Table|Annexure)\s+\d+(?:\.\d+)?[:.]?[ \t]*[^\n]"
TABLE_MARKER = r"(?:Table|Chart|Figure)\s+\d+"
CHART = r"(?:Figure|Chart|Graph)\s+(\d+(?:\.\d+)?)[:.]?\s*([^\n]+)"
ANALYSIS = r"^(?:Chapter|Section|CHAPTER|SECTION)\s+(\d+(?:\.\d+)?)[:.]?\s*([^\n]+)"
TABLE_LINES = [r"(\s{3,}\S+){3,}", r"\|[^\n]*\|[^\n]*\|", r"\t[^\n]*\t[^\n]*\t", r"^\s*\d+[.)]\s+[^\n]*\d+[^\n]*$"]
NUMBER = r"\d+(?:,\d+)*(?:\.\d+)?"
BLOCK, BLOCK_LINES, CHART_SIZE = 2000, 50, 500
GO_PARTS = {
    "subject": [r"(?im)^Sub[ject]*\s*:"], "references": [r"(?im)^Ref\s*:", r"(?im)^Read\s*:"], "orders": [r"(?m)^\s*\d+\.\s+", r"(?im)^ORDERS?\s*:?\s*$", r"(?i)Government\s+Order", r"(?i)Government\s+hereby\s+orders?"],
    "table": [r"\|[^\n]*\|[^\n]*\|", r"(?im)^\s*S\.?\s*No\.?"], "annexure": [r"(?im)^ANNEXURE"],
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pieces(text: Column, pattern: str, flags: str = "m") -> Column:
    """The text cut before each match of the pattern."""
    return F.split(text, f"(?{flags})(?={pattern})", -1)


def starts(part: Column, pattern: str, flags: str = "m") -> Column:
    return part.rlike(rf"\A(?{flags}:{pattern})")


def section(kind: Column, content: Column) -> Column:
    return F.struct(kind.alias("section_type"), content.alias("content"))


def go_sections(text: Column) -> Column:
    """preamble and orders, before and after the first ORDER line; content without one."""
    at = F.regexp_instr(text, F.lit(f"(?im){ORDER_LINE}"))
    marker = F.regexp_extract(text, f"(?im){ORDER_LINE}", 0)
    parts = F.array(
        section(F.lit("preamble"), trimmed(F.substring(text, F.lit(1), at - 1))),
        section(F.lit("orders"), trimmed(F.substring(text, at + F.length(marker), F.length(text)))),
    )
    return F.when(at > 0, F.filter(parts, lambda s: s["content"] != "")).otherwise(F.array(section(F.lit("content"), text)))


def marked(text: Column, markers: dict[str, str], first: str) -> Column:
    """From the first marker of each kind to the next kind's; `first` before them all; content without markers."""
    at = lambda p: F.regexp_instr(text, F.lit(f"(?im){p}"))
    places = F.array_sort(F.filter(F.array(*[F.struct(at(p).alias("at"), F.lit(k).alias("kind")) for k, p in markers.items()]), lambda s: s["at"] > 0))

    def cut(found: Column) -> Column:
        head = F.array(section(F.lit(first), trimmed(F.substring(text, F.lit(1), found[0]["at"] - 1))))
        body = F.transform(found, lambda s, i: section(s["kind"], trimmed(F.substring(text, s["at"], F.coalesce(F.get(found, i + 1)["at"], F.length(text) + 1) - s["at"]))))
        return F.when(F.size(found) == 0, F.array(section(F.lit("content"), text))).otherwise(F.filter(F.concat(head, body), lambda s: s["content"] != ""))

    return bound(places, cut)


def legal_sections(text: Column) -> Column:
    """One section for each Section heading up to the next; what stands before the first is left out; content without headings."""
    parts = F.filter(pieces(text, SECTION, "im"), lambda p: starts(p, SECTION, "i"))
    made = lambda ps: F.transform(ps, lambda p: section(F.regexp_extract(p, r"(?i)\A\S+[ \t]+(\d+[A-Z]?)", 1), trimmed(p)))
    return bound(parts, lambda ps: F.when(F.size(ps) == 0, F.array(section(F.lit("content"), text))).otherwise(made(ps)))


def points(text: Column, pattern: str) -> Column:
    """What starts at each point; null without points."""
    found = F.filter(pieces(text, pattern), lambda p: starts(p, pattern))
    return bound(found, lambda ps: F.when(F.size(ps) > 0, F.filter(F.transform(ps, trimmed), lambda p: p != "")))


def packed(content: Column, vertical: str, pattern: str | None, joint: str = "\n\n") -> Column:
    """A section's chunks: itself if it fits, else its points, else its paragraphs."""
    least, most, overlap = SIZES[vertical]
    plain = pack(paragraphs(content), least, most, overlap)
    if pattern:
        plain = F.coalesce(pack(points(content, pattern), 0, most, 0, True, joint), plain)
    return F.when(F.length(content) <= most, F.array(content)).otherwise(plain)


def subsections(content: Column) -> Column:
    """Subsections packed with the one before as overlap."""
    return pack(points(content, SUBSECTION), 0, SIZES["legal"][1], 0, True, whole=True)


def chunks(text: Column, vertical: str) -> Column:
    """Array of (section_type, content)."""
    if vertical == "go":
        found, one = go_sections(text), lambda s: F.when(s["section_type"] == "orders", packed(s["content"], vertical, POINT)).otherwise(packed(s["content"], vertical, None))
    elif vertical == "legal":
        most = SIZES[vertical][1]
        found = legal_sections(text)
        whole = lambda s: F.coalesce(subsections(s["content"]), pack(paragraphs(s["content"]), *SIZES[vertical]))
        one = lambda s: F.when(s["section_type"] == "content", pack(paragraphs(s["content"]), *SIZES[vertical])).when(F.length(s["content"]) <= most, F.array(s["content"])).otherwise(whole(s))
    elif vertical == "judicial":
        found = marked(text, JUDICIAL, "preamble")
        one = lambda s: F.when(s["section_type"].isin("ratio", "arguments"), packed(s["content"], vertical, POINT)).otherwise(packed(s["content"], vertical, None))
    elif vertical == "scheme":
        found = marked(text, SCHEME, "overview")
        one = lambda s: F.when(s["section_type"].isin("eligibility", "benefits"), packed(s["content"], vertical, BULLET, "\n")).otherwise(packed(s["content"], vertical, None))
    else:
        raise ValueError(vertical)
    return F.flatten(F.transform(found, lambda s: F.transform(one(s), lambda c: section(s["section_type"], c))))


def chunk_rows(docs: DataFrame, found: Column) -> DataFrame:
    """chunk_id, doc_id, chunk_index, section_type, content, word_count of docs (doc_id, text)."""
    rows = docs.where(F.length(trimmed(F.col("text"))) >= 50).select("doc_id", F.posexplode(found).alias("chunk_index", "c"))
    return rows.select(
        F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "c.section_type", "c.content",
        F.size(F.filter(F.split("c.content", r"\s+"), lambda w: w != "")).alias("word_count"),
    )


# ---- reports


def table_line(line: Column) -> Column:
    """Columns by blanks, pipes or tabs, numbered rows with numbers, many digits, or three numbers."""
    digits = F.length(line) - F.length(F.regexp_replace(line, r"\d", ""))
    found = bound(digits, lambda n: (n > 5) & (n / F.greatest(F.length(line), F.lit(1)) > 0.1)) | (F.size(F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1))) >= 3)
    for p in TABLE_LINES:
        found = found | line.rlike(p)
    return (F.trim(line) != "") & found


def cells(line: Column) -> Column:
    """Cells between pipes, else tabs, else two blanks or more; null for fewer than two."""
    by = lambda p: F.filter(F.transform(F.split(F.trim(line), p), lambda c: F.trim(c)), lambda c: c != "")
    tries = [bound(by(p), lambda cs: F.when(F.size(cs) >= 2, cs)) for p in (r"\|", r"\t", r"\s{2,}")]
    return F.coalesce(*tries)


def table_pieces(text: Column) -> Column:
    """The text cut before each caption, as (is_table, content, rest): a table goes to the end of its block, `rest` is what follows until the next caption.

    A block starts after its caption's line, within BLOCK characters, at the first line that looks like one of a table, and ends before a
    line that doesn't and starts a chapter, section or chart, or comes after BLOCK_LINES lines. Without such lines it is the
    caption and up to 1000 characters after it.
    """

    def one(p: Column) -> Column:
        size = F.length(F.regexp_extract(p, r"\A[^\n]*", 0))
        return bound(size, lambda size: bound(F.split(F.substring(p, size + 1, F.lit(BLOCK)), "\n", -1), lambda lines: bound(F.transform(lines, table_line), lambda flags: block(p, size, lines, flags))))

    def block(p: Column, size: Column, lines: Column, flags: Column) -> Column:
        first = F.nullif(F.array_position(flags, True), F.lit(0).cast("long")) - 1
        return bound(first.cast("int"), lambda first: bound(cut_at(p, size, lines, flags, first), lambda cut: table(p, lines, first, cut)))

    def cut_at(p: Column, size: Column, lines: Column, flags: Column, first: Column) -> Column:
        breaks = F.transform(lines, lambda x, i: F.when((i > first) & ~F.get(flags, i) & (x.rlike(f"(?i){CHART}") | x.rlike(ANALYSIS) | (i - first > BLOCK_LINES)), i))
        end = F.coalesce(F.array_min(F.filter(breaks, lambda i: i.isNotNull())), F.size(lines))
        return F.when(first.isNull(), F.least(size + 1000, F.length(p))).otherwise(size + F.length(F.array_join(F.slice(lines, F.lit(1), end), "\n")))

    def table(p: Column, lines: Column, first: Column, cut: Column) -> Column:
        head = F.when(first.isNotNull(), cells(F.get(lines, first)))
        return F.struct(F.lit(True).alias("is_table"), F.substring(p, F.lit(1), cut).alias("content"), F.substring(p, cut + 1, F.length(p)).alias("rest"), head.alias("columns"))

    def other(p: Column) -> Column:
        return F.struct(F.lit(False).alias("is_table"), F.lit("").alias("content"), p.alias("rest"), F.lit(None).cast("array<string>").alias("columns"))

    return F.transform(pieces(text, CAPTION, "i"), lambda p: F.when(starts(p, CAPTION, "i"), one(p)).otherwise(other(p)))


def _rest(found: Column) -> Column:
    return trimmed(F.regexp_replace(F.array_join(F.transform(found, lambda t: t["rest"]), "\n\n"), r"\n{3,}", "\n\n"))


def without_tables(text: Column) -> Column:
    """The text without its tables' blocks, blank lines in their place."""
    return _rest(table_pieces(text))


def data_chunks(text: Column) -> Column:
    """One chunk for each table of 20 characters or more, then the packed rest if it has over 100."""
    none = F.array().cast("array<struct<section_type:string,content:string>>")
    kept = lambda t: t["is_table"] & (F.length(trimmed(t["content"])) >= 20)
    tables = lambda found: F.transform(F.filter(found, kept), lambda t: section(F.lit("table"), t["content"]))
    more = lambda rest: F.when(F.length(rest) > 100, F.transform(pack(paragraphs(rest), *SIZES["data"]), lambda c: section(F.lit("text"), c)))
    return bound(table_pieces(text), lambda found: F.concat(tables(found), F.coalesce(bound(_rest(found), more), none)))


def marked_table_chunks(text: Column) -> Column:
    """Tables, charts and figures by their markers alone: each from its marker to an empty pair of lines or the next marker, what lies between packed."""

    def one(p: Column) -> Column:
        gap = F.locate("\n\n\n", p)
        return bound(starts(p, TABLE_MARKER, "i"), lambda is_table: bound(F.when(~is_table, F.lit(0)).when(gap > 0, gap - 1).otherwise(F.length(p)), lambda end: cut(p, is_table, end)))

    def cut(p: Column, is_table: Column, end: Column) -> Column:
        body = F.transform(pack(paragraphs(F.substring(p, end + 1, F.length(p))), *SIZES["data"]), lambda c: section(F.lit("text"), c))
        return F.when(is_table, F.concat(F.array(section(F.lit("table"), trimmed(F.substring(p, F.lit(1), end)))), body)).otherwise(body)

    return F.flatten(F.transform(pieces(text, TABLE_MARKER, "i"), one))


def charts(text: Column) -> Column:
    """(number, title, content) of each chart: up to the next caption or chart, or 500 characters after its line."""

    def one(p: Column) -> Column:
        last = F.length(F.regexp_extract(p, r"\A[^\n]*\n?", 0)) + CHART_SIZE
        return F.struct(F.regexp_extract(p, f"(?i){CHART}", 1).alias("number"), F.trim(F.regexp_extract(p, f"(?i){CHART}", 2)).alias("title"), p.alias("content"), last.alias("last"))

    either = f"(?:{CAPTION})|(?:{CHART})"
    made = lambda parts: F.transform(parts, lambda p, i: F.when(starts(p, CHART, "i"), F.struct(one(p).alias("c"), (i == F.size(parts) - 1).alias("is_last"))))
    cut = lambda m: trimmed(F.when(m["is_last"], F.substring(m["c"]["content"], F.lit(1), m["c"]["last"])).otherwise(m["c"]["content"]))
    found = F.filter(bound(pieces(text, either, "i"), made), lambda m: m.isNotNull())
    return F.transform(found, lambda m: F.struct(m["c"]["number"].alias("number"), m["c"]["title"].alias("title"), cut(m).alias("content")))


def analysis_sections(text: Column) -> Column:
    """(number, title, content) of each Chapter or Section heading up to the next."""
    parts = F.filter(pieces(text, ANALYSIS), lambda p: starts(p, ANALYSIS))
    body = lambda p: trimmed(F.regexp_replace(p, rf"\A{ANALYSIS[1:]}", ""))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, ANALYSIS, 1).alias("number"), F.trim(F.regexp_extract(p, ANALYSIS, 2)).alias("title"), body(p).alias("content")))


def go_parts(text: Column) -> Column:
    """(section_type, content) between the first place of each part (subject, references, orders, table, annexure), by place; preamble if the first lies beyond 200 characters; content without parts."""

    def first(patterns: list[str]) -> Column:
        hits = [F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in patterns]
        return F.coalesce(*hits) if len(hits) > 1 else hits[0]

    places = F.array(*[F.struct(first(ps).alias("at"), F.lit(k).alias("kind")) for k, ps in GO_PARTS.items()])
    found = F.array_sort(F.filter(places, lambda s: s["at"].isNotNull()))
    body = F.transform(found, lambda s, i: section(s["kind"], trimmed(F.substring(text, s["at"], F.coalesce(F.get(found, i + 1)["at"], F.length(text) + 1) - s["at"]))))
    head = F.when(found[0]["at"] > 201, F.array(section(F.lit("preamble"), trimmed(F.substring(text, F.lit(1), found[0]["at"] - 1))))).otherwise(F.array().cast("array<struct<section_type:string,content:string>>"))
    return F.when(F.size(found) == 0, F.array(section(F.lit("content"), text))).otherwise(F.filter(F.concat(head, body), lambda s: s["content"] != ""))


def section_text(text: Column, number: Column) -> Column:
    """The content of the section of that number; null without it."""
    return F.get(F.filter(legal_sections(text), lambda s: s["section_type"] == number), F.lit(0))["content"]
