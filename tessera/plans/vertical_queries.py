"""Queries for sections and chunks of the verticals, tables of reports, chunk metadata and places of snippets, with checking SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tessera.functions import metadata
from tessera.operators import verticals as v
from tessera.operators.chunking import SIZES, pack, paragraphs
from tessera.sources.tables import load, oracle, structured

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_names = itertools.count()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


# ---- the other engine's words for the same things: separators before matches, folds by list_reduce


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _pieces(text: str, pattern: str, flags: str = "m") -> str:
    return f"string_split(regexp_replace({text}, '(?{flags})({pattern})', chr(1) || '\\1', 'g'), chr(1))"


def _starts(part: str, pattern: str, flags: str = "m") -> str:
    return rf"regexp_matches({part}, '\A(?{flags}:{pattern})')"


def _paragraphs(text: str) -> str:
    x, y = f"x{next(_names)}", f"y{next(_names)}"
    return rf"list_filter(list_transform(string_split_regex({text}, '\n\s*\n'), lambda {x}: {_trim(x)}), lambda {y}: {y} <> '')"


def _pack(parts: str, least: int, most: int, overlap: int, tail: bool = False, joint: str = "chr(10) || chr(10)", whole: bool = False) -> str:
    a, b, p, r, q = (f"{c}{next(_names)}" for c in "abprq")
    text = f"array_to_string({a}.g, {joint})"
    last = f"{a}.g[len({a}.g)]"
    fresh, size = (f"list_concat([{last}], {b}.g)", f"2 * {b}.s") if whole else (f"list_concat([right({last}, {overlap})], {b}.g)", f"length(right({last}, {overlap})) + {b}.s") if overlap else (f"{b}.g", f"{b}.s")
    state = f"list_transform({q}, lambda {p}: {{'c': []::varchar[], 'g': [{p}], 's': length({p})}})"
    fold = f"list_reduce({state}, lambda {a}, {b}: case when {a}.s + {b}.s > {most} and length({text}) >= {least} then {{'c': list_append({a}.c, {text}), 'g': {fresh}, 's': {size}}} else {{'c': {a}.c, 'g': list_concat({a}.g, {b}.g), 's': {a}.s + {b}.s}} end)"
    end = f"array_to_string({r}.g, {joint})"
    keep = "true" if tail else f"length({end}) >= {least}"
    done = f"list_transform([{fold}], lambda {r}: list_concat({r}.c, case when {keep} then [{end}] else [] end))[1]"
    return f"list_transform([{parts}], lambda {q}: case when len({q}) = 0 then []::varchar[] else {done} end)[1]"


def _points(content: str, pattern: str) -> str:
    x, y, z = (f"{c}{next(_names)}" for c in "xyz")
    return f"list_filter(list_transform(list_filter({_pieces(content, pattern)}, lambda {x}: {_starts(x, pattern)}), lambda {y}: {_trim(y)}), lambda {z}: {z} <> '')"


def _packed(vertical: str, points: str | None = None, kinds: str = "", joint: str = "chr(10) || chr(10)") -> str:
    least, most, overlap = SIZES[vertical]
    plain = _pack(_paragraphs("content"), least, most, overlap)
    listed = f"when kind in ({kinds}) and len({_points('content', points)}) > 0 then {_pack(_points('content', points), 0, most, 0, True, joint)} " if points else ""
    return f"case when length(content) <= {most} then [content] {listed}else {plain} end"


def _numbered(sections: str, chunks: str) -> str:
    """SQL of chunk rows, from rows (doc_id, pos, kind, content) and an expression for a section's chunks."""
    return f"with s as ({sections}), c as (select doc_id, pos, kind, unnest(ch) as content, generate_subscripts(ch, 1) as k from (select doc_id, pos, kind, {chunks} as ch from s)) select doc_id || '_chunk_' || (row_number() over (partition by doc_id order by pos, k) - 1) as chunk_id, doc_id, kind as section_type, sha256(content) as content_sha256, cast(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) as integer) as words from c"


def _rows(spark, d, vertical: str, found):
    docs = structured(spark, d).where(F.col("vertical") == vertical)
    return v.chunk_rows(docs, found).select("chunk_id", "doc_id", "section_type", F.sha2("content", 256).alias("content_sha256"), F.col("word_count").alias("words"))


def _long(vertical: str) -> str:
    return f"select doc_id, text from structured where vertical = '{vertical}' and length({_trim('text')}) >= 50"


_GO_SPLIT = f"select doc_id, text, regexp_replace(text, '(?im){v.ORDER_LINE}', chr(1)) as t from ({_long('go')})"
_GO_SECTIONS = f"select doc_id, 0 as pos, 'content' as kind, text as content from ({_GO_SPLIT}) where not contains(t, chr(1)) union all select doc_id, 1, 'preamble', {_trim('split_part(t, chr(1), 1)')} from ({_GO_SPLIT}) where contains(t, chr(1)) and {_trim('split_part(t, chr(1), 1)')} <> '' union all select doc_id, 2, 'orders', {_trim('split_part(t, chr(1), 2)')} from ({_GO_SPLIT}) where contains(t, chr(1)) and {_trim('split_part(t, chr(1), 2)')} <> ''"


@query("H4_H5_chunks_go", _numbered(_GO_SECTIONS, _packed("go", v.POINT, "'orders'")))
def go(spark, d):
    return _rows(spark, d, "go", v.chunks(F.col("text"), "go"))


_LEGAL_PARTS = f"select doc_id, text, list_filter({_pieces('text', v.SECTION, 'im')}, lambda p: {_starts('p', v.SECTION, 'i')}) as ps from ({_long('legal')})"
_LEGAL_SECTIONS = f"select doc_id, 0 as pos, 'content' as kind, text as content from ({_LEGAL_PARTS}) where len(ps) = 0 union all select doc_id, pos, regexp_extract(p, '(?i)\\A\\S+[ \\t]+(\\d+[A-Z]?)', 1), {_trim('p')} from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as pos from ({_LEGAL_PARTS}))"
_SUBS = _pack(_points("content", v.SUBSECTION), 0, SIZES["legal"][1], 0, True, whole=True)


@query("H6_H7_chunks_legal", _numbered(_LEGAL_SECTIONS, f"case when kind = 'content' then {_pack(_paragraphs('content'), *SIZES['legal'])} when length(content) <= {SIZES['legal'][1]} then [content] when len({_points('content', v.SUBSECTION)}) > 0 then {_SUBS} else {_pack(_paragraphs('content'), *SIZES['legal'])} end"))
def legal(spark, d):
    return _rows(spark, d, "legal", v.chunks(F.col("text"), "legal"))


def _marked(vertical: str, markers: dict[str, str], first: str) -> str:
    at = ", ".join(f"{{'at': strpos(regexp_replace(text, '(?im){p}', chr(1)), chr(1)), 'kind': '{k}'}}" for k, p in markers.items())
    base = f"select doc_id, text, list_sort(list_filter([{at}], lambda s: s.at > 0)) as m from ({_long(vertical)})"
    cut = f"select doc_id, text, unnest(m) as s, generate_subscripts(m, 1) as pos from ({base})"
    body = f"select doc_id, pos, s.kind as kind, {_trim('substr(text, s.at, coalesce(lead(s.at) over (partition by doc_id order by pos), length(text) + 1) - s.at)')} as content from ({cut})"
    return f"select doc_id, cast(0 as bigint) as pos, 'content' as kind, text as content from ({base}) where len(m) = 0 union all select * from ({body}) where content <> '' union all select doc_id, 0, '{first}', {_trim('substr(text, 1, m[1].at - 1)')} from ({base}) where len(m) > 0 and {_trim('substr(text, 1, m[1].at - 1)')} <> ''"


@query("H8_H9_chunks_judicial", _numbered(_marked("judicial", v.JUDICIAL, "preamble"), _packed("judicial", v.POINT, "'ratio', 'arguments'")))
def judicial(spark, d):
    return _rows(spark, d, "judicial", v.chunks(F.col("text"), "judicial"))


@query("H10_H11_chunks_scheme", _numbered(_marked("scheme", v.SCHEME, "overview"), _packed("scheme", v.BULLET, "'eligibility', 'benefits'", "chr(10)")))
def scheme(spark, d):
    return _rows(spark, d, "scheme", v.chunks(F.col("text"), "scheme"))


_LINE = "(trim(l) <> '' and (" + " or ".join([f"regexp_matches(l, '{p}')" for p in v.TABLE_LINES] + ["(length(regexp_replace(l, '[^0-9]', '', 'g')) > 5 and length(regexp_replace(l, '[^0-9]', '', 'g')) / length(l) > 0.1)", f"len(regexp_extract_all(l, '{v.NUMBER}')) >= 3"]) + "))"
_BREAK = f"(regexp_matches(l, '(?i){v.CHART}') or regexp_matches(l, '{v.ANALYSIS}'))"
# tables: pieces from caption to caption, their lines within reach, the first that looks like a table's and the first that ends it
_TABLES = f"""p as (select doc_id, unnest(x) as p, generate_subscripts(x, 1) as pos from (select doc_id, {_pieces('text', v.CAPTION, 'i')} as x from ({_long('data')}))),
 q as (select *, {_starts('p', v.CAPTION, 'i')} as is_table, length(regexp_extract(p, '\\A[^\\n]*')) as size from p),
 l as (select doc_id, pos, unnest(ls) as l, generate_subscripts(ls, 1) as i from (select doc_id, pos, string_split(substr(p, size + 1, {v.BLOCK}), chr(10)) as ls from q where is_table)),
 f as (select *, {_LINE} as tl, min(case when {_LINE} then i end) over (partition by doc_id, pos) as first from l),
 e as (select doc_id, pos, any_value(first) as first, coalesce(min(case when i > first and not tl and ({_BREAK} or i - first > {v.BLOCK_LINES}) then i end), max(i) + 1) as stop, min(case when tl then l end) filter (where i = first) as head from f group by doc_id, pos),
 k as (select f.doc_id, f.pos, string_agg(l, chr(10) order by i) as body from f join e using (doc_id, pos) where i < stop group by f.doc_id, f.pos),
 t as (select q.doc_id, q.pos, is_table, p, head, case when not is_table then 0 when e.first is null then least(size + 1000, length(p)) else size + length(body) end as cut from q left join e using (doc_id, pos) left join k using (doc_id, pos)),
 r as (select doc_id, {_trim("regexp_replace(string_agg(substr(p, cut + 1), chr(10) || chr(10) order by pos), '\\n{3,}', chr(10) || chr(10), 'g')")} as rest from t group by doc_id)"""


@query("G19_table_blocks", f"with {_TABLES} select doc_id, cast(pos as integer) as pos, substr(p, 1, cut) as content, array_to_string(list_filter(list_transform(string_split(trim(head), '|'), lambda c: trim(c)), lambda c: c <> ''), ';') as columns from t where is_table")
def table_blocks(spark, d):
    docs = structured(spark, d).where("vertical = 'data'").select("doc_id", F.posexplode(v.table_pieces(F.col("text"))).alias("pos", "t")).where("t.is_table")
    # a text that starts with its first caption has no piece before it
    return docs.select("doc_id", (F.col("pos") + 1).alias("pos"), "t.content", F.array_join("t.columns", ";").alias("columns"))


@query("H13_without_tables", f"with {_TABLES} select doc_id, rest from r")
def without(spark, d):
    return structured(spark, d).where("vertical = 'data'").select("doc_id", v.without_tables(F.col("text")).alias("rest"))


_DATA = f"with {_TABLES}, s as (select doc_id, pos, 'table' as kind, substr(p, 1, cut) as content from t where is_table and length({_trim('substr(p, 1, cut)')}) >= 20 union all select doc_id, 1000000, 'text', rest from r where length(rest) > 100)"


@query("H12_chunks_data", _DATA + _numbered("select * from s", f"case when kind = 'table' then [content] else {_pack(_paragraphs('content'), *SIZES['data'])} end").replace("with s as (select * from s), c as", ", c as"))
def data(spark, d):
    return _rows(spark, d, "data", v.data_chunks(F.col("text")))


_MARKS = f"select doc_id, unnest(x) as p, generate_subscripts(x, 1) as pos from (select doc_id, {_pieces('text', v.TABLE_MARKER, 'i')} as x from ({_long('data')}))"
_MARK_CUT = f"select doc_id, pos, p, {_starts('p', v.TABLE_MARKER, 'i')} as is_table, strpos(p, chr(10) || chr(10) || chr(10)) as gap from ({_MARKS})"
_MARK_END = f"select doc_id, pos, p, is_table, case when not is_table then 0 when gap > 0 then gap - 1 else length(p) end as cut from ({_MARK_CUT})"


@query("H14_marked_tables", _numbered(f"select doc_id, 2 * pos as pos, 'table' as kind, {_trim('substr(p, 1, cut)')} as content from ({_MARK_END}) where is_table union all select doc_id, 2 * pos + 1, 'text', substr(p, cut + 1) from ({_MARK_END})", f"case when kind = 'table' then [content] else {_pack(_paragraphs('content'), *SIZES['data'])} end"))
def marked_tables(spark, d):
    return _rows(spark, d, "data", v.marked_table_chunks(F.col("text")))


@query("G22_charts", "select doc_id, '2' as number, 'Growth' as title, 'Figure 2: Growth' || chr(10) || 'The line climbs.' as content from structured where vertical = 'data'")
def charts(spark, d):
    return structured(spark, d).where("vertical = 'data'").select("doc_id", F.explode(v.charts(F.col("text"))).alias("c")).select("doc_id", "c.*")


_ANALYSIS = f"select doc_id, unnest(ps) as p from (select doc_id, list_filter({_pieces('text', v.ANALYSIS)}, lambda p: {_starts('p', v.ANALYSIS)}) as ps from structured where vertical = 'data')"


@query("G23_analysis_sections", f"select doc_id, regexp_extract(p, '(\\d+(?:\\.\\d+)?)', 1) as number, trim(regexp_extract(p, '{v.ANALYSIS}', 2)) as title, {_trim('substr(p, strpos(p, chr(10)))')} as content from ({_ANALYSIS})")
def analysis(spark, d):
    return structured(spark, d).where("vertical = 'data'").select("doc_id", F.explode(v.analysis_sections(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query("G1_go_sections", "with b as (select doc_id, text, unnest([{'at': strpos(text, chr(10) || 'Sub:') + 1, 'kind': 'subject'}, {'at': strpos(text, chr(10) || 'Ref:') + 1, 'kind': 'references'}, {'at': case when strpos(text, chr(10) || '1. ') > 0 then strpos(text, chr(10) || '1. ') + 1 when contains(text, chr(10) || 'ORDER:' || chr(10)) then strpos(text, chr(10) || 'ORDER:' || chr(10)) + 1 else 0 end, 'kind': 'orders'}, {'at': strpos(text, chr(10) || 'ANNEXURE') + 1, 'kind': 'annexure'}]) as s from structured where vertical = 'go'), c as (select doc_id, s.kind as section_type, " + _trim("substr(text, s.at, coalesce(lead(s.at) over (partition by doc_id order by s.at), length(text) + 1) - s.at)") + " as content from b where s.at > 0) select doc_id, section_type, content from c where content <> ''")
def go_parts(spark, d):
    return structured(spark, d).where("vertical = 'go'").select("doc_id", F.explode(v.go_parts(F.col("text"))).alias("c")).select("doc_id", "c.section_type", "c.content")


@query("G11_section_lookup", f"with s as ({_LEGAL_SECTIONS}) select d.doc_id, x.content from structured d left join (select doc_id, min_by(content, pos) as content from s where kind = '31A' group by doc_id) x using (doc_id) where d.vertical = 'legal'")
def section_lookup(spark, d):
    return structured(spark, d).where("vertical = 'legal'").select("doc_id", v.section_text(F.col("text"), F.lit("31A")).alias("content"))


# ---- plain packing


@query("H2_H3_packed_chunks", _numbered("select doc_id, 0 as pos, 'text' as kind, replace(text, chr(10), chr(10) || chr(10)) as content from documents where length(text) >= 50", _pack(_paragraphs("content"), 600, 1200, 100)))
def packed(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = F.transform(pack(paragraphs(F.col("text")), 600, 1200, 100), lambda c: v.section(F.lit("text"), c))
    return v.chunk_rows(docs, found).select("chunk_id", "doc_id", "section_type", F.sha2("content", 256).alias("content_sha256"), F.col("word_count").alias("words"))


# ---- chunk metadata

_YEAR = r"cast(nullif(regexp_extract(text, '\b(19\d{2}|20\d{2})\b', 1), '') as integer)"


@query("M2_go_metadata", rf"select doc_id, coalesce(nullif(regexp_extract(text, '(?i)G\.?O\.?(?:MS|RT)?\.?\s*No\.?\s*(\d+)', 1), ''), n::varchar) as go_number, {_YEAR} as year, 'Finance' as department from corpus where true_vertical = 'go'")
def go_metadata(spark, d):
    from tessera.sources.tables import corpus

    docs = corpus(spark, d).where("true_vertical = 'go'")
    return docs.select("doc_id", metadata.go(F.col("text"), F.col("n").cast("string"), F.lit("Finance")).alias("m")).select("doc_id", "m.*")


@query("M3_legal_metadata", rf"with s as (select *, regexp_extract_all(text, '(?i)Section\s+(\d+(?:\([a-z]\))?)', 1) as found from structured where vertical = 'legal') select doc_id, found[1] as section, case when len(found) > 1 then array_to_string(found[1:5], ',') end as sections, {_YEAR} as year, case when doc_id % 2 = 0 then 'Public Act' end as act_name from s")
def legal_metadata(spark, d):
    docs = structured(spark, d).where("vertical = 'legal'")
    rows = docs.select("doc_id", metadata.legal(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "Public Act")).alias("m")).select("doc_id", "m.*")
    return rows.withColumn("sections", F.array_join("sections", ","))


@query("M4_judicial_metadata", rf"select doc_id, 'WP ' || doc_id as case_number, case when doc_id % 2 = 0 then 'High Court' end as court, {_YEAR} as year from structured where vertical = 'judicial'")
def judicial_metadata(spark, d):
    docs = structured(spark, d).where("vertical = 'judicial'")
    return docs.select("doc_id", metadata.judicial(F.col("text"), F.concat(F.lit("WP "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, "High Court")).alias("m")).select("doc_id", "m.*")


@query("M5_data_metadata", f"with {_TABLES}, h as (select doc_id, pos, substr(p, 1, cut) as text, list_filter(list_transform(string_split(trim(head), '|'), lambda c: trim(c)), lambda c: c <> '') as cols from t where is_table) select doc_id, cast(pos as integer) as pos, array_to_string(cols[1:10], ';') as columns, cast(len(cols) as integer) as column_count, {_YEAR} as year, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)Table\\s+(\\d+(?:\\.\\d+)?)', 1)))[1:5], ',') as references_tables from h")
def data_metadata(spark, d):
    docs = structured(spark, d).where("vertical = 'data'").select("doc_id", F.posexplode(v.table_pieces(F.col("text"))).alias("pos", "t")).where("t.is_table")
    rows = docs.select("doc_id", (F.col("pos") + 1).alias("pos"), metadata.data(F.col("t.content"), F.col("t.columns")).alias("m")).select("doc_id", "pos", "m.*")
    return rows.withColumns({"columns": F.array_join("columns", ";"), "references_tables": F.array_join("references_tables", ",")})


@query("M6_scheme_metadata", rf"select doc_id, nullif({_trim("regexp_extract(text, '(?i)(Jagananna\\s+[A-Za-z\\s]+)', 1)")}, '') as scheme_name, {_YEAR} as year from corpus where true_vertical = 'scheme'")
def scheme_metadata(spark, d):
    from tessera.sources.tables import corpus

    docs = corpus(spark, d).where("true_vertical = 'scheme'")
    return docs.select("doc_id", metadata.scheme(F.col("text"), F.lit(None).cast("string")).alias("m")).select("doc_id", "m.*")


@query("M7_key_entities", "select chunk_id, array_to_string(list_filter(['go ms no 45', 'G.O. 1', 'The go ms'], lambda x: contains(content, x))[1:3], ',') as mentioned_gos, array_to_string(list_filter(['Section 12', 'Section 9'], lambda x: contains(content, x))[1:3], ',') as mentioned_sections, array_to_string(list_filter(['FIRE Safety', 'teacher', 'Finance', 'posting'], lambda x: contains(lower(content), lower(x)))[1:2], ',') as departments, array_to_string(list_filter(['AMMA VODI', 'hostel', 'scholarship'], lambda x: contains(lower(content), lower(x)))[1:2], ',') as schemes from results")
def key_entities(spark, d):
    from tessera.sources.tables import results

    words = {"go_numbers": ["go ms no 45", "G.O. 1", "The go ms"], "sections": ["Section 12", "Section 9"], "departments": ["FIRE Safety", "teacher", "Finance", "posting"], "schemes": ["AMMA VODI", "hostel", "scholarship"]}
    found = metadata.key_entities({k: F.array(*map(F.lit, ws)) for k, ws in words.items()}, F.col("content"))
    return results(spark, d).select("chunk_id", *[F.array_join(c, ",").alias(k) for k, c in found.items()])


# ---- places of snippets


@query(
    "J32_snippet_location",
    r"""with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as i, n from (select doc_id, string_split(text, chr(10)) as x, len(string_split(text, chr(10))) as n from documents where text is not null)),
    p as (select doc_id, cast((i - 1) // 3 + 1 as integer) as page, trim(regexp_replace(lower(string_agg(line, chr(10) order by i)), '\s+', ' ', 'g')) as t, any_value(n) as n from l group by doc_id, (i - 1) // 3),
    m as (select * from p where page = (n + 2) // 3 // 2 + 1),
    s as (select doc_id, trim(case doc_id % 4 when 0 then substr(t, 5, 80) when 1 then substr(t, 3, 60) || ' zzz zzz' when 2 then array_to_string(list_reverse(string_split(t, ' ')), ' ') else 'nothing of this kind' end) as s from m),
    h as (select s.doc_id, p.page, case when contains(p.t, s.s) then 1 when length(substr(s.s, 1, 50)) > 20 and contains(p.t, substr(s.s, 1, 50)) then 2
      when len(list_distinct(list_filter(string_split(s.s, ' '), lambda w: length(w) > 3))) > 5 and len(list_intersect(list_distinct(list_filter(string_split(s.s, ' '), lambda w: length(w) > 3)), list_distinct(string_split(p.t, ' ')))) / len(list_distinct(list_filter(string_split(s.s, ' '), lambda w: length(w) > 3))) > 0.7 then 3 end as tier from s join p using (doc_id) where s.s <> '')
    select s.doc_id, cast(coalesce(f.page, 1) as integer) as page, case f.tier when 1 then 'exact' when 2 then 'medium' when 3 then 'low' else 'none' end as confidence from s left join (select doc_id, min(page) as page, min_by(tier, page) as tier from h where tier is not null group by doc_id) f using (doc_id) where s.s <> ''""",
)
def snippets(spark, d):
    """A snippet from the middle page of every document, whole, with another end, with its words turned round, or foreign."""
    from tessera.operators import answers

    lines = F.split("text", "\n", -1)
    pages = load(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 3).cast("int")), lambda k: F.array_join(F.slice(lines, k * 3 + 1, 3), "\n"))).alias("page", "text"), F.ceil(F.size(lines) / 3).cast("int").alias("n"))
    pages = pages.withColumn("page", F.col("page") + 1)
    t = answers.plain(F.col("text"))
    made = F.when(F.col("doc_id") % 4 == 0, F.substring(t, 5, 80)).when(F.col("doc_id") % 4 == 1, F.concat(F.substring(t, 3, 60), F.lit(" zzz zzz"))).when(F.col("doc_id") % 4 == 2, F.array_join(F.reverse(F.split(t, " ")), " ")).otherwise("nothing of this kind")
    asked = pages.where(F.col("page") == F.floor(F.col("n") / 2) + 1).select("doc_id", F.trim(made).alias("snippet")).where("snippet <> ''")
    return answers.locate(asked, pages.select("doc_id", "page", "text"))
