"""Queries for cleaning, classification and entities, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, cleaning, entities
from tessera.sources.tables import corpus, dirty, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def column(name: str, function, source, sql: str) -> None:
    """A query of one cleaned text column; sql is the other engine's expression over text."""
    QUERIES[name] = lambda spark, d: source(spark, d).select("doc_id", function(F.col("text")).alias("text"))
    ORACLE[name] = oracle(f"select doc_id, {sql} as text from {source.__name__}")


HYPHEN = r"regexp_replace(text, '(\w+)-\s*\n\s*(\w+)', '\1\2', 'g')"
MARKERS = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\n\s*[-–—]\s*\d+\s*[-–—]\s*\n', chr(10), 'g'),"
    r" '\nPage\s+\d+\s*\n', chr(10), 'gi'), '\n\d+\s+of\s+\d+\s*\n', chr(10), 'gi'), '\n\s*[-–—]{{1,}}\s*Page\s+\d+\s*[-–—]{{1,}}\s*\n', chr(10), 'gi')"
)
ARTIFACTS = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\[Image:.*?\]', '', 'gi'), '\[Chart:.*?\]', '', 'gi'),"
    r" '<.*?>', '', 'g'), '\n\s*&{{2,}}.*?\n', chr(10), 'g'), '\n\s*#{{2,}}.*?\n', chr(10), 'g'), '\n\s*\*{{3,}}.*?\n', chr(10), 'g'), '[©®™]+', '', 'g')"
)
SPACE = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, ' +', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'),"
    r" '(?m)^ +', '', 'g'), '(?m) +$', '', 'g'), '^\s+|\s+$', '', 'g')"
)
OCR = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\bGovemment\b', 'Government', 'gi'), '\bEducalion\b', 'Education', 'gi'),"
    r" '\bAndhra\s+Pradcsh\b', 'Andhra Pradesh', 'gi'), '\b0rder\b', 'Order', 'gi'), '\bSec[il]on\b', 'Section', 'gi')"
)
GO_REFS = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'G\.O\.(Ms|MS)\.?No\.?(\d+)', 'G.O.Ms.No. \2', 'gi'), 'G\.O\.(Rt|RT)\.?No\.?(\d+)', 'G.O.Rt.No. \2', 'gi'),"
    r" 'GO\s+(MS|Ms)\.?\s*No\.?\s*(\d+)', 'G.O.Ms.No. \2', 'gi'), 'GO\s+(RT|Rt)\.?\s*No\.?\s*(\d+)', 'G.O.Rt.No. \2', 'gi')"
)
SECTION_REFS = r"regexp_replace(regexp_replace({}, 'Sec\.?\s*(\d+)', 'Section \1', 'gi'), '§\s*(\d+)', 'Section \1', 'g')"
DATES = r"regexp_replace({}, '(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}})', '\1-\2-\3', 'g')"

column("C3_fix_hyphenation", cleaning.fix_hyphenation, dirty, HYPHEN)
column("C4_remove_page_markers", cleaning.remove_page_markers, dirty, MARKERS.format("text"))
column("C5_remove_artifacts", cleaning.remove_artifacts, dirty, ARTIFACTS.format("text"))
column("C6_normalize_whitespace", cleaning.normalize_whitespace, dirty, SPACE.format("text"))
column("C7_fix_ocr_errors", cleaning.fix_ocr_errors, dirty, OCR.format("text"))
column("C9_go_references", cleaning.standardize_go_references, dirty, GO_REFS.format("text"))
column("C10_section_references", cleaning.standardize_section_references, dirty, SECTION_REFS.format("text"))
column("C11_dates", cleaning.standardize_dates, dirty, DATES.format("text"))
column("C12_match_form", cleaning.match_form, dirty, r"trim(regexp_replace(regexp_replace(lower(text), '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g'))")
GARBAGE = (
    r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: case when length(trim(x)) = 0 then true"
    r" when (length(x) - length(regexp_replace(x, '[ -~]', '', 'g'))) / greatest(length(trim(x)), 1) >= 0.7 then true"
    r" when (length(x) - length(regexp_replace(x, '[~•@_{}\[\]<>|\\\^°±§¶]', '', 'g'))) / greatest(length(trim(x)), 1) > 0.15 then false"
    r" when (length(x) - length(regexp_replace(x, '[ -~]', '', 'g'))) / greatest(length(trim(x)), 1) < 0.4 and length(x) - length(regexp_replace(x, '\pL', '', 'g')) < 5 then false"
    r" when length(trim(x)) < 10 and (length(x) - length(regexp_replace(x, '[ -~]', '', 'g'))) / greatest(length(trim(x)), 1) < 0.5 then false"
    r" when length(x) - length(regexp_replace(x, '\pL', '', 'g')) < length(trim(x)) * 0.3 then regexp_matches(lower(x), 'no\.|dt\.|dated|memo|govt|rc\.|procs\.') else true end), chr(10))"
)
QUERIES["C8_remove_ocr_garbage"] = lambda spark, d: load(spark, d, "documents").select("doc_id", cleaning.remove_ocr_garbage(F.col("text")).alias("text"))
ORACLE["C8_remove_ocr_garbage"] = f"select doc_id, {GARBAGE} as text from documents"
QUERIES["C1_clean"] = lambda spark, d: dirty(spark, d).select("doc_id", cleaning.clean(F.col("text")).alias("text"))
_steps = OCR.format(SPACE.format(ARTIFACTS.format(MARKERS.format(r"regexp_replace(g, '(\w+)-\s*\n\s*(\w+)', '\1\2', 'g')"))))
ORACLE["C1_clean"] = oracle(rf"select doc_id, regexp_replace({_steps}, '^\s+|\s+$', '', 'g') as text from (select doc_id, {GARBAGE} as g from dirty)")
column("C2_normalize_unicode", cleaning.normalize_unicode, dirty, GARBAGE)


@query("C13_C15_document_names", "select doc_id, lower(translate(concat('GO Ms-No ', cast(n as string)), ' -', '__')) as stem_id, concat(upper(doc_id), '.pdf') as pdf_name, doc_id as back from corpus")
def names(spark, d):
    pdf = F.concat(F.upper("doc_id"), F.lit(".pdf"))
    return corpus(spark, d).select("doc_id", cleaning.stem_to_doc_id(F.concat(F.lit("GO Ms-No "), F.col("n").cast("string"))).alias("stem_id"), pdf.alias("pdf_name"), cleaning.filename_to_doc_id(pdf).alias("back"))


def _count_sql(word: str, text: str = "lower(text)") -> str:
    return f"cast((length({text}) - length(replace({text}, '{word}', ''))) / {len(word)} as integer)"


_SCORES = ", ".join(f"{' + '.join(_count_sql(w) for w in words)} as {v}" for v, words in classify.VERTICAL_KEYWORDS.items())


@query(
    "K1_vertical_by_keywords",
    f"""with s as (select doc_id, {_SCORES} from corpus), b as (select *, greatest(go, legal, judicial, data, scheme) as best, go + legal + judicial + data + scheme as total from s)
    select doc_id, case when best < 3 then 'data' when go = best then 'go' when legal = best then 'legal' when judicial = best then 'judicial' when data = best then 'data' else 'scheme' end as vertical,
    round(case when best < 3 then 0.3 else least(cast(best as double) / greatest(total, 1), 0.8) end, 6) as confidence from b""",
)
def verticals(spark, d):
    return corpus(spark, d).select("doc_id", classify.vertical(F.col("text")).alias("v")).select("doc_id", "v.vertical", "v.confidence")


def _any_sql(patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}', 'i')" for p in patterns) + ")"


_TYPE_SQL = f"""case when true_vertical = 'go' then case when {_any_sql(classify.CIRCULAR)} then 'go_circular' when {_any_sql(classify.NOTIFICATION)} then 'go_notification' else 'go_order' end
 when true_vertical = 'legal' then case when {_any_sql(classify.AMENDMENT)} then 'amendment' when {_any_sql(classify.ACT)} then 'act' when {_any_sql(classify.RULE)} then 'rule' when {_any_sql(classify.NOTIFICATION)} then 'notification' when contains(lower(t[:500]), 'regulation') then 'regulation' else 'unknown' end
 when true_vertical = 'judicial' then case when {_any_sql(classify.JUDGMENT)} then 'judgment' when {_any_sql(classify.COURT_ORDER)} then case when contains(lower(t[:500]), 'interim') then 'interim_order' else 'order' end else 'order' end
 when true_vertical = 'data' then case when {_any_sql(classify.BUDGET)} then 'budget' when {_any_sql(classify.REPORT)} then 'report' when {_count_sql('Table', 't')} + {_count_sql('|', 't')} + length(t) - length(replace(t, chr(9), '')) > 10 then 'statistics' else 'report' end
 else case when {_any_sql(classify.GUIDELINES)} then 'guidelines' else 'scheme_document' end end"""
_CATEGORY_SQL = "case " + " ".join(f"when doc_type = '{k}' then '{v}'" for k, v in classify.CATEGORIES.items()) + " else 'unknown' end"


@query("K3_K10_document_type", f"select doc_id, doc_type, {_CATEGORY_SQL} as category from (select doc_id, {_TYPE_SQL} as doc_type from (select doc_id, true_vertical, text[:2000] as t from corpus))")
def types(spark, d):
    out = corpus(spark, d).select("doc_id", classify.document_type(F.col("text"), F.col("true_vertical")).getField("doc_type").alias("doc_type"))
    return out.withColumn("category", classify.category(F.col("doc_type")))


@query(
    "K11_table_content",
    r"select doc_id, (length(text) - length(regexp_replace(text, '[|\t]', '', 'g'))) / greatest(length(text), 1) > 0.05 or (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / greatest(length(text), 1) > 0.2 as is_table from dirty",
)
def table_content(spark, d):
    return dirty(spark, d).select("doc_id", classify.is_table_content(F.col("text")).alias("is_table"))


def _all_sql(patterns: list[str], flags: str = "i") -> str:
    parts = [f"regexp_extract_all(text, '{p.removeprefix('(?i)')}', 1, '{flags}')" for p in patterns]
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")" if len(parts) == 2 else f"flatten([{', '.join(parts)}])"


def _sorted_sql(values: str) -> str:
    return f"list_sort(list_distinct({values}))"


def entity(name: str, function, sql: str) -> None:
    QUERIES[name] = lambda spark, d: corpus(spark, d).select("doc_id", F.array_join(function(F.col("text")), ";").alias("found"))
    ORACLE[name] = oracle(f"select doc_id, array_to_string({sql}, ';') as found from corpus")


entity("E1_go_numbers", entities.go_numbers, _sorted_sql(f"list_transform({_all_sql(entities.GO)}, lambda x: 'GO.MS.No.' || x)"))
entity("E2_sections", entities.sections, _sorted_sql(f"list_transform(list_concat({_all_sql(entities.SECTION[:2])}, regexp_extract_all(text, '§\\s*(\\d+[A-Z]?)', 1)), lambda x: 'Section ' || x)"))
entity("E3_rules", entities.rules, _sorted_sql(f"list_transform({_all_sql([entities.RULE, entities.RULES_OF])}, lambda x: case when starts_with(x, 'Rule') then x else 'Rule ' || x end)"))
entity("E4_dates", entities.dates, _sorted_sql(_all_sql(entities.DATE)))
_strip = "list_transform({}, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^,+|,+$', '', 'g'), '^\\.+|\\.+$', '', 'g'))"
entity("E5_departments", entities.departments, f"list_slice({_sorted_sql('list_filter(' + _strip.format(_all_sql(entities.DEPARTMENT)) + ', lambda x: length(x) > 5)')}, 1, 10)")
entity("E6_schemes", entities.schemes, "list_slice(" + _sorted_sql("list_filter(list_transform(" + _all_sql(entities.SCHEME) + ", lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 5)") + ", 1, 10)")
entity("E7_years", entities.years, _sorted_sql(r"regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1)"))
_good = " and ".join(
    [r"length(x) > 10 and regexp_matches(lower(x), '\bact\s*$')"] + [f"not regexp_matches(lower(x), '{p}')" for p in entities.NOT_ACTS] + [f"not contains(lower(x), '{w}')" for w in entities.NOT_ACT_WORDS]
    + [r"len(list_filter(string_split_regex(regexp_replace(x, '(?i)\s+act\s*$', ''), '\s+'), lambda w: length(w) > 2 and lower(w) not in ('the', 'and', 'of', 'for', 'in', 'to', 'a', 'an'))) >= 2"]
    + [r"len(list_filter(string_split_regex(regexp_replace(x, '(?i)\s+act\s*$', ''), '\s+'), lambda w: length(w) > 1 and regexp_matches(w, '^\p{Lu}'))) > 0"]
)
entity("E8_acts", entities.acts, "list_slice(" + _sorted_sql(f"list_filter({_strip.format(_all_sql(entities.ACT))}, lambda x: {_good})") + ", 1, 10)")


@query(
    "E9_E12_entity_counts",
    rf"""with e as (select doc_id, 'go_numbers' as kind, unnest({_sorted_sql(f"list_transform({_all_sql(entities.GO)}, lambda x: 'GO.MS.No.' || x)")}) as value from corpus
    union all select doc_id, 'dates', unnest({_sorted_sql(_all_sql(entities.DATE))}) from corpus
    union all select doc_id, 'years', unnest({_sorted_sql(r"regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1)")}) from corpus)
    select kind, count(*) as n, count(distinct value) as different from e group by kind""",
)
def entity_counts(spark, d):
    rows = corpus(spark, d).select(F.explode(entities.all_entities(F.col("text"), ("go_numbers", "dates", "years"))).alias("kind", "values"))
    return rows.select("kind", F.explode("values").alias("value")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("different"))


@query("S8_needs_ocr", r"select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / greatest(doc_id % 40, 1) < 10 as needs_ocr from documents")
def needs_ocr(spark, d):
    return load(spark, d, "documents").select("doc_id", cleaning.needs_ocr(F.col("text"), F.col("doc_id") % 40).alias("needs_ocr"))
