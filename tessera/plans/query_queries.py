"""Queries for interpretation, routing, planning, clauses, sources, metadata and answers, with checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import entities, interpret
from tessera.operators import answers, clauses
from tessera.sources import files, web
from tessera.sources.tables import candidates, corpus, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ASKED = [
    "What is Section 12 of the RTE Act?", "List all schemes for girl child education in the state", "Design a comprehensive framework for teacher training and recruitment",
    "Compare the midday meal scheme vs the nutrition program", "history of Nadu-Nedu over time", "latest recruitment notification 2025", "Please tell me about the salary and payscale of a contract teacher",
    "verify that the school meets requirements for fire safety", "ideas", "GO Ms No 45", "explain how to build a smart classroom with new furniture , water and a toilet .", "what are the rules for posting ?",
    "innovate with suggestions, compare, define, validate, propose", "high court judgment in a writ petition about transfer", "dropout statistics and enrollment data by survey", "everything about the entire complete assessment and examination of all academic subjects in every school of the state this year please",
    "show me all types of scholarship", "how many teachers", "what works in Finland and Singapore", "",
]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED, 1))
#: The listed queries, and every user's turn of the conversations.
ASKED_SQL = f"select cast(query_id as bigint) as query_id, query from (values {_VALUES}) v(query_id, query) union all select 1000 + conv_id * 1000 + turn, text from conversations where role = 'user' and text is not null"


def asked(spark, sf_dir):
    listed = spark.createDataFrame(list(enumerate(ASKED, 1)), "query_id long, query string")
    turns = load(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    return listed.unionByName(turns.select((F.lit(1000) + F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("query_id"), F.col("text").alias("query")))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def _votes_sql(patterns: list[str], col: str = "query") -> str:
    # the other engine has no lookahead: the one pattern that needs it is written as two
    one = lambda p: f"cast(regexp_matches({col}, '{p}', 'i') as integer)"
    plain = [one(p) if "(?!" not in p else f"cast(regexp_matches({col}, '\\bexplain\\b', 'i') and not regexp_matches({col}, '\\bexplain\\s+how\\s+to', 'i') as integer)" for p in patterns]
    return "(" + " + ".join(plain) + ")"


_V = ", ".join(f"{_votes_sql(ps)} as v_{k}" for k, ps in interpret.TYPE_PATTERNS.items())
_KINDS = list(interpret.TYPE_PATTERNS)
_IDEAS = " or ".join(f"contains(lower(query), '{w}')" for w in interpret.BRAINSTORM_WORDS)
_TYPE = f"""with q as ({ASKED_SQL}), v as (select *, {_V} from q), b as (select *, {' + '.join(f'v_{k}' for k in _KINDS)} as total, greatest({', '.join(f'v_{k}' for k in _KINDS)}) as best from v),
 t as (select query_id, query, case when total = 0 then 'qa' when cast(best as double) / total < 0.3 and ({_IDEAS}) then 'brainstorm' {' '.join(f"when v_{k} = best then '{k}'" for k in _KINDS)} end as query_type,
 round(case when total = 0 then 0.3 when cast(best as double) / total < 0.3 and ({_IDEAS}) then 0.7 else cast(best as double) / total end, 6) as confidence from b),
 w as (select *, len(list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '')) as n from t),
 s as (select *, {_votes_sql(interpret.NARROW)} + case when n <= 5 then 1 else 0 end as narrow, {_votes_sql(interpret.BROAD)} + case when n > 15 then 1 else 0 end as broad, {_votes_sql(interpret.INTERNET)} > 0 as needs_internet from w),
 i as (select query_id, query, query_type, confidence, case when broad > narrow then 'broad' when narrow > broad then 'narrow' else 'medium' end as scope, needs_internet from s)"""


def interpreted(spark, d):
    q = F.col("query")
    out = asked(spark, d).withColumn("t", interpret.query_type(q)).select("query_id", "query", "t.query_type", "t.confidence", interpret.scope(q).alias("scope"), interpret.needs_internet(q).alias("needs_internet"))
    return out


@query("K12_K16_interpretation", _TYPE + " select query_id, query_type, confidence, scope, needs_internet, query_type in ('framework', 'brainstorm') or scope = 'broad' or (query_type = 'policy' and scope = 'medium') as deep from i")
def interpretation(spark, d):
    return interpreted(spark, d).withColumn("deep", interpret.needs_deep_mode(F.col("query_type"), F.col("scope"))).drop("query")


_STOP = ", ".join(f"'{w}'" for w in interpret.KEYWORD_STOPWORDS)


@query("E15_keywords", f"select query_id, array_to_string(list_slice(list_filter(regexp_extract_all(lower(query), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: length(w) > 2 and w not in ({_STOP})), 1, 10), ' ') as keywords from ({ASKED_SQL})")
def keywords(spark, d):
    return asked(spark, d).select("query_id", F.array_join(interpret.keywords(F.col("query")), " ").alias("keywords"))


_NORM = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), '\s+([.,!?;:])', '\1', 'g'), '([.,!?;:])\s*$', '')"
_ALT = "|".join(interpret.FILLERS)
_FILLER = rf"regexp_replace(regexp_replace(trim(regexp_replace(lower({{}}), '\s+', ' ', 'g')), '^(?:(?:{_ALT})(?: |$))+', ''), '(?:(?:^| )(?:{_ALT}))+$', '')"


@query("C20_C22_query_cleaning", rf"select query_id, {_NORM} as normal, {_FILLER.format('query')} as bare, trim(regexp_replace(regexp_replace({_FILLER.format(_NORM)}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g')) as bm25 from ({ASKED_SQL})")
def cleaning(spark, d):
    q = F.col("query")
    return asked(spark, d).select("query_id", interpret.normalize(q).alias("normal"), interpret.remove_filler(q).alias("bare"), interpret.clean_for_bm25(q).alias("bm25"))


_ROUTE = " union all ".join(f"select query_id, {i} as place, '{v}' as vertical, round(least({' + '.join(f'case when contains(lower(query), {w!r}) then 0.3 else 0 end' for w in ws)}, 1.0), 6) as confidence from q" for i, (v, ws) in enumerate(interpret.V1_KEYWORDS.items()))


@query(
    "Q16_route_v1",
    f"with q as ({ASKED_SQL}), s as (select * from ({_ROUTE}) where confidence > 0), d as (select query_id, unnest([0, 1]) as place, unnest(['legal', 'go']) as vertical, unnest([0.6, 0.4]) as confidence from q where query_id not in (select query_id from s)) select query_id, vertical, cast(confidence as double) as confidence, cast(row_number() over (partition by query_id order by confidence desc, place) - 1 as integer) as place from (select * from s union all select * from d)",
)
def route(spark, d):
    return asked(spark, d).select("query_id", F.posexplode(interpret.route_v1(F.col("query"))).alias("place", "r")).select("query_id", "r.vertical", "r.confidence", "place")


_CATS = " union all ".join(f"select query_id, {i} as place, '{c}' as category, {' + '.join(f'case when regexp_matches(query, {chr(39)}(?i)\\b{w}\\b{chr(39)}) then {len(w.split())} else 0 end' for w in ws)} as score from q" for i, (c, ws) in enumerate(interpret.CATEGORY_KEYWORDS.items()))


@query("K21_categories", f"with q as ({ASKED_SQL}), s as (select *, max(score) over (partition by query_id) as best from ({_CATS})) select query_id, category, cast(r as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, place) as r from s where best > 0 and score >= 0.1 * best) where r <= 3")
def categories(spark, d):
    return asked(spark, d).select("query_id", F.posexplode(interpret.categories(F.col("query"))).alias("p", "category")).select("query_id", "category", (F.col("p") + 1).alias("rank"))


def _mode_sql(i: int) -> str:
    return "case " + " ".join(f"when mode = '{m}' then {row[i]}" for m, row in interpret.MODES.items()) + " end"


_SCALE = "cast(case when scope = 'narrow' then floor({0} * 7 / 10) when scope = 'broad' then floor({0} * 13 / 10) else {0} end as integer)"
_PLAN = f"""{_TYPE}, m as (select *, case {' '.join(f"when query_type = '{k}' then '{v}'" for k, v in interpret.TYPE_TO_MODE.items())} else 'qa' end as mode, query_id % 5 + 1 as verticals from i),
 p as (select *, {_SCALE.format('(' + _mode_sql(2) + ')')} as per, {_SCALE.format('(' + _mode_sql(3) + ')')} as total from m)
 select query_id, mode, case when scope = 'narrow' then greatest(1, {_mode_sql(0)} - 1) when scope = 'broad' then least(5, {_mode_sql(0)} + 1) else {_mode_sql(0)} end as rewrites, {_mode_sql(1)} as hops,
 cast(case when verticals = 1 then floor(per * 15 / 10) when verticals >= 4 then floor(per * 8 / 10) else per end as integer) as k_vertical, cast(case when verticals >= 4 then floor(total * 12 / 10) else total end as integer) as k_total,
 {_mode_sql(4)} as k_rerank, round(cast(case when scope = 'narrow' then {_mode_sql(5)} * 0.5 when scope = 'broad' then least(0.9, {_mode_sql(5)} * 1.3) else {_mode_sql(5)} end as double), 6) as diversity from p"""


@query("Q19_Q21_plan", _PLAN)
def plan(spark, d):
    return interpreted(spark, d).select("query_id", interpret.plan(F.col("query_type"), F.col("scope"), F.col("query_id") % 5 + 1).alias("p")).select("query_id", "p.*")


@query("Q15_Q18_collections", f"select vertical, {'case ' + ' '.join(f'when vertical = {k!r} then {v!r}' for k, v in interpret.COLLECTIONS.items()) + ' end'} as collection, count(*) as n from candidates group by vertical")
def collections(spark, d):
    table = F.create_map(*[F.lit(x) for kv in interpret.COLLECTIONS.items() for x in kv])
    return candidates(spark, d).groupBy("vertical").agg(F.count("*").alias("n")).withColumn("collection", table[F.col("vertical")])


@query("Q24_Q25_vertical_weights", "select vertical, round(1.0 / p, 6) as by_priority, round(cast(1.1 - 0.1 * p as double), 6) as policy from (select distinct vertical, case vertical when 'legal' then 1 when 'go' then 2 when 'judicial' then 3 when 'schemes' then 4 else 5 end as p from candidates)")
def weights(spark, d):
    table = F.create_map(*[F.lit(x) for kv in interpret.VERTICAL_ORDER.items() for x in kv])
    rows = candidates(spark, d).select("vertical").distinct().withColumn("p", table[F.col("vertical")])
    return rows.select("vertical", F.round(1.0 / F.col("p"), 6).alias("by_priority"), F.round(1.1 - 0.1 * F.col("p"), 6).cast("double").alias("policy"))


# ---- clauses

_CLAUSES = " union all ".join(f"select doc_id, '{k} ' || unnest(regexp_extract_all(lower(text), '{p}', 1)) as clause from corpus" for k, p in clauses.PATTERNS.items())


@query("J13_clause_index", f"select clause, min(doc_id) as doc_id, count(distinct doc_id) as documents from ({_CLAUSES}) group by clause")
def clause_index(spark, d):
    return clauses.mentions(corpus(spark, d)).groupBy("clause").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("documents"))


# ---- web pages and files

_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"
for _e, _c in web.ENTITIES.items():
    _HTML = f"replace({_HTML}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query("S40_html_to_text", f"select page_id, trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')) as text from pages")
def html_text(spark, d):
    return load(spark, d, "pages").select("page_id", web.html_to_text(F.col("html")).alias("text"))


@query("S39_S41_main_content")
def main_content(spark, d):
    return web.main_content(load(spark, d, "pages"))


@query("S43_J36_J38_allowed_urls", "select page_id, url, regexp_matches(regexp_extract(url, '^https?://([^/?#:]+)', 1), '(^|\\.)example\\.com$') and (page_id % 3 = 0 or true) as allowed from pages")
def allowed(spark, d):
    return load(spark, d, "pages").select("page_id", "url", web.allowed(F.col("url"), ["example.com"]).alias("allowed"))


@query("J37_safe_url", "select page_id, url is not null and regexp_matches(url, '^https?://') and not regexp_matches(lower(url), 'javascript:|data:|file:|localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|@') as safe from pages")
def safe(spark, d):
    return load(spark, d, "pages").select("page_id", web.safe(F.col("url")).alias("safe"))


_NAMED = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '|' || doc_id || '_chunk_0'))"


@query("S24_stable_ids", f"select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from (select doc_id, {_NAMED} as h from corpus)")
def stable_ids(spark, d):
    return corpus(spark, d).select("doc_id", files.stable_id(F.col("doc_id"), F.concat(F.col("doc_id"), F.lit("_chunk_0"))).alias("point_id"))


@query("S25_payload", "select doc_id, case when length(text) > 8000 then substr(text, 1, 8000) || '...' else text end as text, coalesce(lang, 'unknown') as lang from documents")
def payload(spark, d):
    return load(spark, d, "documents").select("doc_id", files.payload_text(F.col("text")).alias("text"), F.coalesce("lang", F.lit("unknown")).alias("lang"))


@query("S26_resume", "select doc_id from documents where doc_id % 7 <> 0")
def resume(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return files.unfinished(docs, docs.where("doc_id % 7 = 0"), "doc_id")


@query("S23_upsert", "select doc_id, case when doc_id % 5 = 0 then 'new' else 'old' end as version from documents")
def upsert(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return files.upserted(docs.withColumn("version", F.lit("old")), docs.where("doc_id % 5 = 0").withColumn("version", F.lit("new")), ["doc_id"])


@query("V5_embedding_cost", "select lang, round(sum(length(text)) / 1000.0 * 0.00001, 9) as cost from documents group by lang")
def cost(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(F.length("text")) / 1000.0 * 0.00001, 9).alias("cost"))


@query("S36_search_by_entity", "select doc_id from corpus where regexp_matches(text, '(?i)Section\\s+12\\b')")
def by_entity(spark, d):
    return corpus(spark, d).where(F.array_contains(entities.sections(F.col("text")), "Section 12")).select("doc_id")


# ---- metadata


@query(
    "M1_chunk_metadata",
    r"select doc_id, nullif(regexp_extract(text, '(?i)G\.O\.Ms\.No\. (\d+)', 1), '') as go_number, nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '') as year, nullif(regexp_extract(text, '(?i)Section\s+(\d+)', 1), '') as section, nullif(regexp_extract(text, '(?i)Petition No\. (\d+)', 1), '') as case_number, length(text) as char_count from corpus",
)
def metadata(spark, d):
    first = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return corpus(spark, d).select("doc_id", first(r"(?i)G\.O\.Ms\.No\. (\d+)").alias("go_number"), first(r"\b((?:19|20)\d{2})\b").alias("year"), first(r"(?i)Section\s+(\d+)").alias("section"), first(r"(?i)Petition No\. (\d+)").alias("case_number"), F.length("text").cast("long").alias("char_count"))


@query("M8_document_summary", "select true_vertical, count(*) as documents, count(distinct year) as years from (select true_vertical, regexp_extract(text, '\\b((?:19|20)\\d{2})\\b', 1) as year from corpus) group by true_vertical")
def document_summary(spark, d):
    return corpus(spark, d).groupBy("true_vertical").agg(F.count("*").alias("documents"), F.countDistinct(F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1)).alias("years"))


@query("M12_quality_indicators", "select chunk_id, case when score >= 0.8 then 'high' when score >= 0.6 then 'medium' else 'low' end as confidence, round(score, 3) as score from candidates")
def indicators(spark, d):
    s = F.col("score")
    return candidates(spark, d).select("chunk_id", F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low").alias("confidence"), F.round(s, 3).alias("score"))


@query("J6_J7_filters", "select chunk_id from candidates where vertical in ('go', 'legal') and year >= 2020 and (section_type = 'orders' or list_contains(string_split(relation_list, ','), 'amends'))")
def filters(spark, d):
    c = candidates(spark, d).where(F.col("vertical").isin("go", "legal") & (F.col("year") >= 2020))
    return c.where((F.col("section_type") == "orders") | F.array_contains(F.split("relation_list", ","), "amends")).select("chunk_id")


@query("J23_top_entities", "select query_id, vertical, section_type, n from (select *, row_number() over (partition by query_id, vertical order by n desc, section_type) as r from (select query_id, vertical, section_type, count(*) as n from candidates where section_type is not null group by 1, 2, 3)) where r <= 3")
def top_entities(spark, d):
    n = candidates(spark, d).where("section_type is not null").groupBy("query_id", "vertical", "section_type").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "vertical").orderBy(F.desc("n"), "section_type"))).where("r <= 3").drop("r")


@query("J35_recent", "select chunk_id from candidates where vertical = 'go' and date_issued_ts >= 1700000000 - 540 * 86400")
def recent(spark, d):
    return candidates(spark, d).where(F.expr("vertical = 'go' and date_issued_ts >= 1700000000 - 540 * 86400")).select("chunk_id")


# ---- answers

_TOP = "select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from candidates"


@query("W1_W2_summary", f"select query_id, string_agg(vertical || ' ' || chunk_id || '...', ' ' order by rank) as summary, cast(0.7 as double) as confidence from ({_TOP}) where rank <= 3 group by query_id")
def summary(spark, d):
    return answers.summary(candidates(spark, d).withColumn("content", F.concat_ws(" ", "vertical", F.col("chunk_id").cast("string"))), 0)


@query("W3_sections_by_vertical", f"select query_id, vertical, count(*) as n, min(rank) as first_rank from ({_TOP}) where rank <= 20 group by query_id, vertical")
def answer_sections(spark, d):
    return answers.top(candidates(spark, d), 20).groupBy("query_id", "vertical").agg(F.count("*").alias("n"), F.min("rank").cast("long").alias("first_rank"))


@query("W4_J33_citations", f"select query_id, cast(rank as integer) as number, chunk_id, doc_id, vertical from ({_TOP}) where rank <= 10")
def citations(spark, d):
    return answers.citations(candidates(spark, d))


@query("W6_dates", "select n, strftime(strptime(d, ['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y']), '%d-%m-%Y') as date from (select n, case n % 3 when 0 then '2020-05-' || lpad(cast(n % 28 + 1 as varchar), 2, '0') when 1 then lpad(cast(n % 28 + 1 as varchar), 2, '0') || '/11/2021' else lpad(cast(n % 28 + 1 as varchar), 2, '0') || '-01-2019' end as d from corpus)")
def dates(spark, d):
    day = F.lpad((F.col("n") % 28 + 1).cast("string"), 2, "0")
    raw = F.when(F.col("n") % 3 == 0, F.concat(F.lit("2020-05-"), day)).when(F.col("n") % 3 == 1, F.concat(day, F.lit("/11/2021"))).otherwise(F.concat(day, F.lit("-01-2019")))
    return corpus(spark, d).select("n", answers.day_month_year(raw).alias("date"))


@query("W14_coverage", f"with q as ({ASKED_SQL}), c as (select n, lower(text) as text from corpus), t as (select query_id, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 2 and w not in ('what', 'is', 'are', 'the', 'a', 'an', 'how', 'why', 'when', 'where')) as terms from q) select query_id, n, len(terms) = 0 or cast(len(list_filter(terms, lambda w: contains(c.text, w))) as double) / greatest(len(terms), 1) >= 0.5 as covered from t join c on c.n = t.query_id % 1500")
def coverage(spark, d):
    """Every query with the answer text of one document."""
    texts = corpus(spark, d).select("n", "text")
    return asked(spark, d).withColumn("n", F.col("query_id") % 1500).join(texts, "n").select("query_id", "n", answers.covered(F.col("query"), F.col("text")).alias("covered"))


@query("W15_W24_claims", r"with c as (select n, text, flatten([regexp_extract_all(text, '\d+%', 0), regexp_extract_all(text, '\d{4}', 0), regexp_extract_all(text, '(?i)Section\s+\d+', 0), regexp_extract_all(text, '(?i)GO\.?\s*\w*\.?\s*No\.?\s*\d+', 0)]) as claims from corpus) select a.n, len(a.claims) as claims, len(a.claims) > 0 and cast(len(list_filter(a.claims, lambda x: not contains(lower(b.text), lower(x)))) as double) / greatest(len(a.claims), 1) > 0.3 as hallucinated from c a join c b on b.n = a.n + 5")
def claims(spark, d):
    c = corpus(spark, d).select("n", "text")
    other = c.select((F.col("n") - 5).alias("n"), F.col("text").alias("source"))
    return c.join(other, "n").select("n", F.size(answers.claims(F.col("text"))).cast("long").alias("claims"), answers.hallucinated(F.col("text"), F.col("source")).alias("hallucinated"))


@query("W12_W16_quality", f"with t as (select query_id, count(*) filter (where rank <= 10) as cited, max(case when rank = 1 then vertical end) as first, avg(score) filter (where rank <= 10) as mean from ({_TOP}) group by query_id) select query_id, cast(case when first in ('legal', 'go') then 0 else 1 end + case when mean < 0.9 then 1 else 0 end as integer) as issues, round(cast(least(1.0, greatest(0.0, 1.0 - 0.15 * (case when first in ('legal', 'go') then 0 else 1 end + case when mean < 0.9 then 1 else 0 end) + case when first in ('legal', 'go') then 0.1 else 0 end)) as double), 6) as quality from t")
def quality(spark, d):
    top = answers.top(candidates(spark, d), 10)
    g = top.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("vertical"))).alias("first"), F.avg("score").alias("mean"))
    first = F.col("first").isin("legal", "go")
    issues = F.size(F.array_compact(F.array(F.when(~first, "Government sources not prioritized in citations"), F.when(F.col("mean") < 0.9, "Weak sources"))))
    return g.select("query_id", issues.alias("issues"), F.round(answers.quality(issues, first, F.lit(False)), 6).cast("double").alias("quality"))


@query("W19_cited_numbers", r"select n, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: cast(x as integer)))), ',') as cited from (select n, 'As [' || n % 5 || '] and [12] with [' || n % 3 || '] say' as t from corpus)")
def cited(spark, d):
    text = F.concat(F.lit("As ["), (F.col("n") % 5).cast("string"), F.lit("] and [12] with ["), (F.col("n") % 3).cast("string"), F.lit("] say"))
    return corpus(spark, d).select("n", F.array_join(answers.cited_numbers(text).cast("array<string>"), ",").alias("cited"))


@query("W10_uuid", "select doc_id, regexp_matches(case when n % 2 = 0 then '123e4567-e89b-12d3-a456-426614174000' else doc_id end, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') as is_uuid from corpus")
def uuid(spark, d):
    return corpus(spark, d).select("doc_id", F.when(F.col("n") % 2 == 0, "123e4567-e89b-12d3-a456-426614174000").otherwise(F.col("doc_id")).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").alias("is_uuid"))
