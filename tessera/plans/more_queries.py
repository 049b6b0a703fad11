"""Queries for headers, lists, relation rules, boosts, expansion, aggregation and answers beyond the main ones, with checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import boosts, headers, interpret, scoring
from tessera.operators import answers, selection
from tessera.plans.query_queries import ASKED_SQL, asked
from tessera.plans.rank_queries import _all_relations, _relations
from tessera.sources import files
from tessera.sources.tables import candidates, corpus, dirty, load, oracle, results

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def expression(name: str, source, key: str, spark_sql: str, duck_sql: str | None = None, table: str | None = None, alias: str = "value") -> None:
    """One computed column; the same SQL text in both engines unless duck_sql is given."""
    QUERIES[name] = lambda spark, d: source(spark, d).select(key, F.expr(spark_sql).alias(alias))
    ORACLE[name] = oracle(f"select {key}, {duck_sql or spark_sql} as {alias} from {table or source.__name__}")


# ---- headers and lists

for _id, _field in (("G2", "go_number"), ("G5", "department"), ("G6", "proceedings"), ("G10", "act_name"), ("G13", "case_number"), ("G13b", "court"), ("G15", "scheme_name")):
    _size, _pattern = headers.FIELDS[_field]
    QUERIES[f"{_id}_{_field}"] = lambda spark, d, f=_field: (dirty if f == "proceedings" else corpus)(spark, d).select("doc_id", headers.field(F.concat(F.col("text"), F.lit(" Procs. Rc. No. 12/A")) if f == "proceedings" else F.col("text"), f).alias("value"))
    _text = "text || ' Procs. Rc. No. 12/A'" if _field == "proceedings" else "text"
    ORACLE[f"{_id}_{_field}"] = oracle(f"select doc_id, nullif(regexp_extract(substr({_text}, 1, {_size}), '{_pattern}', 1), '') as value from {'dirty' if _field == 'proceedings' else 'corpus'}")
for _id, _list in (("G7", "orders"), ("G8", "chapters"), ("G16_G17", "bullets"), ("G18", "captions"), ("H7", "parts")):
    QUERIES[f"{_id}_{_list}"] = lambda spark, d, f=_list: corpus(spark, d).select("doc_id", F.array_join(headers.listed(F.col("text"), f), ";").alias("found"))
    ORACLE[f"{_id}_{_list}"] = oracle(f"select doc_id, array_to_string(regexp_extract_all(text, '{headers.LISTS[_list]}', 1), ';') as found from corpus")


@query("G20_G21_table_rows", r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from corpus where true_vertical = 'data') select doc_id, array_to_string(list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> ''), ';') as cells from l where contains(line, '|')")
def table_rows(spark, d):
    lines = corpus(spark, d).where("true_vertical = 'data'").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(headers.is_table_line(F.col("line")) & F.col("line").contains("|"))
    return lines.select("doc_id", F.array_join(headers.table_row(F.col("line")), ";").alias("cells"))


@query("G3_G4_order_start", r"select doc_id, case when regexp_matches(text, '(?m)^\s*1\.\s') then strpos(text, regexp_extract(text, '(?m)^\s*1\.\s', 0)) when regexp_matches(text, '(?im)^ORDERS?\s*:?\s*$') then strpos(text, regexp_extract(text, '(?im)^ORDERS?\s*:?\s*$', 0)) end as start from corpus")
def order_start(spark, d):
    return corpus(spark, d).select("doc_id", headers.order_start(F.col("text")).cast("long").alias("start"))


# ---- relation rules


@query("R10_valid_relations", f"select source_id, relation_type, target, case relation_type when 'supersedes' then contains(target, 'G.O') or contains(target, 'GO') when 'amends' then contains(target, 'G.O') or contains(target, 'Section') or contains(target, 'Rule') when 'cites' then true else contains(target, 'Act') or contains(target, 'Rule') or contains(target, 'Policy') or contains(target, 'Scheme') or length(target) > 10 end and length(trim(target)) >= 3 as valid from ({_all_relations})")
def valid_relations(spark, d):
    t, k = F.col("target"), F.col("relation_type")
    has = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: t.contains(w))
    ok = F.when(k == "supersedes", has("G.O", "GO")).when(k == "amends", has("G.O", "GO", "Section", "Rule")).when(k == "cites", F.lit(True)).otherwise(has("Act", "Rule", "Policy", "Scheme") | (F.length(t) > 10))
    return _relations(spark, d).select("source_id", "relation_type", "target", (ok & (F.length(F.trim(t)) >= 3)).alias("valid"))


_TARGET = "case n % 4 when 0 then '  GO.Ms.No  12 ' when 1 then 'the education  act' when 2 then 'G.O.5' else 'rule 7' end"
expression(
    "R11_normal_targets", corpus, "n",
    f"replace(replace(case when upper(trim(regexp_replace({_TARGET}, '\\\\s+', ' '))) like '%GO%' and not trim(regexp_replace({_TARGET}, '\\\\s+', ' ')) like '%G.O%' then replace(trim(regexp_replace({_TARGET}, '\\\\s+', ' ')), 'GO', 'G.O.') else trim(regexp_replace({_TARGET}, '\\\\s+', ' ')) end, 'act', 'Act'), 'rule', 'Rule')",
    f"replace(replace(case when upper(trim(regexp_replace({_TARGET}, '\\s+', ' ', 'g'))) like '%GO%' and not trim(regexp_replace({_TARGET}, '\\s+', ' ', 'g')) like '%G.O%' then replace(trim(regexp_replace({_TARGET}, '\\s+', ' ', 'g')), 'GO', 'G.O.') else trim(regexp_replace({_TARGET}, '\\s+', ' ', 'g')) end, 'act', 'Act'), 'rule', 'Rule')",
)


@query("R7_candidate_sentences", r"with s as (select doc_id, list_filter(string_split_regex(text, '[.!?]\s+'), lambda x: regexp_matches(lower(x), 'supersed|amend|as per|under|in accordance|implement|governed')) as c from corpus) select doc_id, cast(len(c) as integer) as n, array_to_string(list_slice(c, 1, 20), ' / ') as sentences from s")
def candidate_sentences(spark, d):
    c = corpus(spark, d).select("doc_id", F.filter(F.split("text", r"[.!?]\s+"), lambda s: F.lower(s).rlike("supersed|amend|as per|under|in accordance|implement|governed")).alias("c"))
    return c.select("doc_id", F.size("c").alias("n"), F.array_join(F.slice("c", 1, 20), " / ").alias("sentences"))


@query("R9_E13_parsed_responses", "select n, 'cites' as relation_type, 'Section ' || n % 9 as target from corpus where n % 3 <> 2")
def parsed(spark, d):
    fence = F.lit("```")
    body = F.concat(F.lit('[{"relation_type": "cites", "target": "Section '), (F.col("n") % 9).cast("string"), F.lit('"}]'))
    raw = F.when(F.col("n") % 3 == 0, F.concat(fence, F.lit("json\n"), body, F.lit("\n"), fence)).when(F.col("n") % 3 == 1, body).otherwise(F.lit("no json [here"))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    rows = corpus(spark, d).select("n", F.from_json(bare, "array<struct<relation_type string, target string>>").alias("r"))
    return rows.select("n", F.explode("r").alias("r")).select("n", "r.relation_type", "r.target").where("target is not null")


@query("E10_E11_merged_entities", "select n, case when n % 2 = 0 then 'a,b,c' else 'a,b' end as merged from corpus")
def merged(spark, d):
    from tessera.functions.entities import merge_entities

    left = F.create_map(F.lit("k"), F.array(F.lit("a"), F.lit("b")))
    right = F.create_map(F.lit("k"), F.when(F.col("n") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"))))
    return corpus(spark, d).select("n", F.array_join(merge_entities(left, right)["k"], ",").alias("merged"))


# ---- more interpretation

_LEGAL = [r"\b(?:section|clause|article|rule|sub-rule|amendment)\s+\d+", r"\b(?:rte|cce|apsermc)\s+(?:act|rule)\b", r"\b\d+\(\d+\)\(\w+\)", r"\b(?:act|rule|regulation)\s+\d+", r"\b(?:go|government\s+order)\s+(?:no\.?\s*)?\d+"]


@query("K23_legal_clause_query", f"select query_id, {' or '.join(f'regexp_matches(lower(query), {chr(39)}{p}{chr(39)})' for p in _LEGAL)} or (regexp_matches(lower(query), 'section|article|rule|clause|act|rte|cce|apsermc') and regexp_matches(query, '\\d')) as legal from ({ASKED_SQL})")
def legal_clause(spark, d):
    low = F.lower("query")
    hit = low.rlike("section|article|rule|clause|act|rte|cce|apsermc") & low.rlike(r"\d")
    for p in _LEGAL:
        hit = hit | low.rlike(p)
    return asked(spark, d).select("query_id", hit.alias("legal"))


_WEB = [r"\blatest\b", r"\brecent\b", r"\bcurrent\b", r"\bnew\b", r"\bupdated\b", r"\bthis\s+year\b", r"\btoday\b", r"\bnow\b", r"\bpresent\b", r"\b202[4-9]\b", r"\b203\d\b", r"\bnews\b", r"\bannouncement\b", r"\blaunched?\b", r"\bintroduced\b", r"\bchanges?\b", r"\bversus\b", r"\bvs\.?\b", r"\bcompare.*(?:with|to)\b", r"\bdifference.*between\b"]


@query("K24_K25_internet_router", f"select query_id, {' or '.join(f'regexp_matches(query, {chr(39)}(?i){p}{chr(39)})' for p in _WEB)} as internet, case when regexp_matches(lower(query), 'latest|recent|today|this year') then 'recent' when regexp_matches(lower(query), 'comprehensive|all|complete|overview') then 'broad' else 'specific' end as scope from ({ASKED_SQL})")
def internet_router(spark, d):
    q = F.col("query")
    scope = F.when(F.lower(q).rlike("latest|recent|today|this year"), "recent").when(F.lower(q).rlike("comprehensive|all|complete|overview"), "broad").otherwise("specific")
    return asked(spark, d).select("query_id", (interpret.votes(q, _WEB) > 0).alias("internet"), scope.alias("scope"))


_TRIGGERS = "recent|latest|current|new|today|yesterday|this week|this month|this year|2024|2025|update|progress|status|now|currently|international|global|worldwide|other states|other countries|comparison|benchmarking|best practices|external|outside andhra pradesh|internet|search|online|web|google|find out|look up|check|verify"


@query("K26_triggers", f"select query_id, query_id % 4 = 0 or query_id % 3 = 0 or regexp_matches(lower(query), '{_TRIGGERS}') as use_internet from ({ASKED_SQL})")
def triggers(spark, d):
    return asked(spark, d).select("query_id", (F.expr("query_id % 4 = 0 or query_id % 3 = 0") | F.lower("query").rlike(_TRIGGERS)).alias("use_internet"))


@query("C23_academic_years", r"select n, array_to_string(list_transform(regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1), lambda y: cast(cast(y as integer) - 1 as varchar) || '-' || substr(y, 3, 2)), ' ') as years from corpus")
def academic(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return corpus(spark, d).select("n", F.array_join(F.transform(found, lambda y: F.concat((y.cast("int") - 1).cast("string"), F.lit("-"), F.substring(y, 3, 2))), " ").alias("years"))


expression("C24_highlights", lambda spark, d: load(spark, d, "documents"), "doc_id", "case when length(text) > 200 then concat(substring(text, 1, 200), '...') else text end", "case when length(text) > 200 then substr(text, 1, 200) || '...' else text end", "documents")


# ---- boosts


@query("B3_legal_keyword_boost", "select doc_id, round(case when k > 0 then 1.5 * 2 + k * 0.5 else 1.5 end, 6) as score from (select doc_id, (length(lower(text)) - length(replace(lower(text), 'section', ''))) / 7 + (length(lower(text)) - length(replace(lower(text), 'act', ''))) / 3 as k from corpus)")
def legal_boost(spark, d):
    from tessera.functions.classify import occurrences

    k = occurrences(F.lower("text"), "section") + occurrences(F.lower("text"), "act")
    return corpus(spark, d).select("doc_id", F.round(F.when(k > 0, 1.5 * 2 + k * 0.5).otherwise(1.5), 6).alias("score"))


# ---- fusion and reranking beyond the main ones


@query("F13_first_occurrence", "select query_id, doc_id, min(chunk_id) as chunk_id from candidates group by query_id, doc_id")
def first_occurrence(spark, d):
    return candidates(spark, d).groupBy("query_id", "doc_id").agg(F.min("chunk_id").alias("chunk_id"))


@query("F22_F23_reordered", "select query_id, chunk_id, cast(row_number() over (partition by query_id order by case when chunk_id % 7 = 0 then 0 else 1 end, score desc, chunk_id) as integer) as place from candidates")
def reordered(spark, d):
    c = candidates(spark, d)
    ids = c.where("chunk_id % 7 = 0").select("query_id", "chunk_id", F.lit(0).alias("_first"))
    return c.join(ids, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("_first", F.lit(1)), F.desc("score"), "chunk_id")).alias("place"))


@query("F21_pair_scorer", r"with w as (select a.doc_id, list_distinct(regexp_extract_all(lower(a.text), '([a-z0-9]+)', 1)) as x, ['order', 'court', 'act', 'scheme'] as q from corpus a) select doc_id, score from (select doc_id, round(cast(len(list_intersect(x, q)) as double) / len(list_distinct(list_concat(x, q))), 6) as score from w) order by score desc, doc_id limit 25")
def pair_scorer(spark, d):
    s = corpus(spark, d).select("doc_id", F.round(scoring.term_overlap(F.lit("order court act scheme"), F.col("text")), 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(25)


@query("F24_category_coverage")
def category_coverage(spark, d):
    """The categories that K21 predicts for the query; a result has those whose keywords it holds, the first one if none."""
    r = results(spark, d)
    predicted = files.written(r.select("query").distinct().withColumn("predicted", interpret.categories(F.col("query"))), "predicted")
    r = r.join(predicted, "query")
    holds = lambda ws: F.col("content").rlike(r"(?i)\b(?:" + "|".join(ws) + r")\b")
    every = F.array_compact(F.array(*[F.when(holds(ws), c) for c, ws in interpret.CATEGORY_KEYWORDS.items()]))
    own = F.filter("predicted", lambda c: F.array_contains(every, c))
    r = r.withColumn("assigned", F.when(F.size(own) > 0, own).otherwise(F.slice("predicted", 1, 1)))
    # (written down: the rules read these columns often)
    return selection.cover_categories(files.written(r.select("query_id", "chunk_id", "score", "vertical", "predicted", "assigned"), "assigned"))


@query("F24_F27_category_penalty")
def category_penalty(spark, d):
    return selection.penalise_categories(candidates(spark, d))


@query("F25_F26_coverage", "select query_id, vertical, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by query_id), 6) as share from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from candidates) where r <= 20 group by query_id, vertical")
def coverage_report(spark, d):
    n = answers.top(candidates(spark, d), 20).groupBy("query_id", "vertical").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("query_id")), 6))


# ---- joins


@query("J3_J5_filtered_search", "select query_id, vertical, chunk_id, cast(r as integer) as rank from (select *, row_number() over (partition by query_id, vertical order by score desc, chunk_id) as r from candidates where score >= 0.3 and year >= 2015) where r <= 5")
def filtered(spark, d):
    c = candidates(spark, d).where("score >= 0.3 and year >= 2015")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vertical").orderBy(F.desc("score"), "chunk_id"))).where("rank <= 5").select("query_id", "vertical", "chunk_id", "rank")


@query("J12_weighted_text", "select doc_id, length(concat_ws(' ', true_vertical, true_vertical, doc_id, doc_id, substr(text, 1, 500))) as size from corpus")
def weighted_text(spark, d):
    return corpus(spark, d).select("doc_id", F.length(F.concat_ws(" ", "true_vertical", "true_vertical", "doc_id", "doc_id", F.substring("text", 1, 500))).cast("long").alias("size"))


@query("J15_act_context", "select doc_id, case when contains(lower(text), 'rte') or contains(lower(text), 'right to education') then 'rte' when contains(lower(text), 'cce') then 'cce' when contains(lower(text), 'education act') then 'education' end as context from corpus")
def act_context(spark, d):
    t = F.lower("text")
    return corpus(spark, d).select("doc_id", F.when(t.contains("rte") | t.contains("right to education"), "rte").when(t.contains("cce"), "cce").when(t.contains("education act"), "education").alias("context"))


@query("J22_J24_entity_expansion", "with t as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from candidates) where r <= 5), e as (select query_id, vertical, section_type, count(*) as n from t where section_type is not null group by 1, 2, 3), f as (select distinct e.query_id, c.doc_id from e join candidates c on c.vertical = e.vertical and c.section_type = e.section_type and c.score >= 0.9 where not exists (select 1 from t where t.query_id = e.query_id and t.doc_id = c.doc_id)) select query_id, doc_id, cast(0.6 as double) as score from f")
def entity_expansion(spark, d):
    c = candidates(spark, d)
    top = answers.top(c, 5)
    named = top.where("section_type is not null").select("query_id", "vertical", "section_type").distinct()
    found = named.join(c.where("score >= 0.9").select("vertical", "section_type", "doc_id").distinct(), ["vertical", "section_type"]).select("query_id", "doc_id").distinct()
    return found.join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.6))


@query("J25_J27_reverse_edges", f"select c.doc_id, r.source_id as by_doc, r.relation_type, case r.relation_type when 'supersedes' then 0.3 else 1.0 end as factor from ({_all_relations}) r join corpus c on c.n = cast(regexp_extract(r.target, '(\\d+)', 1) as bigint) where r.relation_type in ('supersedes', 'amends') and starts_with(r.target, 'G.O.')")
def reverse_edges(spark, d):
    edges = _relations(spark, d).where("relation_type in ('supersedes', 'amends') and target like 'G.O.%'").select(F.col("source_id").alias("by_doc"), "relation_type", F.regexp_extract("target", r"(\d+)", 1).cast("long").alias("n"))
    out = corpus(spark, d).select("n", "doc_id").join(edges, "n")
    return out.select("doc_id", "by_doc", "relation_type", F.when(F.col("relation_type") == "supersedes", 0.3).otherwise(1.0).alias("factor"))


ORACLE["J25_J27_reverse_edges"] = ORACLE["J25_J27_reverse_edges"].replace("then 0.3 else 1.0 end as factor", "then cast(0.3 as double) else 1.0 end as factor")


# fixed values: addresses that are preferred
_PREFERRED = ["ap.gov.in", "gov.in", ".nic.in", ".in"]
_ADDRESS = "lower(coalesce(nullif(url, ''), nullif(source, ''), ''))"
_WORLD = " or ".join(f"contains(lower(query), '{w}')" for w in boosts.INTERNATIONAL_QUERY)


@query("J39_preferred_with_fallback", f"select query_id, chunk_id from (select *, max(cast(good as integer)) over (partition by query_id) as any_good from (select query_id, chunk_id, query, {' or '.join(f'contains({_ADDRESS}, {chr(39)}{x}{chr(39)})' for x in _PREFERRED)} as good from results)) where ({_WORLD}) or any_good = 0 or good")
def preferred(spark, d):
    world = boosts.holds(F.lower("query"), boosts.INTERNATIONAL_QUERY)
    return selection.prefer_domains(results(spark, d), _PREFERRED, world).select("query_id", "chunk_id")


# ---- aggregation and answers


@query("A1_batch_summary", "select count(*) as documents, count(*) filter (where length(text) >= 100) as succeeded, sum(length(text)) as chars, round(avg(length(text)), 6) as mean from documents")
def batch_summary(spark, d):
    n = F.length("text").cast("long")
    return load(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_if(n >= 100).alias("succeeded"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean"))


@query("A3_A5_grouped_by_vertical", "select query_id, vertical, array_to_string(list_sort(list(chunk_id)), ',') as chunks from candidates where score > 0.9 group by query_id, vertical")
def grouped(spark, d):
    return candidates(spark, d).where("score > 0.9").groupBy("query_id", "vertical").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")).cast("array<string>"), ",").alias("chunks"))


@query("A9_validation_buckets", "select count(*) filter (where score >= 0.8) as high, count(*) filter (where score >= 0.6 and score < 0.8) as medium, count(*) filter (where score < 0.6) as low, round(avg(score), 6) as mean from candidates")
def validation(spark, d):
    s = F.col("score")
    return candidates(spark, d).agg(F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.6) & (s < 0.8)).alias("medium"), F.count_if(s < 0.6).alias("low"), F.round(F.avg(s), 6).alias("mean"))


@query("A12_hierarchy", r"select true_vertical, count(distinct nullif(regexp_extract(text, '(?i)Section\s+(\d+)', 1), '')) as sections, count(distinct regexp_extract(text, '(\d+)', 1)) as orders from corpus group by true_vertical")
def hierarchy(spark, d):
    return corpus(spark, d).groupBy("true_vertical").agg(F.countDistinct(F.nullif(F.regexp_extract("text", r"(?i)Section\s+(\d+)", 1), F.lit(""))).alias("sections"), F.countDistinct(F.regexp_extract("text", r"(\d+)", 1)).alias("orders"))


@query("W5_display_names", r"select doc_id, coalesce(nullif(regexp_extract(text, 'The ([A-Z][A-Za-z ]+ Act, \d{4})', 1), ''), 'G.O. ' || nullif(regexp_extract(text, 'G\.O\.Ms\.No\. (\d+)', 1), ''), doc_id) as name from corpus")
def display(spark, d):
    some = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return corpus(spark, d).select("doc_id", F.coalesce(some(r"The ([A-Z][A-Za-z ]+ Act, \d{4})"), F.concat(F.lit("G.O. "), some(r"G\.O\.Ms\.No\. (\d+)")), F.col("doc_id")).alias("name"))


@query("W18_W20_context_and_bibliography", "select query_id, string_agg('[' || rank || '] ' || vertical || ' ' || chunk_id, chr(10) order by rank) as context from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from candidates) where rank <= 5 group by query_id")
def context(spark, d):
    top = answers.top(candidates(spark, d), 5).select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "vertical", F.lit(" "), F.col("chunk_id").cast("string")).alias("line"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("context"))


@query("W23_weak_retrieval", "select query_id, max(score) < 0.97 as weak from candidates group by query_id")
def weak(spark, d):
    return candidates(spark, d).groupBy("query_id").agg((F.max("score") < 0.97).alias("weak"))


@query("W22_W28_key_points", "select doc_id, split_part(text, '.', 1) as point, length(text) > 220 as cut from documents")
def points(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("point"), (F.length("text") > 220).alias("cut"))


@query("S37_distinct_before_embedding", "select count(distinct text) as texts from documents")
def distinct_texts(spark, d):
    return load(spark, d, "documents").select("text").distinct().agg(F.count("*").alias("texts"))


@query("T1_event_windows", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2")
def windows(spark, d):
    from tessera.streaming.ingest import event_windows

    return event_windows(load(spark, d, "events")).select("start", "event_type", "n")


@query("T2_sessions", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, count(distinct k) as sessions, count(*) as n from s group by user_id")
def session_counts(spark, d):
    from tessera.streaming.ingest import sessions

    return sessions(load(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
