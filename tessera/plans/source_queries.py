"""Queries for files in and out, stored indexes, caches, query entities, reranking by text, answers and set operations, with checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import boosts, matching, scoring
from tessera.operators import answers, fusion, models, vectors
from tessera.operators import stored_index as index
from tessera.plans.query_queries import _HTML
from tessera.plans.rank_queries import BM25_SQL, _POLICY, _case, user_turns
from tessera.sources import files, web
from tessera.sources.tables import load, oracle, results, structured

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


# ---- files, indexes, caches


@query("S13_accepted_uploads", "select page_id, length(html) <= 10485760 and page_id % 4 in (0, 1) as accepted from pages")
def uploads(spark, d):
    name = F.concat(F.lit("Report."), F.element_at(F.array(*map(F.lit, ["PDF", "docx", "exe", "tar.gz"])), (F.col("page_id") % 4 + 1).cast("int")))
    return load(spark, d, "pages").select("page_id", files.accepted(name, F.length("html")).alias("accepted"))


@query("S15_S17_S20_json_lines", "select doc_id, vertical, sha256(text) as text_sha256 from structured union all select doc_id + 1000000000, vertical, sha256(text) from structured where doc_id % 10 = 0")
def json_lines(spark, d):
    """Written by vertical, appended to, read again."""
    path = files.work_path(spark, "lines")
    docs = structured(spark, d)
    files.write_jsonl(docs, path, by=["vertical"])
    files.write_jsonl(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000), path, append=True, by=["vertical"])
    return spark.read.schema("doc_id long, text string, vertical string").json(path).select("doc_id", "vertical", F.sha2("text", 256).alias("text_sha256"))


@query("S19_text_files", "select sha256(text) as text_sha256, count(*) as n from documents group by text")
def text_files(spark, d):
    path = files.work_path(spark, "texts")
    files.write_texts(load(spark, d, "documents"), path)
    return files.read_texts(spark, path).groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("n"))


@query("S22_chunk_folders", "select case vertical when 'scheme' then 'schemes' else vertical end as vertical, count(*) as chunks from structured group by 1")
def chunk_folders(spark, d):
    path = files.work_path(spark, "chunks")
    files.write_jsonl(structured(spark, d).select("doc_id", "vertical"), path, by=["vertical"])
    return files.chunk_folders(spark, path)


_CHANGED = "(select doc_id, case when n_chars % 5 = 0 then text || ' zusatz addendum' else text end as text from documents where n_chars % 5 = 0 or n_chars % 7 <> 0)"


@query("S30_S31_stored_index", BM25_SQL.format(docs=_CHANGED))
def stored_index_after_changes(spark, d):
    """An index of two segments, deletions, updated documents and merged buckets gives what an index of the final documents gives."""
    path, docs = files.work_path(spark, "index"), load(spark, d, "documents")
    index.add(docs.where("lang = 'en'"), path)
    index.add(docs.where("lang is null or lang <> 'en'"), path)
    index.delete(docs.where("n_chars % 7 = 0").select(F.col("doc_id").alias("key")), path)
    index.merge(spark, path, 3)
    index.update(docs.where("n_chars % 5 = 0").withColumn("text", F.concat("text", F.lit(" zusatz addendum"))), path)
    index.merge(spark, path, 5)
    return index.search(spark, path, user_turns(spark, d))


@query("S33_cache", "with e as (select doc_id % 7000 as key, lang as value, doc_id as stored_at from documents where doc_id % 3 = 0 union all select doc_id % 7000, lang || '2', doc_id + 100 from documents where doc_id % 2 = 0), n as (select key, max_by(value, stored_at) as value, max(stored_at) as stored_at from e group by key) select value, count(*) as entries, min(stored_at) as oldest from n where 1000 - stored_at <= 960 group by value")
def cache(spark, d):
    """Newer answers replace older ones, entries past their age go, statistics of what is left."""
    docs = load(spark, d, "documents")
    entry = lambda rows, value, at: rows.select((F.col("doc_id") % 7000).alias("key"), value.alias("value"), at.alias("stored_at"))
    kept = files.cache_put(entry(docs.where("doc_id % 3 = 0"), F.col("lang"), F.col("doc_id")), entry(docs.where("doc_id % 2 = 0"), F.concat("lang", F.lit("2")), F.col("doc_id") + 100))
    return files.cache_clean(kept, F.lit(1000), 960).groupBy("value").agg(F.count("*").alias("entries"), F.min("stored_at").alias("oldest"))


_TEXT = f"substr(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')), 1, 3000)"


@query("S44_content_fallback", f"select page_id, case when length({_TEXT}) > length(repeat(url, cast(page_id % 40 as integer))) then {_TEXT} else repeat(url, cast(page_id % 40 as integer)) end as text from pages")
def fallback(spark, d):
    snippet = F.repeat(F.col("url"), (F.col("page_id") % 40).cast("int"))
    return load(spark, d, "pages").select("page_id", files.content_or_snippet(web.html_to_text(F.col("html")), snippet).alias("text"))


@query("M9_M10_sidecars", "select chunk_id, vertical, coalesce(section_type, case when chunk_id % 3 = 0 then 'side' end) as section_type, case when chunk_id % 3 = 0 then cast(chunk_id % 7 as varchar) end as pages from candidates")
def sidecars(spark, d):
    """Sidecar files are written and read again, and give chunks the keys that they lack."""
    from tessera.sources.tables import candidates

    c = candidates(spark, d)
    path = files.work_path(spark, "sidecars")
    c.where("chunk_id % 3 = 0").select("chunk_id", F.create_map(F.lit("vertical"), F.lit("wrong"), F.lit("section_type"), F.lit("side"), F.lit("pages"), (F.col("chunk_id") % 7).cast("string")).alias("side")).write.json(path)
    side = spark.read.schema("chunk_id long, side map<string,string>").json(path)
    own = F.map_filter(F.create_map(F.lit("vertical"), F.col("vertical"), F.lit("section_type"), F.col("section_type")), lambda _, v: v.isNotNull())
    both = c.select("chunk_id", own.alias("own")).join(side, "chunk_id", "left").withColumn("m", files.with_sidecar(F.col("own"), F.col("side")))
    return both.select("chunk_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("vertical", "section_type", "pages")])


@query("V2_V3_embedded_chunks", "select doc_id, regexp_matches(text, '\\S') as embedded, 64 as dims from documents where regexp_matches(text, '\\S')")
def embedded(spark, d):
    """Chunks with text, cut to 20000 characters, whose vectors are finite and of a sound length."""
    docs = load(spark, d, "documents").where(F.col("text").rlike(r"\S"))
    e = docs.select("doc_id", models.embed(F.col("text"), [models.WordHashing("words", 64)], 64)["value"].alias("e"))
    return e.where(vectors.good_quality(F.col("e"))).select("doc_id", F.lit(True).alias("embedded"), F.size("e").alias("dims"))


# ---- query entities

_Q = "select distinct query_id, query from results"


def _kind_sql(kind: str) -> str:
    parts = [f"regexp_extract_all(lower(query), '{matching.FORMAL[kind]}', 1)"] if kind in matching.FORMAL else []
    parts += [f"case when regexp_matches(lower(query), '{p}') then [regexp_extract(lower(query), '{p}', 0)] else [] end" for p in matching.INFORMAL.get(kind, [])]
    if kind == "keywords":
        parts.append(f"list_filter(regexp_extract_all(lower(query), '\\b([a-z]+)\\b', 1), lambda w: w in ({', '.join(map(repr, matching.WORDS))}))")
    if kind == "schemes":
        parts.append(f"list_filter([{', '.join(map(repr, matching.SCHEMES))}], lambda s: contains(lower(query), s))")
    return f"array_to_string(list_sort(list_distinct(flatten([{', '.join(parts)}]))), ',') as {kind}"


@query("E19_matching_entities", f"select query_id, {', '.join(_kind_sql(k) for k in {**matching.FORMAL, **matching.INFORMAL})} from ({_Q})")
def matching_entities(spark, d):
    q = results(spark, d).select("query_id", "query").distinct()
    return q.select("query_id", *[F.array_join(c, ",").alias(k) for k, c in matching.query_entities(F.col("query")).items()])


@query("E18_outside_entities", r"select n, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)G\.?O\.?\s*(?:Ms\.?|Rt\.?|P\.?)?[\s\.]?(?:No\.?|Number)?\s*\d+', 0), list_filter(regexp_extract_all(text, '(?:The\s+)?([A-Z][a-zA-Z\s]+Act(?:,?\s+\d{4})?)', 1), lambda a: length(a) between 11 and 49)))), ';') as found from corpus")
def outside(spark, d):
    from tessera.sources.tables import corpus

    return corpus(spark, d).select("n", F.array_join(matching.outside_entities(F.col("text")), ";").alias("found"))


_STRICT_TEXT = "concat('Per G.O.Ms.No. ', chunk_id, ' and G.O.Rt.No.7 the ', case chunk_id % 3 when 0 then 'Finance Department' when 1 then 'school education department' else 'office' end, ' and the RTE Act: ', content, ' recruitment to a post')"


@query("E14_E20_strict_entities", f"with t as (select chunk_id, {_STRICT_TEXT} as t from results) select chunk_id, 'G.O.Ms.No.' || chunk_id || ',G.O.Rt.No.7' as go_numbers, " + ", ".join(f"array_to_string(regexp_extract_all(t, '{p}', 1), ',') as {k}" for k, p in matching.STRICT.items()) + " from t")
def strict(spark, d):
    found = matching.strict_entities(F.expr(_STRICT_TEXT))
    return results(spark, d).select("chunk_id", *[F.array_join(c, ",").alias(k) for k, c in found.items()])


@query("J8_mapped_fields", "select distinct vertical, field, case field when 'sections' then case vertical when 'legal' then 'section,sections,mentioned_sections' when 'go' then 'mentioned_sections' when 'judicial' then 'mentioned_sections' else '' end when 'go_number' then case vertical when 'go' then 'go_number' when 'legal' then 'mentioned_gos' when 'judicial' then 'mentioned_gos' else '' end when 'department' then case vertical when 'go' then 'department,departments' when 'data' then 'departments' when 'schemes' then 'departments' else '' end when 'case_number' then case vertical when 'judicial' then 'case_number' else '' end else field end as fields from results cross join (values ('sections'), ('go_number'), ('year'), ('department'), ('case_number'), ('colour')) f(field)")
def mapped(spark, d):
    names = ["sections", "go_number", "year", "department", "case_number", "colour"]
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.array_join(matching.mapped_fields(n, F.col("vertical")), ",").alias("fields")) for n in names])
    return results(spark, d).select("vertical").distinct().select("vertical", F.explode(each).alias("e")).select("vertical", "e.*")


# ---- reranking by text and payload

_W = "list_distinct(regexp_extract_all(lower({}), '(\\w+)', 1))"
_JACCARD = f"(len(list_intersect({_W.format('query')}, {_W.format('content')})) / len(list_distinct(list_concat({_W.format('query')}, {_W.format('content')}))))"
_META = "((case when vertical in ('go', 'legal') then 1 else 0 end + case when year in (2020, 2021) then 1 else 0 end) / 2.0)"
_FILTERS = {"vertical": ["go", "legal"], "year": ["2020", "2021"]}


def _parts():
    return scoring.term_overlap(F.col("query"), F.col("content")), boosts.filter_matches({k: F.col(k) for k in _FILTERS}, _FILTERS)


@query("F17_light_rerank", f"select query_id, chunk_id, cast(rank as integer) as rank, rerank_score from (select *, row_number() over (partition by query_id order by rerank_score desc, chunk_id) as rank from (select query_id, chunk_id, round(cast(0.7 * score + 0.2 * {_JACCARD} + 0.1 * {_META} as double), 9) as rerank_score from results)) where rank <= 5")
def light(spark, d):
    overlap, metadata = _parts()
    return fusion.light_rerank(results(spark, d), overlap, metadata, 5).select("query_id", "chunk_id", "rank", "rerank_score")


def _policy_sql() -> str:
    """The plan of the ranked candidates' query, over texts and payloads."""
    authority = "case when vertical = 'legal' and act_name ilike '%constitution%' then 1.0 when vertical = 'legal' and act_name ilike '%act%' then 0.95 when vertical = 'judicial' and court_name ilike '%supreme%' then 1.0 when vertical = 'judicial' and court_name ilike '%high%' then 0.95 else " + _case("vertical", scoring.VERTICAL_AUTHORITY, 0.5) + " end"
    return _POLICY.replace(_case("vertical", scoring.VERTICAL_AUTHORITY, 0.5), authority).replace("candidates", "results").replace("0.15 * bm25", f"0.15 * {_JACCARD}").replace("0.1 * 0.5", f"0.1 * {_META}").replace("2024 - year", "2024 - coalesce(year, 2000)")


@query("F18_F19_policy_rerank", _policy_sql())
def policy(spark, d):
    overlap, metadata = _parts()
    r = results(spark, d).withColumn("_m", metadata).withColumn("year", F.coalesce("year", F.lit(2000)))
    return fusion.policy_rerank(r, overlap, F.col("_m"), 4, act_name=F.col("act_name"), court=F.col("court_name")).select("query_id", "chunk_id", "rank")


# ---- answers


@query("A16_policy_reasoning", "with r as (select *, row_number() over (partition by query_id, vertical order by score desc, chunk_id) as place from results) select query_id, bucket, cast(place as integer) as place, chunk_id from r join (values ('constitutional_foundation', 'legal', 3), ('statutory_framework', 'legal', 3), ('administrative_orders', 'go', 3), ('judicial_precedents', 'judicial', 2), ('data_evidence', 'data', 2), ('implementation_schemes', 'schemes', 2)) b(bucket, v, most) on b.v = r.vertical and place <= most")
def reasoning(spark, d):
    return answers.reasoning(results(spark, d))


@query("W13_W17_citations", "with q as (select query_id, list_sort(list(chunk_id)) as known from results group by query_id), c as (select query_id, known, case query_id % 3 when 0 then [] when 1 then [known[1], -5, known[2]] else [known[1]] end as cited from q), i as (select query_id, case when len(cited) = 0 then ['No citations'] else list_transform(list_filter(cited, lambda c: not list_contains(known, c)), lambda c: 'Citation ' || c || ' not in source results') end as issues from c) select query_id, array_to_string(issues, ';') as issues, array_to_string(list_transform(issues, lambda x: 'Add proper citations to sources'), ';') as suggestions from i")
def cited(spark, d):
    g = results(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("known"))
    first, second = (F.get("known", F.lit(i)) for i in (0, 1))
    mine = F.when(F.col("query_id") % 3 == 0, F.array().cast("array<long>")).when(F.col("query_id") % 3 == 1, F.array(first, F.lit(-5).cast("long"), second)).otherwise(F.array(first))
    issues = answers.citation_issues(mine, F.col("known"))
    return g.select("query_id", F.array_join(issues, ";").alias("issues"), F.array_join(answers.suggestions(issues), ";").alias("suggestions"))


_ANSWER = "case chunk_id % 3 when 0 then concat('1. **Direct Answer:** ', content, chr(10), '2. More on ', chunk_id, chr(10), 'end') when 1 then concat('  ', content, chr(10), 'second line', chr(10), chr(10), 'Body ', chunk_id, chr(10), chr(10), 'last') else content end"


@query("W8_parsed_answers", "select chunk_id, case chunk_id % 3 when 0 then trim(content) when 1 then content || ' second line' else content end as summary, case chunk_id % 3 when 0 then 'detailed_analysis' when 1 then 'main_content' end as kind, case chunk_id % 3 when 0 then '2. More on ' || chunk_id || chr(10) || 'end' when 1 then 'Body ' || chunk_id || chr(10) || 'last' else '' end as body from results")
def parsed(spark, d):
    return results(spark, d).select("chunk_id", answers.parsed(F.expr(_ANSWER.replace("chr(10)", "'\\n'"))).alias("p")).select("chunk_id", "p.*")


@query("W9_fenced_json", "select chunk_id, case when chunk_id % 4 = 3 then 'nothing here' else '{\"n\": {\"id\": ' || chunk_id || '}}' end as json from results")
def fenced(spark, d):
    body = F.concat(F.lit('{"n": {"id": '), F.col("chunk_id").cast("string"), F.lit("}}"))
    k = F.col("chunk_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye {"))).when(k == 1, F.concat(F.lit("so "), body, F.lit(" ok"))).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise("nothing here")
    return results(spark, d).select("chunk_id", answers.fenced_json(raw).alias("json"))


# ---- set operations and windows


@query("U1_U3_set_operations", "select 'both' as kind, count(*) as n from (select l_orderkey from lineitem where l_quantity > 30 intersect select o_orderkey from orders where o_totalprice > 100000) union all select 'only', count(*) from (select o_orderkey from orders except select l_orderkey from lineitem where l_quantity > 30) union all select 'all', count(*) from (select l_orderkey from lineitem where l_quantity > 30 except all select o_orderkey from orders)")
def set_operations(spark, d):
    large = load(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"))
    orders = load(spark, d, "orders")
    keys, dear = orders.select(F.col("o_orderkey").alias("k")), orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(large.intersect(dear), "both").unionByName(n(keys.subtract(large), "only")).unionByName(n(large.exceptAll(keys), "all"))


@query("T3_sliding_windows", "select s as start, event_type, count(*) as n from (select event_type, unnest([date_trunc('hour', ts) - to_hours(cast(date_part('hour', ts) % 6 as integer)), date_trunc('hour', ts) - to_hours(cast(date_part('hour', ts) % 6 as integer)) - interval 6 hours]) as s from events) group by all")
def sliding(spark, d):
    g = load(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")
