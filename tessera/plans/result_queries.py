"""Queries for boosts, states, hints, relations, entities and verification of search results, with checking SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import boosts, scoring
from tessera.operators import fusion
from tessera.sources.tables import load, oracle, results

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The year and second that ages are counted from.
YEAR, NOW = 2025, 1_700_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def any_of(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({text}, '')), '{w}')" for w in words) + ")"


def boosted(name: str, vertical: str, make, sql: str) -> None:
    """Results of one vertical: their boost, and the score with it."""

    def run(spark, d):
        r = results(spark, d).where(F.col("vertical") == vertical).withColumn("boost", make())
        return r.select("chunk_id", F.round("boost", 9).alias("boost"), F.round(F.col("score") * F.col("boost"), 9).alias("boosted"))

    QUERIES[name] = run
    ORACLE[name] = oracle(f"select chunk_id, round(b, 9) as boost, round(score * b, 9) as boosted from (select chunk_id, score, cast({sql} as double) as b from results where vertical = '{vertical}')")


boosted(
    "B30_go_boost", "go", lambda: boosts.go_boost(F.col("year"), F.col("department"), F.col("go_number"), YEAR),
    "case when year >= 2022 then 1.2 when year >= 2020 then 1.1 else 1.0 end * case when department in ('School Education', 'Teacher Training') then 1.15 else 1.0 end * case when go_number is not null then 1.1 else 1.0 end",
)
boosted(
    "B29_legal_boost", "legal", lambda: boosts.legal_boost(F.col("act_name"), F.col("section_number")),
    "case act_name when 'Constitution of India' then 1.3 when 'Right to Education Act' then 1.2 when 'RTE Rules' then 1.2 else 1.0 end * case when section_number <> '' then 1.1 else 1.0 end",
)
boosted(
    "B31_judicial_boost", "judicial", lambda: boosts.judicial_boost(F.col("court_name"), F.col("citation_count"), F.col("content")),
    "case court_name when 'Supreme Court of India' then 1.0 when 'High Court of the State' then 0.9 when 'District Court' then 0.7 when 'Service Tribunal' then 0.6 else 1.0 end * case when citation_count > 10 then 1.2 when citation_count > 5 then 1.1 else 1.0 end * case when content ilike '%landmark%' or content ilike '%precedent%' or content ilike '%overruled%' or content ilike '%binding%' then 1.15 else 1.0 end",
)
_METRICS = "(" + " or ".join(f"regexp_matches(coalesce(content, ''), '{p}', 'i')" for p in boosts.METRICS) + ")"
boosted(
    "B32_data_boost", "data", lambda: boosts.data_boost(F.col("source"), F.col("content"), F.col("year")),
    f"case when source in ('UDISE', 'ASER survey', 'Annual Report 2020') then 1.2 else 1.0 end * case when {_METRICS} then 1.15 else 1.0 end * case when year >= 2020 then 1.2 when year >= 2018 then 1.1 else 1.0 end",
)
_WORLD = f"({any_of('content', boosts.INTERNATIONAL)} or {any_of('source', boosts.INTERNATIONAL)})"
boosted(
    "B33_schemes_boost", "schemes", lambda: boosts.schemes_boost(F.col("content"), F.col("source"), F.col("status")),
    f"case when {_WORLD} then 1.25 else 1.0 end * case when status in ('Active', 'ongoing pilot') then 1.15 else 1.0 end * case when content ilike '%success%' or content ilike '%effective%' or content ilike '%impact%' or content ilike '%outcome%' then 1.1 else 1.0 end",
)


@query("K30_contains_metrics", f"select chunk_id, {_METRICS} as metrics from results")
def metrics(spark, d):
    return results(spark, d).select("chunk_id", boosts.contains_metrics(F.col("content")).alias("metrics"))


@query("K31_go_status", "select chunk_id, case when year is null then 'unknown' when year >= 2023 then 'likely_active' when year >= 2020 then 'possibly_active' else 'historical' end as status from results where vertical = 'go'")
def go_status(spark, d):
    return results(spark, d).where("vertical = 'go'").select("chunk_id", boosts.go_status(F.col("year"), YEAR).alias("status"))


@query("K32_precedent_value", "select chunk_id, case court_name when 'Supreme Court of India' then 'binding' when 'High Court of the State' then 'persuasive' else 'informative' end as precedent from results where vertical = 'judicial'")
def precedent(spark, d):
    return results(spark, d).where("vertical = 'judicial'").select("chunk_id", boosts.precedent_value(F.col("court_name")).alias("precedent"))


@query("K33_scheme_type", f"select chunk_id, case when {_WORLD} then 'international' when regexp_matches(lower(content), 'pilot|experimental|trial') then 'pilot' when regexp_matches(lower(content), 'central|national|india') then 'central' when regexp_matches(lower(content), 'state|ap') then 'state' else 'unknown' end as kind from results where vertical = 'schemes'")
def scheme_kind(spark, d):
    return results(spark, d).where("vertical = 'schemes'").select("chunk_id", boosts.scheme_type(F.col("content"), F.col("source")).alias("kind"))


@query("M14_action_hints", "select chunk_id, place, hint from (select chunk_id, vertical from results) join (values ('legal', 1, 'Check related sections'), ('legal', 2, 'Review amendments'), ('legal', 3, 'See judicial interpretations'), ('go', 1, 'Check implementation status'), ('go', 2, 'Review related GOs'), ('go', 3, 'See department circulars'), ('judicial', 1, 'Read full judgment'), ('judicial', 2, 'Check if appealed'), ('judicial', 3, 'See cited precedents'), ('data', 1, 'Download full report'), ('data', 2, 'Compare year-over-year'), ('data', 3, 'Check district-wise data'), ('schemes', 1, 'Check eligibility criteria'), ('schemes', 2, 'Review implementation guidelines'), ('schemes', 3, 'See similar schemes')) h(vertical, place, hint) using (vertical)")
def action_hints(spark, d):
    r = results(spark, d).select("chunk_id", F.posexplode(boosts.hints(F.col("vertical"))).alias("place", "hint"))
    return r.withColumn("place", F.col("place") + 1)


@query("M13_related_hints", "select chunk_id, concat_ws('; ', 'same_document:' || chunk_id, case when section_number <> '' then 'nearby_sections:' || section_number || ':Check adjacent sections for context' end, case when go_number <> '' then 'same_series:' || go_number || ':Check related GOs from same department' end) as hints from results")
def related(spark, d):
    return results(spark, d).select("chunk_id", F.array_join(boosts.related_hints(F.col("chunk_id").cast("string"), F.col("section_number"), F.col("go_number")), "; ").alias("hints"))


@query("B25_metadata_relevance", "select chunk_id, ((case when vertical in ('go', 'legal') then 1 else 0 end) + (case when year in (2020, 2021) then 1 else 0 end) + (case when department = 'Finance' then 1 else 0 end)) / 3.0::double as relevance from results")
def metadata_relevance(spark, d):
    wanted = {"vertical": ["go", "legal"], "year": ["2020", "2021"], "department": ["Finance"]}
    return results(spark, d).select("chunk_id", boosts.filter_matches({k: F.col(k) for k in wanted}, wanted).alias("relevance"))


@query("B27_payload_year", "select chunk_id, cast(coalesce(year, cast(nullif(regexp_extract(title, '\\b(19\\d{2}|20\\d{2})\\b', 1), '') as integer), 2000) as integer) as year from results")
def payload_year(spark, d):
    return results(spark, d).select("chunk_id", boosts.payload_year(F.col("year"), F.col("title")).alias("year"))


# ---- relations and entities


@query("B11_domain_relevance", "select chunk_id, len(list_filter(string_split(query, ' '), lambda w: w <> '')) <= 2 or contains(lower(query), vertical) or len(list_intersect(list_distinct(string_split(lower(query), ' ')), list_distinct(string_split(lower(substr(content, 1, 200)), ' ')))) >= 2 as relevant from results")
def relevance(spark, d):
    return results(spark, d).select("chunk_id", boosts.domain_relevant(F.col("query"), F.col("vertical"), F.col("content")).alias("relevant"))


_TYPES = "string_split(relation_list, ',')"
_SUPERSEDED = f"(list_contains({_TYPES}, 'superseded_by') or {any_of('content', boosts.SUPERSEDED_WORDS)})"


@query("B12_B14_superseded_flags", f"select chunk_id, {_SUPERSEDED} as superseded, list_contains({_TYPES}, 'supersedes') or {any_of('content', boosts.SUPERSEDING_WORDS)} as supersedes, list_contains({_TYPES}, 'cites') and {any_of('target', boosts.IMPORTANT)} as cites_important from results")
def flags(spark, d):
    types = F.split("relation_list", ",")
    edges = F.transform(types, lambda t: F.struct(t.alias("relation_type"), F.col("target").alias("target")))
    r = results(spark, d)
    return r.select("chunk_id", boosts.is_superseded(types, F.col("content")).alias("superseded"), boosts.supersedes_others(types, F.col("content")).alias("supersedes"), boosts.cites_important(edges).alias("cites_important"))


@query("B15_final_relation_rerank", "with r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r0 from results), s as (select query_id, chunk_id, round(score * case when r0 <= 5 and not is_superseded then 1.05 else 1.0 end * case when r0 <= 3 and is_neighbour then 0.95 else 1.0 end, 9) as score from r) select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from s")
def final_rerank(spark, d):
    r = fusion.ranked(results(spark, d), "score", "r0")
    factor = boosts.final_factor(F.col("r0"), ~F.col("is_superseded"), F.col("is_neighbour"))
    return fusion.ranked(r.select("query_id", "chunk_id", F.round(F.col("score") * factor, 9).alias("score")), "score")


def _entities(text):
    """Entities of a query and, where null stands for an absent type, of a result."""
    found = {"sections": r"(section \d+)", "acts": r"((?:rte|education) act)", "schemes": r"(amma vodi(?: scholarship)?)", "departments": r"(school|teacher|commissioner)"}
    return {k: F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for k, p in found.items()}


def _overlap():
    mine = {k: F.when(F.size(v) > 0, v) for k, v in _entities(F.col("content")).items()}
    return boosts.entity_overlap(_entities(F.col("query")), mine)


_KINDS = {"sections": (r"(section \d+)", 1.4), "acts": ("((?:rte|education) act)", 1.2), "schemes": ("(amma vodi(?: scholarship)?)", 1.1), "departments": ("(school|teacher|commissioner)", 1.0)}
_EACH = " union all ".join(f"select chunk_id, {w} as w, list_distinct(regexp_extract_all(lower(query), '{p}', 1)) as q, list_distinct(regexp_extract_all(lower(content), '{p}', 1)) as r from results" for p, w in _KINDS.values())
_SHARE = "(len(list_intersect(q, r)) + 0.5 * len(list_filter(q, lambda x: not list_contains(r, x) and len(list_filter(r, lambda y: contains(x, y) or contains(y, x))) > 0))) / len(list_distinct(list_concat(q, r)))"
_OVERLAP = f"select chunk_id, coalesce(sum(case when len(q) > 0 and len(r) > 0 then {_SHARE} * w when len(q) > 0 then 0 end) / sum(case when len(q) > 0 and len(r) > 0 then w when len(q) > 0 then 1.0 end), 0) as overlap, sum(len(r)) as entities from ({_EACH}) group by chunk_id"


@query("B16_entity_overlap", f"select chunk_id, round(cast(overlap as double), 9) as overlap from ({_OVERLAP})")
def entity_overlap(spark, d):
    return results(spark, d).select("chunk_id", F.round(_overlap(), 9).alias("overlap"))


_TIME = "(case when date_issued_ts is null then 0.0 else least(greatest(1.0 / (1.0 + log10(greatest(1.0, (1700000000 - date_issued_ts) / 86400.0))) - case when is_superseded then 0.9 else 0.0 end - case when effective_to_ts < 1700000000 then 0.7 else 0.0 end, -1.0), 1.0) end)"
_FACTOR = f"select r.query_id, r.chunk_id, r.score, (1 + 0.3 * overlap) * case when entities >= 5 then 1.1 when entities >= 3 then 1.05 else 1.0 end * case when not regexp_matches(query, 'latest|recent|new|current') then 1.0 when {_TIME} > 0.5 then 1 + 0.5 * {_TIME} when {_TIME} < -0.5 then 0.3 else 1.0 end as factor from results r join ({_OVERLAP}) o using (chunk_id)"


def _entity_boosted(r):
    n = sum((F.size(F.array_distinct(v)) for v in _entities(F.col("content")).values()), F.lit(0))
    when = scoring.time_score(F.col("date_issued_ts"), F.col("is_superseded"), F.col("effective_to_ts"), NOW)
    return boosts.entity_boost(F.col("score"), _overlap(), n, F.col("query").rlike("latest|recent|new|current"), when)


@query("B17_entity_boost", f"select chunk_id, round(cast(score * factor as double), 9) as score from ({_FACTOR})")
def entity_boost(spark, d):
    r = results(spark, d)
    return r.select("chunk_id", F.round(_entity_boosted(r), 9).alias("score"))


@query(
    "F28_F29_phases",
    f"""with p as (select query_id, chunk_id, score, {_TYPES} as t, is_neighbour, {_SUPERSEDED} as old, len(list_filter(string_split(query, ' '), lambda w: w <> '')) <= 2 or contains(lower(query), vertical) or len(list_intersect(list_distinct(string_split(lower(query), ' ')), list_distinct(string_split(lower(substr(content, 1, 200)), ' ')))) >= 2 as rel from results),
    a as (select query_id, chunk_id, old, is_neighbour, score * case when old then 0.4 else 1.0 end * case when list_contains(t, 'supersedes') then 1.15 else 1.0 end * least(case when list_contains(t, 'amends') then 1.08 else 1.0 end * case when list_contains(t, 'implements') then 1.05 else 1.0 end * case when list_contains(t, 'cites') then 1.05 else 1.0 end * case when list_contains(t, 'governed_by') then 1.05 else 1.0 end, case when rel then 1.25 else 1.03 end) as s from p),
    b as (select a.*, s * x.factor as s2 from a join ({_FACTOR}) x using (chunk_id)),
    f as (select *, row_number() over (partition by query_id order by round(s2, 9) desc, chunk_id) as r0 from b),
    g as (select query_id, chunk_id, round(cast(s2 * case when r0 <= 5 and not old then 1.05 else 1.0 end * case when r0 <= 3 and is_neighbour then 0.95 else 1.0 end as double), 9) as score from f)
    select query_id, chunk_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from g) where rank <= 20""",
)
def phases(spark, d):
    """Relations, then entities, then the order's last adjustments, the best 20 of each query."""
    types = F.split("relation_list", ",")
    r = results(spark, d).withColumn("old", boosts.is_superseded(types, F.col("content")))
    r = r.withColumn("score", scoring.relation_score(F.col("score"), types, F.col("old"), boosts.domain_relevant(F.col("query"), F.col("vertical"), F.col("content"))))
    r = fusion.ranked(r.withColumn("score", _entity_boosted(r)).withColumn("key", F.round("score", 9)), "key", "r0")
    factor = boosts.final_factor(F.col("r0"), ~F.col("old"), F.col("is_neighbour"))
    last = fusion.ranked(r.select("query_id", "chunk_id", F.round(F.col("score") * factor, 9).alias("score")), "score")
    return last.where("rank <= 20").select("query_id", "chunk_id", "score", "rank")


# ---- words of categories

_WORDS = ", ".join(f"('{c}', {f}, '{boosts.boost_pattern(c, w)}')" for c, (f, words) in boosts.BOOST_WORDS.items() for w in words)
_TERMS = f"select query_id, query, category, factor, unnest(regexp_extract_all(lower(query), pattern, 0)) as term from (select distinct query_id, query from results) cross join (values {_WORDS}) w(category, factor, pattern)"


def _asked(spark, d):
    """Each query once, with its categories' terms."""
    return results(spark, d).select("query_id", "query").distinct().withColumn("terms", boosts.boost_terms(F.col("query")))


@query("B20_boost_terms", f"select query_id, category, array_to_string(list_sort(list(term)), ',') as terms from ({_TERMS}) group by query_id, category")
def boost_terms(spark, d):
    return _asked(spark, d).select("query_id", F.explode("terms").alias("category", "t")).select("query_id", "category", F.array_join(F.array_sort("t"), ",").alias("terms"))


@query("K29_should_boost", f"select distinct query_id, {any_of('query', boosts.TRIGGERS)} as boosts from results")
def should_boost(spark, d):
    return results(spark, d).select("query_id", "query").distinct().select("query_id", boosts.should_boost(F.col("query")).alias("boosts"))


@query(
    "B18_B19_category_boost",
    f"""with t as ({_TERMS}), c as (select r.chunk_id, r.score, t.factor, t.term, regexp_extract_all(lower(r.content), '(\\w+)', 1) as w from results r join t using (query_id)),
    s as (select chunk_id, any_value(score) as score, sum(case when tf > 0 then ln(999.5 / 1.5 + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 100.0)) * factor * 0.1 else 0 end) as gain from (select *, len(w) as n, len(list_filter(w, lambda x: x = term)) as tf from c) group by chunk_id)
    select r.chunk_id, round(cast(case when r.score >= 0.5 and coalesce(s.gain, 0) > 0 and {any_of('r.query', boosts.TRIGGERS)} then least(r.score + s.gain, 1.0) else r.score end as double), 9) as score from results r left join s using (chunk_id)""",
)
def category_boost(spark, d):
    asked = _asked(spark, d).withColumn("terms", F.when(boosts.should_boost(F.col("query")), F.col("terms"))).select("query_id", "terms")
    r = results(spark, d).join(asked, "query_id", "left").withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,array<string>>")))
    return r.select("chunk_id", F.round(boosts.category_boost(F.col("score"), F.col("terms"), F.col("content")), 9).alias("score"))


# ---- hybrid and web results


@query("B5_term_hybrid", "select chunk_id, round(0.7 * score + 0.3 * len(list_filter(string_split(query, ' '), lambda t: list_contains(string_split(lower(content), ' '), t))) / len(string_split(query, ' ')), 9) as score from results")
def term_hybrid(spark, d):
    return results(spark, d).select("chunk_id", F.round(boosts.term_hybrid(F.col("score"), F.split(F.lower("query"), r"\s+"), F.col("content")), 9).alias("score"))


@query(
    "B6_full_hybrid",
    """with w as (select query_id, chunk_id, query, score, string_split(lower(content), ' ') as w from results), st as (select count(*) as n, avg(len(w)) as avgdl from w),
    df as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from w) group by term),
    q as (select distinct query_id, unnest(string_split(query, ' ')) as term from results),
    h as (select w.chunk_id, sum(ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w.w) / st.avgdl))) as s from (select w.*, q.term, len(list_filter(w.w, lambda x: x = q.term)) as tf from w join q using (query_id)) w join df using (term) cross join st where tf > 0 group by w.chunk_id)
    select w.chunk_id, round(0.7 * w.score + 0.3 * least(coalesce(h.s, 0) / 10.0, 1.0), 9) as score from w left join h using (chunk_id)""",
)
def full_hybrid(spark, d):
    """Hybrid with document frequencies and the mean length of all contents."""
    from tessera.operators import lexical

    r = results(spark, d).withColumn("w", F.split(F.lower("content"), r"\s+"))
    stats = r.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    terms = r.select("query_id", F.explode(F.array_distinct(F.split("query", r"\s+"))).alias("term")).distinct()
    df = r.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(terms.select("term").distinct(), "term", "left_semi")
    asked = terms.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "df")).alias("asked"))
    both = r.join(asked, "query_id", "left").crossJoin(F.broadcast(stats))  # stats is one row
    tf = lambda t: F.size(F.filter(F.col("w"), lambda x: x == t))
    part = lambda e: lexical.idf(e["df"], F.col("n")) * tf(e["term"]) * 2.5 / (tf(e["term"]) + 1.5 * (0.25 + 0.75 * F.size("w") / F.col("avgdl")))
    bm25 = F.aggregate(F.coalesce("asked", F.array().cast("array<struct<term:string,df:bigint>>")), F.lit(0.0), lambda s, e: s + part(e))
    return both.select("chunk_id", F.round(0.7 * F.col("score") + 0.3 * F.least(bm25 / 10.0, F.lit(1.0)), 9).alias("score"))


_AUTHORITY = f"case when {any_of('url', boosts.GOVERNMENT)} or {any_of('source', boosts.GOVERNMENT)} then 1.5 when {any_of('url', boosts.EDUCATION)} or {any_of('source', boosts.EDUCATION)} then 1.3 when {any_of('url', boosts.WORLD)} or {any_of('source', boosts.WORLD)} then 1.2 else 1.0 end"
_YEARS = "list_max(list_transform(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(snippet, ''), '\\b(20\\d{2})\\b', 1), lambda y: cast(y as integer)))"


@query("B34_B36_web_rerank", f"with r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r0 from results), s as (select query_id, chunk_id, {_AUTHORITY} as a, case {_YEARS} when 2025 then 1.2 when 2024 then 1.1 else 1.0 end as f, r0 from r), t as (select query_id, chunk_id, round(cast(1.0 / r0 * a * f as double), 9) as score from s) select query_id, chunk_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from t) where rank <= 20")
def web_rerank(spark, d):
    r = fusion.ranked(results(spark, d), "score", "r0")
    s = 1.0 / F.col("r0") * boosts.web_authority(F.col("url"), F.col("source")) * boosts.web_recency(F.col("title"), F.col("snippet"), YEAR)
    return fusion.ranked(r.select("query_id", "chunk_id", F.round(s, 9).alias("score")), "score").where("rank <= 20").select("query_id", "chunk_id", "score", "rank")


@query("B37_B38_official_first", f"select query_id, chunk_id, cast(row_number() over (partition by query_id order by case when {any_of('url', boosts.GOVERNMENT)} or {any_of('source', boosts.GOVERNMENT)} then 0 else 1 end, score desc, chunk_id) as integer) as place from results where title <> '' and length(snippet) > 50")
def official_first(spark, d):
    r = results(spark, d).where(boosts.web_keeps(F.col("title"), F.col("snippet"))).withColumn("o", boosts.official(F.col("url"), F.col("source")))
    return r.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o"), F.desc("score"), "chunk_id")).alias("place"))


@query("Q26_brainstorm_weights", "select query_id, chunk_id, round(cast(score * b as double), 9) as score, cast(rank as integer) as rank from (select r.*, k, b, row_number() over (partition by query_id, vertical order by score desc, chunk_id) as rank from results r join (values ('schemes', 15, 1.2), ('data', 15, 1.1), ('go', 8, 0.9), ('legal', 5, 0.7), ('judicial', 5, 0.7)) c(vertical, k, b) using (vertical)) where rank <= k")
def brainstorm(spark, d):
    """Each vertical's own number of results, with its weight."""
    r = results(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vertical").orderBy(F.desc("score"), "chunk_id")))
    k, b = (scoring.lookup(F.col("vertical"), {v: x[i] for v, x in boosts.BRAINSTORM.items()}, 0) for i in (0, 1))
    return r.where(F.col("rank") <= k).select("query_id", "chunk_id", F.round(F.col("score") * b.cast("double"), 9).alias("score"), "rank")


# ---- answers


@query("K27_international_query", f"select distinct query_id, {any_of('query', boosts.INTERNATIONAL_QUERY)} as international from results")
def international(spark, d):
    return results(spark, d).select("query_id", "query").distinct().select("query_id", boosts.holds(F.lower("query"), boosts.INTERNATIONAL_QUERY).alias("international"))


@query("K28_should_verify", "select chunk_id, regexp_matches(content, '\\d') or (regexp_matches(lower(content), 'enrollment|dropout|attendance|achievement|performance|ratio|rate|percentage|count|total|number of') and regexp_matches(query, 'latest|current|recent|now|today|2024|2025|as of|up to date|newest')) or score < 0.7 as verify from results")
def should_verify(spark, d):
    from tessera.operators import answers

    return results(spark, d).select("chunk_id", answers.should_verify(F.col("content"), F.col("query"), F.col("score")).alias("verify"))


_NUM = "list_transform(regexp_extract_all({}, '\\d+(?:,\\d{{3}})*(?:\\.\\d+)?', 0), lambda x: cast(replace(x, ',', '') as double))"


@query("W25_claim_consistency", f"with n as (select chunk_id, {_NUM.format('content')} as a, {_NUM.format(chr(99) + 'oalesce(snippet, ' + chr(39) * 2 + ')')} as b from results), p as (select chunk_id, a, list_filter(flatten(list_transform(a, lambda x: list_transform(b, lambda y: abs(x - y) / greatest(x, y)))), lambda r: r < 0.3) as near from n) select chunk_id, cast(case when len(a) = 0 then 0.5 when len(near) = 0 then 0.4 when near[1] < 0.1 then 0.9 else 0.7 end as double) as confidence from p")
def consistency(spark, d):
    return results(spark, d).select("chunk_id", boosts.claim_confidence(F.col("content"), F.array("snippet")).alias("confidence"))


@query("W26_overall_confidence", "select query_id, round(0.6 * max(score) + 0.4 * avg(score) filter (where score >= 0.9), 9) as confidence from results group by query_id")
def overall(spark, d):
    g = results(spark, d).groupBy("query_id").agg(F.max("score").alias("first"), F.collect_list(F.when(F.col("score") >= 0.9, F.col("score"))).alias("checks"))
    return g.select("query_id", F.round(boosts.overall_confidence(F.col("first"), F.col("checks")), 9).alias("confidence"))


@query("W21_confidence", "select query_id, cast(least(1.0, 0.5 + case when n > 0 then 0.3 else 0 end + case when size > 200 then 0.1 else 0 end + case when n >= 3 then 0.1 else 0 end) as double) as confidence from (select query_id, count(*) filter (where score >= 0.985) as n, sum(length(content)) filter (where score >= 0.985) as size from results group by query_id)")
def answer_confidence(spark, d):
    g = results(spark, d).groupBy("query_id").agg(F.count_if(F.col("score") >= 0.985).alias("n"), F.array_join(F.collect_list(F.when(F.col("score") >= 0.985, F.col("content"))), "").alias("answer"))
    return g.select("query_id", F.round(boosts.answer_confidence(F.col("answer"), F.col("n")), 6).alias("confidence"))


@query("Q23_dynamic_k", "select query_id, cast(case when v > 3 then floor(k * 1.2 + 1e-9) else k end as integer) as k from (select query_id, count(distinct vertical) filter (where score >= 0.95) as v, case when avg(score) > 0.5 then 30 else 20 end as k from results group by query_id)")
def dynamic_k(spark, d):
    g = results(spark, d).groupBy("query_id").agg(F.avg("score").alias("comprehensive"), F.count_distinct(F.when(F.col("score") >= 0.95, F.col("vertical"))).alias("verticals"))
    return g.select("query_id", boosts.dynamic_k(20, F.col("comprehensive"), F.col("verticals")).alias("k"))


@query("W27_citation_styles", "select chunk_id, case vertical when 'legal' then concat_ws(', ', s, 'Section ' || nullif(section_number, ''), y) when 'go' then concat_ws(', ', 'G.O. Ms. No. ' || go_number, s, y) when 'judicial' then concat_ws(', ', 'Case ' || go_number, s, y) else concat_ws(', ', s, y) end as entry from (select *, coalesce(source, 'Unknown Source') as s, '(' || year || ')' as y from results)")
def styles(spark, d):
    from tessera.operators import answers

    case = F.concat(F.lit("Case "), F.col("go_number"))
    return results(spark, d).select("chunk_id", answers.citation(F.col("vertical"), F.col("source"), F.col("section_number"), F.col("go_number"), case, F.col("year")).alias("entry"))


@query("S32_cache_lookup", "select d.doc_id, sha256('classify:m:' || d.text) as key, c.cached from documents d left join (select text, min(lang) as cached from documents where doc_id % 3 = 0 group by text) c on c.text = d.text")
def cache(spark, d):
    """Answers by content alone: equal texts of other rows hit as well."""
    from tessera.sources import files

    docs = load(spark, d, "documents").withColumn("key", files.cache_key("classify", "m", F.col("text")))
    stored = docs.where("doc_id % 3 = 0").groupBy("key").agg(F.min("lang").alias("cached"))
    return docs.join(stored, "key", "left").select("doc_id", "key", "cached")
