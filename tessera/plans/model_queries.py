"""Queries that apply embedders, pair scorers, web sources and generators, and summaries by policy level, with checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import answers, fusion, hierarchy, models, vectors
from tessera.plans import rest_queries
from tessera.plans.query_queries import ASKED_SQL, asked
from tessera.sources.tables import load, oracle, results

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


# ---- embeddings

_HEX = "cast(cast('0x' || substr({s}, {at}, 8) as bigint) as double)"


def _lite_sql(dims: int) -> str:
    """Components x, i of the lite vectors of rows (key, text, dims) in a relation t."""
    a, b = _HEX.format(s="s", at=1), _HEX.format(s="s", at=9)
    return f"""select key, i, sqrt(-2.0 * ln(({a} + 1.0) / 4294967296.0)) * cos(2.0 * pi() * {b} / 4294967296.0) as x
 from (select key, i, sha256(sha256(text) || ':' || i) as s from (select key, text, unnest(range({dims})) as i from t))"""


@query(
    "V1_V6_lite_embeddings",
    f"""with t as (select distinct sha256(text) as key, text from documents where regexp_matches(text, '\\S')), x as ({_lite_sql(64)}), n as (select key, sqrt(sum(x * x)) as n from x group by key)
 select key, cast(count(*) as integer) as dims, round(sqrt(sum((x / n) * (x / n))), 4) as norm, round(max(case when i = 0 then x / n end), 6) as first, round(max(case when i = 63 then x / n end), 6) as last from x join n using (key) group by key""",
)
def lite(spark, d):
    e = F.col("e")
    distinct = load(spark, d, "documents").where(F.col("text").rlike(r"\S")).select("text").distinct().select(F.sha2("text", 256).alias("key"), models.lite(F.col("text")).alias("e"))
    return distinct.select("key", F.size(e).alias("dims"), F.round(vectors.norm(e), 4).alias("norm"), F.round(e[0], 6).alias("first"), F.round(e[63], 6).alias("last"))


DIMS = {"fast": 64, "deep": 128}
_MODE = rest_queries.ORACLE["K17_K18_intent"]


@query(
    "V7_V8_embedding_by_mode",
    rf"""with q as (select a.query_id as key, a.query as text, case when mode = 'qa' then 'fast' else 'deep' end as model, case when mode = 'qa' then {DIMS['fast']} else {DIMS['deep']} end as dims from ({ASKED_SQL}) a join ({_MODE}) m on a.query_id = m.query_id where regexp_matches(a.query, '\S')),
 h as (select key, dims, cast('0x' || substr(md5(w), 1, 8) as bigint) as h from (select key, dims, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) as w from q)),
 c as (select key, h % dims as i, sum(case when h >= 2147483648 then 1.0 else -1.0 end) as x from h group by key, h % dims),
 good as (select key from c group by key having sum(x * x) > 0),
 t as (select key, text from q where key not in (select key from good)),
 l as ({_lite_sql(128)}),
 v as (select key, i, cast(x as double) as x, 'words' as backend from c where key in (select key from good) union all select l.key, l.i, l.x, 'lite' from l join q on l.key = q.key where l.i < q.dims),
 n as (select key, sqrt(sum(x * x)) as n from v group by key)
 select q.key as query_id, any_value(model) as model, any_value(backend) as backend, any_value(dims) as dims, round(sqrt(sum((x / n) * (x / n))), 6) as norm, round(sum((i + 1) * x / n), 4) as mark from q join v on q.key = v.key join n on q.key = n.key group by q.key""",
)
def by_mode(spark, d):
    """Turns without words of a-z and 0-9 have no vector of the first model and take the lite one."""
    mode = rest_queries.QUERIES["K17_K18_intent"](spark, d).select("query_id", "mode")
    q = asked(spark, d).where(F.col("query").rlike(r"\S")).join(mode, "query_id")
    chains = {m: ([models.WordHashing("words", n)], n) for m, n in DIMS.items()}
    e = F.col("embedding")
    mark = F.aggregate(F.transform(e, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return models.embed_by_mode(q, "query", "mode", chains).select("query_id", "model", "backend", F.size(e).alias("dims"), F.round(vectors.norm(e), 6).alias("norm"), F.round(mark, 4).alias("mark"))


_BAD = {1: "0.0", 2: "x * 0.001", 3: "x * 1000", 4: "cast('nan' as double)", 5: "cast('inf' as double)", 6: "cast(null as double)"}
_SPOILT = " ".join(f"when {k} then {x}" for k, x in _BAD.items())


@query(
    "V4_V15_spoilt_vectors",
    f"""with v as (select vec_id, case when vec_id % 8 <> 0 then list_transform(cast(embedding as double[]), lambda x: case vec_id % 8 {_SPOILT} else x end) end as e from embeddings),
 f as (select vec_id, e, e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 as valid from v)
 select vec_id, valid, valid and len(list_filter(e, lambda x: x <> 0)) > 0 and sqrt(list_sum(list_transform(e, lambda x: x * x))) between 0.01 and 100 as good from f""",
)
def spoilt(spark, d):
    """Vectors that are null, zero, too short, too long, or hold NaN, infinity or null, beside whole ones."""
    x = F.expr(f"case when vec_id % 8 <> 0 then transform(cast(embedding as array<double>), x -> case vec_id % 8 {_SPOILT} else x end) end")
    e = F.col("e")
    no = lambda c: F.coalesce(c, F.lit(False))
    return load(spark, d, "embeddings").select("vec_id", x.alias("e")).select("vec_id", no(vectors.valid(e)).alias("valid"), no(vectors.good_quality(e)).alias("good"))


# ---- reranking

_TEXTS = "(select *, content as text from results)"


def _texts(spark, d):
    return results(spark, d).withColumnRenamed("content", "text")


_WORDS = lambda c: rf"list_distinct(regexp_extract_all(lower({c}), '(\w+)', 1))"
_DEEP = "query like '%order%'"


@query(
    "F21_pairs_by_mode",
    rf"""with r as (select query_id, chunk_id, score, query, coalesce(text, '') as text, case when {_DEEP} then 30 else 25 end as most, row_number() over (partition by query_id order by score desc, chunk_id) as place from {_TEXTS}),
 w as (select *, {_WORDS('query')} as a, {_WORDS(r"array_to_string(string_split_regex(trim(text), '\s+')[1:500], ' ')")} as b from r),
 s as (select *, case when place <= most then cast(len(list_intersect(a, b)) as double) / len(list_distinct(list_concat(a, b))) end as new from w)
 select query_id, chunk_id, cast(rank as integer) as rank, round(coalesce(new, score), 6) as score from (select *, row_number() over (partition by query_id order by case when new is null then 1 else 0 end, new desc, place) as rank from s) where rank <= 40""",
)
def pairs(spark, d):
    """Forty results a query: 25 or 30 in the scorer's order, the rest in their own."""
    r = _texts(spark, d).select("query_id", "query", "chunk_id", "text", "score", F.when(F.expr(_DEEP), "policy").otherwise("qa").alias("mode"))
    return models.rerank_pairs(r, [models.WordOverlap()], 40).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("F20_brainstorm_diversity")
def brainstorm(spark, d):
    """0.3 similarity, 0.25 innovation and 0.2 recency, then picks that differ from those before."""
    return fusion.brainstorm_rerank(_texts(spark, d), 15)


_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "F32_web_by_host",
    f"""with w as (select query_id, chunk_id, {_HOST} as source, row_number() over (partition by query_id order by score desc, chunk_id) as rank from results where url is not null),
 m as (select query_id, 'local' as origin, chunk_id as item, round(score * 0.7, 9) as score from results where url is null
 union all select query_id, 'web', chunk_id, round(cast(1.0 as double) / rank * case when contains(source, 'gov.in') or contains(source, 'nic.in') then 1.5 else 1.0 end * 0.3, 9) from w)
 select query_id, cast(rank as integer) as rank, origin, item, score from (select *, row_number() over (partition by query_id order by score desc, origin, item) as rank from m) where rank <= 15""",
)
def web_by_host(spark, d):
    """Results with an address are what the web found, by their scores."""
    r = results(spark, d)
    found = fusion.ranked(r.where("url is not null"), "score").select("query_id", F.col("chunk_id").alias("item"), "rank", F.expr(_HOST).alias("source"))
    return fusion.merge_web(r.where("url is null").select("query_id", F.col("chunk_id").alias("item"), "score"), found, 15)


@query(
    "F22_F23_reordered_by_ids",
    f"""with s as (select query_id, chunk_id, score, {_WORDS('query')} as a, {_WORDS('content')} as b from results),
 o as (select query_id, chunk_id, score, round(cast(len(list_intersect(a, b)) as double) / len(list_distinct(list_concat(a, b))), 9) as near from s),
 n as (select *, row_number() over (partition by query_id order by near desc, chunk_id) as spot from o)
 select query_id, chunk_id, cast(row_number() over (partition by query_id order by case when spot <= 10 then spot else 11 end, score desc, chunk_id) as integer) as place from n""",
)
def reordered_by_ids(spark, d):
    """The ten ids that overlap most with the query, then the rest by score."""
    r = results(spark, d)
    near = r.select("query_id", "chunk_id", F.round(scoring.term_overlap(F.col("query"), F.col("content")), 9).alias("near"))
    ids = fusion.ranked(near, "near").where("rank <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("ids"))
    return fusion.reorder_by_ids(r.select("query_id", "chunk_id", "score"), ids).select("query_id", "chunk_id", "place")


@query(
    "W22_bullets",
    rf"""with r as (select query_id, title, chunk_id, replace(trim(coalesce(content, ''), concat(' ', chr(9), chr(10), chr(13))), chr(10), ' ') as text, row_number() over (partition by query_id order by score desc, chunk_id) as n from results)
 select query_id, '{answers.NO_MODEL}' || chr(10) || string_agg('- [' || n || '] ' || coalesce(nullif(title, ''), cast(chunk_id as varchar)) || ': ' || case when length(text) > {answers.BULLET} then rtrim(left(text, {answers.BULLET})) || '...' else text end, chr(10) order by n) as answer, cast({answers.NO_MODEL_CONFIDENCE} as double) as confidence from r where n <= 5 group by query_id""",
)
def bullets(spark, d):
    return answers.bullets(_texts(spark, d).withColumn("doc_id", F.col("chunk_id")), 5)


# ---- policy levels

_LEGAL = " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in hierarchy.CONSTITUTION)
_METRIC = " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in hierarchy.METRICS)
_FIELDS = [
    ("constitutional", "reference", f"case when vertical = 'legal' and ({_LEGAL}) then left(text, 200) end", "cast(chunk_id as varchar)"),
    ("statutory", "act", "case when vertical = 'legal' then nullif(act_name, '') end", "''"),
    ("statutory", "section", "case when vertical = 'legal' then nullif(section_number, '') end", "''"),
    ("administrative", "go", "case when vertical = 'go' then nullif(go_number, '') end", "''"),
    ("administrative", "recent", "case when vertical = 'go' and year >= 2020 then nullif(go_number, '') end", "cast(chunk_id as varchar)"),
    ("administrative", "department", "case when vertical = 'go' then nullif(department, '') end", "''"),
    ("judicial", "case", "case when vertical = 'judicial' and nullif(case_number, '') is not null then concat_ws(', ', case_number, court_name, cast(year as varchar)) end", "cast(chunk_id as varchar)"),
    ("judicial", "court", "case when vertical = 'judicial' then nullif(court_name, '') end", "''"),
    ("empirical", "source", "case when vertical = 'data' then nullif(source, '') end", "''"),
    ("empirical", "metric", f"case when vertical = 'data' and ({_METRIC}) then left(text, 150) end", "cast(chunk_id as varchar)"),
]
_CASE_NUMBER = "case when chunk_id % 3 = 0 then concat('W.P. ', cast(chunk_id % 70 as string)) end"
_LIST = lambda f: f"max(case when field = '{f}' then list end)"
_COUNT = lambda f: f"coalesce(max(case when field = '{f}' then count end), 0)"
_LEVELS = [
    ("constitutional", "legal", "reference", "null", _COUNT("reference"), "reference", "strong", "moderate", 2),
    ("statutory", "legal", "act", "section", f"{_COUNT('act')} + {_COUNT('section')}", "act", "comprehensive", "limited", 2),
    ("administrative", "go", "recent", "department", _COUNT("go"), "recent", "active", "historical", 0),
    ("judicial", "judicial", "case", "court", _COUNT("case"), "case", "strong", "moderate", 3),
    ("empirical", "data", "source", "metric", _COUNT("source"), "source", "strong", "moderate", 2),
]


@query(
    "A12_policy_levels",
    f"""with r as (select *, {_CASE_NUMBER} as case_number from {_TEXTS}), p as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as place from r),
 e as ({" union all ".join(f"select query_id, place, '{lv}' as level, '{f}' as field, {v} as value, {i} as item from p" for lv, f, v, i in _FIELDS)}),
 g as (select query_id, field, value, item, min(place) as place from e where value is not null group by all),
 n as (select *, row_number() over (partition by query_id, field order by place, value) as n, count(*) over (partition by query_id, field) as count from g),
 f as (select query_id, field, max(count) as count, string_agg(value, ' | ' order by n) filter (where n <= case field {" ".join(f"when '{f}' then {m}" for f, m in hierarchy.MOST.items())} else 1000000000 end) as list from n group by query_id, field),
 h as (select query_id, {", ".join(f"max(cast(vertical = '{v}' as integer)) = 1 as has_{v}" for v in ("legal", "go", "judicial", "data"))} from r group by query_id)
 {" union all ".join(f"select query_id, '{lv}' as level, total > 0 as present, cast(total as bigint) as total, case when has then coalesce(items, '') end as items, {'cast(null as varchar)' if more == 'null' else f'''case when has then coalesce(more, '') end'''} as more, case when has then case when graded > {least} then '{high}' else '{low}' end end as grade from (select h.query_id, any_value(has_{v}) as has, {total} as total, {_LIST(items)} as items, {'null' if more == 'null' else _LIST(more)} as more, {_COUNT(graded)} as graded from h left join f on h.query_id = f.query_id group by h.query_id)" for lv, v, items, more, total, graded, high, low, least in _LEVELS)}""",
)
def levels(spark, d):
    return hierarchy.summary(_texts(spark, d).withColumn("case_number", F.expr(_CASE_NUMBER)))
