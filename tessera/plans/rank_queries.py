"""Queries for relations, chunks, lexical and vector search, scores, fusion and reranking, with checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import chunking, fusion, lexical, relations, stored_index, vectors
from tessera.sources import files
from tessera.sources.tables import candidates, corpus, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = 1_700_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


# ---- relations

_EXTRA = "concat(text, case when n % 4 = 0 then ' It is governed by the Public Education Act. Done as per the Service Conduct Rule. Supersession in terms of Rule 7.' else '' end)"
_STD = rf"(select doc_id, n, true_vertical, regexp_replace({_EXTRA}, '(?i)(G\.?O\.?)\s*(MS|RT)\.\s*No\.?\s*', '\1\2No. ', 'g') as text from corpus)"


def _relations(spark, d, kinds=tuple(relations.PATTERNS)):
    return relations.extract(corpus(spark, d).select("doc_id", relations.standard_go(F.expr(_EXTRA)).alias("text")), kinds)


def _relation_sql(kind: str) -> str:
    parts = []
    for p in relations.PATTERNS[kind]:
        whole, group = (f"unnest(regexp_extract_all(text, '{p}', {g}, 'i'))" for g in (0, 1))
        parts.append(f"select doc_id, {whole} as w, {group} as g from {_STD}")
    go = "'G.O.MS.No.' || g"
    target = {
        "supersedes": go, "amends": f"case when contains(lower(w), 'section') or contains(lower(w), 'rule') then 'Section ' || g else {go} end",
        "cites": f"case when contains(lower(w), 'section') then 'Section ' || g when contains(lower(w), 'rule') then 'Rule ' || g when contains(lower(w), 'vide') then {go} else g end",
    }.get(kind, r"regexp_replace(g, '^\s+|\s+$', '', 'g')")
    return f"select doc_id as source_id, {target} as target, cast({relations.CONFIDENCE[kind]} as double) as confidence from ({' union all '.join(parts)})"


for _i, _kind in enumerate(relations.PATTERNS, 1):
    QUERIES[f"R{_i}_{_kind}"] = lambda spark, d, kind=_kind: _relations(spark, d, (kind,)).select("source_id", "target", "confidence")
    ORACLE[f"R{_i}_{_kind}"] = oracle(_relation_sql(_kind))
_all_relations = " union all ".join(f"select source_id, '{k}' as relation_type, target, confidence from ({_relation_sql(k)})" for k in relations.PATTERNS)
_priority_sql = "case " + " ".join(f"when relation_type = '{k}' then {v}" for k, v in relations.PRIORITY.items()) + " else 0 end"


@query("R6_R8_R12_deduplicated", f"select source_id, relation_type, min(target) as target, {_priority_sql} as priority from ({_all_relations}) group by source_id, relation_type, lower(target)")
def deduplicated(spark, d):
    return relations.deduplicate(_relations(spark, d)).select("source_id", "relation_type", "target", relations.priority(F.col("relation_type")).alias("priority"))


@query("R13_worth_extracting", "select doc_id, true_vertical in ('go', 'legal', 'judicial') and length(text) >= 500 as worth from corpus")
def worth(spark, d):
    return corpus(spark, d).select("doc_id", relations.worth_extracting(F.col("true_vertical"), F.col("text")).alias("worth"))


def _superseded(spark, d):
    docs = corpus(spark, d).select("doc_id", F.col("n").cast("string").alias("go_number"))
    return relations.supersession_map(docs, _relations(spark, d, ("supersedes",)))


_SUPERSESSION = f"select c.doc_id, max(r.source_id) as superseded_by from ({_relation_sql('supersedes')}) r join corpus c on c.n = cast(regexp_extract(r.target, '(\\d+)', 1) as bigint) where c.doc_id <> r.source_id group by c.doc_id"
query("J28_supersession_map", _SUPERSESSION)(_superseded)


@query("J29_J34_superseded_last", f"select c.doc_id, s.doc_id is not null as is_superseded, row_number() over (partition by floor(c.n / 100) order by s.doc_id is not null, c.n desc) as place from corpus c left join ({_SUPERSESSION}) s on s.doc_id = c.doc_id")
def superseded_last(spark, d):
    """Result lists of a hundred documents each, those in force first."""
    flagged = corpus(spark, d).join(_superseded(spark, d), "doc_id", "left").withColumn("is_superseded", F.col("superseded_by").isNotNull())
    place = F.row_number().over(Window.partitionBy(F.floor(F.col("n") / 100)).orderBy("is_superseded", F.desc("n")))
    return flagged.select("doc_id", "is_superseded", place.cast("long").alias("place"))


@query(
    "J20_neighbours",
    f"""with e as (select source_id, target, relation_type from ({_all_relations}) where relation_type in ('amends', 'supersedes') and starts_with(target, 'G.O.'))
    select e.source_id, c.doc_id as neighbour, e.relation_type, round(cast(c.n % 1000 as double) / 1000 * 0.85, 6) as score from e join corpus c on c.n = cast(regexp_extract(e.target, '(\\d+)', 1) as bigint)""",
)
def neighbours(spark, d):
    edges = _relations(spark, d).where("relation_type in ('amends', 'supersedes') and target like 'G.O.%'").select("source_id", "relation_type", F.regexp_extract("target", r"(\d+)", 1).cast("long").alias("n"))
    docs = corpus(spark, d).select("n", F.col("doc_id").alias("neighbour"))
    return edges.join(docs, "n").select("source_id", "neighbour", "relation_type", F.round((F.col("n") % 1000).cast("double") / 1000 * 0.85, 6).alias("score"))


# ---- chunks


@query("H1_paragraphs", r"select doc_id, cast(len(p) as integer) as n, p[1] as first, p[len(p)] as last from (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from corpus)")
def paragraphs(spark, d):
    return corpus(spark, d).select("doc_id", chunking.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"))


@query(
    "G9_legal_sections",
    r"select doc_id, regexp_extract(text, '(?im)^(?:Section|Sec\.?)\s+(\d+[A-Z]?)', 1) as section_number, regexp_replace(regexp_extract(text, '(?ims)^(?:Section|Sec\.?)\s+\d.*', 0), '^\s+|\s+$', '', 'g') as content from corpus where regexp_matches(text, '(?im)^(?:Section|Sec\.?)\s+\d')",
)
def legal(spark, d):
    return chunking.legal_sections(corpus(spark, d)).select("doc_id", "section_number", "content")


def _marked_sql(vertical: str, markers: list[str]) -> str:
    at = " union all ".join(f"select doc_id, text, '{m.lower()}' as section_type, strpos(text, chr(10) || '{m}') + 1 as place from corpus where true_vertical = '{vertical}' and contains(text, chr(10) || '{m}')" for m in markers)
    return f"with s as ({at}) select doc_id, section_type, length(trim(substr(text, place, coalesce(lead(place) over (partition by doc_id order by place), length(text) + 1) - place))) as size from s"


def _marked(vertical: str, markers: dict, first: str):
    def run(spark, d):
        rows = chunking.marked_sections(corpus(spark, d).where(F.col("true_vertical") == vertical), markers, first)
        return rows.where(F.col("pos") > 0).select("doc_id", "section_type", F.length("content").cast("long").alias("size"))

    return run


QUERIES["G12_judicial_sections"], ORACLE["G12_judicial_sections"] = _marked("judicial", chunking.JUDICIAL_MARKERS, "preamble"), oracle(_marked_sql("judicial", ["FACTS", "JUDGMENT"]))
QUERIES["G14_scheme_sections"], ORACLE["G14_scheme_sections"] = _marked("scheme", chunking.SCHEME_MARKERS, "overview"), oracle(_marked_sql("scheme", ["ELIGIBILITY", "BENEFITS"]))

# ---- lexical search

_TERMS = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
#: Every user's turn asks the documents of {docs}.
BM25_SQL = f"""with t as (select doc_id, {_TERMS.format('text')} as t from {{docs}}), st as (select count(*) as n, avg(len(t)) as avgdl from t),
 q as (select query_id, term, count(*) as qtf from (select query_id, unnest({_TERMS.format('query')}) as term from (select conv_id * 1000 + turn as query_id, text as query from conversations where role = 'user')) group by query_id, term),
 h as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from t) where term in (select term from q) group by doc_id, term),
 f as (select term, count(*) as df from h group by term),
 s as (select q.query_id, h.doc_id, round(sum(q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from h join f using (term) join q using (term) cross join st group by q.query_id, h.doc_id)
 select query_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 10"""


def user_turns(spark, d):
    return load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


@query("J11_bm25_topk", BM25_SQL.format(docs="documents"))
def bm25(spark, d):
    """Every user's turn over all documents, through a stored index."""
    path = files.work_path(spark, "index")
    stored_index.add(load(spark, d, "documents"), path)
    return stored_index.search(spark, path, user_turns(spark, d))


@query("A17_B1_term_statistics", f"with t as (select doc_id, unnest(list_distinct({_TERMS.format('text')})) as term from documents) select term, count(*) as df, round(ln(((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5) + 1.0), 6) as idf from t group by term")
def term_statistics(spark, d):
    docs = load(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))
    df = lexical.postings(docs).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("df"), F.col("n")), 6).alias("idf"))


# ---- vectors

_COS = "list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) / sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[])))"


@query("J1_J2_V12_vector_topk", f"select * from (select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from (select a.vec_id as query_id, b.vec_id, round({_COS}, 6) as score from embeddings a cross join embeddings b where a.vec_id % 20 = 0) where score >= 0.3) where rank <= 10")
def vector_topk(spark, d):
    v = load(spark, d, "embeddings")
    return vectors.top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query(
    "V9_V10_V16_pair_measures",
    f"select a.vec_id, round(least(greatest({_COS}, 0), 1), 6) as cosine, round({_COS}, 6) as raw, round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def measures(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return v.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(a, b), 6).alias("cosine"), F.round(vectors.cosine(a, b, clip=False), 6).alias("raw"), F.round(vectors.euclidean(a, b), 6).alias("distance"))


@query("V4_V11_V15_quality", "select vec_id, len(embedding) > 0 as valid, list_dot_product(embedding, embedding) > 0 as good, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as norm from embeddings")
def quality(spark, d):
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", vectors.valid(e).alias("valid"), vectors.good_quality(e).alias("good"), F.round(vectors.norm(vectors.normalized(e)), 6).alias("norm"))


@query(
    "V13_V14_mean_vector",
    "with p as (select label, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as i from embeddings) select kind, cast(i - 1 as integer) as i, round(m, 6) as m from (select 'plain' as kind, i, avg(x) as m from p group by i union all select 'weighted', i, sum(x * (label + 1)) / sum(label + 1) from p group by i)",
)
def means(spark, d):
    v = load(spark, d, "embeddings")
    both = vectors.mean_vector(v, "embedding").withColumn("kind", F.lit("plain")).unionByName(vectors.mean_vector(v, "embedding", F.col("label") + 1).withColumn("kind", F.lit("weighted")))
    return both.select("kind", F.posexplode("mean").alias("i", "m")).select("kind", "i", F.round("m", 6).alias("m"))


# ---- scores


def _case(col: str, table: dict, default) -> str:
    return f"case {' '.join(f'when {col} = {k!r} then {v}' for k, v in table.items())} else {default} end"


def score_query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, d: candidates(spark, d).select("chunk_id", F.round(make(), 6).alias("value"))
    ORACLE[name] = oracle(f"select chunk_id, round(cast({sql} as double), 6) as value from candidates")


score_query(
    "B7_time_score", lambda: scoring.time_score(F.col("date_issued_ts"), F.col("is_superseded"), F.col("effective_to_ts"), NOW),
    f"case when date_issued_ts is null then 0 else least(1, greatest(-1, 1.0 / (1.0 + log10(greatest(1.0, cast({NOW} - date_issued_ts as double) / 86400))) - case when is_superseded then 0.9 else 0 end - case when effective_to_ts < {NOW} then 0.7 else 0 end)) end",
)
score_query("B8_relation_bonus", lambda: scoring.relation_bonus(F.split("relation_list", ",")), f"least(0.9, greatest(-1, list_sum(list_transform(list_distinct(string_split(relation_list, ',')), lambda t: {_case('t', scoring.RELATION_WEIGHTS, 0.0)}))))")
score_query("B9_section_boost", lambda: scoring.section_boost(F.col("section_type")), _case("lower(coalesce(section_type, ''))", scoring.SECTION_BOOSTS, 1.0))
score_query("B23_recency_steps", lambda: scoring.recency_steps(F.col("year")), "case when 2024 - year <= 1 then 1.0 when 2024 - year <= 3 then 0.9 when 2024 - year <= 5 then 0.8 when 2024 - year <= 10 then 0.6 else 0.3 end")
score_query("B28_authority", lambda: scoring.authority(F.col("vertical")), _case("vertical", scoring.VERTICAL_AUTHORITY, 0.5))
_has = "list_contains(string_split(relation_list, ','), '{}')"
score_query(
    "B10_relation_scoring", lambda: scoring.relation_score(F.col("score"), F.split("relation_list", ","), F.col("is_superseded"), F.col("chunk_id") % 2 == 0),
    f"score * case when is_superseded then 0.4 else 1.0 end * case when {_has.format('supersedes')} then 1.15 else 1.0 end * least(cast(case when {_has.format('amends')} then 1.08 else 1.0 end as double) * case when {_has.format('implements')} then 1.05 else 1.0 end * case when {_has.format('cites')} then 1.05 else 1.0 end * case when {_has.format('governed_by')} then 1.05 else 1.0 end, case when chunk_id % 2 = 0 then 1.25 else 1.03 end)",
)
score_query("B4_vector_and_keyword", lambda: 0.7 * F.col("score") + 0.3 * F.least(F.col("bm25") * 12 / 10, F.lit(1.0)), "0.7 * score + 0.3 * least(bm25 * 12 / 10, 1.0)")


@query("B24_term_overlap", r"with w as (select a.doc_id, list_distinct(regexp_extract_all(lower(a.text), '([a-z0-9]+)', 1)) as x, list_distinct(regexp_extract_all(lower(b.text), '([a-z0-9]+)', 1)) as y from corpus a join corpus b on b.n = a.n + 1) select doc_id, round(cast(len(list_intersect(x, y)) as double) / len(list_distinct(list_concat(x, y))), 6) as overlap from w")
def overlap(spark, d):
    docs = corpus(spark, d)
    other = docs.select((F.col("n") - 1).alias("n"), F.col("text").alias("other"))
    return docs.join(other, "n").select("doc_id", F.round(scoring.term_overlap(F.col("text"), F.col("other")), 6).alias("overlap"))


@query("B21_B22_source_signals", r"with y as (select doc_id, list_max(list_transform(regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1), lambda x: cast(x as integer))) as last, lower(text[:60]) as s from corpus) select doc_id, round(cast(case when last is null then 0.5 else least(1, greatest(0, 1.0 - 0.1 * (2000 - last))) end as double), 6) as recency, cast(case when contains(s, 'act') then 1.0 when contains(s, 'rule') then 0.9 when contains(s, 'go') then 0.85 when contains(s, 'circular') then 0.7 when contains(s, 'guideline') then 0.6 else 0.5 end as double) as authority from y")
def signals(spark, d):
    return corpus(spark, d).select("doc_id", F.round(scoring.recency_of_text(F.col("text"), 2000), 6).alias("recency"), scoring.source_authority(F.substring("text", 1, 60)).alias("authority"))


@query("B26_position_score", "select chunk_id, round(1.0 - cast(row_number() over (partition by query_id order by score desc, chunk_id) - 1 as double) / count(*) over (partition by query_id), 6) as value from candidates")
def position(spark, d):
    ranked = fusion.ranked(candidates(spark, d), "score")
    return ranked.select("chunk_id", F.round(scoring.position_score(F.col("rank") - 1, F.count("*").over(Window.partitionBy("query_id"))), 6).alias("value"))


@query("B39_innovation", "select chunk_id, round(least(" + " + ".join(f"case when contains(t, '{w}') then 1 else 0 end" for w in scoring.INNOVATION_WORDS) + ", 5) / 5.0, 6) as value from (select chunk_id, case chunk_id % 4 when 0 then 'a global pilot model' when 1 then 'novel innovative creative experimental pilot model' when 2 then 'oecd case study' else 'none' end as t from candidates)")
def innovation(spark, d):
    text = F.expr("case chunk_id % 4 when 0 then 'a global pilot model' when 1 then 'novel innovative creative experimental pilot model' when 2 then 'oecd case study' else 'none' end")
    return candidates(spark, d).select("chunk_id", F.round(scoring.innovation(text), 6).alias("value"))


# ---- fusion

_RANKED = "row_number() over (partition by query_id order by {} desc, chunk_id)"
_RRF = f"with v as (select query_id, chunk_id, {_RANKED.format('score')} as rank from candidates), k as (select query_id, chunk_id, {_RANKED.format('bm25')} as rank from candidates), u as (select * from v where rank <= 20 union all select * from k where rank <= 20), f as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) as rrf from u group by query_id, chunk_id)"


def _lists(spark, d):
    c = candidates(spark, d)
    return [fusion.ranked(c, s).where("rank <= 20") for s in ("score", "bm25")]


@query("F1_F4_rrf", _RRF + " select query_id, chunk_id, rrf from f")
def rrf(spark, d):
    return fusion.rrf(_lists(spark, d))


@query("F3_rrf_of_ranks", "select chunk_id, round(1.0 / (60 + chunk_id % 7 + 1) + 1.0 / (60 + chunk_id % 11 + 1), 9) as rrf from candidates")
def rrf_ranks(spark, d):
    return candidates(spark, d).select("chunk_id", F.round(fusion.rrf_of_ranks(F.array(F.col("chunk_id") % 7 + 1, F.col("chunk_id") % 11 + 1)), 9).alias("rrf"))


@query("F5_hybrid_search", _RRF + f", r as (select *, cast(row_number() over (partition by query_id order by rrf desc, chunk_id) as integer) as rank from f) select r.query_id, r.chunk_id, rank, round(1.0 / (rank + 1) * greatest({_case('lower(coalesce(section_type, chr(0)))', scoring.SECTION_BOOSTS, 1.0)}, 1.0), 9) as score from r join candidates c using (chunk_id)")
def hybrid(spark, d):
    v, k = _lists(spark, d)
    return fusion.hybrid(v, k, candidates(spark, d).select("query_id", "chunk_id", "section_type")).withColumn("score", F.round("score", 9))


@query("F7_F8_normalize", "select chunk_id, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as minmax, round(least(1, greatest(0, (case when coalesce(sd, 0) = 0 then 0 else (score - m) / sd end + 3) / 6)), 6) as zscore from (select *, min(score) over w as lo, max(score) over w as hi, avg(score) over w as m, stddev_samp(score) over w as sd from candidates window w as (partition by query_id))")
def normalize(spark, d):
    c = fusion.normalize_scores(candidates(spark, d)).withColumnRenamed("norm_score", "minmax")
    return fusion.normalize_scores(c, "z").select("chunk_id", F.round("minmax", 6).alias("minmax"), F.round("norm_score", 6).alias("zscore"))


@query("F9_F11_best_per_document", "select query_id, doc_id, chunk_id, score from (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) as r from candidates) where r = 1")
def best_per(spark, d):
    return fusion.best_per(candidates(spark, d), "doc_id").select("query_id", "doc_id", "chunk_id", "score")


@query("F10_F14_best_limited", "with b as (select query_id, doc_id, chunk_id, score from (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) as r from candidates where score >= 0.2) where r = 1) select query_id, doc_id, chunk_id, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from b) where rank <= 12")
def best_limited(spark, d):
    return fusion.best_per(candidates(spark, d).where("score >= 0.2"), "doc_id", 12).select("query_id", "doc_id", "chunk_id", "rank")


_WEIGHTS = {"legal": 1.2, "go": 1.1, "judicial": 1.0, "data": 0.9, "schemes": 0.8}


@query("F6_F12_weighted", f"select chunk_id, round(score * {_case('vertical', _WEIGHTS, 1.0)}, 6) as weighted_score, round(score * 0.625 + bm25 * 0.375, 6) as fused from candidates")
def weighted(spark, d):
    return fusion.weighted(candidates(spark, d), _WEIGHTS, {"score": 0.5, "bm25": 0.3}).select("chunk_id", F.round("weighted_score", 6).alias("weighted_score"), F.round("fused", 6).alias("fused"))


_POLICY = f"""with s as (select query_id, chunk_id, vertical, round(0.4 * score + 0.2 * {_case('vertical', scoring.VERTICAL_AUTHORITY, 0.5)} + 0.15 * case when 2024 - year <= 1 then 1.0 when 2024 - year <= 3 then 0.9 when 2024 - year <= 5 then 0.8 when 2024 - year <= 10 then 0.6 else 0.3 end + 0.15 * bm25 + 0.1 * 0.5, 9) as rerank_score from candidates),
 r as (select *, row_number() over (partition by query_id order by rerank_score desc, chunk_id) as r0 from s),
 v as (select *, row_number() over (partition by query_id, vertical order by r0) as v1, count(*) over (partition by query_id, vertical) as n from r),
 q as (select query_id, count(distinct case when r0 <= 4 then vertical end) as top, count(distinct vertical) as every from r group by query_id)
 select query_id, chunk_id, cast(rank as integer) as rank from (select v.query_id, chunk_id, row_number() over (partition by v.query_id order by case when top < least(3, every) and v1 = 1 then 0 else 1 end, r0) as rank from v join q using (query_id)) where rank <= 4"""


@query("F18_F19_policy_rerank", _POLICY)
def policy(spark, d):
    return fusion.policy_rerank(candidates(spark, d), F.col("bm25"), F.lit(0.5), 4).select("query_id", "chunk_id", "rank")


@query("F15_F16_mmr")
def mmr(spark, d):
    v = load(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("query_id"), F.col("vec_id").alias("chunk_id"), "embedding", (F.col("vec_id") * 37 % 101 / 101.0).alias("score"))
    return fusion.greedy(v, 8, 0.7, 60, "mmr")


@query("F30_F31_source_order", "with p as (select query_id, chunk_id, score, 'local' as source, 1.0 as priority, row_number() over (partition by query_id order by score desc, chunk_id) as number from candidates where chunk_id % 3 = 0 union all select query_id, chunk_id, score, 'internet', 0.3, 100 + row_number() over (partition by query_id order by score desc, chunk_id) from candidates where chunk_id % 3 = 1) select query_id, chunk_id, source, cast(number as integer) as number, cast(row_number() over (partition by query_id order by priority desc, number) as integer) as rank from p")
def sources(spark, d):
    c = candidates(spark, d)
    return fusion.by_priority([("local", 1.0, c.where("chunk_id % 3 = 0")), ("internet", 0.3, c.where("chunk_id % 3 = 1"))]).select("query_id", "chunk_id", "source", "number", "rank")


@query("F32_web_merge", "with m as (select query_id, chunk_id, score * 0.7 as s from candidates where chunk_id % 2 = 0 union all select query_id, chunk_id, 1.0 / row_number() over (partition by query_id order by score desc, chunk_id) * case when chunk_id % 3 = 0 then 1.5 else 1.0 end * 0.3 from candidates where chunk_id % 2 = 1) select query_id, chunk_id, round(s, 9) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by round(s, 9) desc, chunk_id) as rank from m) where rank <= 15")
def web_merge(spark, d):
    c = candidates(spark, d)
    web = fusion.ranked(c.where("chunk_id % 2 = 1"), "score").select("query_id", "chunk_id", (1.0 / F.col("rank") * F.when(F.col("chunk_id") % 3 == 0, 1.5).otherwise(1.0) * 0.3).alias("score"))
    both = c.where("chunk_id % 2 = 0").select("query_id", "chunk_id", (F.col("score") * 0.7).alias("score")).unionByName(web).withColumn("score", F.round("score", 9))
    return fusion.ranked(both, "score").where("rank <= 15")


@query("F33_interleave", "with a as (select query_id, chunk_id, 0 as side, row_number() over (partition by query_id order by score desc, chunk_id) as rank from candidates where chunk_id % 2 = 0), b as (select query_id, chunk_id, 1 as side, row_number() over (partition by query_id order by score desc, chunk_id) as rank from candidates where chunk_id % 2 = 1), u as (select *, (rank - 1) // 3 as turn from a union all select *, (rank - 1) // 2 from b) select query_id, chunk_id, side, cast(row_number() over (partition by query_id order by turn, side, rank) as integer) as place from u")
def interleave(spark, d):
    c = candidates(spark, d)
    return fusion.interleave(fusion.ranked(c.where("chunk_id % 2 = 0"), "score"), fusion.ranked(c.where("chunk_id % 2 = 1"), "score"), 3, 2)


@query("F34_early_exit", "select query_id, max(score) > 0.8 and avg(score) > 0.75 as stop from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from candidates) where r <= 3 group by query_id")
def early_exit(spark, d):
    return fusion.early_exit(candidates(spark, d))


@query("F35_decay", "select query_id, chunk_id, round(cast(0.85 - 0.05 * (row_number() over (partition by query_id order by score desc, chunk_id) - 1) as double), 6) as decayed from candidates")
def decay(spark, d):
    return fusion.ranked(candidates(spark, d), "score").select("query_id", "chunk_id", F.round(0.85 - 0.05 * (F.col("rank") - 1), 6).alias("decayed"))


# ---- aggregation


@query("A2_chunk_statistics", "select true_vertical, count(*) as n, min(length(text)) as least, max(length(text)) as most, round(avg(length(text)), 6) as mean from corpus group by true_vertical")
def text_statistics(spark, d):
    n = F.length("text").cast("long")
    return corpus(spark, d).groupBy("true_vertical").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


@query("A4_A6_A7_result_summary", "select query_id, count(*) as n, min(score) as least, max(score) as most, round(avg(score), 6) as mean, count(distinct vertical) as verticals, min(year) as first_year, max(year) as last_year, count(*) filter (where score >= 0.8) as high, count(*) filter (where score >= 0.6 and score < 0.8) as medium from candidates group by query_id")
def summary(spark, d):
    s = F.col("score")
    return candidates(spark, d).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 6).alias("mean"), F.countDistinct("vertical").alias("verticals"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.6) & (s < 0.8)).alias("medium"),
    )


@query("A11_grouping_sets", "select vertical, section_type, count(*) as n from candidates group by grouping sets ((vertical), (section_type), ())")
def grouping(spark, d):
    return candidates(spark, d).groupingSets([["vertical"], ["section_type"], []], "vertical", "section_type").agg(F.count("*").alias("n"))


@query("A13_A14_coherence_and_gaps", "select query_id, round(cast(count(distinct case when vertical in ('legal', 'go', 'judicial') then vertical end) as double) / 3, 6) as coherence, array_to_string(list_sort(list_filter(['legal', 'go', 'judicial', 'data', 'schemes'], lambda v: not list_contains(list(distinct vertical), v))), ',') as gaps from candidates where score > 0.9 group by query_id")
def coherence(spark, d):
    every = F.array(*[F.lit(v) for v in ("legal", "go", "judicial", "data", "schemes")])
    got = candidates(spark, d).where("score > 0.9").groupBy("query_id").agg(F.collect_set("vertical").alias("v"))
    main = F.array(F.lit("legal"), F.lit("go"), F.lit("judicial"))
    return got.select("query_id", F.round(F.size(F.array_intersect(main, "v")) / 3, 6).alias("coherence"), F.array_join(F.array_sort(F.array_except(every, "v")), ",").alias("gaps"))


@query("A8_stage_timings", "with r as (select *, row_number() over (partition by query_id order by chunk_id desc) as back from candidates), l as (select query_id, list_sort(list(score)) as s from r where back <= 100 group by query_id) select query_id, round(list_avg(s), 6) as mean, s[1] as least, s[len(s)] as most, s[len(s) // 2 + 1] as p50, case when len(s) > 20 then s[cast(floor(len(s) * 0.95) as integer) + 1] end as p95 from l")
def timings(spark, d):
    last = candidates(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("chunk_id")))).where("back <= 100")
    s = last.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("s"))
    return s.select(
        "query_id", F.expr("round(aggregate(s, 0D, (a, x) -> a + x) / size(s), 6)").alias("mean"), F.expr("s[0]").alias("least"), F.expr("s[size(s) - 1]").alias("most"),
        F.expr("s[size(s) div 2]").alias("p50"), F.expr("case when size(s) > 20 then s[cast(floor(size(s) * 0.95D) as int)] end").alias("p95"),
    )


@query("A10_running_mean", "select query_id, chunk_id, round(cast(sum(cast(round(score * 1000) as bigint)) over (partition by query_id order by chunk_id rows unbounded preceding) as double) / count(*) over (partition by query_id order by chunk_id rows unbounded preceding), 6) as mean from candidates")
def running(spark, d):
    w = Window.partitionBy("query_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return candidates(spark, d).select("query_id", "chunk_id", F.round(F.sum(F.round(F.col("score") * 1000).cast("long")).over(w) / F.count("*").over(w), 6).alias("mean"))


@query("A15_idea_buckets", "select query_id, bucket, chunk_id from (select query_id, chunk_id, bucket, row_number() over (partition by query_id, bucket order by score desc, chunk_id) as r from (select *, case when vertical = 'schemes' then 'ideas' when vertical = 'data' then 'evidence' else 'constraints' end as bucket from candidates)) where r <= case when bucket = 'constraints' then 3 else 5 end")
def buckets(spark, d):
    b = candidates(spark, d).withColumn("bucket", F.when(F.col("vertical") == "schemes", "ideas").when(F.col("vertical") == "data", "evidence").otherwise("constraints"))
    r = b.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(F.desc("score"), "chunk_id")))
    return r.where(F.col("r") <= F.when(F.col("bucket") == "constraints", 3).otherwise(5)).select("query_id", "bucket", "chunk_id")
