"""Queries that look up clauses and files by substrings, search in hops, follow chains and reverse edges, join by time and cache, with checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import clauses, fifo, filefind, hops, relations, stored_index, temporal
from tessera.plans.query_queries import ASKED_SQL, asked
from tessera.plans.rank_queries import _SUPERSESSION, _TERMS, _all_relations, _relations, _superseded
from tessera.plans.understanding_queries import QUESTIONS_SQL, questions
from tessera.sources import files
from tessera.sources.tables import corpus, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = oracle(sql)
        return f

    return add


# ---- clauses

_MENTIONS = " union all ".join(
    rf"select doc_id, lower(text) as low, '{k}' as kind, regexp_extract_all(lower(text), '\b{k}\s+{n}', 0) as w, regexp_extract_all(lower(text), '\b{k}\s+{n}', 1) as g, string_split_regex(lower(text), '\b{k}\s+{n}') as s from corpus"
    for k, n in clauses.KEYED.items()
)
_ACT = "case " + " ".join(f"when contains(low, '{w}') then '{a}'" for w, a in clauses.ACTS) + " end"
_LEGAL_TERMS = " + ".join(f"cast(contains(around, '{t}') as integer)" for t in clauses.LEGAL_TERMS)
_INDEX = f"""k as ({_MENTIONS}), m as (select *, unnest(range(1, len(w) + 1)) as i from k where len(w) > 0),
 p as (select *, cast(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as bigint) as start from m),
 z as (select *, {_ACT} as act, kind || ' ' || g[i] as clause, substring(low, greatest(start - 100, 0) + 1, start + length(w[i]) + 100 - greatest(start - 100, 0)) as around, cast(start as double) / length(low) as share from p),
 e as (select doc_id, clause, act, i, round(least(1.0, cast(0.5 as double) + case when act is not null then 0.3 else 0.0 end + case when share < 0.1 then 0.2 when share < 0.3 then 0.1 else 0.0 end + least(0.2, ({_LEGAL_TERMS}) * 0.03)), 6) as confidence from z),
 l as (select * from (select *, row_number() over (partition by doc_id, clause order by i desc) as r from e) where r = 1),
 x as (select key, clause, doc_id, confidence from (select *, row_number() over (partition by key order by confidence desc, doc_id) as r from (select concat_ws(' ', act, clause) as key, clause, doc_id, confidence from l)) where r = 1)"""
_NAMED = "flatten([" + ", ".join(rf"list_transform(regexp_extract_all(query, '\b{k}\s+{n}', 1), lambda y: '{k} ' || y)" for k, n in clauses.KEYED.items()) + "])"
_LOOKUP = f"""{_INDEX}, q as (select query_id, lower(query) as query from ({QUESTIONS_SQL})), a as (select q.query_id, x.* from q join x on contains(q.query, x.key)),
 n as (select query_id, unnest({_NAMED}) as needle from q where query_id not in (select query_id from a)),
 b as (select distinct n.query_id, x.* from n join x on contains(x.key, n.needle)),
 u as (select *, row_number() over (partition by query_id, doc_id, clause order by confidence desc, key) as same from (select * from a union all select * from b)),
 hits as (select * from (select query_id, cast(row_number() over (partition by query_id order by confidence desc, key) as integer) as rank, key, clause, doc_id, confidence from u where same = 1) where rank <= {clauses.MOST})"""


def _entries(spark, d):
    return clauses.index(corpus(spark, d))


@query("J13_J14_keyed_clause_index", f"with {_INDEX} select * from x")
def keyed_index(spark, d):
    return _entries(spark, d)


@query("J16_clause_lookup", f"with {_LOOKUP} select * from hits")
def clause_lookup(spark, d):
    return clauses.lookup(questions(spark, d), _entries(spark, d))


@query(
    "J17_clause_lookup_by_terms",
    rf"""with {_INDEX}, q as (select query_id, lower(query) as query from ({QUESTIONS_SQL})), a as (select q.query_id, x.* from q join x on q.query = x.key),
 n as (select query_id, unnest(list_filter(string_split_regex(query, '\s+'), lambda y: y <> '')) as needle from q where query_id not in (select query_id from a)),
 b as (select distinct n.query_id, x.* from n join x on contains(x.key, n.needle))
 select * from (select query_id, cast(row_number() over (partition by query_id order by confidence desc, key) as integer) as rank, key, clause, doc_id, confidence from (select * from a union all select * from b)) where rank <= {clauses.MOST}""",
)
def clause_terms(spark, d):
    return clauses.lookup_terms(questions(spark, d), _entries(spark, d))


_ABOUT = rf"(regexp_matches(query, '{clauses.ABOUT_CLAUSES}') or (({' or '.join(f'contains(query, {chr(39)}{w}{chr(39)})' for w in clauses.CLAUSE_WORDS)}) and regexp_matches(query, '\d')))"


@query("J18_fast_path", f"with {_LOOKUP} select q.query_id, case when {_ABOUT} then coalesce(c.n, 0) else 0 end as hits, {_ABOUT} and coalesce(c.n, 0) >= 2 as fast from q left join (select query_id, count(*) as n from hits group by query_id) c using (query_id)")
def fast_path(spark, d):
    return clauses.fast_path(questions(spark, d), _entries(spark, d))


_FIRST = "coalesce(" + ", ".join(rf"case when regexp_matches(query, '{k}\s+\d') then '{k} ' || regexp_extract(query, '{k}\s+{n}', 1) end" for k, n in clauses.SCANNED.items()) + ")"


@query(
    "J19_clause_scan",
    f"""with q as (select query_id, {_FIRST} as needle from (select query_id, lower(query) as query from ({QUESTIONS_SQL}))), w as (select distinct needle from q where needle is not null),
 r as (select needle, n as doc_id, cast(row_number() over (partition by needle order by n) as integer) as rank from w join (select n, lower(text) as low from corpus where true_vertical = 'legal') c on contains(c.low, w.needle))
 select query_id, needle, rank, doc_id from q join r using (needle) where rank <= 3""",
)
def clause_scan(spark, d):
    return clauses.scan(questions(spark, d), corpus(spark, d).where("true_vertical = 'legal'").select(F.col("n").alias("doc_id"), "text"))


# ---- files

PATHS_SQL = """select concat(case o_orderkey % 3 when 0 then 'Orders/' when 1 then 'acts/2019/' else 'misc files/' end, case when o_orderkey % 4 = 0 then concat(cast(o_orderkey * 37 as string), '_') else '' end,
 case o_orderkey % 5 when 0 then 'SE_MS' when 1 then 'Fin MS' else 'rules-' end, cast(o_orderkey as string), case o_orderkey % 7 when 0 then '_E.PDF' when 1 then '.docx' else '_final.pdf' end) as path from {orders}"""
NAMES_SQL = """select concat(case c_custkey % 4 when 0 then '5294663_' else '' end, case c_custkey % 3 when 0 then 'se_ms' when 1 then 'FIN_MS' else 'Rules_' end, cast(c_custkey as string), case c_custkey % 5 when 0 then '_E.pdf' when 1 then '_final.PDF' when 2 then '.pdf' else '' end) as name from {customer}"""


@query(
    "S45_stored_files",
    rf"""with p as (select distinct path, lower(path) as low, replace(replace(lower(path), '.pdf', ''), '_', '') as base from ({PATHS_SQL.format(orders='orders')})), n as (select distinct name, lower(name) as low, replace(replace(lower(name), '.pdf', ''), '_', '') as base from ({NAMES_SQL.format(customer='customer')})),
 x as (select name, min(path) as path from n join p on ends_with(p.low, n.low) group by name),
 y as (select name, path, row_number() over (partition by name order by length(path), path) as r from n join p on (regexp_matches(n.low, '^\d+_.') and ends_with(p.low, regexp_extract(n.low, '^\d+_(.*)$', 1)))
   or (ends_with(p.low, '.pdf') and (contains(replace(p.base, '/', ''), n.base) or (length(regexp_replace(n.base, '[^\p{{L}}\p{{N}}]', '', 'g')) > 5 and contains(regexp_replace(p.low, '[^\p{{L}}\p{{N}}]', '', 'g'), regexp_replace(n.base, '[^\p{{L}}\p{{N}}]', '', 'g'))))) where name not in (select name from x))
 select name, path, true as exact from x union all select name, path, false from y where r = 1""",
)
def stored_files(spark, d):
    return filefind.find(spark.sql(NAMES_SQL, customer=load(spark, d, "customer")), spark.sql(PATHS_SQL, orders=load(spark, d, "orders")))


# ---- hops

REFERRING_SQL = "select doc_id, concat(coalesce(text, ''), ' See GO Ms No ', cast(doc_id % 90 as string), ' and Section ', cast(doc_id % 41 as string), '.') as text from {documents}"
_HOP_DOCS = f"docs as ({REFERRING_SQL.format(documents='documents')}), t as (select doc_id, {_TERMS.format('text')} as t from docs), st as (select count(*) as n, avg(len(t)) as avgdl from t), p as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from t) group by doc_id, term), f as (select term, count(*) as df from p group by term)"
_HOP_TERMS = " || ".join(f"regexp_extract_all(text, '{p}', 0)[1:{hops.EACH}]" for p in hops.REFERENCES)


def _hop_sql(hop: int, k: int) -> str:
    """Searches of q{hop}, what of it is new as v{hop}, and the terms of the ten best as n{hop}."""
    seen = "".join(f" and (query_id, doc_id) not in (select query_id, doc_id from v{h})" for h in range(1, hop))
    return f"""w{hop} as (select query, term, count(*) as qtf from (select query, unnest({_TERMS.format('query')}) as term from (select distinct query from q{hop})) group by query, term),
 s{hop} as (select query, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from w{hop} join p using (term) join f using (term) cross join st group by query, doc_id),
 r{hop} as (select * from (select *, row_number() over (partition by query order by score desc, doc_id) as rank from s{hop}) where rank <= {k}),
 v{hop} as (select query_id, cast({hop} as integer) as hop, cast(rank as integer) as rank, doc_id, score from q{hop} join r{hop} using (query) where true{seen}),
 m{hop} as (select query_id, rank, {_HOP_TERMS} as terms from v{hop} join docs using (doc_id) where rank <= {hops.DOCUMENTS}),
 o{hop} as (select query_id, term, min(rank * 100 + pos) as place from (select query_id, rank, unnest(terms) as term, unnest(range(len(terms))) as pos from m{hop}) group by query_id, term),
 n{hop} as (select query_id, term, row_number() over (partition by query_id order by place) as place from o{hop}),
 q{hop + 1} as (select query_id, string_agg(term, ' ' order by place) as query from n{hop} where place <= {hops.TERMS} group by query_id)"""


def _referring(spark, d):
    """Documents with references, and a stored index of them."""
    docs = spark.sql(REFERRING_SQL, documents=load(spark, d, "documents"))
    path = files.work_path(spark, "hop-index")
    stored_index.add(docs, path)
    return docs, path


@query("J30_second_hop_queries", f"with {_HOP_DOCS}, q1 as ({ASKED_SQL}), {_hop_sql(1, hops.DOCUMENTS)} select query_id, cast(place as integer) as place, term from n1 where place <= {hops.QUERIES}")
def second_hop(spark, d):
    docs, path = _referring(spark, d)
    first = hops.search(asked(spark, d), docs, path, hops=1, k=hops.DOCUMENTS)
    return hops.next_terms(first.join(hops.referring(docs), "doc_id"), hops.QUERIES)


@query("J31_multi_hop", f"with {_HOP_DOCS}, q1 as ({ASKED_SQL}), {', '.join(_hop_sql(h, 20) for h in (1, 2, 3))} select * from v1 union all select * from v2 union all select * from v3")
def multi_hop(spark, d):
    docs, path = _referring(spark, d)
    return hops.search(asked(spark, d), docs, path, hops=3)


# ---- reverse edges and chains

_LISTED = "select cast(floor(n / 100) as bigint) as query_id, row_number() over (partition by floor(n / 100) order by n * 7919 % 1000 desc, n) as rank, doc_id, concat('G.O.MS.No.', cast(n as string)) as target, cast(n * 7919 % 1000 as double) / 1000 as score from {corpus}"


@query(
    "J25_J26_nested_reverse_edges",
    f"""with e as (select target, relation_type as type, source_id as doc_id, row_number() over (partition by target, relation_type order by source_id) as r from (select distinct source_id, relation_type, target from ({_all_relations}))), l as ({_LISTED.format(corpus='corpus')}),
 old as (select distinct target from e where type = 'supersedes')
 select query_id, doc_id, round(case when rank <= 10 and target in (select target from old) then score * 0.3 else score end, 6) as score, cast(null as varchar) as via, cast(null as varchar) as of from l
 union all select l.query_id, e.doc_id, case e.type when 'supersedes' then cast(1.5 as double) else 1.2 end, e.type, l.doc_id from l join e using (target) where rank <= 10 and e.r <= 5 and e.type in ('supersedes', 'amends')""",
)
def nested_reverse_edges(spark, d):
    """Result lists of a hundred documents each, with what supersedes or amends their first ten."""
    edges = relations.inverted(relations.nested(_relations(spark, d)))
    listed = spark.sql(_LISTED, corpus=corpus(spark, d))
    return relations.with_reverse_edges(listed, edges).withColumn("score", F.round("score", 6))


@query(
    "J29_current_versions",
    f"""with s as ({_SUPERSESSION}), r as (select doc_id, superseded_by as current, cast(1 as bigint) as steps from s where superseded_by not in (select doc_id from s) union all select s.doc_id, r.current, r.steps + 1 from s join r on s.superseded_by = r.doc_id)
 select s.doc_id, r.current, r.steps, r.doc_id is null as looped from s left join r using (doc_id)""",
)
def current_versions(spark, d):
    return relations.current_versions(_superseded(spark, d))


ORACLE["J29_current_versions"] = ORACLE["J29_current_versions"].replace("with ", "with recursive ", 1)

# ---- joins by time


@query("T5_last_error_before", "select l.event_id, r.event_id as found_event_id, r.value as found_value from (select * from events where event_type <> 'error') l asof left join (select * from events where event_type = 'error') r on l.user_id = r.user_id and l.ts >= r.ts")
def last_error(spark, d):
    """For each event the user's last error until then."""
    e = load(spark, d, "events")
    return temporal.as_of(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), "user_id", "ts", "ts", ["event_id", "value"]).select("event_id", "found_event_id", "found_value")


@query(
    "T6_order_in_force",
    """with f as (select o_custkey, o_orderkey as in_force, o_orderdate as since, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as until from orders)
    select l_orderkey, l_linenumber, l_shipdate, in_force from (select l_orderkey, l_linenumber, l_shipdate, o_custkey from lineitem join orders on l_orderkey = o_orderkey) p join f using (o_custkey) where since <= l_shipdate and (until is null or l_shipdate < until)""",
)
def in_force(spark, d):
    """For each shipment the customer's order that was the newest then: an order is in force until the next one."""
    o = load(spark, d, "orders")
    next_ = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    spans = o.select("o_custkey", F.col("o_orderkey").alias("in_force"), F.col("o_orderdate").alias("since"), next_.alias("until"))
    points = load(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    return temporal.during(points, spans, "o_custkey", "l_shipdate", "since", "until").select("l_orderkey", "l_linenumber", "l_shipdate", "in_force")


# ---- a bounded cache

_BATCHES, _KEPT = 4, 100


def _fifo_sql() -> str:
    parts = ["d as (select sha256(text) as key, doc_id as place, cast(doc_id % 4 as integer) as batch from documents)", "c0 as (select key, batch, place from d where false)"]
    for b in range(_BATCHES):
        parts.append(f"a{b} as (select d.key, d.batch, d.place, c.key is not null as hit from d left join c{b} c on c.key = d.key where d.batch = {b})")
        parts.append(f"c{b + 1} as (select * from (select * from c{b} union all select key, cast({b} as integer) as batch, min(place) as place from a{b} where not hit and key is not null group by key) order by batch desc, place desc, key limit {_KEPT})")
    return f"with {', '.join(parts)} " + " union all ".join(f"select batch, place as doc_id, hit from a{b}" for b in range(_BATCHES))


@query("S37_fifo_cache", _fifo_sql())
def fifo_cache(spark, d):
    """Documents in four batches that ask a cache of a hundred entries."""
    cache, out = spark.createDataFrame([], fifo.SCHEMA), None
    docs = load(spark, d, "documents").select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("place"))
    for b in range(_BATCHES):
        answers, cache = fifo.request(cache, docs.where(F.col("place") % _BATCHES == b), b, _KEPT)
        answers, cache = files.written(answers, "answers"), files.written(cache, "cache")
        out = (lambda x: x if out is None else out.unionByName(x))(answers.select(F.lit(b).alias("batch"), F.col("place").alias("doc_id"), "hit"))
    return out
