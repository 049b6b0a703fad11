"""Queries that normalise, rewrite and widen questions, over all users' turns and a question for each customer, with checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalizer, rewriting
from tessera.functions import vocabulary as words
from tessera.operators import expansion
from tessera.plans.query_queries import ASKED_SQL, asked
from tessera.sources.tables import CORPUS_SQL, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A question for each customer, in the forms that normalisation, rewriting and expansion tell apart; {k} is the customer's number.
POLICY_SQL = """select -c_custkey as query_id, concat(case c_custkey % 14 when 0 then 'SHOW ME  GO.Ms.No.' when 1 then 'Explain   RTE  Section 12(1)(c) and l copy , please; see section ' when 2 then 'What are CWSN, MDM and FLN provisions? ... of O block '
 when 3 then 'How to integrate AI in the school curriculum and syllabus of class ' when 4 then 'What are all education policies of the state since 20' when 5 then 'Latest   education policies in Andhra Pradesh !!? No. '
 when 6 then 'Requirements for School Infrastructure: toilets,drinking water and boundary walls ; unit ' when 7 then 'List all types of scholarship and hostel for disabled children in ward ' when 8 then 'Which sub-rule of the admission rules is Rule '
 when 9 then 'Article 21a and the cce act , clause ' when 10 then 'teacher transfer and training committe; GO Rt No 7 and G.O. ' when 11 then 'naadu nedu for out-of-school children AND ammavadi, goverment quality education ' when 12 then 'technology integration and digital coding, robotics; recieve GO MS No '
 else 'rte section 13, year 2019 and section ' end, cast(c_custkey % 40 as string), case c_custkey % 3 when 0 then ' details!!! in 2021' when 1 then '(2)(b)' else '' end) as query from {customer}"""
QUESTIONS_SQL = f"select query_id, query from ({ASKED_SQL}) union all select query_id, query from ({POLICY_SQL.format(customer='customer')})"


def questions(spark, d):
    every = asked(spark, d).unionByName(spark.sql(POLICY_SQL, customer=load(spark, d, "customer")).select(F.col("query_id").cast("long").alias("query_id"), "query"))
    # (the files are small, what is computed of each question is not: dealt to all cores, three tasks each)
    return every.repartition(3 * spark.sparkContext.defaultParallelism, "query_id")


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = oracle(sql)
        return f

    return add


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def _any_sql(col: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({col}, {_text(p)})" for p in patterns) + ")"


# ---- normalisation

_S, _W = normalizer.SPACE, normalizer.WORD
_CLEAN = lambda q: f"regexp_replace(trim(regexp_replace({q}, '{_S}+', ' ', 'g')), '([!?.]){{2,}}', '\\1', 'g')"
_TABLE = "map([" + ", ".join(map(_text, words.ABBREVIATIONS)) + "], [" + ", ".join(map(_text, words.ABBREVIATIONS.values())) + "])"
_BARE = "rtrim(w, '.,!?;:')"
_EXPAND = lambda q: f"array_to_string(list_transform(list_filter(string_split_regex({q}, '{_S}+'), lambda w: w <> ''), lambda w: coalesce({_TABLE}[{_BARE}] || substr(w, length({_BARE}) + 1), w)), ' ')"
_MARKS = lambda q: f"trim(regexp_replace(regexp_replace({q}, '[\\t\\n\\r ]+', ' ', 'g'), ' *([,;:.!?]) *', '\\1 ', 'g'))"


def _spelling(q: str) -> str:
    outside = f"[^{_W[1:-1]}]"
    for letter, digit in (("l", "1"), ("o", "0")):
        for _ in range(2):  # neighbours share the character between them
            q = f"regexp_replace({q}, '(^|{outside})(?i:{letter})({outside}|$)', '\\1{digit}\\2', 'g')"
    for wrong, right in words.SPELLINGS:
        q = f"replace({q}, '{wrong}', '{right}')"
    return q


def normal_sql(source: str) -> str:
    """query_id, query, clean and normal of each query in source."""
    return f"""select query_id, query, clean, trim(array_to_string(list_transform(string_split(marked, '{normalizer.MASK}'), lambda part, i: part || coalesce(spans[i], '')), '')) as normal from (
      select query_id, query, clean, spans, {_MARKS(_spelling('expanded'))} as marked from (
        select query_id, query, clean, regexp_extract_all(clean, {_text(normalizer.SPANS)}, 1) as spans, {_EXPAND(f"lower(regexp_replace(clean, {_text(normalizer.SPANS)}, '{normalizer.MASK}', 'g'))")} as expanded
        from (select query_id, query, {_CLEAN("coalesce(query, '')")} as clean from {source})))"""


@query("C16_C18_expanded_queries", f"select query_id, normal as expanded from ({normal_sql(f'({QUESTIONS_SQL})')})")
def normalized(spark, d):
    return questions(spark, d).select("query_id", normalizer.normalize_query(F.col("query")).alias("expanded"))


@query(
    "C19_variants",
    f"select distinct query_id, unnest([normal, {_MARKS('lower(clean)')}, {_EXPAND('normal')}]) as variant from ({normal_sql(f'({QUESTIONS_SQL})')})",
)
def variants(spark, d):
    return questions(spark, d).select("query_id", F.explode(normalizer.variants(F.col("query"))).alias("variant"))


# ---- rewrites

_DOMAIN_ROWS = ", ".join(f"({i}, {_text(d)}, {_list(ts)})" for i, (d, ts) in enumerate(words.DOMAINS.items()))
_DEFAULT_ROWS = ", ".join(f"({i}, {_text(d)})" for i, d in enumerate(words.DEFAULT_DOMAINS))
_PATTERN = f"case when {_any_sql('lower(query)', rewriting.LEGAL)} then 'legal_clause' " + " ".join(f"when regexp_matches(lower(query), {_text(p)}) then '{k}'" for k, p in rewriting.PATTERNS.items()) + " else 'general' end"
_TERMS = f"list_slice(list_filter(regexp_extract_all(lower(query), '({_W}+)', 1), lambda w: length(w) > 2 and w not in ({', '.join(map(_text, words.REWRITE_STOPWORDS))})), 1, 5)"
_SCORE = "list_sum(list_transform(list_filter(v.terms, lambda t: contains(lower(q.query), lower(t))), lambda t: len(string_split(t, ' '))))"
_NUMBER = f"case when regexp_extract(lower(query), {_text(rewriting.CLAUSE)}, 1) = '' then '12' else regexp_extract(lower(query), {_text(rewriting.CLAUSE)}, 1) end"
_LEGAL = (
    "case when contains(lower(query), 'rte') or contains(lower(query), 'right to education') then 'Right to Education Act 2009 Section ' || number || ' responsibilities of schools' || "
    + "case number "
    + " ".join(f"when '{n}' then {_text(' ' + ' '.join(ws))}" for n, ws in words.SECTION_WORDS.items())
    + " else '' end when contains(lower(query), 'rule') then 'AP ' || case when contains(lower(query), 'rte') then 'RTE' when contains(lower(query), 'cce') then 'CCE' when contains(lower(query), 'admission') then 'Admission' else 'Education' end || ' Rule ' || number || ' detailed provisions' "
    "else case when contains(lower(query), 'cce') then 'CCE' when contains(lower(query), 'apsermc') then 'APSERMC' when contains(lower(query), 'education') then 'Education' else 'Act' end || ' Act Section ' || number || ' legal provisions' end"
)


def rewrites_sql(source: str, most: int) -> str:
    """query_id, place, domain and rewrite of each query in source."""
    return f"""with q as (select query_id, query, {_PATTERN} as kind, {_any_sql('lower(query)', rewriting.BROAD)} as broad, array_to_string({_TERMS}, ' ') as terms, {_NUMBER} as number from {source}),
     v as (select * from (values {_DOMAIN_ROWS}) t(place, domain, terms)),
     s as (select q.query_id, v.place, v.domain, v.terms, coalesce({_SCORE}, 0) as score, q.broad from q cross join v),
     c as (select query_id, domain, terms, row_number() over (partition by query_id order by case when broad then 0 else -score end, place) - 1 as place from s where broad or score > 0
       union all select query_id, t.domain, [], t.place from (values {_DEFAULT_ROWS}) t(place, domain) cross join (select query_id from s group by query_id having max(score) = 0 and not bool_or(broad))),
     r as (select q.query_id, c.place, case when kind = 'legal_clause' then 'legal' else domain end as domain,
       case kind when 'legal_clause' then {_LEGAL} when 'what_is' then q.terms || ' ' || replace(domain, '_', ' ') || ' policy provisions' when 'how_to' then 'Implementation of ' || q.terms || ' in ' || replace(domain, '_', ' ')
        when 'requirements' then q.terms || ' ' || replace(domain, '_', ' ') || ' requirements standards' when 'list' then 'All ' || q.terms || ' related to ' || replace(domain, '_', ' ')
        else query || ' ' || coalesce(array_to_string(list_slice(c.terms, 1, 3), ' '), '') end as rewrite from q join c on c.query_id = q.query_id where c.place < {most})
     select query_id, cast(place as integer) as place, domain, rewrite from r
     union all select q.query_id, n, 'comprehensive', terms || ' comprehensive {' '.join(words.CROSS_DOMAIN)}' from q join (select query_id, cast(count(*) as integer) as n from r group by query_id) k on k.query_id = q.query_id where n < {most}"""


@query("Q1_Q4_rewrites", rewrites_sql(f"({QUESTIONS_SQL})", 3))
def rewrites(spark, d):
    return rewriting.rewritten(questions(spark, d), most=3).select("query_id", "place", "domain", "rewrite")


@query("Q1_Q5_deep_rewrites", rewrites_sql(f"({QUESTIONS_SQL})", 5))
def deep_rewrites(spark, d):
    return rewriting.rewritten(questions(spark, d), most=5).select("query_id", "place", "domain", "rewrite")


@query("Q2_rewrite_pattern", f"select query_id, {_PATTERN} as pattern, {_any_sql('lower(query)', rewriting.BROAD)} as broad from ({QUESTIONS_SQL})")
def patterns(spark, d):
    return questions(spark, d).select("query_id", rewriting.pattern(F.col("query")).alias("pattern"), rewriting.is_broad(F.col("query")).alias("broad"))


@query(
    "Q3_Q5_domains",
    f"with q as ({QUESTIONS_SQL}), s as (select q.query_id, v.place, v.domain, coalesce({_SCORE}, 0) as score from q cross join (values {_DOMAIN_ROWS}) v(place, domain, terms)) select query_id, coalesce(string_agg(domain, ',' order by score desc, place) filter (where score > 0), '{','.join(words.DEFAULT_DOMAINS)}') as domains from s group by query_id",
)
def domains(spark, d):
    return questions(spark, d).select("query_id", F.array_join(rewriting.target_domains(F.col("query")), ",").alias("domains"))


@query("Q5_legal_clauses", f"select query_id, {_LEGAL} as clause from (select query_id, query, {_NUMBER} as number from ({QUESTIONS_SQL})) where {_any_sql('lower(query)', rewriting.LEGAL)}")
def legal_clauses(spark, d):
    q = questions(spark, d).where(rewriting.pattern(F.col("query")) == "legal_clause")
    return q.select("query_id", rewriting.legal_clause(F.col("query")).alias("clause"))


@query("Q6_key_terms", f"select query_id, array_to_string({_TERMS}, ' ') as terms from ({QUESTIONS_SQL})")
def key_terms(spark, d):
    return questions(spark, d).select("query_id", F.array_join(rewriting.key_terms(F.col("query")), " ").alias("terms"))


# ---- expansion: the fixed entries, and what follows words and pairs of words in the benchmark's passages

_FIXED_ROWS = ", ".join(f"('{kind}', {_text(k.lower())}, {i}, {_text(e)})" for kind, table in (("phrase", words.PHRASES), ("term", words.V1_SYNONYMS)) for k, es in table.items() for i, e in enumerate(es, 1))
DICTIONARY_SQL = f"""select kind, key, place, expansion from (values {_FIXED_ROWS}) f(kind, key, place, expansion) union all
 select kind, key, cast(row_number() over (partition by kind, key order by length(expansion) desc, expansion) as integer), expansion from (
  select distinct 'term' as kind, w as key, n1 as expansion from b where length(w) >= 4 and n1 is not null union select distinct 'phrase', w || ' ' || n1, n2 || ' ' || n3 from b where n3 is not null)"""
_WORDS_SQL = "select item_id, i, w, lead(w) over o as n1, lead(w, 2) over o as n2, lead(w, 3) over o as n3 from (select item_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select item_id, regexp_extract_all(lower(text), '(\\p{L}+)', 1) as ws from benchmark)) window o as (partition by item_id order by i)"
_WITH = f"b as ({_WORDS_SQL}), dict as ({DICTIONARY_SQL})"


def dictionary(spark, d):
    each = load(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("ws")).select(
        "item_id", F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("w"), F.get("ws", i + 1).alias("n1"), F.get("ws", i + 2).alias("n2"), F.get("ws", i + 3).alias("n3")))).alias("e")
    )
    b = each.select("e.*")
    terms = b.where("length(w) >= 4 and n1 is not null").select(F.lit("term").alias("kind"), F.col("w").alias("key"), F.col("n1").alias("expansion"))
    phrases = b.where("n3 is not null").select(F.lit("phrase").alias("kind"), F.concat_ws(" ", "w", "n1").alias("key"), F.concat_ws(" ", "n2", "n3").alias("expansion"))
    derived = terms.unionByName(phrases).distinct().selectExpr("kind", "key", "cast(row_number() over (partition by kind, key order by length(expansion) desc, expansion) as int) as place", "expansion")
    return expansion.fixed_dictionary(spark).unionByName(derived)


def found_sql(source: str) -> str:
    """query_id, query and found (expansions of all keys in the query, not there yet, longest first)."""
    # (words between blanks; patterns made of each key would be compiled for each pair)
    apart = f"' ' || regexp_replace(lower(q.query), '[^{_W[1:-1]}]', ' ', 'g') || ' '"
    return f"""select q.query_id, q.query, coalesce(h.found, []) as found from {source} q left join (
      select query_id, list(expansion order by length(expansion) desc, expansion) as found from (
        select distinct q.query_id, e.expansion from {source} q join dict e on contains(lower(q.query), lower(e.key)) and not contains(lower(q.query), lower(e.expansion))
          and (e.kind = 'phrase' or contains({apart}, ' ' || lower(e.key) || ' '))) group by query_id) h on h.query_id = q.query_id"""


_HAS = lambda ws, q="query": "(" + " or ".join(f"contains(lower({q}), {_text(w)})" for w in ws) + ")"
_IS_AI = f"({_HAS(words.AI_SIGNS)} and ({_HAS(words.CURRICULUM_SIGNS)} or contains(lower(query), 'integration')))"


def expanded_sql(source: str, most: str) -> str:
    """query_id, query and expanded of each row of found_sql's source; most is SQL for the cap."""
    ai = f"list_transform(list_slice(list_sort(list_transform(list_filter(list_concat({_list(words.AI_TERMS)}, found), lambda t: not contains(lower(query), lower(t))), lambda t, i: {{'w': len(string_split(t, ' ')), 'n': length(t), 'i': i, 't': t}})), 1, 2 * {most}), lambda s: s.t)"
    return f"""select * exclude (chosen), query || case when len(chosen) > 0 then ' ' || array_to_string(chosen, ' ') else '' end as expanded
      from (select *, case when {_IS_AI} then {ai} else list_slice(found, 1, {most}) end as chosen from ({found_sql(source)}))"""


@query("Q8_Q12_synonym_expansion", f"with {_WITH}, q as ({QUESTIONS_SQL}) select query_id, expanded from ({expanded_sql('q', '10')})")
def synonym_expansion(spark, d):
    return expansion.expand_query(questions(spark, d), dictionary(spark, d), 10).select("query_id", "expanded")


@query("Q8_found_terms", f"with {_WITH}, q as ({QUESTIONS_SQL}) select query_id, array_to_string(found, '|') as found from ({found_sql('q')})")
def found_terms(spark, d):
    """All expansions, with a dictionary over several automata."""
    out = expansion.expansions(questions(spark, d), dictionary(spark, d), limit=20_000)
    return out.select("query_id", F.array_join("found", "|").alias("found"))


@query("Q9_technology_questions", f"with {_WITH}, q as (select * from ({QUESTIONS_SQL}) where {_IS_AI}) select query_id, expanded from ({expanded_sql('q', '3')})")
def technology_questions(spark, d):
    return expansion.expand_query(questions(spark, d).where(expansion.is_technology(F.col("query"))), dictionary(spark, d), 3).select("query_id", "expanded")


_CATEGORY_ROWS = ", ".join(f"({_text(c)}, {_text(t)})" for c, ts in words.CATEGORY_TERMS.items() for t in ts)
_CATEGORY_HITS = "[" + ", ".join(f"case when {' or '.join(f'contains(lower(query), {_text(t)})' for t in ts)} then {_text(c)} end" for c, ts in words.CATEGORY_TERMS.items()) + "]"


@query(
    "Q10_category_expansion",
    f"""with {_WITH}, q as (select query_id, query, list_filter({_CATEGORY_HITS}, lambda c: c is not null) as cats from ({QUESTIONS_SQL})),
     t as (select c.category, e.expansion from (values {_CATEGORY_ROWS}) c(category, term) join dict e on e.kind = 'term' and e.key = c.term and e.place <= 3),
     h as (select distinct q.query_id, t.expansion from (select query_id, query, unnest(cats) as category from q) q join t on t.category = q.category where not contains(lower(q.query), lower(t.expansion))),
     l as (select query_id, array_to_string(list_slice(list(expansion order by length(expansion) desc, expansion), 1, 10), ' ') as more from h group by query_id)
     select q.query_id, q.query || coalesce(' ' || l.more, '') as expanded from q left join l on l.query_id = q.query_id""",
)
def category_expansion(spark, d):
    low = F.lower("query")
    hits = F.array_compact(F.array(*[F.when(expansion._one_of(low, ts), c) for c, ts in words.CATEGORY_TERMS.items()]))
    return expansion.expand_with_categories(questions(spark, d).withColumn("categories", hits), dictionary(spark, d)).select("query_id", "expanded")


def _v1_sql() -> str:
    none = "cast([] as varchar[])"
    parts = [f"case when {_HAS(t)} then {_list(ws[:8])} else {none} end" for t, ws in words.V1_RULES]
    parts.append(f"case when {_HAS(words.V1_AI)} and {_HAS(words.V1_CURRICULUM)} then {_list(words.V1_AI_TERMS)} else {none} end")
    return f"list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]}))"


_V1_RULES = " + ".join([f"cast({_HAS(t)} as integer)" for t, _ in words.V1_RULES] + [f"cast({_HAS(words.V1_AI)} and {_HAS(words.V1_CURRICULUM)} as integer)"])
_V1 = f"select *, query || case when len(kw) > 0 then ' ' || array_to_string(kw, ' ') else '' end as wide from (select *, list_slice(list_filter(every, lambda x, i: list_position(every, x) = i), 1, 8) as kw from (select query_id, query, {_v1_sql()} as every from ({QUESTIONS_SQL})))"


@query("Q11_first_expander", f"select query_id, wide as expanded, cast(len(kw) as integer) as added, least(1.0, round((select cast({_V1_RULES} as double)) * 0.4, 6)) as confidence from ({_V1})")
def first_expander(spark, d):
    q = F.col("query")
    out = questions(spark, d).withColumn("kw", expansion.v1_keywords(q))
    return out.select("query_id", expansion.appended(q, F.col("kw")).alias("expanded"), F.size("kw").alias("added"), expansion.v1_confidence(q).alias("confidence"))


_SYNONYMS = "[" + ", ".join(f"case when contains(lower(wide), {_text(t.lower())}) then {_text(s[0])} end" for t, s in words.V1_SYNONYMS.items()) + "]"
_ENTITY_TEXT = "concat_ws(' ', case when len(sections) > 0 then 'Section ' || array_to_string(sections, ', ') end, case when len(years) > 0 then 'Year ' || array_to_string(years, ', ') end)"


@query(
    "Q12_enhanced",
    f"""select query_id, mode, trim(wide || case when len(syn) > 0 then ' ' || array_to_string(list_slice(syn, 1, 3), ' ') else '' end || case when entity_text <> '' then ' ' || entity_text else '' end || case mode when 'deep_think' then {_text(' ' + words.V1_MODE_WORDS['deep_think'])} when 'brainstorm' then {_text(' ' + words.V1_MODE_WORDS['brainstorm'])} else '' end) as enhanced
     from (select *, {_ENTITY_TEXT} as entity_text from (select query_id, wide, list_filter({_SYNONYMS}, lambda s: s is not null) as syn, regexp_extract_all(query, '(?i)section\\s+(\\d+)', 1) as sections, regexp_extract_all(query, '\\b((?:19|20)\\d{{2}})\\b', 1) as years from ({_V1}))) cross join (values ('qa'), ('deep_think'), ('brainstorm')) m(mode)""",
)
def enhanced(spark, d):
    q = F.col("query")
    listed = lambda label, p: F.when(F.regexp_like(q, F.lit(p)), F.concat(F.lit(label), F.array_join(F.regexp_extract_all(q, F.lit(p), F.lit(1)), ", ")))
    found = F.concat_ws(" ", listed("Section ", r"(?i)section\s+(\d+)"), listed("Year ", r"\b((?:19|20)\d{2})\b"))
    out = questions(spark, d).withColumn("found", found).withColumn("mode", F.explode(F.array(F.lit("qa"), F.lit("deep_think"), F.lit("brainstorm"))))
    return out.select("query_id", "mode", expansion.enhance(q, F.col("found"), F.col("mode")).alias("enhanced"))


# ---- everything in a row

CONTEXT_GO = r"(?i)G\.?O\.?\s*(?:Ms\.?|Rt\.?|P\.?)?[\s.]?(?:No\.?|Number)?\s*\d+"
CONTEXT_ACT = r"(?:The\s+)?([A-Z][a-zA-Z\s]+Act(?:,?\s+\d{4})?)"


def context_entities(text):
    """Orders and acts that an uploaded text names, each once, orders first."""
    acts = F.filter(F.regexp_extract_all(text, F.lit(CONTEXT_ACT), F.lit(1)), lambda a: (F.length(a) > 10) & (F.length(a) < 50))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(CONTEXT_GO), F.lit(0)), acts))


def understood(queries, entries, most: int = 3, qa: bool = False):
    """queries (query_id, query, context) as the list that is searched: the normalised query, its rewrites, what the context names; each widened by up to 3 (questions and answers), 10 (five rewrites or more) or 8 terms."""
    normal = queries.select("query_id", "context", normalizer.normalize_query(F.col("query")).alias("query"))
    own = F.array(F.struct(F.lit("normalized").alias("origin"), F.col("query").alias("text")))
    made = F.transform(rewriting.rewrites(F.col("query"), 1 if qa else most), lambda r: F.struct(r["domain"].alias("origin"), r["text"].alias("text")))
    named = F.transform(context_entities(F.coalesce(F.col("context"), F.lit(""))), lambda e: F.struct(F.lit("context").alias("origin"), e.alias("text")))
    # (no list is empty; without _outer Spark would add a filter that computes every list twice more)
    each = normal.select("query_id", F.posexplode_outer(F.concat(own, made, named)).alias("place", "one")).select("query_id", "place", "one.origin", F.col("one.text").alias("rewrite"))
    return expansion.expand_query(each, entries, 3 if qa else 10 if most >= 5 else 8, "rewrite")


def _understood_sql(most: int, cap: int) -> str:
    return f"""with {_WITH}, n as (select query_id, normal as query from ({normal_sql(f'({QUESTIONS_SQL})')})), r as ({rewrites_sql('n', most)}),
     x as (select n.query_id, list_concat(regexp_extract_all(c.text, {_text(CONTEXT_GO)}), list_filter(regexp_extract_all(c.text, {_text(CONTEXT_ACT)}, 1), lambda a: length(a) > 10 and length(a) < 50)) as named from n join corpus c on c.n = n.query_id),
     k as (select query_id, count(*) as made from r group by query_id),
     e as (select x.query_id, name, row_number() over (partition by x.query_id order by i) as p from (select query_id, unnest(named) as name, generate_subscripts(named, 1) as i, named from x) x where list_position(named, name) = i),
     a as (select query_id, 0 as place, 'normalized' as origin, query as rewrite from n union all select query_id, place + 1, domain, rewrite from r
       union all select e.query_id, made + p, 'context', name from e join k on k.query_id = e.query_id),
     q as (select query_id * 1000 + place as query_id, rewrite as query from a)
     select a.query_id, cast(a.place as integer) as place, origin, rewrite, expanded from a join ({expanded_sql('q', str(cap))}) w on w.query_id = a.query_id * 1000 + a.place"""


def _with_context(spark, d):
    # texts are made of the orders that questions name, so that the others' are neither shuffled nor broadcast; then dealt, since the join may leave few tasks
    every = questions(spark, d)
    named = load(spark, d, "orders").join(every.select(F.col("query_id").alias("o_orderkey")), "o_orderkey", "left_semi")
    texts = spark.sql(CORPUS_SQL, orders=named).select(F.col("n").cast("long").alias("query_id"), F.col("text").alias("context"))
    return every.join(texts, "query_id", "left").repartition(3 * spark.sparkContext.defaultParallelism)


@query("Q13_understood", _understood_sql(3, 8))
def understood_queries(spark, d):
    return understood(_with_context(spark, d), dictionary(spark, d))


@query("Q13_understood_deep", _understood_sql(5, 10))
def understood_deep(spark, d):
    return understood(_with_context(spark, d), dictionary(spark, d), most=5)
