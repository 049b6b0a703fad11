"""Queries for the remaining classifiers, query entities, routing, lookups and answer parts, with checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import entities, interpret
from tessera.operators import answers, clauses, fusion
from tessera.plans.query_queries import ASKED_SQL, asked
from tessera.sources.tables import candidates, corpus, load, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


def flags(name: str, patterns: dict[str, str]) -> None:
    """One boolean column for each pattern over the lower-cased queries."""
    QUERIES[name] = lambda spark, d: asked(spark, d).select("query_id", *[F.lower("query").rlike(p).alias(c) for c, p in patterns.items()])
    ORACLE[name] = f"select query_id, {', '.join(f'regexp_matches(lower(query), {chr(39)}{p}{chr(39)}) as {c}' for c, p in patterns.items())} from ({ASKED_SQL})"


# fixed values: patterns of the three intents, of international topics and of what needs verification
INTENTS = {
    "comprehensive": [r"\b(design|create|build|develop|formulate|establish)\s+\w+", r"\b(all|complete|comprehensive|entire|full|every|total)\s+\w+\s+(for|required|needed|necessary)", r"\b(framework|structure|architecture|blueprint|roadmap|plan|strategy)\s+(for|of|to)"],
    "qa": [r"^\s*(what|who|when|where|which|how many|how much)\s+(is|are|was|were|does|do)", r"\bdefine\s+\w+", r"\b(section|article|rule|provision|clause)\s+\d+"],
    "brainstorm": [r"\b(innovative|creative|novel|new|fresh|modern|advanced)\s+(ideas|approaches|solutions|methods|ways)", r"\b(ideas|suggestions|recommendations|proposals)\s+(for|to|about)", r"\b(explore|brainstorm|ideate|think about|consider)"],
}
_SCORES = {k: " + ".join(f"cast(regexp_matches(lower(query), '{p}') as integer)" for p in ps) for k, ps in INTENTS.items()}


@query("K17_K18_intent", f"with s as (select query_id, {', '.join(f'least(0.3 * ({v}), 1.0) as {k}' for k, v in _SCORES.items())} from ({ASKED_SQL})) select query_id, case when greatest(comprehensive, qa, brainstorm) < 0.3 then 'qa' when comprehensive = greatest(comprehensive, qa, brainstorm) then 'deep_think' when qa = greatest(comprehensive, qa, brainstorm) then 'qa' else 'brainstorm' end as mode, round(cast(case when greatest(comprehensive, qa, brainstorm) < 0.3 then 0.6 else greatest(comprehensive, qa, brainstorm) end as double), 6) as confidence from s")
def intent(spark, d):
    s = {k: F.least(0.3 * interpret.votes(F.lower("query"), ps), F.lit(1.0)) for k, ps in INTENTS.items()}
    best = F.greatest(*s.values())
    mode = F.when(best < 0.3, "qa").when(s["comprehensive"] == best, "deep_think").when(s["qa"] == best, "qa").otherwise("brainstorm")
    return asked(spark, d).select("query_id", mode.alias("mode"), F.round(F.when(best < 0.3, 0.6).otherwise(best), 6).alias("confidence"))


@query("E16_temporal", rf"select query_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(query, '\b((?:19|20)\d{{2}})\b', 1), regexp_extract_all(lower(query), '\b(last\s+year|this\s+year|next\s+year|recent|current|previous)\b', 1)))), ',') as refs from ({ASKED_SQL})")
def temporal(spark, d):
    found = F.concat(F.regexp_extract_all("query", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), F.regexp_extract_all(F.lower("query"), F.lit(r"\b(last\s+year|this\s+year|next\s+year|recent|current|previous)\b"), F.lit(1)))
    return asked(spark, d).select("query_id", F.array_join(entities.tidy(found), ",").alias("refs"))


@query("E17_entity_places", "select doc_id, 'section' as kind, strpos(text, regexp_extract(text, '(?i)Section\\s+\\d+', 0)) - 1 as start, regexp_extract(text, '(?i)Section\\s+(\\d+)', 1) as value from corpus where regexp_matches(text, '(?i)Section\\s+\\d+')")
def places(spark, d):
    c = corpus(spark, d).where(F.col("text").rlike(r"(?i)Section\s+\d+"))
    return c.select("doc_id", F.lit("section").alias("kind"), (F.regexp_instr("text", F.lit(r"(?i)Section\s+\d+")) - 1).cast("long").alias("start"), F.regexp_extract("text", r"(?i)Section\s+(\d+)", 1).alias("value"))


@query("K2_cached_classification", "select doc_id, case when n % 3 = 0 then 'cached' else true_vertical end as vertical from corpus")
def cached(spark, d):
    c = corpus(spark, d)
    key = F.sha2(F.concat(F.lit("vertical:m:"), F.substring("text", 1, 3000)), 256)
    cache = c.where("n % 3 = 0").select(key.alias("key"), F.lit("cached").alias("hit"))
    return c.withColumn("key", key).join(cache, "key", "left").select("doc_id", F.coalesce("hit", "true_vertical").alias("vertical"))


@query("K19_K20_K22_category_counts", f"select c as category, count(*) as queries from (select unnest(list_filter([{', '.join(f'case when regexp_matches(lower(query), {chr(39)}' + '|'.join(ws) + f'{chr(39)}) then {chr(39)}{c}{chr(39)} end' for c, ws in interpret.CATEGORY_KEYWORDS.items())}], lambda x: x is not null)) as c from ({ASKED_SQL})) group by c")
def category_counts(spark, d):
    hits = F.array_compact(F.array(*[F.when(F.lower("query").rlike("|".join(ws)), c) for c, ws in interpret.CATEGORY_KEYWORDS.items()]))
    return asked(spark, d).select(F.explode(hits).alias("category")).groupBy("category").agg(F.count("*").alias("queries"))


@query("M11_provenance", """select chunk_id, '{' || concat_ws(',', '"doc_id":' || doc_id, '"vertical":"' || vertical || '"', '"section_type":"' || section_type || '"', '"date_issued_ts":' || date_issued_ts) || '}' as provenance from candidates""")
def provenance(spark, d):
    return candidates(spark, d).select("chunk_id", F.to_json(F.struct("doc_id", "vertical", "section_type", "date_issued_ts")).alias("provenance"))


@query("J4_global_order", "select query_id, chunk_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from (select *, row_number() over (partition by query_id, vertical order by score desc, chunk_id) as r from candidates) where r <= 10")
def global_order(spark, d):
    best = candidates(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "vertical").orderBy(F.desc("score"), "chunk_id"))).where("r <= 10")
    return fusion.ranked(best, "score").select("query_id", "chunk_id", "rank")


@query("J10_filters_of_entities", rf"select query_id, array_to_string(regexp_extract_all(lower(query), 'section\s+(\d+)', 1), ',') as section, array_to_string(regexp_extract_all(lower(query), 'go\s+ms\s+no\s+(\d+)', 1), ',') as go_number from ({ASKED_SQL})")
def entity_filters(spark, d):
    found = lambda p: F.array_join(F.regexp_extract_all(F.lower("query"), F.lit(p), F.lit(1)), ",")
    return asked(spark, d).select("query_id", found(r"section\s+(\d+)").alias("section"), found(r"go\s+ms\s+no\s+(\d+)").alias("go_number"))


@query("J14_clause_confidence", r"with m as (select doc_id, strpos(lower(text), regexp_extract(lower(text), 'section\s+\d+', 0)) - 1 as place, length(text) as size, contains(lower(text), 'education act') as known, lower(text) as t from corpus where regexp_matches(lower(text), 'section\s+\d+')) select doc_id, round(cast(least(1.0, 0.5 + case when known then 0.3 else 0 end + case when cast(place as double) / size < 0.1 then 0.2 when cast(place as double) / size < 0.3 then 0.1 else 0 end + least(0.2, 0.03 * (" + " + ".join(f"case when contains(t, '{w}') then 1 else 0 end" for w in clauses.LEGAL_TERMS) + "))) as double), 6) as confidence from m")
def clause_confidence(spark, d):
    c = corpus(spark, d).where(F.lower("text").rlike(r"section\s+\d+"))
    place = F.regexp_instr(F.lower("text"), F.lit(r"section\s+\d+")) - 1
    return c.select("doc_id", F.round(clauses.confidence(place, F.length("text"), F.lower("text").contains("education act"), F.col("text")), 6).alias("confidence"))


@query("J17_J19_clause_scan", r"with k as (select unnest(range(1, 31)) as n) select k.n, min(c.doc_id) as doc_id, count(distinct c.doc_id) as documents from k join (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), 'section\s+(\d+)', 1))) as s from corpus) c on c.s = cast(k.n as varchar) group by k.n")
def clause_scan(spark, d):
    named = corpus(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"section\s+(\d+)"), F.lit(1)))).alias("s")).withColumn("n", F.col("s").cast("long"))
    return spark.range(1, 31).withColumnRenamed("id", "n").join(named, "n").groupBy("n").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("documents"))


@query("J21_fetch_by_identifier", "select i.n, c.chunk_id from (select distinct n from (select doc_id % 40 as n from candidates)) i join candidates c on c.doc_id = i.n or c.chunk_id = i.n")
def fetch(spark, d):
    c = candidates(spark, d)
    ids = c.select((F.col("doc_id") % 40).alias("n")).distinct()
    by = lambda key: ids.join(c.select(F.col(key).alias("n"), F.col("chunk_id").alias("hit")), "n").select("n", F.col("hit").alias("chunk_id"))
    return by("doc_id").unionByName(by("chunk_id")).distinct()


ORACLE["J21_fetch_by_identifier"] = ORACLE["J21_fetch_by_identifier"].replace("select i.n, c.chunk_id", "select distinct i.n, c.chunk_id")


@query("F2_best_copy_of_fused", "with u as (select query_id, doc_id, chunk_id, score, 1.0 / (60 + row_number() over (partition by query_id order by score desc, chunk_id)) as part from candidates where chunk_id % 2 = 0 union all select query_id, doc_id, chunk_id, bm25, 1.0 / (60 + row_number() over (partition by query_id order by bm25 desc, chunk_id)) from candidates) select query_id, chunk_id, round(sum(part), 9) as rrf, max(score) as best from u group by query_id, chunk_id")
def best_copy(spark, d):
    c = candidates(spark, d)
    a = fusion.ranked(c.where("chunk_id % 2 = 0"), "score").select("query_id", "chunk_id", "score", "rank")
    b = fusion.ranked(c, "bm25").select("query_id", "chunk_id", F.col("bm25").alias("score"), "rank")
    u = a.unionByName(b)
    return u.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("best"))


_BROAD = "\\b(?:current|latest|all|comprehensive|complete|overall)\\s+(?:education\\s+)?polic|\\beducation\\s+(?:system|framework|structure|overview)\\b"


@query("Q14_Q17_vertical_routing", f"with f as (select query_id, regexp_matches(lower(query), '{_BROAD}') as broad, {', '.join(f'regexp_matches(lower(query), {chr(39)}{chr(92)}b(?:' + '|'.join(ws) + f'){chr(92)}b{chr(39)}) as {v}' for v, ws in interpret.V1_KEYWORDS.items())} from ({ASKED_SQL})) select query_id, array_to_string(list_filter([{', '.join(f'case when broad or {v} then {chr(39)}{v}{chr(39)} end' for v in interpret.VERTICAL_ORDER)}], lambda x: x is not null), ',') as verticals from f")
def vertical_routing(spark, d):
    low = F.lower("query")
    broad = low.rlike(_BROAD)
    every = F.array(*[F.when(broad | low.rlike(r"\b(?:" + "|".join(interpret.V1_KEYWORDS[v]) + r")\b"), v) for v in interpret.VERTICAL_ORDER])
    return asked(spark, d).select("query_id", F.array_join(F.array_compact(every), ",").alias("verticals"))


@query("W7_W17_enriched_and_suggested", "select query_id, cast(rank as integer) as rank, vertical || '/' || coalesce(section_type, 'none') as label, case when vertical in ('legal', 'go') then '' else 'Prioritize government/legal sources' end as suggestion from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from candidates) where rank <= 10")
def enriched(spark, d):
    return answers.top(candidates(spark, d), 10).select("query_id", "rank", F.concat("vertical", F.lit("/"), F.coalesce("section_type", F.lit("none"))).alias("label"), F.when(F.col("vertical").isin("legal", "go"), "").otherwise("Prioritize government/legal sources").alias("suggestion"))


@query("W11_formatted", r"select n, regexp_replace(regexp_replace('See GO MS No ' || n || ' [' || n % 30 || ']', 'GO\s+MS\s+No\s+(\d+)', 'G.O.Ms.No. \1', 'g'), '\[(2[0-9])\]', '[20]', 'g') as answer from corpus")
def formatted(spark, d):
    raw = F.concat(F.lit("See GO MS No "), F.col("n").cast("string"), F.lit(" ["), (F.col("n") % 30).cast("string"), F.lit("]"))
    return corpus(spark, d).select("n", F.regexp_replace(F.regexp_replace(raw, r"GO\s+MS\s+No\s+(\d+)", "G.O.Ms.No. $1"), r"\[(2[0-9])\]", "[20]").alias("answer"))


@query("S27_S28_failures_and_metrics", "select lang, count(*) as n, count(*) filter (where length(text) < 100) as failed, round(cast(count(*) filter (where length(text) >= 100) as double) / count(*), 6) as rate from documents group by lang")
def metrics(spark, d):
    good = F.length("text") >= 100
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~good).alias("failed"), F.round(F.count_if(good) / F.count("*"), 6).alias("rate"))


@query("S12_path_metadata", "select page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 2) as section, length(url) - length(replace(url, '/', '')) as depth from pages")
def path_metadata(spark, d):
    rest = F.regexp_replace("url", "^https?://", "")
    return load(spark, d, "pages").select("page_id", F.coalesce(F.get(F.split(rest, "/"), F.lit(1)), F.lit("")).alias("section"), (F.length("url") - F.length(F.replace(F.col("url"), F.lit("/"), F.lit("")))).cast("long").alias("depth"))


@query("S34_S35_enriched_results", "select c.query_id, c.chunk_id, n.documents from candidates c left join (select vertical, count(distinct doc_id) as documents from candidates group by vertical) n using (vertical)")
def enriched_results(spark, d):
    c = candidates(spark, d)
    return c.join(c.groupBy("vertical").agg(F.countDistinct("doc_id").alias("documents")), "vertical", "left").select("query_id", "chunk_id", "documents")
