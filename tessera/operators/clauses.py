"""Clause mentions, their index and its lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import substrings
from tessera.sources import files

# fixed values: patterns of clauses, terms that speak for legal text
PATTERNS = {"section": r"\bsection\s+(\d+)", "rule": r"\brule\s+(\d+)", "article": r"\barticle\s+(\d+)", "clause": r"\bclause\s+(\d+)", "amendment": r"\bamendment\s+(\d+)"}
LEGAL_TERMS = ["shall", "provided", "whereas", "hereby", "therefore", "act", "rule"]


def _named(text: Column) -> Column:
    """Kind and number of every clause in lower-cased text."""
    of_kind = lambda k: F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(1)), lambda n: F.concat(F.lit(f"{k} "), n))
    return F.flatten(F.array(*[of_kind(k) for k in PATTERNS]))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, clause (kind and number) of every mention."""
    found = _named(F.lower("text"))
    return docs.select("doc_id", F.explode(found).alias("clause"))


def confidence(place: Column, length: Column, has_context: Column, window: Column) -> Column:
    """0.5, 0.3 for a known act, 0.2 or 0.1 near the start, 0.03 for each legal term around (0.2 at most)."""
    share = place / length
    terms = sum((F.when(F.lower(window).contains(t), 1).otherwise(0) for t in LEGAL_TERMS), F.lit(0))
    return F.least(F.lit(1.0), 0.5 + F.when(has_context, 0.3).otherwise(0.0) + F.when(share < 0.1, 0.2).when(share < 0.3, 0.1).otherwise(0.0) + F.least(F.lit(0.2), terms * 0.03))


# fixed values: clauses that the index knows, words of a text that name the act it belongs to, what marks a question about clauses
_NUMBER = r"(\d+(?:\(\d+\))?(?:\([a-z]\))?)"
KEYED = {"section": _NUMBER, "rule": _NUMBER, "article": r"(\d+\w*)", "clause": _NUMBER, "sub-rule": _NUMBER, "amendment": r"(\d+)"}
ACTS = [("rte", "rte"), ("right to education", "rte"), ("cce", "cce"), ("apsermc", "apsermc"), ("education act", "education")]
ABOUT_CLAUSES = r"\b(?:section|clause|article|rule|sub-rule|amendment|act|regulation)\s+\d+|\b(?:rte|cce|apsermc)\s+(?:act|rule)\b|\b\d+\(\d+\)\(\w+\)\b|\b(?:go|government\s+order)\s+(?:no\.?\s*)?\d+"
CLAUSE_WORDS = ["section", "article", "rule", "clause", "act", "rte", "cce", "apsermc"]
SCANNED = {"section": r"(\d+)", "rule": r"(\d+)", "article": r"(\d+\w*)"}
AROUND, MOST = 100, 5
#: Texts that a task of the index reads on average, so that its memory doesn't grow with the table.
TEXTS = 20_000


def act_of(low: Column) -> Column:
    """Short name of the act that a lower-cased text speaks of, or null."""
    return F.coalesce(*[F.when(low.contains(words), F.lit(name)) for words, name in ACTS])


def index(docs: DataFrame) -> DataFrame:
    """key, clause, doc_id, confidence: one entry for each key (act, where the text names one, kind and number) of (doc_id, text).

    A document's last mention of a key speaks for it; of several documents the one with the highest
    confidence, ties by the smallest doc_id. doc_ids are distinct. Null and empty texts have no mentions.
    """
    low = F.lower("text")
    # dealt by document first: small files would give a single task all patterns, and the steps by doc_id need no other shuffle
    tasks = max(3 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TEXTS))
    docs = docs.select("doc_id", "text").where(low.rlike("|".join(KEYED))).repartition(tasks, "doc_id")

    def mentioned(kind: str, number: str) -> Column:
        plain = rf"\b{kind}\s+{number}"
        # the text before a mention is looked up backwards: all of it near the start, else AROUND characters
        around = rf"(?s)\b{kind}(?<=(^.{{0,{AROUND - 1}}}|.{{{AROUND}}}){kind})\s+{number}(?=(.{{0,{AROUND}}}))"
        part = lambda g: F.regexp_extract_all("low", F.lit(around), F.lit(g))
        zipped = F.arrays_zip(part(0).alias("whole"), part(1).alias("before"), part(2).alias("number"), part(3).alias("after"), F.transform(F.split("low", plain), F.length).alias("gap"))
        rows = F.transform(zipped, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["whole"].alias("whole"), m["before"].alias("before"), m["number"].alias("number"), m["after"].alias("after"), m["gap"].alias("gap")))
        # most texts name few kinds: the patterns are for those that hold the word
        return F.when(F.contains("low", F.lit(kind)), rows)

    kinds = F.array(*[mentioned(k, n) for k, n in KEYED.items()])
    texts = docs.select("doc_id", F.length("text").alias("size"), low.alias("low"), act_of(low).alias("act"))
    rows = texts.select("doc_id", "size", "act", F.explode(kinds).alias("m")).where(F.size("m") > 1)
    found = rows.select("doc_id", "size", "act", F.inline("m")).withColumn("clause", F.concat_ws(" ", "kind", "number"))
    so_far = Window.partitionBy("doc_id", "kind").orderBy("i")
    start = F.sum(F.col("gap") + F.coalesce(F.length("whole"), F.lit(0))).over(so_far) - F.length("whole")
    placed = found.withColumn("start", start).where("whole is not null")
    sure = confidence(F.col("start"), F.col("size"), F.col("act").isNotNull(), F.concat("before", "whole", "after"))
    last = placed.withColumn("confidence", sure).groupBy("doc_id", "kind", "clause").agg(F.max(F.struct("i", F.round("confidence", 6).alias("confidence"), "act")).alias("m"))
    keyed = last.select(F.concat_ws(" ", "m.act", "clause").alias("key"), "clause", "doc_id", "m.confidence")
    return keyed.groupBy("key").agg(F.min(F.struct(-F.col("confidence"), "doc_id", "clause")).alias("e")).select("key", "e.clause", "e.doc_id", (-F.col("e.col1")).alias("confidence"))


def _best(hits: DataFrame, of: str) -> DataFrame:
    """The MOST surest hits of each query or needle, each clause of a document once."""
    once = hits.groupBy(of, "doc_id", "clause").agg(F.min(F.struct(-F.col("confidence"), "key")).alias("e")).select(of, "doc_id", "clause", (-F.col("e.col1")).alias("confidence"), "e.key")
    rank = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("confidence"), "key"))
    return once.withColumn("rank", rank).where(F.col("rank") <= MOST)


def _in_keys(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of keys that contain a needle of a query (query_id, needle): the best of a needle first, so that common needles cost no more than others."""
    hits = substrings.matches(entries, asked, "key", "key", "needle").join(entries, "key")
    return asked.distinct().join(_best(hits, "needle").drop("rank"), "needle")


def lookup(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, rank, key, clause, doc_id, confidence: entries whose key the query contains; where it contains none, those whose key contains a clause of the query."""
    entries = files.written(entries, "clause-index")
    asked = files.written(queries.select("query_id", F.lower("query").alias("query")), "clause-queries")
    whole = files.written(substrings.matches(asked, entries, "query_id", "query", "key").join(entries, "key"), "clause-hits")
    of_kind = lambda k: F.transform(F.regexp_extract_all("query", F.lit(rf"\b{k}\s+{KEYED[k]}"), F.lit(1)), lambda x: F.concat(F.lit(f"{k} "), x))
    named = F.flatten(F.array(*[of_kind(k) for k in KEYED]))
    rest = asked.join(whole.select("query_id"), "query_id", "left_anti").select("query_id", F.explode(named).alias("needle"))
    columns = ["query_id", "key", "clause", "doc_id", "confidence"]
    return _best(whole.select(columns).unionByName(_in_keys(rest, entries).select(columns)), "query_id").select("query_id", "rank", "key", "clause", "doc_id", "confidence")


def lookup_terms(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Like lookup, by other tiers: the entry whose key is the query; where there is none, those whose key contains a word of the query."""
    entries = files.written(entries, "clause-index")
    asked = files.written(queries.select("query_id", F.lower("query").alias("query")), "clause-queries")
    whole = files.written(asked.join(entries, F.col("query") == F.col("key")), "clause-hits")
    rest = asked.join(whole.select("query_id"), "query_id", "left_anti").select("query_id", F.explode(F.split(F.trim("query"), r"\s+")).alias("needle"))
    columns = ["query_id", "key", "clause", "doc_id", "confidence"]
    hits = whole.select(columns).unionByName(_in_keys(rest, entries).select(columns)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "key"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= MOST).select("query_id", "rank", *columns[1:])


def about_clauses(query: Column) -> Column:
    """Whether a question asks for a clause."""
    low = F.lower(query)
    words = F.lit(False)
    for w in CLAUSE_WORDS:
        words = words | low.contains(w)
    return low.rlike(ABOUT_CLAUSES) | (words & low.rlike(r"\d"))


def fast_path(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, hits, fast: questions about clauses with two hits or more need no search."""
    hits = lookup(queries.where(about_clauses(F.col("query"))), entries).groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), (F.coalesce("hits", F.lit(0)) >= 2).alias("fast"))


def scan(queries: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """query_id, needle, rank, doc_id: the first documents whose text contains the section (else rule, else article) that the query names first."""
    low = F.lower("query")
    first = F.coalesce(*[F.when(low.rlike(rf"{k}\s+\d"), F.concat(F.lit(f"{k} "), F.regexp_extract(low, rf"{k}\s+{n}", 1))) for k, n in SCANNED.items()])
    asked = files.written(queries.select("query_id", first.alias("needle")).where("needle is not null"), "scan-needles")
    hits = substrings.matches(docs.select("doc_id", F.lower("text").alias("text")), asked, "doc_id")
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("doc_id"))
    return asked.join(hits.withColumn("rank", rank).where(F.col("rank") <= most), "needle").select("query_id", "needle", "rank", "doc_id")
