"""Widening of queries by the expansions of the dictionary keys that occur in them.

A dictionary is a table (kind, key, place, expansion): kind `phrase` (the key counts wherever its letters
stand) or `term` (the key counts as a word). Keys and expansions go into one automaton (a trie with
failure links), so a query is read once, whatever the number of entries. The automaton is built from at
most LIMIT letters; a larger dictionary is dealt into as many automata, each with all its entries'
letters, and what they find is put together, so the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rewriting import bound
from tessera.functions.vocabulary import AI_SIGNS, AI_TERMS, CATEGORY_TERMS, CURRICULUM_SIGNS, PHRASES, V1_AI, V1_AI_TERMS, V1_CURRICULUM, V1_MODE_WORDS, V1_RULES, V1_SYNONYMS

#: Letters of keys and expansions in one automaton (about 50 bytes each in memory).
LIMIT = 4_000_000
ENTRY = "kind string, key string, place int, expansion string"


def fixed_dictionary(spark) -> DataFrame:
    """The phrases and one-word synonyms that the library states; larger dictionaries come as tables."""
    rows = [("phrase", k, i, e) for k, es in PHRASES.items() for i, e in enumerate(es, 1)] + [("term", k.lower(), i, e) for k, es in V1_SYNONYMS.items() for i, e in enumerate(es, 1)]
    return spark.createDataFrame(rows, ENTRY)


def _automaton(entries):
    """Automaton over lower-case keys and expansions; a value is (letters, is phrase, is term, is expansion, expansions of the key)."""
    import ahocorasick

    found: dict[str, list] = {}
    slot = lambda s: found.setdefault(s, [s, set(), set(), False])
    for e in entries:
        key, out = (e.key or "").lower(), e.expansion or ""
        if key and out:
            slot(key)[1 if e.kind == "phrase" else 2].add(out)
            slot(out.lower())[3] = True
    made = ahocorasick.Automaton()
    for s, v in found.items():
        made.add_word(s, tuple(v))
    made.make_automaton()
    return made


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _found(automaton, text: str) -> list[str]:
    low = text.lower()
    hits, present = set(), set()
    if len(automaton):
        for end, (s, by_phrase, by_term, is_expansion) in automaton.iter(low):
            if is_expansion:
                present.add(s)
            hits |= by_phrase
            if by_term:
                start = end - len(s) + 1
                before = start > 0 and _is_word(low[start - 1])
                after = end + 1 < len(low) and _is_word(low[end + 1])
                if before != _is_word(s[0]) and after != _is_word(s[-1]):
                    hits |= by_term
    return [e for e in hits if e.lower() not in present]


def expansions(queries: DataFrame, dictionary: DataFrame, text: str = "query", limit: int = LIMIT) -> DataFrame:
    """queries and `found`: the expansions of all keys in the text that the text doesn't hold already, longest first, then by letters."""
    spark = queries.sparkSession
    letters = dictionary.agg(F.sum(F.length("key") + F.length("expansion"))).first()[0] or 0
    shards = -(-letters // limit) or 1
    place = queries.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields) + ", found array<string>"
    parts = []
    for shard in range(shards):
        mine = dictionary if shards == 1 else dictionary.where(F.pmod(F.xxhash64("key", "expansion"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast(_automaton(mine.toLocalIterator()))

        def search(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                out = [_found(shared.value, t or "") for t in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "found"])

        parts.append(queries.mapInArrow(search, schema))
    out = parts[0]
    if shards > 1:
        for more in parts[1:]:
            out = out.unionByName(more)
        out = out.groupBy(*[F.col(f"`{c}`") for c in queries.columns]).agg(F.flatten(F.collect_list("found")).alias("found"))
    return out.withColumn("found", longest_first(F.array_distinct("found")))


def longest_first(terms: Column) -> Column:
    return F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])


def _one_of(low: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def is_technology(query: Column) -> Column:
    return bound(F.lower(query), lambda low: _one_of(low, AI_SIGNS) & (_one_of(low, CURRICULUM_SIGNS) | low.contains("integration")))


def technology_terms(query: Column, found: Column, most: int) -> Column:
    """The fixed terms and what was found, without those in the query; fewest words first, then shortest, twice as many as usual."""
    every = bound(F.lower(query), lambda low: F.filter(F.concat(F.array(*map(F.lit, AI_TERMS)), found), lambda t: ~low.contains(F.lower(t))))
    keyed = F.transform(every, lambda t, i: F.struct(F.size(F.split(t, " ")).alias("words"), F.length(t).alias("n"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["t"]), 1, 2 * most)


def appended(query: Column, terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.concat(query, F.lit(" "), F.array_join(terms, " "))).otherwise(query)


def expand_query(queries: DataFrame, dictionary: DataFrame, most: int | Column = 10, text: str = "query", limit: int = LIMIT) -> DataFrame:
    """queries and `expanded`: the text with up to `most` expansions, of questions on technology in teaching with up to twice as many."""
    most = F.lit(most) if isinstance(most, int) else most
    query = F.coalesce(F.col(text), F.lit(""))
    terms = F.when(is_technology(query), technology_terms(query, F.col("found"), most)).otherwise(F.slice("found", 1, most))
    return expansions(queries, dictionary, text, limit).withColumn("expanded", bound(terms, lambda kept: appended(query, kept))).drop("found")


def expand_with_categories(queries: DataFrame, dictionary: DataFrame, categories: str = "categories", text: str = "query", most: int = 10) -> DataFrame:
    """queries (with one array of categories a row) and `expanded`: up to ten of the first three expansions of each term of the categories."""
    rows = [(c, t) for c, ts in CATEGORY_TERMS.items() for t in ts]
    terms = F.broadcast(queries.sparkSession.createDataFrame(rows, "category string, key string"))  # a fixed list
    first = dictionary.where("kind = 'term' and place <= 3").select("key", "expansion")
    by_category = terms.join(first, "key").groupBy("category").agg(F.collect_set("expansion").alias("more"))
    # a row for each category: at most 3 expansions a term
    table = by_category.agg(F.map_from_entries(F.collect_list(F.struct("category", "more"))).alias("table"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    wide = queries.join(F.broadcast(table))
    found = F.flatten(F.transform(F.coalesce(F.col(categories), F.array().cast("array<string>")), lambda c: F.coalesce(F.try_element_at("table", c), F.array().cast("array<string>"))))
    kept = F.slice(longest_first(F.filter(F.array_distinct(found), lambda t: ~low.contains(F.lower(t)))), 1, most)
    return wide.withColumn("expanded", appended(F.coalesce(F.col(text), F.lit("")), kept)).drop("table")


# ---- the first version: three rules, synonyms, entities, words of the mode


def v1_keywords(query: Column, most: int = 8) -> Column:
    """Keywords of the rules whose triggers stand in the query, in the rules' order, `most` at most."""
    none = F.array().cast("array<string>")

    def found(low: Column) -> Column:
        parts = [F.when(_one_of(low, triggers), F.array(*map(F.lit, words[:most]))).otherwise(none) for triggers, words in V1_RULES]
        special = F.when(_one_of(low, V1_AI) & _one_of(low, V1_CURRICULUM), F.array(*map(F.lit, V1_AI_TERMS))).otherwise(none)
        return F.slice(F.array_distinct(F.concat(*parts, special)), 1, most)

    return bound(F.lower(query), found)


def v1_confidence(query: Column) -> Column:
    rules = lambda low: sum((_one_of(low, t).cast("int") for t, _ in V1_RULES), (_one_of(low, V1_AI) & _one_of(low, V1_CURRICULUM)).cast("int"))
    return F.least(F.lit(1.0), F.round(bound(F.lower(query), rules) * 0.4, 6))


def v1_synonyms(query: Column, most: int = 3) -> Column:
    hits = lambda low: F.array_compact(F.array(*[F.when(low.contains(t.lower()), s[0]) for t, s in V1_SYNONYMS.items()]))
    return bound(query, lambda q: bound(F.slice(bound(F.lower(q), hits), 1, most), lambda found: appended(q, found)))


def enhance(query: Column, entity_text: Column, mode: Column) -> Column:
    """The first version's whole widening: rules, three synonyms, the entities' text, the words of the mode."""
    wide = bound(F.coalesce(query, F.lit("")), lambda q: v1_synonyms(bound(v1_keywords(q), lambda found: appended(q, found))))
    more = F.when(F.coalesce(entity_text, F.lit("")) != "", F.concat(F.lit(" "), entity_text)).otherwise("")
    return F.trim(F.concat(wide, more, *[F.when(mode == name, " " + words).otherwise("") for name, words in V1_MODE_WORDS.items()]))
