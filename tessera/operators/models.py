"""Models that callers bring: embedders, pair scorers, web sources and generators, tried in order for each row.

A chain is a list of such objects. A row takes the answer of the first one that gives it a good one, so one
bad text doesn't move its whole batch to another model. A batch that fails is halved until the rows that fail
stand alone; a model that is down (DOWN) isn't called again by that task. Objects are sent to the executors
and must be picklable; they should open connections and read weights when they are first called.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rewriting, scoring
from tessera.operators import vectors

log = logging.getLogger(__name__)

DOWN = (PermissionError, ConnectionError, TimeoutError)

# fixed values: the longest text to embed, words of a text that a scorer reads, results that it reads in each mode, models of the modes
LONGEST_TEXT, SCORED_WORDS = 20000, 500
SCORED_RESULTS = {"qa": 25, "policy": 30, "framework": 30, "brainstorm": 30, "deepthink": 30, "deep_think": 30}
MODE_MODELS = {"qa": "fast", "deep_think": "deep", "brainstorm": "deep"}


class Embedder(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str]) -> list: ...


class PairScorer(Protocol):
    name: str

    def score(self, pairs: list[tuple[str, str]]) -> list: ...


class WebSource(Protocol):
    name: str

    def search(self, queries: list[str]) -> list[list[dict]]: ...


class Generator(Protocol):
    name: str

    def generate(self, prompts: list[str]) -> list: ...


# ---- chains


def _each(call: Callable, items: list) -> list:
    """One answer for each item, None where the call failed."""
    try:
        out = list(call(items))
        if len(out) == len(items):
            return out
        log.warning("%d answers to %d rows", len(out), len(items))
    except DOWN:
        raise
    except Exception as e:  # a model may raise anything; its row goes to the next model
        log.warning("%s", e)
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return _each(call, items[:half]) + _each(call, items[half:])


def answers(calls: list[tuple[str, Callable, Callable]], items: list, down: set[str]) -> tuple[list, list]:
    """The answers to items and the names of the models that gave them, by (name, call, is the answer good) in order."""
    values, names = [None] * len(items), [None] * len(items)
    left = [i for i, x in enumerate(items) if x is not None]
    for name, call, good in calls:
        if not left:
            break
        if name in down:
            continue
        try:
            got = _each(call, [items[i] for i in left])
        except DOWN as e:
            log.warning("%s is down: %s", name, e)
            down.add(name)
            continue
        for i, v in zip(left, got, strict=True):
            if v is not None and good(v):
                values[i], names[i] = v, name
        left = [i for i in left if names[i] is None]
    return values, names


def _asked(calls: list, schema: str):
    """A pandas UDF that answers the rows of one column by a chain."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        down: set[str] = set()
        for texts in batches:
            values, names = answers(calls, [None if t is None or t != t else t for t in texts], down)
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "backend": pd.Series(names, dtype=object)})

    # called nondeterministic, so that no plan asks the models twice for one row (once in a filter, once in a projection)
    return F.pandas_udf(run, f"value {schema}, backend string").asNondeterministic()


def _or(made: Column, spare: Column) -> Column:
    """The answer if a model gave one, else spare; the answer is named once, in an array of one."""
    return F.get(F.transform(F.array(made), lambda m: F.when(m["backend"].isNotNull(), m).otherwise(spare)), F.lit(0))


# ---- embedding


def lite(text: Column, dims: int = 64) -> Column:
    """A unit vector of normally distributed components that the text's SHA-256 fixes: equal texts, equal vectors; null for null and blank texts."""
    part = lambda s, at: F.conv(F.substring(s, at, 8), 16, 10).cast("double")
    # (the digest stands outside of the list, or the whole text would be hashed for each component)
    keys = rewriting.bound(F.sha2(text, 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.sha2(F.concat(digest, F.lit(":"), i.cast("string")), 256)))
    normal = F.transform(keys, lambda s: F.sqrt(-2.0 * F.log((part(s, 1) + 1.0) / 4294967296.0)) * F.cos(2.0 * F.pi() * part(s, 9) / 4294967296.0))
    # the vector and its length stand in a struct, so that neither is worked out once for each component
    sized = F.transform(F.array(normal), lambda v: F.struct(v.alias("v"), vectors.norm(v).alias("n")))
    unit = F.transform(sized, lambda p: F.transform(p["v"], lambda x: x / p["n"]))[0]
    return F.when(text.rlike(r"\S"), unit)


def good_vector(v, dims: int) -> bool:
    """Of dims finite components, and of a length from 0.01 to 100."""
    try:
        x = np.asarray(v, float)
    except (TypeError, ValueError):
        return False
    return x.shape == (dims,) and bool(np.isfinite(x).all()) and 0.01 <= float(np.linalg.norm(x)) <= 100


def embed(text: Column, chain: list[Embedder], dims: int) -> Column:
    """struct(value array<double>, backend): the first good vector of the chain; the lite one where none is.

    Null and blank texts get nulls. A text longer than LONGEST_TEXT is cut there and marked, since models
    bound their input; whoever wants the whole text embedded chunks it first.
    """
    some = F.when(text.rlike(r"\S"), F.when(F.length(text) > LONGEST_TEXT, F.concat(F.left(text, F.lit(LONGEST_TEXT)), F.lit("..."))).otherwise(text))
    spare = F.when(some.isNotNull(), F.struct(lite(some, dims).alias("value"), F.lit("lite").alias("backend")))
    if not chain:
        return spare
    calls = [(m.name, lambda texts, m=m: [_floats(v) for v in m.embed(texts)], lambda v: good_vector(v, dims)) for m in chain]
    return _or(_asked(calls, "array<double>")(some), spare)


def _floats(v):
    return None if v is None else [float(x) for x in v]


def embed_by_mode(df: DataFrame, text: str, mode: str, models: dict[str, tuple[list[Embedder], int]]) -> DataFrame:
    """df with model, embedding and backend: MODE_MODELS names the model of a mode (fast for others), models its chain and dims."""
    name = scoring.lookup(F.col(mode), MODE_MODELS, "fast")
    made = F.coalesce(*[embed(F.when(name == m, F.col(text)), chain, dims) for m, (chain, dims) in models.items()])
    return df.withColumn("model", name).withColumn("_made", made).withColumn("embedding", F.col("_made.value")).withColumn("backend", F.col("_made.backend")).drop("_made")


class WordHashing:
    """Signed counts of words hashed into dims places, as a unit vector; None for texts without words of a-z and 0-9."""

    def __init__(self, name: str, dims: int):
        self.name, self.dims = name, dims

    def embed(self, texts: list[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in re.findall("[a-z0-9]+", t.lower()):
                h = _word_hash(w)
                v[h % self.dims] += 1 if h >> 31 else -1
            size = float(np.linalg.norm(v))
            out.append((v / size).tolist() if size else None)
        return out


@lru_cache(100_000)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)


# ---- pairs


class WordOverlap:
    """Jaccard of the two texts' word sets; 0 without words in the first."""

    name = "overlap"

    def score(self, pairs: list[tuple[str, str]]) -> list:
        out = []
        for q, t in pairs:
            a, b = (set(re.findall(r"\w+", x.lower())) for x in (q, t))
            out.append(len(a & b) / len(a | b) if a else 0.0)
        return out


def rerank_pairs(df: DataFrame, chain: list[PairScorer], k: int, most: Column | int | None = None) -> DataFrame:
    """The best k of each query's results (query_id, query, chunk_id, text, score, mode): the first `most` by score take the chain's score and its order, the others follow.

    `most` is SCORED_RESULTS of the mode (25 for others) unless given; the scorer reads the first SCORED_WORDS words.
    A query with a result that no scorer scores keeps the order and scores it had. Null texts and queries
    are empty ones. Ties keep the former order. Adds rank and backend.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    limit = scoring.lookup(F.col("mode"), SCORED_RESULTS, 25) if most is None else (F.lit(most) if isinstance(most, int) else most)
    placed = df.withColumn("_place", F.row_number().over(order)).withColumn("_most", limit).where(F.col("_place") <= F.greatest(F.col("_most"), F.lit(k)))
    words = F.array_join(F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), 1, SCORED_WORDS), " ")
    calls = [(m.name, lambda pairs, m=m: [None if s is None else float(s) for s in m.score(pairs)], np.isfinite) for m in chain]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        down: set[str] = set()
        for queries, texts in batches:
            values, names = answers(calls, [None if t is None else (q, t) for q, t in zip(queries, texts, strict=True)], down)
            yield pd.DataFrame({"value": pd.Series(values, dtype="float64"), "backend": pd.Series(names, dtype=object)})

    score = F.pandas_udf(run, "value double, backend string")
    read = F.col("_place") <= F.col("_most")
    scored = placed.withColumn("_made", score(F.coalesce("query", F.lit("")), F.when(read, words)))
    failed = F.max((read & F.col("_made.backend").isNull()).cast("int")).over(Window.partitionBy("query_id")) == 1
    taken = F.when(~F.col("_failed") & F.col("_made.backend").isNotNull(), F.col("_made"))
    out = scored.withColumn("_failed", failed).withColumn("_taken", taken)
    new = Window.partitionBy("query_id").orderBy(F.col("_taken").isNull().cast("int"), F.desc("_taken.value"), "_place")
    first = F.when(F.col("_failed"), F.col("_place")).otherwise(F.row_number().over(new))
    out = out.withColumn("rank", first).where(F.col("rank") <= k).withColumn("score", F.coalesce("_taken.value", "score")).withColumn("backend", F.col("_taken.backend"))
    return out.drop("_place", "_most", "_made", "_failed", "_taken")


# ---- the web and generated text


def web_results(queries: DataFrame, chain: list[WebSource], n: int = 10, offline: DataFrame | None = None) -> DataFrame:
    """query_id, rank, title, url, snippet, backend of the first n results of each query (query_id, query), by the first source that finds some.

    Results without a url are left out. Queries that no source answers take their rows (query_id, rank,
    title, url, snippet) from offline, if given. Null and blank queries find nothing.
    """
    clean = lambda rows: None if rows is None else [{f: r.get(f) for f in ("title", "url", "snippet")} for r in rows if r.get("url")][:n]
    calls = [(m.name, lambda qs, m=m: [clean(rows) for rows in m.search(qs)], len) for m in chain]
    made = _asked(calls, "array<struct<title string, url string, snippet string>>")
    some = F.coalesce(F.col("query").rlike(r"\S"), F.lit(False))
    asked = queries.select("query_id", made(F.when(some, F.col("query"))).alias("m"), some.alias("some"))
    found = asked.select("query_id", "m.backend", F.posexplode("m.value").alias("at", "r")).select("query_id", (F.col("at") + 1).alias("rank"), "r.title", "r.url", "r.snippet", "backend")
    if offline is None:
        return found
    rest = asked.where("some and m.backend is null").select("query_id").join(offline.where(F.col("rank") <= n), "query_id")
    return found.unionByName(rest.select("query_id", F.col("rank").cast("int").alias("rank"), "title", "url", "snippet", F.lit("offline").alias("backend")))


def generated(prompt: Column, chain: list[Generator], otherwise: Column) -> Column:
    """struct(value, backend): the first text that is not blank, or `otherwise` with the name rules. Null prompts are not asked."""
    calls = [(m.name, m.generate, lambda s: bool(s.strip())) for m in chain]
    return _or(_asked(calls, "string")(prompt), F.struct(otherwise.alias("value"), F.lit("rules").alias("backend")))


# fixed values: the marks of a rewrite in a generated text
_DOMAIN, _REWRITE = "DOMAIN:", "REWRITE:"


def parsed_rewrites(text: Column) -> Column:
    """array<struct(domain, text)> of the blocks, parted by blank lines, that hold a DOMAIN and a REWRITE line; of repeated lines in a block the last counts."""

    def last(block: Column, mark: str) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.startswith(mark))
        return F.trim(F.substring(F.try_element_at(lines, F.lit(-1)), len(mark) + 1, 1 << 30))

    blocks = F.split(F.trim(text), r"\n\s*\n")
    both = F.transform(blocks, lambda b: F.struct(F.lower(last(b, _DOMAIN)).alias("domain"), last(b, _REWRITE).alias("text")))
    return F.filter(both, lambda r: F.coalesce((r["domain"] != "") & (r["text"] != ""), F.lit(False)))


def generated_rewrites(queries: DataFrame, chain: list[Generator], prompt: Column, most: int = 3) -> DataFrame:
    """queries (query_id, query) with rewrites and backend: at most `most` rewrites parsed from the first generated text, by rules where no text holds one."""
    made = queries.withColumn("_text", generated(prompt, chain, F.lit("")))
    parsed = made.withColumn("_rewrites", F.slice(F.coalesce(parsed_rewrites(F.col("_text.value")), F.array()), 1, most))
    some = F.size("_rewrites") > 0
    out = parsed.withColumn("rewrites", F.when(some, F.col("_rewrites")).otherwise(rewriting.rewrites(F.col("query"), most)))
    return out.withColumn("backend", F.when(some, F.col("_text.backend")).otherwise("rules")).drop("_text", "_rewrites")
