"""Toxicity scores from a learnt lexicon, misspellings and context.

The lexicon is learnt from labelled training rows: whole words and word beginnings that toxic texts
hold and clean texts don't. It becomes a trie, and each text word is matched by intersecting the
trie with the word's Levenshtein automaton (one edit from FUZZY_FROM letters on). Hits inside
quotation marks or next to reporting words count as quotation, the others as abuse; a logistic
model over these sums, fitted on the same bounded sample, gives the score.

Bounds: the sample (SAMPLE_TOXIC, SAMPLE_CLEAN) and the lexicon (LEXICON entries) are bounded; words of
over 64 letters are matched but not learnt; a quotation that isn't closed within 60 words is none.

Defined results: null and empty texts have no hits and get the score of a text without hits;
without labels of both kinds the score is 0 for all; repeated rows are scored each; labels of ids
that occur several times count once (the largest).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, train_row

#: Labelled rows that are learnt from, at most, of each label; entries of the lexicon, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON = 4000, 8000, 4000
#: Word beginnings of these lengths may become entries that stand for all words that begin so.
STEM_MIN, STEM_MAX = 3, 12
#: One edit is allowed from this many letters on.
FUZZY_FROM = 5
#: Words around a hit that are looked at for reporting.
WINDOW = 5
# fixed values: words that report another's speech, and quotation marks
REPORTING = {"said", "says", "called", "wrote", "quote", "quoted", "quoting", "reported", "tweeted", "dit", "écrit", "cité", "sagte", "schrieb", "zitat", "dijo", "escribió", "cita"}
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
_WORD = re.compile(r"[^\W_]+|[\"“”«»„‘’]")
_MARKS = set("\"“”«»„‘’")


class Trie:
    """Entries as nested dicts; a node's None holds (weight, stem), stem: longer words match too."""

    def __init__(self, entries: dict[str, tuple[float, bool]]):
        self.root: dict = {}
        for word, value in entries.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[None] = value

    def exact(self, word: str) -> float:
        """The largest weight of an entry that is the word, or of a stem that it begins with."""
        node, best = self.root, 0.0
        for i, ch in enumerate(word, 1):
            node = node.get(ch)
            if node is None:
                return best
            if (v := node.get(None)) and (v[1] or i == len(word)):
                best = max(best, v[0])
        return best

    def fuzzy(self, word: str) -> float:
        """As exact(), for entries of FUZZY_FROM letters or more at one edit. Trie and automaton are walked together; a branch ends when the automaton dies."""
        best, n = 0.0, len(word)
        stack = [(self.root, 0, 0, 0)]  # node, depth, place in the word, edits
        seen = set()
        while stack:
            node, depth, at, edits = stack.pop()
            if (id(node), at, edits) in seen:
                continue
            seen.add((id(node), at, edits))
            v = node.get(None)
            if v and depth >= FUZZY_FROM and (v[1] or n - at + edits <= 1):
                best = max(best, v[0])
            if not edits and at < n:
                stack.append((node, depth, at + 1, 1))
            for ch, child in node.items():
                if ch is None:
                    continue
                if at < n and ch == word[at]:
                    stack.append((child, depth + 1, at + 1, edits))
                elif not edits:
                    stack.append((child, depth + 1, at, 1))
                    if at < n:
                        stack.append((child, depth + 1, at + 1, 1))
        return best


class Matcher:
    """word -> weight (negative for a misspelling), remembered up to a bound. Halves of the entries rule most words out: one edit leaves one half whole."""

    def __init__(self, entries: dict[str, tuple[float, bool]], clean: set[str], bound: int = 150_000):
        self.trie, self.clean, self.bound = Trie(entries), clean, bound
        self.halves: dict[int, tuple[set, set]] = {}
        for w in entries:
            if len(w) >= FUZZY_FROM:
                heads, tails = self.halves.setdefault(len(w), (set(), set()))
                heads.add(w[: len(w) // 2])
                tails.add(w[len(w) // 2 :])
        self.known: dict[str, float] = {}

    def near(self, word: str) -> bool:
        for size, (heads, tails) in self.halves.items():
            if len(word) >= size - 1:
                h = size // 2
                if word[:h] in heads or any(word[i : i + size - h] in tails for i in (h - 1, h, h + 1)):
                    return True
        return False

    def __call__(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= self.bound:
                self.known.clear()
            w = self.trie.exact(word)
            if not w and len(word) >= FUZZY_FROM - 1 and word not in self.clean and self.near(word):
                w = -self.trie.fuzzy(word)
            self.known[word] = w
        return w


def text_features(text: str | None, match: Matcher) -> tuple[float, float, float, float, float]:
    """Sum and maximum of the weights of abuse, the sum of misspelled and of quoted hits' weights, and abuse among 100 words."""
    words = _WORD.findall((text or "").lower())
    total = top = odd = quoted = 0.0
    hits = [(i, w) for i, w in enumerate(map(match, words)) if w]
    if not hits:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    inside, closes, k = [False] * len(words), None, 0
    if not _MARKS.isdisjoint(words):
        opened = 0
        for k, w in enumerate(words):
            if closes is None and w in QUOTES:
                closes, opened = QUOTES[w], k
            elif closes is not None and (w == closes or k - opened > 60):
                if w == closes:
                    inside[opened : k + 1] = [True] * (k + 1 - opened)
                closes = None
    for i, w in hits:
        if inside[i] or not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1]):
            quoted += abs(w)
        elif w < 0:
            odd += -w
            top = max(top, -w)
        else:
            total += w
            top = max(top, w)
    return math.log1p(total), top, math.log1p(odd), math.log1p(quoted), min(1.0, len(hits) * 20 / len(words))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of a bounded sample of training rows, without copies: of texts that share the least three-word hash one is kept."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(train_row(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    part = lambda k, most: (F.col("toxic") == k) & (mark <= int(min(1.0, most / max(1, n.get(k, 0))) * 1_000_000))
    picked = lab.where(part(1, SAMPLE_TOXIC) | part(0, SAMPLE_CLEAN))
    # a bounded number of ids: at most the two bounds, and what a hash may exceed them by
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

    def least(batches):
        for pdf in batches:
            words = [t.lower().split() for t in pdf["text"]]
            yield pdf.assign(least=[min(zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))) for w in words])

    rows = rows.mapInPandas(least, "doc_id long, text string, toxic int, least long")
    # the smallest id of each group, so that every run learns the same
    first = rows.groupBy("toxic", "least").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    return materialize(first.select("first.doc_id", "first.text", "toxic"), "toxic-sample")


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, tuple[float, bool]], set[str]]:
    """entry -> (weight, stem), and the words of clean texts that lie one edit from an entry."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                for w in set(_WORD.findall(text.lower())):
                    if len(w) >= STEM_MIN and w not in _MARKS and len(w) <= 64:
                        seen.setdefault(w, [0, 0])[toxic] += 1
        items = sorted(seen.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pd.DataFrame({"word": [w for w, _ in part], "clean": [c[0] for _, c in part], "toxic": [c[1] for _, c in part]})

    words = materialize(rows.select("text", "toxic").mapInPandas(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    totals = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    if not n.get(0) or not n.get(1):
        release(words)
        return {}, set()
    ratio = n[1] / n[0]
    # a stem's counts are of (text, word) pairs; words counts different words, which copies of one text don't raise
    cut = F.sequence(F.lit(STEM_MIN), F.least(F.length("word"), F.lit(STEM_MAX)))
    stems = words.select(F.explode(F.transform(cut, lambda k: F.substring("word", F.lit(1), k))).alias("stem"), "clean", "toxic")
    stems = stems.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("words"))
    least = max(4, round(0.003 * n[1]))
    weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") * ratio + 0.5))
    whole = words.where(F.col("toxic") >= least).select("word", "clean", "toxic", F.lit(1).alias("words"), F.lit(False).alias("stem"))
    begun = stems.where((F.col("toxic") >= 2 * least) & (F.col("words") >= 4)).select(F.col("stem").alias("word"), "clean", "toxic", "words", F.lit(True).alias("stem"))
    found = whole.unionByName(begun).withColumn("weight", weight).where("weight > 2.3").orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "word", "stem").limit(LEXICON).collect()
    entries: dict[str, tuple[float, bool]] = {}
    # the shortest stem that is nearly pure stands for what begins so
    for r in sorted(found, key=lambda r: (not r["stem"], len(r["word"]), r["word"])):
        w = r["word"]
        covered = any(entries.get(w[:k], (0, False))[1] and entries[w[:k]][0] >= r["weight"] - 1.0 for k in range(STEM_MIN, len(w)))
        if not covered and w not in entries:
            entries[w] = (float(r["weight"]), r["stem"])

    def clash(batches):
        match = Matcher(entries, set())
        for pdf in batches:
            hit = [match(w) < 0 for w in pdf["word"]]
            yield pdf[hit][["word"]]

    clean = {r["word"] for r in words.where("clean > 0 and clean * 2 >= toxic").mapInPandas(clash, "word string").collect()}  # words of the bounded sample
    release(words)
    return entries, clean


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights by Newton steps with a small ridge; hits never speak against toxicity."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.5)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    rows = _sample(docs, labels)
    entries, clean = learn_lexicon(rows)
    if not entries:
        release(rows)
        return {}

    def extract(batches):
        match = Matcher(entries, clean)
        for pdf in batches:
            yield pd.DataFrame([text_features(t, match) for t in pdf["text"]], columns=list("abcde")).assign(toxic=pdf["toxic"].to_numpy()).astype({"toxic": "int32"})

    got = sorted(tuple(r) for r in rows.mapInPandas(extract, "a double, b double, c double, d double, e double, toxic int").collect())  # the bounded sample
    release(rows)
    data = np.array(got, float)
    # misspelled hits and quotations are rare in the sample: they join the sums at set rates, and the model learns one scale
    return {"entries": entries, "clean": clean, "weights": _logistic(_columns(data), data[:, 5])}


def _columns(f: np.ndarray) -> np.ndarray:
    """Model columns: abuse (misspelled hits at 0.8, quoted ones at 0.1 of their weight) and the strongest hit."""
    total = np.expm1(f[:, 0]) + 0.8 * np.expm1(f[:, 2]) + 0.1 * np.expm1(f[:, 3])
    return np.column_stack([np.log1p(total), f[:, 1], f[:, 4] * (f[:, 1] > 0)])


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # LEXICON entries at most, and clashing words of the bounded sample

    def apply(batches):
        m = shared.value
        match = Matcher(m["entries"], m["clean"]) if m else None
        for pdf in batches:
            s = np.zeros(len(pdf))
            if m and len(pdf):
                f = np.array([text_features(t, match) for t in pdf["text"]])
                w = m["weights"]
                s = 1 / (1 + np.exp(-np.clip(_columns(f) @ w[:-1] + w[-1], -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(~train_row(doc_id), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores threshold or more; other columns pass unchanged."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        match = Matcher(m["entries"], m["clean"]) if m else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if m and len(texts):
                w = m["weights"]
                f = np.array([text_features(t, match) for t in texts])
                s = 1 / (1 + np.exp(-np.clip(_columns(f) @ w[:-1] + w[-1], -30, 30)))
                batch = batch.filter(pa.array(s < threshold))
            yield batch

    return docs.mapInArrow(apply, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
