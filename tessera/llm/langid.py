"""Language identification by hierarchical discrimination.

A text's letters become hashed character n-gram frequencies. One linear support vector machine per
family pair picks the family; one-versus-one machines pick the language inside it. All are trained
here, on at most SAMPLE rows of each language (a documented bound), chosen by a hash of the id.

Defined results: null texts and texts without letters are `und` with score 0; a language alone in
its family needs no second step; with no labelled row at all every text is `und`; rows without
doc_id are predicted like any other and count as not held out.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import train_row

#: Labelled rows of a language that are learnt from, at most.
SAMPLE = 800
#: Hashed n-gram features.
DIMS = 2048
# fixed values: language families by ISO 639-1 code; a code not listed is a family of its own
FAMILIES = {
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the frequencies of hashed byte 2-, 3- and 4-grams of the text's words, of length 1; None without letters."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    # what is neither letter nor mark nor decimal digit (fractions, superscripts, Roman numerals) isn't a letter either
    if not words or not words.isascii() and not any(map(str.isalpha, words)):
        return None
    a = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint32)
    out = np.zeros(DIMS)
    h = a
    for n, k in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
        if len(a) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + a[n - 1 :]
        out += np.bincount((h * np.uint32(k)) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of an L2-regularised hinge-loss machine, by dual coordinate descent (y is -1 or 1)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norms, alpha, w = np.einsum("ij,ij->i", x, x), np.zeros(len(x)), np.zeros(x.shape[1])
    # both sides weigh the same
    upper = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.RandomState(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (x[i] @ w) - 1) / norms[i], 0), upper[i])
            if alpha[i] != old:
                w += (alpha[i] - old) * y[i] * x[i]
    return w


def _one_vs_one(x: np.ndarray, labels: np.ndarray) -> dict:
    names = sorted(set(labels))
    pairs = {}
    for a, b in itertools.combinations(names, 2):
        mine = (labels == a) | (labels == b)
        pairs[a, b] = fit_svm(x[mine], np.where(labels[mine] == a, 1.0, -1.0))
    return {"names": names, "pairs": pairs}


def _decide(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Names with the most one-versus-one votes (margins break ties), and how sure the machines are."""
    names = model["names"]
    sure = np.zeros((len(x), len(names)))
    votes = np.zeros((len(x), len(names)))
    least = np.ones((len(x), len(names)))
    for (a, b), w in model["pairs"].items():
        p = 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -30, 30)))
        for name, q in ((a, p), (b, 1 - p)):
            k = names.index(name)
            votes[:, k] += q > 0.5
            sure[:, k] += q
            least[:, k] = np.minimum(least[:, k], q)
    best = np.argmax(votes + sure / (len(names) + 1), axis=1)
    return [names[k] for k in best], least[np.arange(len(x)), best]


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, from rows with a lang whose id is of the training folds. Reads ids and languages first, then the sampled texts."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang is not null").where(train_row(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (mark < int(min(1.0, sample / n) * 1_000_000) + 1))

    def vectors(batches):
        for pdf in batches:
            found = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "x": [None if v is None else v.tobytes() for v in found]})

    rows = labelled.where(keep).mapInPandas(vectors, "doc_id long, lang string, x binary").where("x is not null").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["x"]))
    rows = [r for _, g in itertools.groupby(rows, key=lambda r: r["lang"]) for r in list(g)[: 2 * sample]]
    if not rows:
        return {}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    lang = np.array([r["lang"] for r in rows])
    family = np.array([_FAMILY.get(k, k) for k in lang])
    return {"family": _one_vs_one(x, family), "within": {f: _one_vs_one(x[family == f], lang[family == f]) for f in sorted(set(family))}}


def predict(model: dict, texts) -> tuple[list[str], np.ndarray]:
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    for lo in range(0, len(texts) if model else 0, 500):
        found = [(i, v) for i, t in enumerate(texts[lo : lo + 500], lo) if (v := features(t)) is not None]
        if not found:
            continue
        at, x = np.array([i for i, _ in found]), np.stack([v for _, v in found])
        families, sure = _decide(model["family"], x)
        families = np.array(families)
        for f in set(families):
            mine = families == f
            langs, within = _decide(model["within"][f], x[mine])
            score[at[mine]] = sure[mine] * within
            for i, name in zip(at[mine], langs, strict=True):
                names[i] = name
    return names, score


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row's whole text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, sample))  # DIMS weights for each pair of families or languages

    def apply(batches):
        for pdf in batches:
            names, score = predict(model.value, pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": names, "score": score})

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(~train_row(doc_id), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
