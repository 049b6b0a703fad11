"""Relations between documents, by pattern, with the text around each match."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import files

# fixed values: an order's number with or without its prefix, and the patterns, confidences and priorities of relation types
_GO = r"(?:G\.?O\.?(?:MS|RT)?\.?\s*No\.?\s*)?"
PATTERNS = {
    "supersedes": [rf"supersedes?\s+{_GO}(\d+)", rf"in supersession of\s+{_GO}(\d+)", rf"{_GO}(\d+)\s+(?:is|are)\s+hereby\s+(?:rescinded|cancelled|superseded)"],
    "amends": [rf"amends?\s+{_GO}(\d+)", rf"in\s+(?:partial\s+)?amendment\s+(?:of|to)\s+{_GO}(\d+)", r"(?:Section|Rule)\s+(\d+)\s+(?:is|are)\s+(?:hereby\s+)?amended"],
    "cites": [r"(?:as per|under|in accordance with)\s+(?:Section|Rule)\s+(\d+)", r"(?:Section|Rule)\s+(\d+)\s+(?:provides|states|mandates)", r"in terms of\s+(?:Section|Rule)\s+(\d+)", rf"vide\s+{_GO}(\d+)"],
    "implements": [r"implement(?:s|ing|ation)?\s+(?:of\s+)?(?:the\s+)?([A-Z][A-Za-z\s,]+(?:Act|Rule|Policy|Scheme))", r"in implementation of\s+(?:the\s+)?([A-Z][A-Za-z\s,]+(?:Act|Rule))", r"gives effect to\s+(?:Section|Rule)\s+(\d+)"],
    "governed_by": [r"governed by\s+(?:the\s+)?([A-Z][A-Za-z\s,]+(?:Act|Rule))", r"under\s+(?:the\s+)?([A-Z][A-Za-z\s,]+(?:Act|Rule))", r"as per\s+(?:the\s+)?([A-Z][A-Za-z\s,]+(?:Act|Rule))"],
}
CONFIDENCE = {"supersedes": 0.95, "amends": 0.90, "cites": 0.85, "implements": 0.80, "governed_by": 0.80}
PRIORITY = {"supersedes": 5, "amends": 4, "implements": 3, "governed_by": 2, "cites": 1}
CONTEXT = 50
SCHEMA = "source_id string, relation_type string, target string, confidence double, context string, place int"


def standard_go(text: Column) -> Column:
    """G.O.Ms.No. 12 as G.O.Ms No. 12: the relation patterns allow no stop between MS and No."""
    return F.regexp_replace(text, r"(?i)(G\.?O\.?)\s*(MS|RT)\.\s*No\.?\s*", "$1$2No. ")


def _target(kind: str, whole: str, group: str) -> str:
    low = whole.lower()
    if kind == "supersedes":
        return f"G.O.MS.No.{group}"
    if kind == "amends":
        return f"Section {group}" if "section" in low or "rule" in low else f"G.O.MS.No.{group}"
    if kind == "cites":
        return f"Section {group}" if "section" in low else f"Rule {group}" if "rule" in low else f"G.O.MS.No.{group}" if "vide" in low else group
    return group.strip()


#: Letters that every match of a pattern holds in lower case, in the order of PATTERNS: a text without them needs no search.
NEEDED = {
    "supersedes": ["supersede", "in supersession of", "hereby"],
    "amends": ["amend", "amendment", "amended"],
    "cites": ["section|rule", "provides|states|mandates", "in terms of", "vide"],
    "implements": ["implement", "in implementation of", "gives effect to"],
    "governed_by": ["governed by", "under", "as per"],
}


def extract(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """SCHEMA rows of these kinds for (doc_id, text): matches need places in the text, so this is one Arrow pass over documents."""
    compiled = {k: [(re.compile(p, re.IGNORECASE), need.split("|")) for p, need in zip(PATTERNS[k], NEEDED[k], strict=True)] for k in PATTERNS if k in kinds}

    def find(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                place, text = 0, text or ""
                # (beyond ASCII a pattern without case also takes letters that lower() leaves as they are)
                low = text.lower() if text.isascii() else None
                for kind, patterns in compiled.items():
                    for p, need in patterns:
                        if low is not None and not any(n in low for n in need):
                            continue
                        for m in p.finditer(text):
                            context = text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT].strip()
                            rows.append((doc_id, kind, _target(kind, m.group(0), m.group(1)), CONFIDENCE[kind], context, place))
                            place += 1
            yield pd.DataFrame(rows, columns=["source_id", "relation_type", "target", "confidence", "context", "place"]).astype({"place": "int32", "confidence": "float64"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(find, SCHEMA)


def deduplicate(relations: DataFrame) -> DataFrame:
    """The first of each (source, type, target without case)."""
    first = F.row_number().over(Window.partitionBy("source_id", "relation_type", F.lower("target")).orderBy("place"))
    return relations.withColumn("_n", first).where("_n = 1").drop("_n")


def priority(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in PRIORITY.items():
        out = out.when(kind == k, v)
    return out.otherwise(0)


def worth_extracting(vertical: Column, text: Column) -> Column:
    return vertical.isin("go", "legal", "judicial") & (F.length(text) >= 500)


def supersession_map(docs: DataFrame, relations: DataFrame) -> DataFrame:
    """doc_id, superseded_by: claims joined with the document of that number (go_number: string), no loops, the last claim wins."""
    claims = relations.where("relation_type = 'supersedes'").select(F.col("source_id").alias("superseded_by"), F.regexp_extract("target", r"(\d+)", 1).alias("go_number"))
    named = docs.select("doc_id", "go_number").groupBy("go_number").agg(F.max("doc_id").alias("doc_id"))
    joined = claims.join(named, "go_number").where("doc_id <> superseded_by")
    return joined.groupBy("doc_id").agg(F.max("superseded_by").alias("superseded_by"))


def nested(relations: DataFrame) -> DataFrame:
    """doc_id, relations (array of type and target), as documents carry them."""
    return relations.groupBy("source_id").agg(F.sort_array(F.collect_set(F.struct(F.col("relation_type").alias("type"), "target"))).alias("relations")).withColumnRenamed("source_id", "doc_id")


def has_relation(relations: Column, kind: str, target: Column) -> Column:
    """Whether one and the same element has this type and this target."""
    return F.exists(relations, lambda r: (r["type"] == kind) & (r["target"] == target))


def inverted(docs: DataFrame) -> DataFrame:
    """type, target, doc_id of (doc_id, relations): a row for each distinct element, so that has_relation becomes an equi-join."""
    return docs.select("doc_id", F.explode(F.array_distinct("relations")).alias("r")).select("r.type", "r.target", "doc_id").distinct()


def sources_of(wanted: DataFrame, edges: DataFrame, kind: str, most: int = 5) -> DataFrame:
    """target, doc_id: the first documents with a relation of this type to each target of wanted."""
    kept = edges.where(F.col("type") == kind).join(wanted.select("target").distinct(), "target", "left_semi")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("doc_id"))
    return kept.withColumn("_r", rank).where(F.col("_r") <= most).select("target", "doc_id")


# fixed values: factors for a superseded result, and for documents that supersede or amend one
SUPERSEDED, SUPERSEDING, AMENDING, CHECKED = 0.3, 1.5, 1.2, 10


def with_reverse_edges(results: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, doc_id, score, via, of: results (query_id, rank, doc_id, target, score) and the documents that supersede or amend their first ten.

    target is the name by which relations call a result. A superseded result loses most of its score.
    """
    top = results.where(F.col("rank") <= CHECKED)
    found = {kind: files.written(sources_of(top, edges, kind), kind) for kind in ("supersedes", "amends")}
    old = found["supersedes"].select("target").distinct().withColumn("_old", F.lit(True))
    marked = results.join(old, "target", "left").withColumn("_old", F.coalesce("_old", F.lit(False)) & (F.col("rank") <= CHECKED))
    out = marked.select("query_id", "doc_id", F.when(F.col("_old"), F.col("score") * SUPERSEDED).otherwise(F.col("score")).alias("score"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("of"))
    for kind, factor in (("supersedes", SUPERSEDING), ("amends", AMENDING)):
        named = found[kind].withColumnRenamed("doc_id", "_new")
        out = out.unionByName(top.join(named, "target").select("query_id", F.col("_new").alias("doc_id"), F.lit(factor).alias("score"), F.lit(kind).alias("via"), F.col("doc_id").alias("of")))
    return out


def current_versions(pointers: DataFrame) -> DataFrame:
    """doc_id, current, steps, looped for (doc_id, superseded_by): the end of each document's chain and how far it is.

    Pointer jumping: each round doubles the steps that a pointer spans, so a chain of n documents takes
    about log2(n) rounds, each written to the shared folder. The distances along a chain have no gaps, so once no
    document finishes in a round, those left lead into a loop: looped, without current and steps. Of several
    pointers of a document the largest counts; rows with a null id are left out.
    """
    first = pointers.where("doc_id is not null and superseded_by is not null").groupBy("doc_id").agg(F.max("superseded_by").alias("to")).withColumn("steps", F.lit(1).cast("long"))
    open_ = files.written(first, "pointers")
    done = files.written(open_.join(open_.select(F.col("doc_id").alias("to")), "to", "left_anti").select("doc_id", "to", "steps"), "chain-ends")
    finished = done
    left = files.written(open_.join(done, "doc_id", "left_anti"), "pointers")
    while not left.isEmpty():
        # a pointer to a finished document ends where that one ends; others jump on
        ends = finished.select(F.col("doc_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.lit(True).alias("_end"))
        jumps = left.select(F.col("doc_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.lit(False).alias("_end"))
        moved = files.written(left.join(ends.unionByName(jumps), "to").select("doc_id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), "_end"), "pointers")
        new = moved.where("_end").drop("_end")
        if new.isEmpty():
            break
        finished = finished.unionByName(new)
        left = moved.where("not _end").drop("_end")
    ended = finished.select("doc_id", F.col("to").alias("current"), "steps", F.lit(False).alias("looped"))
    return ended.unionByName(left.select("doc_id", F.lit(None).cast(ended.schema["current"].dataType).alias("current"), F.lit(None).cast("long").alias("steps"), F.lit(True).alias("looped")))
