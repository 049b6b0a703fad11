"""Paragraph splitting and greedy packing of paragraphs into chunks, as array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: least, most and overlapping characters of each vertical's chunks
SIZES = {"go": (600, 1200, 100), "legal": (800, 1500, 150), "judicial": (700, 1300, 120), "data": (500, 1000, 80), "scheme": (600, 1200, 100)}


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def pack(parts: Column, least: int, most: int, overlap: int, keep_tail: bool = False, joint: str = "\n\n", whole: bool = False) -> Column:
    """Chunks of an array of paragraphs: a group closes when the next paragraph would pass `most`, if it has `least` characters; the next group starts with its last paragraph, or that one's end.

    A last group under `least` is left out, unless keep_tail. With `whole` the last paragraph is carried over as it is, and the next one counts twice.
    """
    state = "struct<chunks:array<string>,group:array<string>,size:int>"
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<string>").alias("group"), F.lit(0).alias("size")).cast(state)

    def step(acc: Column, para: Column) -> Column:
        chunks, group, size = acc["chunks"], acc["group"], acc["size"]
        n = F.length(para)
        text = F.array_join(group, joint)
        closes = (size + n > most) & (F.size(group) > 0) & (F.length(text) >= least)
        last = F.element_at(group, -1)
        tail = F.substring(last, F.greatest(F.length(last) - overlap + 1, F.lit(1)), F.lit(overlap))
        fresh = F.array(F.element_at(group, -1), para) if whole else F.array(tail, para) if overlap else F.array(para)
        fresh_size = n * 2 if whole else F.length(tail) + n if overlap else n
        return F.struct(
            F.when(closes, F.concat(chunks, F.array(text))).otherwise(chunks).alias("chunks"),
            F.when(closes, fresh).otherwise(F.concat(group, F.array(para))).alias("group"),
            F.when(closes, fresh_size).otherwise(size + n).cast("int").alias("size"),
        ).cast(state)

    def end(acc: Column) -> Column:
        text = F.array_join(acc["group"], joint)
        keep = F.size(acc["group"]) > 0 if keep_tail else (F.size(acc["group"]) > 0) & (F.length(text) >= least)
        return F.when(keep, F.concat(acc["chunks"], F.array(text))).otherwise(acc["chunks"])

    return F.aggregate(parts, start, step, end)


def chunk(docs: DataFrame, least: int, most: int, overlap: int, keep_tail: bool = False) -> DataFrame:
    """chunk_id, doc_id, chunk_index, content, word_count, char_count; documents under 50 characters give none."""
    rows = docs.where(F.length("text") >= 50).select("doc_id", F.posexplode(pack(paragraphs(F.col("text")), least, most, overlap, keep_tail)).alias("chunk_index", "content"))
    return rows.select(
        F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "content",
        F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")).alias("word_count"), F.length("content").alias("char_count"),
    )


def split_before(text: Column, pattern: str) -> Column:
    """Pieces that start where the pattern does; what precedes the first start is left out."""
    return F.filter(F.split(text, f"(?im)(?={pattern})"), lambda p: p.rlike(f"(?im)^{pattern}"))


def legal_sections(docs: DataFrame) -> DataFrame:
    """doc_id, pos, section_number, content of each Section heading up to the next."""
    pieces = docs.select("doc_id", F.posexplode(split_before(F.col("text"), r"^(?:Section|Sec\.?)\s+\d")).alias("pos", "piece"))
    return pieces.select("doc_id", "pos", F.regexp_extract("piece", r"(?i)^(?:Section|Sec\.?)\s+(\d+[A-Z]?)", 1).alias("section_number"), F.regexp_replace("piece", r"^\s+|\s+$", "").alias("content"))


def marked_sections(docs: DataFrame, markers: dict[str, str], first: str) -> DataFrame:
    """doc_id, pos, section_type, content: from each type's first marker to the next one's; the text before them is `first` if over 200 characters."""
    places = [F.struct(F.when(F.regexp_instr(F.col("text"), F.lit(f"(?im){p}")) > 0, F.regexp_instr(F.col("text"), F.lit(f"(?im){p}"))).alias("at"), F.lit(k).alias("kind")) for k, p in markers.items()]
    found = docs.select("doc_id", "text", F.explode(F.array(*places)).alias("s")).select("doc_id", "text", "s.at", "s.kind").where("at is not null")
    w = Window.partitionBy("doc_id").orderBy("at", "kind")
    spans = found.withColumn("next", F.coalesce(F.lead("at").over(w), F.length("text") + 1)).withColumn("pos", F.row_number().over(w))
    rows = spans.select("doc_id", "pos", F.col("kind").alias("section_type"), F.trim(F.expr("substring(text, at, next - at)")).alias("content"))
    head = spans.where("pos = 1 and at > 201").select("doc_id", F.lit(0).alias("pos"), F.lit(first).alias("section_type"), F.trim(F.expr("substring(text, 1, at - 1)")).alias("content"))
    return rows.unionByName(head)


# fixed values: section markers of judicial and scheme documents
JUDICIAL_MARKERS = {"facts": r"^\s*FACTS\b", "judgment": r"^\s*JUDGMENT\b", "arguments": r"^\s*ARGUMENTS\b", "order": r"^\s*ORDER\b"}
SCHEME_MARKERS = {"eligibility": r"^\s*ELIGIBILITY\b", "benefits": r"^\s*BENEFITS\b", "objectives": r"^\s*OBJECTIVES\b", "application": r"^\s*APPLICATION\b", "implementation": r"^\s*IMPLEMENTATION\b"}
