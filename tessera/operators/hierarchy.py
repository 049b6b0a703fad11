"""What the results of each query hold at the five levels of policy: constitution, statutes, administration, courts, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words, the year from which an order is recent, the most values of a field, lengths of excerpts, how many make a level strong
CONSTITUTION = ["constitution", "article", "fundamental right"]
METRICS = ["percentage", "%", "statistics", "data"]
RECENT = 2020
MOST = {"reference": 3, "act": 5, "section": 10, "department": 5, "case": 5, "source": 5, "metric": 3}
EXCERPT = {"reference": 200, "metric": 150}
#: level: vertical, first field, second field, fields of which one makes it present, field that is graded, grades, the graded number above which the first holds
LEVELS = {
    "constitutional": ("legal", "reference", None, ["reference"], "reference", ("strong", "moderate"), 2),
    "statutory": ("legal", "act", "section", ["act", "section"], "act", ("comprehensive", "limited"), 2),
    "administrative": ("go", "recent", "department", ["go"], "recent", ("active", "historical"), 0),
    "judicial": ("judicial", "case", "court", ["case"], "case", ("strong", "moderate"), 3),
    "empirical": ("data", "source", "metric", ["source"], "source", ("strong", "moderate"), 2),
}


def _some(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _found() -> list[Column]:
    """Structs of level, field, value and item; equal ones count once, and an item other than '' keeps equal values of different results apart."""
    low = F.lower(F.coalesce("text", F.lit("")))
    names = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    own = F.col("chunk_id").cast("string")
    row = lambda level, field, value, item=F.lit(""): F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.when(F.col("vertical") == LEVELS[level][0], value).alias("value"), item.alias("item"))
    case = F.concat_ws(", ", _some("case_number"), "court_name", F.col("year").cast("string"))
    return [
        row("constitutional", "reference", F.when(names(CONSTITUTION), F.left("text", F.lit(EXCERPT["reference"]))), own),
        row("statutory", "act", _some("act_name")),
        row("statutory", "section", _some("section_number")),
        row("administrative", "go", _some("go_number")),
        row("administrative", "recent", F.when(F.col("year") >= RECENT, _some("go_number")), own),
        row("administrative", "department", _some("department")),
        row("judicial", "case", F.when(_some("case_number").isNotNull(), case), own),
        row("judicial", "court", _some("court_name")),
        row("empirical", "source", _some("source")),
        row("empirical", "metric", F.when(names(METRICS), F.left("text", F.lit(EXCERPT["metric"]))), own),
    ]


def summary(results: DataFrame) -> DataFrame:
    """query_id, level, present, total, items, more, grade: five rows for each query of (query_id, chunk_id, vertical, score, text, act_name, section_number, go_number, department, case_number, court_name, source, year).

    items and more are the level's two lists, in the order in which results by score (then chunk_id) first hold
    their values, joined by ' | ' ('' if empty); total counts the distinct values of the field that makes the level
    present. A query without results in a level's vertical has present false, total 0 and nulls. Null and empty
    fields are no values. Distinct values are counted by a shuffle before the first MOST of them are listed.
    """
    ranked = results.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    long = ranked.select("query_id", "_place", F.explode(F.array(*_found())).alias("f")).where("f.value is not null").select("query_id", "_place", "f.*")
    distinct = long.groupBy("query_id", "level", "field", "value", "item").agg(F.min("_place").alias("place"))
    numbered = distinct.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "level", "field").orderBy("place", "value")))
    cap = F.coalesce(*[F.when(F.col("field") == f, F.lit(m)) for f, m in MOST.items()])
    listed = F.array_sort(F.collect_list(F.when(cap.isNull() | (F.col("n") <= cap), F.struct("n", "value"))))
    fields = numbered.groupBy("query_id", "level", "field").agg(F.count("*").alias("count"), F.array_join(F.transform(listed, lambda s: s["value"]), " | ").alias("list"))
    of = lambda what, field: F.max(F.when(F.col("field") == field, F.col(what)))
    pick = lambda what, at: F.coalesce(*[F.when(F.col("level") == lv, of(what, spec[at])) for lv, spec in LEVELS.items() if spec[at]])
    shown = F.coalesce(*[F.when(F.col("level") == lv, sum((F.coalesce(of("count", f), F.lit(0)) for f in spec[3]), F.lit(0))) for lv, spec in LEVELS.items()])
    facts = fields.groupBy("query_id", "level").agg(shown.alias("total"), pick("list", 1).alias("items"), pick("list", 2).alias("more"), F.coalesce(pick("count", 4), F.lit(0)).alias("graded"))
    levels = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(spec[0]).alias("vertical")) for lv, spec in LEVELS.items()])
    there = results.groupBy("query_id").agg(*[F.max((F.col("vertical") == v).cast("int")).alias(f"_{v}") for v in sorted({s[0] for s in LEVELS.values()})])
    has = F.coalesce(*[F.when(F.col("l.vertical") == v, F.col(f"_{v}") == 1) for v in sorted({s[0] for s in LEVELS.values()})], F.lit(False))
    every = there.select("*", F.explode(levels).alias("l")).select("query_id", F.col("l.level").alias("level"), F.coalesce(has, F.lit(False)).alias("has"))
    grade = F.coalesce(*[F.when(F.col("level") == lv, F.when(F.coalesce("graded", F.lit(0)) > spec[6], spec[5][0]).otherwise(spec[5][1])) for lv, spec in LEVELS.items()])
    two = F.col("level") != "constitutional"
    out = every.join(facts, ["query_id", "level"], "left")
    return out.select(
        "query_id", "level", (F.coalesce("total", F.lit(0)) > 0).alias("present"), F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.when(F.col("has"), F.coalesce("items", F.lit(""))).alias("items"), F.when(F.col("has") & two, F.coalesce("more", F.lit(""))).alias("more"), F.when(F.col("has"), grade).alias("grade"),
    )
