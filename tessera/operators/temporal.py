"""Joins by time: the last row before an instant, and the intervals that hold an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import files

DAY = 86_400_000_000  # microseconds
LEAST_LEVEL = 20  # intervals below 2^20 microseconds share a level
FEW = 64  # a key with so many intervals at most is joined whole


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, values: list[str], width: int = DAY) -> DataFrame:
    """left with the values of the newest row of right that has the same key and isn't later (null without one).

    Both sides are sorted together, within a key and a span of width microseconds, so that no key, however
    hot, is one task; what a span starts with is the newest row of earlier spans, found among one row for each span.
    Of rows of right at one instant the one with the largest values counts. Null keys or times find nothing.
    """
    span = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / F.lit(width))
    found = F.struct(F.col(right_at).cast("timestamp").alias("t"), *[F.col(v).alias(v) for v in values])
    rows = left.select(F.struct("*").alias("_row"), F.col(by).alias("_by"), F.col(at).cast("timestamp").alias("_at"), span(at).alias("_span"))
    facts = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.col(by).alias("_by"), span(right_at).alias("_span"), found.alias("_found"))
    both = rows.withColumn("_found", F.lit(None).cast(facts.schema["_found"].dataType)).withColumn("_side", F.lit(1)).unionByName(
        facts.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_by", F.col("_found.t").alias("_at"), "_span", "_found", F.lit(0).alias("_side"))
    )
    earlier = Window.partitionBy("_by", "_span").orderBy("_at", "_side", "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("_found", F.last("_found", ignorenulls=True).over(earlier)).where("_side = 1").drop("_side")
    # the newest row before each span that left has rows in
    starts = facts.groupBy("_by", "_span").agg(F.max("_found").alias("_newest")).unionByName(rows.select("_by", "_span").where("_by is not null and _at is not null").distinct().withColumn("_newest", F.lit(None).cast(facts.schema["_found"].dataType)))
    starts = starts.groupBy("_by", "_span").agg(F.max("_newest").alias("_newest"))
    before = Window.partitionBy("_by").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_carried", F.last("_newest", ignorenulls=True).over(before)).drop("_newest").where("_carried is not null")
    out = within.join(starts, ["_by", "_span"], "left")
    best = F.when(F.col("_by").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    return out.withColumn("_best", best).select("_row.*", *[F.col(f"_best.{v}").alias(f"found_{v}") for v in values])


def during(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """Columns of points and of intervals (which don't share names but by) where the keys are equal and start <= at < end; a null end is open.

    Points of a key with FEW intervals at most meet all of them. Beyond, an interval's level is the power of two that it fits in,
    so it touches two bins of that size at most, and a point looks into one bin of each level that occurs (45 at most). Nothing
    is enumerated by days; ends are compared exactly.
    """
    hit = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    whole = files.written(intervals.where(F.col(by).isNotNull()), "intervals")
    crowded = files.written(whole.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(by), "crowded-keys")
    # (written files look small beside what they hold: the joins sort rather than broadcast)
    direct = points.where(F.col(at).isNotNull()).join(whole.join(crowded.hint("merge"), by, "left_anti").hint("merge"), by).where(hit)
    if crowded.isEmpty():
        return direct
    return direct.unionByName(_binned(points.join(crowded.hint("merge"), by, "left_semi"), whole.join(crowded.hint("merge"), by, "left_semi"), by, at, start, end))


def _binned(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """during for keys with many intervals, by level and bin."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    most = 62
    length = micros(end) - micros(start)
    level = F.when(F.col(end).isNull(), F.lit(most)).otherwise(F.greatest(F.lit(LEAST_LEVEL), F.least(F.lit(most), F.ceil(F.log2(length.cast("double"))).cast("int") + 1)))
    bin_of = lambda t, lv: F.floor(t / F.pow(F.lit(2.0), lv)).cast("long")
    spans = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (length > 0))).withColumn("_level", level)
    last = F.when(F.col(end).isNull(), F.greatest(bin_of(micros(start), F.col("_level")), F.lit(0).cast("long"))).otherwise(bin_of(micros(end) - 1, F.col("_level")))
    spans = spans.withColumn("_bin", F.explode(F.sequence(bin_of(micros(start), F.col("_level")), last)))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # powers of two: 43 numbers at most
    if not levels:
        levels = [LEAST_LEVEL]
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bin", bin_of(micros(at), F.col("_level")))
    hits = asked.join(spans, [by, "_level", "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))
    return hits.drop("_level", "_bin")
