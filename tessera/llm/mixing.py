"""Mixing sources to target weights by Pfair scheduling; DataFrame operations only.

A source with share n/Q of the mix gets, as its k-th block (k from 1), the window from release
floor((k-1)Q/n) to deadline ceil(kQ/n), in slots of one block. Earliest deadline first over unit
blocks keeps every block inside its window, so after any number of slots each source is less than
one block from its share. Windows repeat every Q slots: the driver schedules one period of the
target weights (Q slots, whatever the corpus holds), and blocks take their slots by a join.

The mix lasts until each source has been used whole at least once. Sources that their weight asks
for sooner start over (epoch 1, 2, ...), so no document is left out; the last slot may end a period.

Defined results: null sources are one source of their own; repeated rows are documents of their
own; rows without doc_id are mixed too; an empty table gives no rows; sources that the given
weights don't name, or give a weight that is not above 0, are an error, since their documents
would have to go. Columns of docs that have the names of the added ones are replaced by those.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slots in a period, at least; each source's share is a whole number of them.
PERIOD = 4096
#: Documents in a block.
BLOCK = 16
#: Without given weights a source's share follows its number of documents to this power.
TEMPERATURE = 0.9
# fixed values: how much more of some sources the registered query asks for, by a hash of their names
TILT = (1.0, 1.5, 2.0)


def quotas(weights: dict, period: int = PERIOD) -> tuple[dict, int]:
    """Slots of a period for each source (largest remainders, one at least), and the period."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    left = period - sum(slots.values())
    for s in order:
        if left > 0:
            slots[s] += 1
            left -= 1
    while left < 0:
        s = max(slots, key=lambda s: (slots[s] - exact[s] if slots[s] > 1 else -1, str(s)))
        slots[s] -= 1
        left += 1
    return slots, period


def schedule(slots: dict, period: int) -> list[tuple]:
    """(source, k from 0, release, deadline, slot) of one period, by earliest deadline first among the released blocks."""
    names = sorted(slots, key=str)
    releases = sorted((k * period // slots[s], i, k) for i, s in enumerate(names) for k in range(slots[s]))
    ready, out, at = [], [], 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            r, i, k = releases[at]
            heapq.heappush(ready, (-(-(k + 1) * period // slots[names[i]]), i, k, r))
            at += 1
        deadline, i, k, r = heapq.heappop(ready)
        out.append((names[i], k, r, deadline, slot))
    return out


def mix(docs: DataFrame, weights: dict | Callable[[dict], dict] | None = None, block: int = BLOCK, period: int = PERIOD, temperature: float = TEMPERATURE) -> DataFrame:
    """docs with mix_block, mix_epoch, mix_release, mix_deadline, mix_slot and mix_seat (place in the block). Read in order of slot and seat it is the mix. weights may be a function of the sources' sizes."""
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    sizes = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each source
    weights = weights(sizes) if callable(weights) else weights if weights is not None else {s: n**temperature for s, n in sizes.items()}
    if bad := [s for s in sizes if not weights.get(s, 0) > 0]:
        raise ValueError(f"no weight above 0 for the sources {bad}")
    added = "mix_block long, mix_epoch long, mix_release long, mix_deadline long, mix_slot long, mix_seat int"
    if not sizes:
        return docs.select(*[f"`{c}`" for c in docs.columns if c not in added.replace(",", "").split()[::2]], *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in added.split(", "))])
    slots, period = quotas({s: weights[s] for s in sizes}, period)
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    plan = schedule(slots, period)
    # the horizon: the first slot count at which every source has had all its blocks
    last = {}
    for s, k, _, _, slot in plan:
        last[s, k] = slot
    horizon = max((b - 1) // slots[s] * period + last[s, (b - 1) % slots[s]] + 1 for s, b in blocks.items())
    given = {s: horizon // period * n for s, n in slots.items()}
    for s, _, _, _, slot in plan:
        given[s] += slot < horizon % period
    facts = spark.createDataFrame([(s, blocks[s], given[s], slots[s]) for s in sizes], "s string, _blocks long, _given long, _quota long")
    table = spark.createDataFrame(plan, "t string, _k long, _release long, _deadline long, _slot long")

    # a document's place in its source: by a hash, ranked in salted groups, so that a hot source is many groups
    salts = max(64, sum(sizes.values()) // 20_000)
    names = [c for c in docs.columns if c not in added.replace(",", "").split()[::2]]
    row = docs.select(F.struct("*").alias("_row"), source.alias("_source"), F.xxhash64(F.lit(17), "doc_id").alias("_order"))
    row = row.withColumn("_salt", F.floor((F.col("_order") / 2.0**64 + 0.5) * salts).cast("int"))
    groups = docs.select(source.alias("_source"), F.floor((F.xxhash64(F.lit(17), "doc_id") / 2.0**64 + 0.5) * salts).cast("int").alias("_salt"))
    before = groups.groupBy("_source", "_salt").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col("_source").alias("_s"), F.col("_salt").alias("_t"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_source", "_salt").orderBy("_order", "_row.doc_id"))
    ranked = row.withColumn("_in", within).join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_t")))
    ranked = ranked.withColumn("_rank", F.col("_in") - 1 + F.col("_before"))
    # facts has a row for each source, table one for each slot of a period: both follow the weights, not the corpus
    ranked = ranked.join(F.broadcast(facts), F.col("_source").eqNullSafe(F.col("s")))
    ranked = ranked.withColumn("mix_block", F.expr(f"_rank div {block}")).withColumn("mix_seat", F.expr(f"cast(_rank % {block} as int)"))
    ranked = ranked.withColumn("mix_epoch", F.explode(F.expr("sequence(0L, (_given - 1 - mix_block) div _blocks)")))
    ranked = ranked.withColumn("_m", F.col("mix_block") + F.col("mix_epoch") * F.col("_blocks"))
    ranked = ranked.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("t")) & (F.expr("_m % _quota") == F.col("_k")))
    shift = F.expr("_m div _quota") * period
    return ranked.select(
        *[F.col("_row").getField(n).alias(n) for n in names], "mix_block", "mix_epoch",
        (F.col("_release") + shift).alias("mix_release"), (F.col("_deadline") + shift).alias("mix_deadline"), (F.col("_slot") + shift).alias("mix_slot"), "mix_seat",
    )


def tilted(sizes: dict) -> dict:
    """Unequal targets: each source's size to the power TEMPERATURE, times one of TILT by its name."""
    return {s: n**TEMPERATURE * TILT[zlib.crc32(str(s).encode()) % len(TILT)] for s, n in sizes.items()}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, tilted)
