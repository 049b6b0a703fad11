"""Best-fit packing of tokenized documents into sequences by bin completion.

Only the histogram of piece lengths (at most max_tokens entries) reaches the driver. There, bin
completion branch and bound fills each sequence around the longest piece left with undominated
sets of lengths, pruned by the waste that a better solution may have; best-fit decreasing gives
the first incumbent. The plan says how often each filling is used; pieces take their places by
their rank within their length, which is counted over salted groups, so no length is one group.

Best-fit often meets the lower bound and is then proven. Otherwise the search may take STEPS steps; what it
has found by then is returned, and the columns sequences, lower_bound and proved say how far it is from the bound.

Defined results: a null text is empty (one piece, the end token alone); repeated rows are packed
each; an empty table gives no rows; rows without doc_id are packed too.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.tokens import run_ids

MAX_TOKENS, END_ID = 4096, 1
#: Steps of the search (pieces tried, fillings compared, nodes visited) before it keeps its incumbent: some seconds.
STEPS = 4_000_000
#: Fillings that are looked at around one longest piece, and steps of their enumeration.
FILLINGS, TRIES = 100, 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """PIECES rows of every document's whole text; only documents of more than max_tokens ids are cut."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of = run_ids(path)
            for lo in range(0, batch.num_rows, 2000):
                rows = []
                texts = [t or "" for t in batch.column(1)[lo : lo + 2000].to_pylist()]
                for doc_id, ids in zip(batch.column(0)[lo : lo + 2000].to_pylist(), ids_of.encode_many(texts), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, at in enumerate(range(0, len(ids), max_tokens)):
                        part = ids[at : at + max_tokens]
                        rows.append((doc_id, k, at, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def least_bins(counts: dict[int, int], cap: int) -> int:
    """A lower bound: total size, or for some a the pieces over cap - a alone and what cannot go beside them (Martello and Toth's L2)."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // cap) if counts else 0
    for a in [s for s in sizes if s <= cap // 2] or [0]:
        big = sum(n for s, n in counts.items() if s > cap - a)
        half = [(s, n) for s, n in counts.items() if cap // 2 < s <= cap - a]
        low = sum(s * n for s, n in counts.items() if a <= s <= cap // 2)
        mid = sum(n for _, n in half)
        free = sum((cap - s) * n for s, n in half)
        best = max(best, big + mid + max(0, -(-(low - free) // cap)))
    return best


def best_fit(counts: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (filling, times). Equal pieces meet equal gaps, so they are placed many at a time."""
    bins: dict[tuple[int, ...], int] = {}
    gaps: dict[int, set] = defaultdict(set)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            gap = min((g for g, b in gaps.items() if g >= size and b), default=None)
            if gap is None:
                per = min(left, cap // size)
                made = [((size,) * per, left // per)] + ([((size,) * (left % per), 1)] if left % per else [])
                left = 0
            else:
                old = min(gaps[gap])
                per = min(left, gap // size)
                times = min(bins[old], left // per)
                bins[old] -= times
                if not bins[old]:
                    del bins[old]
                    gaps[gap].discard(old)
                made, left = [(old + (size,) * per, times)], left - per * times
            for filling, times in made:
                bins[filling] = bins.get(filling, 0) + times
                gaps[cap - sum(filling)].add(filling)
    return sorted(bins.items(), reverse=True)


def _dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of a can be dealt into rooms of the sizes in b: then b is as good a filling."""
    if sum(a) > sum(b):
        return False

    def deal(k: int, rooms: list[int]) -> bool:
        if k == len(a):
            return True
        for i in range(len(rooms)):
            if rooms[i] >= a[k] and rooms[i] not in rooms[:i]:
                rooms[i] -= a[k]
                if deal(k + 1, rooms):
                    return True
                rooms[i] += a[k]
        return False

    return deal(0, list(b))


def fillings(counts: dict[int, int], room: int, slack: int, most: int = FILLINGS, tries: int = TRIES) -> tuple[list[tuple[int, ...]], bool, int]:
    """Undominated sets of pieces for the room beside the longest piece that leave at most `slack` of it empty, fullest first; whether these are all; steps taken."""
    if counts.get(room):
        return [(room,)], True, 1  # one piece that fills the room dominates every other filling
    sizes = [s for s in sorted(counts, reverse=True) if s <= room and counts[s]]
    if not sizes:
        return ([()] if room <= slack else []), True, 1
    after = [0] * (len(sizes) + 1)  # what the pieces from here on hold in all
    for i in range(len(sizes) - 1, -1, -1):
        after[i] = after[i + 1] + sizes[i] * counts[sizes[i]]
    found: list[tuple[int, ...]] = []
    left = tries

    def grow(chosen: tuple[int, ...], at: int, free: int) -> None:
        nonlocal left
        fits = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s > free or chosen.count(s) >= counts[s]:
                continue
            fits = True
            if after[i] < free - slack or left <= 0:
                return
            left -= 1
            rest, more = free - s, (*chosen, s)
            if rest and rest <= s and counts.get(rest, 0) > more.count(rest):
                found.append((*more, rest))  # full: it dominates all that starts alike
            elif not rest:
                found.append(more)
            else:
                grow(more, i, rest)
        if not fits and free <= slack and not any(s <= free and chosen.count(s) < counts[s] for s in sizes):
            found.append(chosen)

    grow((), 0, room)
    whole, steps = left > 0, tries - left
    found = sorted(set(found), key=lambda f: (-sum(f), len(f), f))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if len(kept) >= most:
            whole = False
            break
        steps += len(kept)
        if not any(_dominated(f, k) for k in kept):
            kept.append(f)
    return kept, whole, steps


def _search(counts: dict[int, int], cap: int, best_n: int, least: int, steps: int, often: bool) -> tuple[list | None, bool, int]:
    """Depth-first bin completion for fewer than best_n bins: (a plan with fewer or None, whether all was searched, steps left)."""
    total = sum(s * n for s, n in counts.items())
    now, path, stack, whole, best = dict(counts), [], [], True, None
    used = waste = 0
    tries = max(500, min(TRIES, steps // best_n))  # so that the first way down ends within the budget

    def options() -> list[tuple[tuple[int, ...], int]]:
        nonlocal whole, steps
        size = max(now)
        now[size] -= 1
        found, every, taken = fillings(now, cap - size, (best_n - 1) * cap - total - waste, tries=tries)
        now[size] += 1
        steps -= taken
        out = []
        for f in found:
            need = defaultdict(int)
            for s in (size, *f):
                need[s] += 1
            times = min(now[s] // n for s, n in need.items()) if often else 1
            every = every and times == 1
            out.append(((size, *f), times))
        whole = whole and every
        return out

    def put(filling: tuple[int, ...], times: int) -> None:
        for s in filling:
            now[s] = now.get(s, 0) - times
            if not now[s]:
                del now[s]

    stack.append(iter(options()))
    while stack:
        if steps <= 0:
            return best, False, 0
        step = next(stack[-1], None)
        if step is not None:
            steps -= 1
            filling, times = step
            over = waste + times * (cap - sum(filling))
            if over > (best_n - 1) * cap - total:  # no better solution has so much waste
                continue
            put(filling, times)
            path.append(step)
            used, waste = used + times, over
            if now:
                stack.append(iter(options()))
                continue
            if used < best_n:
                best, best_n = list(path), used
                if best_n <= least:
                    return best, True, steps
        else:
            stack.pop()
        if path:
            filling, times = path.pop()
            used, waste = used - times, waste - times * (cap - sum(filling))
            put(filling, -times)
    return best, whole, steps


def bin_completion(counts: dict[int, int], cap: int, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], int, bool]:
    """(filling, times) for all pieces, the number of bins, and whether that is proven least.

    Each level takes the longest piece left and tries its undominated fillings, fullest first. A branch
    ends when its waste leaves no room for fewer bins than the incumbent's (best-fit decreasing at first). Two
    searches share the budget of steps, at every size alike: one uses a filling as often as the counts
    allow, then one takes a bin at a time. Only the second, and only if neither its fillings nor its steps were cut, proves
    what it didn't improve; meeting the lower bound always does.
    """
    counts = {s: n for s, n in counts.items() if n}
    least = least_bins(counts, cap)
    best = best_fit(counts, cap)
    best_n = sum(t for _, t in best)
    whole = best_n <= least
    for often, share in ((True, steps // 4), (False, steps)):
        if whole:
            break
        better, whole, left = _search(counts, cap, best_n, least, share, often)
        steps -= share - left
        if better:
            best, best_n = better, sum(t for _, t in better)
        whole = best_n <= least or whole
    return best, best_n, whole


def _plan_arrays(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces in a sequence and first offset of each use, in order of rank."""
    uses: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for filling, times in plan:
        at = 0
        for size in sorted(set(filling), reverse=True):
            n = filling.count(size)
            uses[size].append((ranks[size], first, n, at))
            ranks[size] += n * times
            at += n * size
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*u, strict=True)) for s, u in uses.items()}


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, steps: int = STEPS) -> DataFrame:
    """parts (PIECES) with sequence_id and offset, and the number of sequences, its lower bound and whether it is proven least. parts is read several times: materialize it first."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most max_tokens rows
    plan, used, proved = bin_completion(histogram, max_tokens, steps)
    least = least_bins(histogram, max_tokens)
    arrays = spark.sparkContext.broadcast(_plan_arrays(plan))  # at most one use of a length in each filling: some thousand numbers
    salts = max(64, sum(histogram.values()) // 20_000)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[group[0]])
                lo, first, n, at = arrays.value[size]
                use = np.searchsorted(lo, rank[group], side="right") - 1
                k = rank[group] - lo[use]
                seq[group], off[group] = first[use] + k // n[use], at[use] + k % n[use] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    names = [x.split()[0] for x in PIECES.split(", ")]
    placed = ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")
    return placed.withColumns({"sequences": F.lit(used).cast("long"), "lower_bound": F.lit(least).cast("long"), "proved": F.lit(proved)})


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, steps: int = STEPS) -> DataFrame:
    return pack(materialize(pieces(docs, path or tokenizer_path(), max_tokens), "pieces"), max_tokens, steps)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
