"""Which texts contain which needles, without comparing each with each: one short string of every needle picks its candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.sources import files

SIZE = 8  # bytes, so that a gram is a whole number
#: Up to so many needles of so many characters together are broadcast; beyond, both sides are shuffled by gram. The rows are the same.
BROADCAST_NEEDLES = 100_000
BROADCAST_CHARS = 8_000_000
#: Tables of fixed size: counters of the texts' grams, and the bits of the grams that are looked for.
COUNTER_BITS = 18
FILTER_BITS = 26
_AT_ONCE = 1 << 20  # bytes of text that are looked at together


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _grams(texts, sizes):
    """Arrays (row, size, gram) of all substrings of so many UTF-8 bytes in an Arrow array of strings, a stretch of bytes at a time."""
    import pyarrow as pa

    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for a in range(int(ends[0]), int(ends[-1]), _AT_ONCE):
        b = min(a + _AT_ONCE, int(ends[-1]))
        part = np.concatenate([data[a : b + SIZE], np.zeros(max(0, b + SIZE - len(data)), np.uint8)])
        at = np.arange(a, b)
        row = np.searchsorted(ends, at, "right") - 1
        left = ends[row + 1] - at
        gram = np.zeros(b - a, np.uint64)
        for j in range(SIZE):
            gram |= part[j : j + b - a].astype(np.uint64) << np.uint64(8 * j)
            if j + 1 in sizes:
                whole = left > j
                yield row[whole], j + 1, gram[whole]


def _counted(rows: DataFrame, sizes: list[int]) -> np.ndarray:
    """How often texts hold the grams of each counter."""

    def count(batches):
        import pyarrow as pa

        seen = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for _, _, gram in _grams(batch.column(0), sizes):
                seen += np.bincount(_slots(gram, COUNTER_BITS).astype(np.int64), minlength=1 << COUNTER_BITS)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(seen[slots])], ["slot", "n"])

    found = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def _anchored(wanted: DataFrame, sizes: list[int], counts) -> DataFrame:
    """needle, gram: of each needle's grams the one that texts hold least often (itself, where it is shorter); needles with one that no text holds are left out."""

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            needles = batch.column(0)
            size = np.minimum(np.array([len(x.encode()) for x in needles.to_pylist()], np.int64), SIZE)
            rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for row, k, gram in _grams(needles, sizes):
                own = size[row] == k
                rows.append(row[own])
                grams.append(gram[own])
            row, gram = np.concatenate(rows), np.concatenate(grams)
            n = counts.value[_slots(gram, COUNTER_BITS)]
            order = np.lexsort((gram, n, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            first = first[n[first] > 0]
            yield pa.RecordBatch.from_arrays([needles.take(pa.array(row[first])), pa.array(gram[first].view(np.int64))], ["needle", "gram"])

    return wanted.select("needle").mapInArrow(pick, "needle string, gram long")


def _looked_for(anchors: DataFrame) -> np.ndarray:
    """A bit for each slot of the anchors' grams, in words of 64."""

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).view(np.int64)), pa.array(np.left_shift(np.uint64(1), slot & np.uint64(63)).view(np.int64))], ["word", "bits"])

    found = anchors.select("gram").mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def _candidates(rows: DataFrame, sizes: list[int], words) -> DataFrame:
    """rows (text in the last column) with each gram of the text that may be an anchor."""

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for row, _, gram in _grams(batch.column(batch.num_columns - 1), sizes):
                slot = _slots(gram, FILTER_BITS)
                hit = (words.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                pairs = np.unique(np.rec.fromarrays([row[hit], gram[hit].view(np.int64)], names="row,gram"))
                for at in range(0, len(pairs), 10_000):
                    some = pairs[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some["row"])).columns, pa.array(some["gram"])], [*batch.schema.names, "gram"])

    return rows.mapInArrow(search, StructType([*rows.schema.fields, StructField("gram", LongType())]))


def matches(texts: DataFrame, needles: DataFrame, key: str, text: str = "text", needle: str = "needle") -> DataFrame:
    """Distinct (key, needle) of every needle that is a substring of the text of a row.

    Of a needle's grams of SIZE bytes (itself, where it is shorter) the one that texts hold least often, by a table of
    counters, is its anchor; a text goes to the needles of those of its grams that a filter of all anchors lets
    through, and is searched there. Null texts and null or empty needles match nothing.
    """
    spark = texts.sparkSession
    wanted = files.written(needles.select(F.col(needle).alias("needle")).where(F.length("needle") > 0).distinct(), "needles")
    seen = wanted.agg(F.count("*").alias("n"), F.sum(F.length("needle")).alias("chars"), F.sort_array(F.collect_set(F.least(F.octet_length("needle"), F.lit(SIZE)))).alias("sizes")).first()
    small = seen.n <= BROADCAST_NEEDLES and (seen.chars or 0) <= BROADCAST_CHARS
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    counts = spark.sparkContext.broadcast(_counted(rows, seen.sizes))
    anchors = files.written(_anchored(wanted, seen.sizes, counts), "anchors")
    words = spark.sparkContext.broadcast(_looked_for(anchors))
    # (written files look small beside what they hold, so that Spark would broadcast needles without number)
    found = _candidates(rows, seen.sizes, words).join(F.broadcast(anchors) if small else anchors.hint("merge"), "gram")
    return found.where(F.contains("text", "needle")).select(F.col("key").alias(key), F.col("needle").alias(needle)).distinct()
