"""Jaccard join of word-shingle sets, exact: who belongs together at a similarity of NUM/DEN or more.

Candidates. Shingles have one global order, rare hash buckets first, known from a count of all
shingles in a table of fixed size. Two sets that are similar enough share a shingle of the larger
set's probing prefix and the smaller set's indexing prefix, so prefix shingles bring candidates
together. Entries travel as packed arrays, a row for each bucket of shingles.

A shingle that too many documents hold is dealt into several buckets by document; each bucket's
first document of a band leads its own, and the leaders are paired afterwards.

Tiles. The documents under one shingle (equal groups of them counted once) are dealt into bands of set size; only equal or neighbouring
bands can hold similar sets. Small tiles give their pairs at once. In larger ones each document is
first paired with its band's smallest document alone; once those links are known, a later round
compares, inside the tile, only documents that are not yet connected: those outside the group's
largest component, with each other and with it.

Bounds and proof. Each set has a parity bitmap: hashed bits, flipped by every shingle. Two bitmaps
differ in no more bits than the sets differ in shingles, so counting differing bits bounds the
overlap from above. Pairs that pass are proved by intersecting the sorted arrays.

Defined results: null and empty texts have no shingles, are linked with nothing and are their own
component; rows without doc_id are returned without a component; rows that repeat a doc_id are one
node, linked where any of their texts is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, batches_of, dealt_into, keep_ids, materialize, mix64, release
from tessera.llm.components import components
from tessera.llm.shingles import WORDS, shingle_sets

NUM, DEN = 3, 4
#: Slots of the count of all shingles; a fixed size, whatever the corpus.
SLOTS = 1 << 22
_SHIFT = 64 - 22
#: Tables of counts travel and are summed in so many pieces of PIECE slots.
PIECES = 16
PIECE = SLOTS // PIECES
#: Groups of up to this many documents under a shingle give all their pairs at once.
SMALL = 16
#: Documents on a side of a tile.
SIDE = 512
#: Rows in an Arrow batch, and packed entries that a task holds.
BATCH, HELD = 200, 250_000
#: Packed entries that a bucket holds on average.
BUCKET = 250_000
#: Documents that may have a shingle before its group is dealt into several buckets.
GROUP = 250_000
MOST_BITS, SHORT_BITS = 1 << 18, 8192


def _bits(n: int) -> int:
    """Bits of a set's parity bitmap: some four or more for each shingle, so that few flips cancel. Bits are numbered from the low end, so halves fold by xor."""
    return min(MOST_BITS, max(64, 4 << (max(1, n) - 1).bit_length()))


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmap words folded to `size` words."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def needed(x, y):
    """Shingles that sets of x and y must share: overlap >= NUM/DEN of the union."""
    return -(-NUM * (x + y) // (NUM + DEN))


def links(shared: int, x: int, y: int) -> bool:
    return DEN * shared >= NUM * (x + y - shared)


class SlotCounts:
    """Counts of shingles by slot, in cells of four bytes; a task holds one, and packs it a piece at a time."""

    def __init__(self):
        self.cells, self.waiting, self.size = np.zeros(SLOTS, np.uint32), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.waiting.append(slots)
        self.size += len(slots)
        if self.size > 500_000:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            slot, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.cells[slot] += n.astype(np.uint32)
            self.waiting, self.size = [], 0

    def pieces(self):
        self.settle()
        for piece in range(PIECES):
            part = self.cells[piece * PIECE : (piece + 1) * PIECE]
            if part.any():
                yield piece, _packed(part)


def _packed(counts: np.ndarray) -> bytes:
    """Slots that are not 0, and their counts."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), counts[at]]).astype("<u4").tobytes(), 1)


def _add(total: np.ndarray, blob: bytes) -> None:
    steps, counts = np.frombuffer(zlib.decompress(blob), "<u4").reshape(2, -1)
    total[np.cumsum(steps, dtype=np.int64)] += counts.astype(total.dtype)


def signatures(docs: DataFrame, words: int) -> tuple[DataFrame, list[bytes], int]:
    """(doc_id, n, f1, f2, bits) of every document, the packed counts of shingles by slot (a blob for each piece), and how many there are."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("bits", pa.binary()), ("is_count", pa.bool_())])

    def rows_of(ids, sets, counts):
        """Signatures of some documents together: all their shingles in one array, whose slots are counted."""
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        has = np.flatnonzero(n)
        out = [(d, 0, 0, 0, b"", False) for d in ids]
        if len(has):
            every, n = np.concatenate([sets[k] for k in has]), n[has]
            counts.add((every >> U64(_SHIFT)).astype(np.uint32))
            start = np.cumsum(n) - n
            f1, f2 = (np.add.reduceat(mix64(every ^ U64(k)), start).view(np.int64).tolist() for k in (0x1234567, 0x89ABCDEF1234))
            bits = np.array([_bits(int(k)) for k in n])
            base = np.cumsum(bits) - bits
            at = np.repeat(base, n) + (mix64(every) & np.repeat(bits - 1, n).astype(U64)).astype(np.int64)
            flips = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
            for k, size, x, y, lo, width in zip(has.tolist(), n.tolist(), f1, f2, (base // 8).tolist(), (bits // 8).tolist(), strict=True):
                out[k] = (ids[k], size, x, y, flips[lo : lo + width], False)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def sign(batches):
        counts = SlotCounts()
        for batch in batches:
            ids, sets, size = [], [], 0
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), words), strict=True):
                ids.append(doc_id)
                sets.append(s)
                size += len(s)
                if size > 100_000:
                    yield rows_of(ids, sets, counts)
                    ids, sets, size = [], [], 0
            if ids:
                yield rows_of(ids, sets, counts)
        for piece, blob in counts.pieces():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, piece, 0, 0, blob, True), schema, strict=True)], schema=schema)

    sigs = materialize(docs.mapInArrow(sign, "doc_id long, n int, f1 long, f2 long, bits binary, is_count boolean"), "signatures")

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _add(total.setdefault(piece, np.zeros(PIECE, np.uint64)), blob.as_py())
        for piece, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([int(t.sum())], pa.int64()), pa.array([_packed(np.minimum(t, U64(2**32 - 1)))], pa.binary())], names=["piece", "n", "bits"])

    pieces = sigs.where("is_count").select(F.col("n").alias("piece"), "bits").repartition(PIECES, "piece")
    sums = pieces.mapInArrow(add, "piece int, n long, bits binary").collect()  # PIECES rows of at most 8 * PIECE bytes
    blobs = [b""] * PIECES
    for row in sums:
        blobs[row["piece"]] = bytes(row["bits"])
    return sigs, blobs, sum(row["n"] for row in sums)


def slot_classes(blobs: list[bytes], total: int) -> np.ndarray:
    """The frequency class of every slot, from the packed counts."""
    classes = np.zeros(SLOTS, np.uint8)
    for piece, blob in enumerate(blobs):
        if blob:
            counts = np.zeros(PIECE, np.int64)
            _add(counts, blob)
            classes[piece * PIECE : (piece + 1) * PIECE] = frequency_class(counts, total / SLOTS)
    return classes


def frequency_class(counts: np.ndarray, mean: float) -> np.ndarray:
    """0 for slots within two standard deviations of the mean; above that, half doublings of the excess."""
    spread = np.sqrt(max(mean, 1.0))
    excess = np.maximum(0.0, counts - mean - 2 * spread) / spread
    return np.ceil(2 * np.log2(1 + excess)).clip(0, 120).astype(np.uint8)


def class_parts(mean: float) -> np.ndarray:
    """For each frequency class, into how many buckets a shingle's group is dealt: by the most documents that the class allows above the mean."""
    spread = np.sqrt(max(mean, 1.0))
    parts = np.ceil((2 + 2 ** (np.arange(256) / 2)) * spread / GROUP)
    parts[0] = 1
    return np.clip(parts, 1, 2**31).astype(np.int64)


def ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Order keys of shingles: frequency class in the top byte, then the hash."""
    return (classes[(s >> U64(_SHIFT)).astype(np.int64)].astype(U64) << U64(56)) | (mix64(s) >> U64(8))


def prefix_groups(docs: DataFrame, words: int, classes: np.ndarray, parts: np.ndarray, buckets: int) -> DataFrame:
    """Rows of kind 0: candidate pair (x, y); of kind 1: document y, of n shingles, in the large group x; of kind 2: document y leads a part of the split group x in its band."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # SLOTS bytes
    packed = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def entries(batches):
        cls = shared.value
        keys, ids, sizes, seen, held = [], [], [], set(), 0
        for batch in batches:
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), words), strict=True):
                n = len(s)
                if doc_id is None or not n:
                    continue
                mark = int(mix64(s).sum(dtype=U64)) << 64 | int(mix64(s ^ U64(0x1234567)).sum(dtype=U64))
                if mark in seen:  # a copy in the same task: it is linked through its fingerprint
                    continue
                if len(seen) < 100_000:
                    seen.add(mark)
                k = ordered(s, cls)
                probe = n - -(-NUM * n // DEN) + 1
                if probe < n:
                    k = np.partition(k, probe - 1)[:probe]
                k.sort()
                keys.append(k)
                ids.append(np.full(len(k), doc_id, np.int64))
                # the size, and the place in the set's order, which bounds what two sets can share after it
                sizes.append(np.uint64(n << 32) | np.arange(len(k), dtype=U64))
                held += len(k)
                if held > HELD:
                    yield from pack(keys, ids, sizes)
                    keys, ids, sizes, held = [], [], [], 0
        if held:
            yield from pack(keys, ids, sizes)

    def pack(keys, ids, sizes):
        k, i, z = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes).astype("<u8")
        salt = mix64(i.view(U64)) % parts[(k >> U64(56)).astype(np.int64)].astype(U64)
        b = (mix64(k + salt * U64(0x9E3779B97F4A7C15)) % U64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        b, k, i, z = b[order], k[order], i[order], z[order]
        cut = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(cut[1:], len(b))
        squeeze = lambda a: zlib.compress(a.tobytes(), 1)
        rows = [(int(b[lo]), k[lo:hi].tobytes(), squeeze(np.diff(i[lo:hi], prepend=np.int64(0))), squeeze(z[lo:hi].view(np.uint8).reshape(-1, 8).T.copy())) for lo, hi in zip(cut, ends, strict=True)]
        for lo in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 2000], strict=True), packed, strict=True)], schema=packed)

    def groups(batches):
        now, held = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for b, k, i, z in zip(*cols, strict=True):
                if b != now and held:
                    yield from _bucket_groups(held, parts)
                    held = []
                now = b
                held.append((np.frombuffer(k, U64), np.cumsum(np.frombuffer(zlib.decompress(i), np.int64)), np.frombuffer(zlib.decompress(z), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()))
        if held:
            yield from _bucket_groups(held, parts)

    blobs = docs.mapInArrow(entries, "bucket int, keys binary, ids binary, sizes binary")
    dealt = blobs.repartition(dealt_into(docs.sparkSession, buckets), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(groups, "kind int, x long, y long, n long")


def _out(kind: int, x: np.ndarray, y: np.ndarray, n: np.ndarray):
    for lo in range(0, len(x), 100_000):
        part = slice(lo, lo + 100_000)
        size = len(x[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, kind, np.int32)), pa.array(x[part].astype(np.int64)), pa.array(y[part].astype(np.int64)), pa.array(n[part].astype(np.int64))],
            names=["kind", "x", "y", "n"],
        )


def band(n: np.ndarray) -> np.ndarray:
    """Sets whose bands differ by two or more can't be similar."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


def _bucket_groups(held, parts):
    k, i, z = (np.concatenate(c) for c in zip(*held, strict=True))
    n, at = (z >> U64(32)).astype(np.int64), (z & U64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((i, n, k))
    k, i, n, at = k[order], i[order], n[order], at[order]
    start = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
    size = np.diff(np.append(start, len(k)))
    many = np.repeat(size, size)
    split = parts[(k >> U64(56)).astype(np.int64)] > 1  # others of the group are in other buckets
    keep = (many >= 2) | split
    k, i, n, at, many, split = k[keep], i[keep], n[keep], at[keep], many[keep], split[keep]
    pairs = []
    few = (many <= SMALL) & ~split
    for shift in range(1, SMALL):
        a, b = np.arange(max(0, len(k) - shift)), np.arange(min(shift, len(k)), len(k))
        ok = few[a] & (k[a] == k[b]) & (n[a] * DEN >= n[b] * NUM) & (i[a] != i[b])
        a, b = a[ok], b[ok]
        # if this is the first shingle that both hold, they share no more than what follows it
        ok = 1 + np.minimum(n[a] - 1 - at[a], n[b] - 1 - at[b]) >= needed(n[a], n[b])
        pairs.append((i[a[ok]], i[b[ok]]))
    large = ~few
    if large.any():
        k, i, n, split = k[large], i[large], n[large], split[large]
        w = band(n)
        # the first document of each band of a shingle leads its own band and the next
        order = np.lexsort((i, w, k))
        k, i, n, w, split = k[order], i[order], n[order], w[order], split[order]
        new = (np.diff(k, prepend=~k[:1]) != 0) | (np.diff(w, prepend=w[:1] - 9) != 0)
        lead = np.flatnonzero(new)
        mine = np.cumsum(new) - 1
        for back in (0, 1):
            g = mine - back
            ok = g >= 0
            to = lead[np.maximum(g, 0)]
            ok &= (k[to] == k) & (w - w[to] <= 1) & (i[to] != i)
            ok &= np.minimum(n[to], n) * DEN >= np.maximum(n[to], n) * NUM
            pairs.append((i[to[ok]], i[ok]))
        # a group is known by its members: near copies meet under many shingles, and equal groups become one tile
        first = np.diff(k, prepend=~k[:1]) != 0
        group = np.cumsum(first) - 1
        order = np.lexsort((i, group))
        mark = mix64(i[order].view(U64) + U64(0x9E3779B97F4A7C15))
        name = mix64(np.add.reduceat(mark, np.flatnonzero(first)))[group]
        name[split] = mix64(k[split])
        yield from _out(1, name.view(np.int64), i, n)
        lead = lead[split[lead]]
        yield from _out(2, k[lead].view(np.int64), i[lead], n[lead])
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
    if len(a):
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield from _out(0, both[:, 0], both[:, 1], np.zeros(len(both), np.int64))


def leader_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) that bring the parts of split groups together: each part's leader with the first leader of its band and of the band below."""
    w = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("long")
    leaders = groups.where("kind = 2").select(F.col("x").alias("key"), w.alias("band"), F.col("y").alias("id")).distinct()
    first = leaders.groupBy("key", "band").agg(F.min("id").alias("first"))
    both = first.unionByName(first.withColumn("band", F.col("band") + 1))
    return leaders.join(both, ["key", "band"]).where("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))


def _differ(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, U64)[None], np.frombuffer(y, U64)[None]
    size = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def bounded_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave room for enough shared shingles."""
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def bound(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            room = na + nb - 2 * needed(na, nb)
            ok = (np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM) & (na > 0) & (nb > 0)
            xs, ys = batch.column(4), batch.column(5)
            for k in np.flatnonzero(ok):
                ok[k] = _differ(xs[k].as_py(), ys[k].as_py()) <= room[k]
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return joined.mapInArrow(bound, "a long, b long").distinct()


def exact_links(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs that are similar enough, proved on the sorted shingle arrays of their texts."""

    def sets(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, len(ids), 500):
                made = [s.tobytes() for s in shingle_sets(batch.column(1)[lo : lo + 500].to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 500], pa.array(made, pa.binary())], names=["doc_id", "shingles"])

    def prove(batches):
        for batch in batches:
            a, b, xs, ys = batch.columns
            ok = np.zeros(len(a), bool)
            for k in range(len(a)):
                x, y = np.frombuffer(xs[k].as_py(), U64), np.frombuffer(ys[k].as_py(), U64)
                both = np.concatenate([x, y])
                both.sort()
                ok[k] = links(int((both[1:] == both[:-1]).sum()), len(x), len(y))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    held = keep_ids(docs, ids, "doc_id").select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles binary")
    # each set is read by two joins: written once, it isn't made twice
    held = materialize(held, "pair-sets")
    out = pairs.join(held.withColumnRenamed("doc_id", "b").withColumnRenamed("shingles", "y"), "b")
    out = out.join(held.withColumnRenamed("doc_id", "a").withColumnRenamed("shingles", "x"), "a").select("a", "b", "x", "y")
    proved = materialize(out.mapInArrow(prove, "a long, b long"), "links")
    release(ids, held)
    return proved


def _short_bitmaps(batches):
    """Bitmaps folded to SHORT_BITS at most: tiles hold a document many times, and pairs are bounded by the long ones later."""
    size = SHORT_BITS // 64
    for batch in batches:
        ids, bits = batch.column(0), batch.column(1)
        short = [fold(np.frombuffer(b.as_py(), U64)[None], max(1, min(size, len(b.as_py()) // 8))).tobytes() for b in bits]
        yield pa.RecordBatch.from_arrays([ids, pa.array(short, pa.binary())], names=["doc_id", "bits"])


def open_tiles(tiles: DataFrame, labels: DataFrame, sigs: DataFrame, best: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of unconnected documents in the large groups that pass the bounds; with best, a document's best one in each other component. With them, the tables to release afterwards."""
    rows = tiles.select(F.col("x").alias("key"), F.col("y").alias("doc_id"), "n").distinct()
    rows = rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # no pair inside a group's largest component is open, so its documents meet only the group's other ones
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("m"))
    several = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    w = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("long")
    rows = rows.join(several.select("key", "main"), "key").select("key", "doc_id", "n", "component", (F.col("component") != F.col("main")).alias("other"), w.alias("band"))
    # these are read several times below: written once, the joins before them aren't made again
    rows = materialize(rows, "open-rows")
    counts = materialize(rows.groupBy("key", "band", "other").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts")), "tile-parts")
    # tile (key, band): the band's other documents on the left; on the right other documents of this band and the next, and the largest component's of these and the band below
    lefts = counts.where("other").select("key", "band", F.col("parts").alias("left_parts"))
    bands = F.when(F.col("other"), F.expr("array(band, band - 1)")).otherwise(F.expr("array(band, band - 1, band + 1)"))
    meets = materialize(counts.select("key", "other", F.col("band").alias("from"), "parts", F.explode(bands).alias("band")).join(lefts, ["key", "band"]), "tile-meets")
    own = rows.join(counts, ["key", "band", "other"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    # a left document goes to each right part of its tile, a right one to each left part; two parts of the same documents meet once
    same = F.col("other") & (F.col("from") == F.col("band"))
    left = own.where("other").select("key", "band", "doc_id", "n", "component", "part").join(meets, ["key", "band"])
    left = left.select("key", "band", "other", "from", "doc_id", "n", "component", F.lit(0).alias("side"), F.col("part").alias("i"), F.explode(F.sequence(F.when(same, F.col("part")).otherwise(0), F.col("parts") - 1)).alias("j"))
    right = own.select("key", F.col("band").alias("from"), "other", "doc_id", "n", "component", "part").join(meets.drop("parts"), ["key", "from", "other"])
    right = right.select("key", "band", "other", "from", "doc_id", "n", "component", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.when(same, F.col("part")).otherwise(F.col("left_parts") - 1))).alias("i"), F.col("part").alias("j"))
    dealt = left.unionByName(right).join(sigs.select("doc_id", "bits").mapInArrow(_short_bitmaps, "doc_id long, bits binary"), "doc_id")
    dealt = dealt.withColumn("tile", F.xxhash64("key", "band", "other", "from", "i", "j")).select("tile", "side", "doc_id", "n", "component", "bits")

    def tile_pairs(left, right):
        if not left or not right:
            return
        cut = min(min(len(r[3]) for r in left), min(len(r[3]) for r in right)) // 8
        pack = lambda rows: np.vstack([fold(np.frombuffer(r[3], U64)[None], cut) for r in rows])
        lb, rb = pack(left), pack(right)
        rid, rn, rc = (np.array([r[k] for r in right], np.int64) for k in range(3))
        for row, bits in zip(left, lb, strict=True):
            doc, n, comp, _ = row
            ok = (rc != comp) & (np.minimum(n, rn) * DEN >= np.maximum(n, rn) * NUM)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            spare = n + rn[at] - 2 * needed(n, rn[at]) - np.bitwise_count(rb[at] ^ bits).sum(axis=1, dtype=np.int64)
            at, spare = at[spare >= 0], spare[spare >= 0]
            if best and len(at) > 1:
                order = np.lexsort((rid[at], -spare, rc[at]))
                at = at[order]
                at = at[np.flatnonzero(np.diff(rc[at], prepend=rc[at[0]] - 1) != 0)]
            for r in rid[at]:
                yield (doc, int(r)) if doc < r else (int(r), doc)

    def compare(batches):
        now, sides, found = None, ([], []), set()

        def flush(found):
            rows = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

        for batch in batches:
            for tile, side, doc, n, comp, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tile != now:
                    found.update(tile_pairs(*sides))
                    now, sides = tile, ([], [])
                    if len(found) > 50_000:
                        yield flush(found)
                        found = set()
                sides[side].append((doc, n, comp, bits))
        found.update(tile_pairs(*sides))
        if found:
            yield flush(found)

    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long").distinct(), [rows, counts, meets]


def join_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    with batches_of(docs.sparkSession, BATCH):
        return _join_components(docs, words)


def _join_components(docs: DataFrame, words: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_sigs, counts, total = signatures(docs, words)
    every = all_sigs.where("not is_count").select("doc_id", "n", "f1", "f2", "bits")
    sigs = every.where("doc_id is not null and n > 0")
    buckets = max(8, total // 4 // BUCKET)
    groups = materialize(prefix_groups(docs, words, slot_classes(counts, total), class_parts(total / SLOTS), buckets), "groups")
    pairs = groups.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(leader_pairs(groups)).distinct()
    likely = materialize(bounded_pairs(pairs, sigs), "bounded")
    found = exact_links(docs, likely, words)
    release(likely)
    # equal sets are linked through the smallest id of their fingerprint
    first = sigs.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = materialize(sigs.select("doc_id", "f1", "f2", "n").join(first, ["f1", "f2", "n"]).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "copies")
    edges = [copies, found]
    labels = components(copies.unionByName(found))
    tiles = groups.where("kind = 1")
    for best in (True, False):
        met, held = open_tiles(tiles, labels, sigs, best)
        open_pairs = materialize(bounded_pairs(met, sigs), "open-pairs")
        release(*held)
        if open_pairs.isEmpty():
            release(open_pairs)
            break
        more = exact_links(docs, open_pairs, words)
        release(open_pairs)
        if more.isEmpty():
            release(more)
            continue
        edges.append(more)
        new = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        release(labels)
        labels = new
    release(groups, *edges)
    out = every.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
