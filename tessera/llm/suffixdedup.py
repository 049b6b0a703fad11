"""Removal of byte strings of length SPAN that also start in a document with a smaller doc_id.

Anchors. Each string of SPAN bytes holds the smallest of its hashed K-byte strings; these places
are the same wherever the string occurs, so repeated strings meet at an anchor. An anchor's context
is the text up to SPAN - K bytes before and after it, all that strings around that anchor can reach.

Groups. Anchors travel as packed arrays, a row for each bucket of hashes. Where two contexts are
equal the larger document's is covered whole; most repeats end there, already among the documents
of one batch. Only anchors that occur in different contexts are looked at in the text.

Suffixes. The suffixes at these anchors, and the reversed text before them, are put in order by
deep-shallow sorting. From the two orders' common prefixes, each string around an anchor gets a
class (how far two contexts agree to the left and right), and a class belongs to its smallest document.

Defined results: null texts are empty; rows without doc_id are left out; of rows that repeat a
doc_id the smallest text counts; an empty table gives no rows. What is left of a text may end
inside a character, since removal goes by bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, dealt_into, keep_ids, key_groups, materialize, mix64, release, runs
from tessera.llm.deepshallow import sort_strings
from tessera.llm.shingles import _BASE, _INVERSE, _LETTER, CHUNK, _power

SPAN, K = 50, 20
SIDE = SPAN - K
#: Anchors that a bucket holds on average.
BUCKET = 250_000


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    step = 1
    total = len(a) - width + 1
    while 2 * step <= width:
        a = pick(a[:-step], a[step:])
        step *= 2
    return pick(a[:total], a[width - step : width - step + total]) if step < width else a[:total]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place, anchor hash and context hash of every anchor; contexts end with their text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not lengths.sum() or lengths.max() < SPAN:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(U64), empty.astype(U64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    first = ends - lengths
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(_LETTER[data] * _power(_BASE, n), out=total[1:])
    inverse = _power(_INVERSE, n)
    h = mix64((total[K:] - total[:-K]) * inverse[: n - K + 1])
    least = _slide(h, SIDE + 1, np.minimum)
    whole = np.zeros(len(least) + 1, np.int32)  # windows inside one text
    for lo, hi in zip(first, ends, strict=True):
        if hi - lo >= SPAN:
            whole[lo] += 1
            whole[hi - SPAN + 1] -= 1
    least = np.where(np.cumsum(whole[:-1]) > 0, least, U64(0))
    pad = np.zeros(SIDE, U64)
    at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum)[: len(h)] == h) & (h > 0))
    doc = np.searchsorted(ends, at, side="right")
    lo, hi = np.maximum(at - SIDE, first[doc]), np.minimum(at + SPAN, ends[doc])
    context = mix64((total[hi] - total[lo]) * inverse[lo] + U64(0x9E3779B97F4A7C15) * ((at - lo) * 128 + (hi - lo)).astype(U64))
    return doc, at - first[doc], h[at], context


def _chunks(texts: list[bytes]):
    part, size, base = [], 0, 0
    for k, t in enumerate(texts):
        if part and size + len(t) > CHUNK:
            yield base, part
            part, size, base = [], 0, k
        part.append(t)
        size += len(t)
    if part:
        yield base, part


def _narrow(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit numbers."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


_WIDTH = 6
FOUND = "kind int, doc_id long, pos long, anchor long"


def _found(kind: int, doc, pos, anchor=None):
    for lo in range(0, len(doc), 100_000):
        s = slice(lo, lo + 100_000)
        m = len(doc[s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int32)), pa.array(doc[s]), pa.array(pos[s].astype(np.int64)), pa.array(np.zeros(m, np.int64) if anchor is None else anchor[s].view(np.int64))],
            names=["kind", "doc_id", "pos", "anchor"],
        )


def _owners(h, c, doc, pos):
    """Sorted by (h, c, doc, pos): those arrays, and whether each row's document is its context's smallest."""
    order = np.lexsort((pos, doc, c, h))
    h, c, doc, pos = h[order], c[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    start = np.flatnonzero(new)
    own = doc == doc[start][np.cumsum(new) - 1]
    return h, c, doc, pos, new, own


def anchor_groups(docs: DataFrame, buckets: int) -> DataFrame:
    """FOUND rows. Kind 0: the whole context at pos occurs in a smaller document; kind 1: the text around pos has to be compared with others at this anchor."""
    packed = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])

    def entries(batches):
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for lo in range(0, len(ids), 5000):
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1)[lo : lo + 5000].to_pylist()]
                found = []
                for base, part in _chunks(texts):
                    d, p, h, c = anchors(part)
                    found.append((d + lo + base, p, h, c))
                if found:
                    d, p, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield from pack(h, c, ids[d], p)

    def pack(h, c, doc, pos):
        h, c, doc, pos, _, own = _owners(h, c, doc, pos)
        # a copy of a context in the same batch is settled here
        rows = [(1, int(d), b"", b"", p.astype("<u4").tobytes()) for d, p in _by_doc(doc[~own], pos[~own])]
        h, c, doc, pos = h[own], c[own], doc[own], pos[own]
        b = ((h >> U64(40)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((pos, doc, b))
        b, h, c, doc, pos = b[order], h[order], c[order], doc[order], pos[order]
        for lo, hi in runs(b):
            s = slice(lo, hi)
            docs_, places = (zlib.compress(np.diff(x[s], prepend=0).astype("<i8").tobytes(), 1) for x in (doc, pos))
            rows.append((0, int(b[lo]), _narrow(h[s], _WIDTH) + _narrow(c[s], _WIDTH), docs_, places))
        for lo in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[lo : lo + 2000], strict=True), packed, strict=True)], schema=packed)

    def groups(batches):
        for kind_key, part in _packed_groups(batches):
            if kind_key[0] == 1:
                for places in part:
                    p = np.frombuffer(places[2], "<u4").astype(np.int64)
                    yield from _found(0, np.full(len(p), kind_key[1], np.int64), p)
                continue
            cols = []
            for hashes, d, p in part:
                half = len(hashes) // 2
                cols.append((_widen(hashes[:half], _WIDTH), _widen(hashes[half:], _WIDTH), *(np.cumsum(np.frombuffer(zlib.decompress(x), "<i8")) for x in (d, p))))
            h, c, doc, pos, new, own = _owners(*(np.concatenate(x) for x in zip(*cols, strict=True)))
            yield from _found(0, doc[~own], pos[~own])
            # contexts of one anchor, of which some lie in a larger document than another
            group = np.cumsum(np.diff(h, prepend=~h[:1]) != 0) - 1
            contexts = np.bincount(group, weights=new)
            low = np.minimum.reduceat(doc, np.flatnonzero(np.diff(group, prepend=-1)))
            high = np.zeros(len(low), np.int64) + low
            np.maximum.at(high, group[own], doc[own])
            look = own & (contexts[group] > 1) & (high[group] > low[group])
            yield from _found(1, doc[look], pos[look], mix64(h[look] ^ (U64(kind_key[1]) << U64(48))))

    blobs = docs.mapInArrow(entries, "kind int, key long, hashes binary, docs binary, places binary")
    n = dealt_into(docs.sparkSession, buckets)
    return blobs.repartition(n, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(groups, FOUND)


def _by_doc(doc: np.ndarray, pos: np.ndarray):
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    for lo, hi in runs(doc):
        yield doc[lo], pos[lo:hi]


def _packed_groups(batches):
    now, held = None, []
    for batch in batches:
        for kind, key, *blobs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (kind, key) != now:
                if held:
                    yield now, held
                now, held = (kind, key), []
            held.append(blobs)
    if held:
        yield now, held


def contexts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """anchor, doc_id, pos, left, right, text: the context of SIDE + SPAN bytes, zero where the text ends (left and right say how much is text)."""
    per_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "anchor")).alias("asked"))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                items = asked.values
                for p, a in zip(items.field("pos").to_pylist(), items.field("anchor").to_pylist(), strict=True):
                    left, right = raw[max(0, p - SIDE) : p], raw[p : p + SPAN]
                    rows.append((a, doc_id, p, len(left), len(right), left.rjust(SIDE, b"\0") + right.ljust(SPAN, b"\0")))
                    if len(rows) >= 20_000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    def flush(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "doc_id", "pos", "left", "right", "text"])

    return docs.join(per_doc, "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, "anchor long, doc_id long, pos long, left int, right int, text binary")


def covered(anchor, doc, left, right, text) -> np.ndarray:
    """For contexts (anchors sorted), whether the string that starts o bytes before the anchor, for o from 0 to SIDE, occurs in a smaller document."""
    n = len(doc)
    # an anchor's suffixes sort together behind its hash, which is their first character
    head = np.ascontiguousarray(anchor.astype(">i8")).view(np.uint8).reshape(n, 8)
    order_r, lcp_r = sort_strings(np.hstack([head, text[:, SIDE:]]))
    order_l, lcp_l = sort_strings(np.hstack([head, text[:, :SIDE][:, ::-1]]))
    out = np.zeros((n, SIDE + 1), bool)
    for o in range(SIDE + 1):
        to_left, to_right = np.empty(n, np.int64), np.empty(n, np.int64)
        to_left[order_l] = np.cumsum(lcp_l < 8 + o)
        to_right[order_r] = np.cumsum(lcp_r < 8 + SPAN - o)
        fits = np.flatnonzero((left >= o) & (right >= SPAN - o))
        key = to_left[fits] * (n + 1) + to_right[fits]
        order = np.lexsort((doc[fits], key))
        k, d = key[order], doc[fits][order]
        start = np.ones(len(k), bool)
        start[1:] = k[1:] != k[:-1]
        if len(k):
            out[fits[order], o] = d > d[np.flatnonzero(start)][np.cumsum(start) - 1]
    return out


def resolve(contexts: DataFrame) -> DataFrame:
    """doc_id, start, end of the covered bytes around anchors with different contexts."""

    def settle(batches):
        held, size = [], 0
        for _, part in key_groups(batches):
            held += part
            size += sum(b.num_rows for b in part)
            if size >= 30_000:
                yield from spans(held)
                held, size = [], 0
        if held:
            yield from spans(held)

    def spans(held):
        t = pa.Table.from_batches(held)
        anchor, doc, pos, left, right = (t.column(k).to_numpy().astype(np.int64) for k in range(5))
        text = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(-1, SIDE + SPAN)
        hit = covered(anchor, doc, left, right, text)
        # runs of o give one span each
        edges = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, lo = np.nonzero(edges == 1)
        hi = np.nonzero(edges == -1)[1] - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(pos[row] - hi), pa.array(pos[row] - lo + SPAN)], names=["doc_id", "start", "end"])

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(settle, "doc_id long, start long, end long")


def single_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text with one row for each doc_id; texts are only shuffled if an id repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return materialize(rows.groupBy("doc_id").agg(F.min("text").alias("text")), "single-rows")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    rows = single_rows(docs)
    # whole copies are covered whole: only the first of equal texts goes on
    digests = rows.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), F.octet_length("text").alias("size"))
    digests = materialize(digests, "digests")
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(digests.where(f"size >= {SPAN}").join(first, "digest").where("doc_id <> first").select("doc_id"), "copies")
    total = digests.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fresh = keep_ids(rows, copies, "doc_id", anti=True)
    found = materialize(anchor_groups(fresh, max(8, total * 2 // (SIDE + 2) // BUCKET)), "anchors")
    near = materialize(resolve(contexts_of(fresh, found.where("kind = 1"))), "near-spans")
    spans = found.where("kind = 0").select("doc_id", (F.col("pos") - SIDE).alias("start"), (F.col("pos") + SPAN).alias("end")).unionByName(near)
    spans = spans.unionByName(copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(2**62).alias("end")))
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def remove(batches):
        for batch in batches:
            out, size = [], 0
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                kept, gone, runs = raw, 0, 0
                if spans.is_valid:
                    v = spans.values
                    n = len(raw)
                    start, end = (np.clip(v.field(c).to_numpy(zero_copy_only=False), 0, n) for c in ("start", "end"))
                    depth = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    drop = np.cumsum(depth[:-1]) > 0
                    gone, runs = int(drop.sum()), int((np.diff(drop.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(raw, np.uint8)[~drop].tobytes()
                out.append((doc_id, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    release(digests)
    return rows.join(per_doc, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
