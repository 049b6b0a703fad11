"""WARC transaction assembly.

write_archives() turns page rows into WARC/1.1 files (request, response or revisit, metadata
for each capture); read_records() parses any WARC files that Spark can list; assemble() joins
the records of a transaction through WARC-Concurrent-To and emits one nested row per capture.

Defined results: a null html is an empty payload; rows without page_id are left out, and of rows
with the same page_id one (the smallest by digest and url) is captured, since the id names the
capture; a null or blank url has no WARC-Target-URI; an empty table gives an empty archive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, materialize, new_path

#: Payloads below this size are never written as revisits.
REVISIT_MIN_BYTES = 100
#: Archives are rotated after so many records, so that a reader holds one small file at a time.
RECORDS_PER_ARCHIVE = 3000
#: Captures with payloads above this go to archives of one capture's records, so a file never holds more than
#: RECORDS_PER_ARCHIVE / 3 payloads of this size, or one larger one.
LARGE_PAYLOAD = 1 << 18

RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_bytes long, payload_digest string, page_id long, payload binary"
)
_RECORDS_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "warc_date")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary())]
)


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: the first of equal payloads is stored, the others point at it."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    ).where("page_id is not null")
    p = p.groupBy("page_id").agg(F.min(F.struct("payload_digest", "url", "html", "payload_bytes")).alias("p")).select("page_id", "p.*")
    # the pointers are found on ids and digests alone, so that html is shuffled once, by page_id
    slim = p.where(F.col("payload_bytes") >= REVISIT_MIN_BYTES).select("page_id", "payload_digest")
    firsts = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    refers = slim.join(firsts, "payload_digest").where("first <> page_id").select("page_id", F.col("first").alias("refers_to"))
    return p.join(refers, "page_id", "left")


def _headers(*pairs) -> object:
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def write_archives(pages: DataFrame, path: str, warc_date: str = "2024-01-01T00:00:00Z") -> None:
    """Write WARC files below path with Spark's own writer (each record ends with CRLF CRLF), gzipped and rotated."""
    urn = lambda kind: F.concat(F.lit("<urn:capture:"), F.col("page_id").cast("string"), F.lit(f":{kind}>"))
    uri = F.regexp_replace(F.col("url"), r"[\r\n]", "")
    uri = F.when(F.trim(uri) != "", uri)
    captures = plan_captures(pages)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    size = lambda b: F.octet_length(F.encode(b, "UTF-8")).cast("string")
    whole = lambda head, b: F.concat(head, F.lit("\r\n\r\n"), b)
    request = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nUser-Agent: tessera\r\n\r\n"))
    meta = F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n"))
    date = ("WARC-Date", F.lit(warc_date))
    records = [
        whole(_headers(("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn("request")), ("WARC-Concurrent-To", urn("response")), date, ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http;msgtype=request")), ("Content-Length", size(request))), request),
        whole(_headers(("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", urn("response")), date, ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(":response>")))), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", size(block))), block),
        whole(_headers(("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn("metadata")), ("WARC-Concurrent-To", urn("request")), date, ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/warc-fields")), ("Content-Length", size(meta))), meta),
    ]
    large = F.col("payload_bytes") > LARGE_PAYLOAD
    parts = [("archives", captures, RECORDS_PER_ARCHIVE)]
    if not pages.where(F.octet_length("html") > LARGE_PAYLOAD).limit(1).isEmpty():
        parts = [("archives", captures.where(~large), RECORDS_PER_ARCHIVE), ("large", captures.where(large), len(records))]
    for name, part, most in parts:
        out = part.select(F.explode(F.array(*records)).alias("value"))
        out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def _inflate(content: bytes) -> bytes:
    """One or several gzip members, or plain bytes."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        d = zlib.decompressobj(31)
        parts.append(d.decompress(content))
        content = d.unused_data
    return b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by Content-Length. What precedes the next version line is skipped."""
    data, at = _inflate(content), 0
    version = re.compile(rb"WARC/\d\.\d\r\n")
    while m := version.search(data, at):
        end = data.find(b"\r\n\r\n", m.end())
        if end < 0:
            return
        head = _fields(data[m.end() : end])
        try:
            size = int(head.get("content-length", "0"))
        except ValueError:
            size = 0
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _record_row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    import hashlib

    kind = head.get("warc-type", "").lower()
    size = digest = page = payload = None
    if kind in ("response", "revisit") and "http" in head.get("content-type", ""):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest, payload = len(body), hashlib.sha256(body).hexdigest(), body if with_payload else None
        else:
            size = _fields(http).get("content-length", "")
            size = int(size) if size.isdigit() else None
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    elif kind == "metadata":
        page = _fields(block).get("page_id", "")
        page = int(page) if re.fullmatch(r"-?\d+", page) else None
    return (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), size, digest, page, payload)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per WARC record below path. A file is held by one task at a time; damaged tails end that file's records."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [_record_row(h, b, with_payload) for h, b in parse_archive(content.as_py() or b"")]
                for i in range(0, len(rows), 1000):
                    cols = list(zip(*rows[i : i + 1000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _RECORDS_ARROW, strict=True)], schema=_RECORDS_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: capture_id, response, request and metadata (structs; null where missing).

    WARC-Concurrent-To may lead from the request to the response or back, and from the metadata to
    either. Of several requests or metadata records of one capture the smallest record_id is taken.
    """
    main = records.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct("record_type", "target_uri", "warc_date", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"), F.col("concurrent_to").alias("back"))
    request = records.where("record_type = 'request'").select(F.col("record_id").alias("request_id"), F.col("concurrent_to").alias("to"), F.struct("record_id", "target_uri", "warc_date").alias("request"))
    back = main.where("back is not null").select(F.col("back").alias("request_id"), F.col("capture_id").alias("by_back"))
    request = request.join(back, "request_id", "left").select("request_id", F.coalesce("by_back", "to").alias("capture_id"), "request").where("capture_id is not null")
    metadata = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("request_id"), F.struct("record_id", "page_id", "warc_date").alias("metadata"))
    metadata = metadata.where("request_id is not null").join(request.select("request_id", "capture_id"), "request_id", "left").select(F.coalesce("capture_id", "request_id").alias("capture_id"), "metadata")
    first = lambda df, c: df.groupBy("capture_id").agg(F.min(c).alias(c))
    return main.drop("back").join(first(request, "request"), "capture_id", "left").join(first(metadata, "metadata"), "capture_id", "left")


def warc_roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and assemble the captures."""
    path = new_path(spark, "warc")
    write_archives(pages, path)
    records = materialize(read_records(spark, path), "warc-records")
    delete(spark, path)
    return assemble(records)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc_roundtrip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return captures.select(
        F.coalesce("metadata.page_id", F.regexp_extract("capture_id", r"^<urn:capture:(-?\d+):", 1).cast("long")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d+):", 1).cast("long")).alias("refers_to"),
    )


ORACLE_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages where page_id is not null
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
from f
"""
