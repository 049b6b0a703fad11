"""Files in and out: text, JSON lines, stable ids, upserts, resuming and failures."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "txt", "docx")
PAYLOAD_CHARS = 8000
MOST_BYTES = 10 * 1024 * 1024
LINES = 100_000


# fixed values: collections whose folders have another name, and what an upload may be
FOLDERS = {"scheme": "schemes"}
UPLOADS = ("pdf", "txt", "docx", "doc", "md", "csv")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, in a folder of this process (local sessions) or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and re.match(r"local(\[|$)", spark.sparkContext.master):
        own = tempfile.mkdtemp(prefix="tessera-files-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{root.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path and read again: its lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def accepted(name: Column, size: Column) -> Column:
    """Uploads of up to MOST_BYTES whose names end with a known extension."""
    return (size <= MOST_BYTES) & F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*UPLOADS)


def write_texts(df: DataFrame, path: str, separator: str = "\x1e") -> None:
    """The column text, one value after another; the separator may not occur in them."""
    df.select("text").write.option("lineSep", separator).text(path)


def read_texts(spark: SparkSession, path: str, separator: str = "\x1e") -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).withColumnRenamed("value", "text")


def folder_of(vertical: Column) -> Column:
    out = F.when(F.lit(False), vertical)
    for k, v in FOLDERS.items():
        out = out.when(vertical == k, v)
    return out.otherwise(vertical)


def chunk_folders(spark: SparkSession, path: str) -> DataFrame:
    """vertical (as its collection is called) and chunks of each folder vertical=... below path."""
    return spark.read.option("basePath", path).json(path).groupBy(folder_of(F.col("vertical")).alias("vertical")).agg(F.count("*").alias("chunks"))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (key, value, stored_at): the newest of each key."""
    newest = cache.unionByName(new).groupBy("key").agg(F.max(F.struct("stored_at", "value")).alias("e"))
    return newest.select("key", "e.value", "e.stored_at")


def cache_clean(cache: DataFrame, now: Column, most_age: int) -> DataFrame:
    return cache.where(now - F.col("stored_at") <= most_age)


def content_or_snippet(text: Column, snippet: Column, most: int = 3000) -> Column:
    """The first characters of a page's text if they are longer than its snippet, else the snippet."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(cut) > F.length(snippet), cut).otherwise(snippet)


def with_sidecar(metadata: Column, sidecar: Column) -> Column:
    """Maps together; a chunk's own keys win."""
    return F.when(sidecar.isNull(), metadata).otherwise(F.map_concat(F.map_filter(sidecar, lambda k, _: ~F.map_contains_key(metadata, k)), metadata))


def scan(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int | None = None) -> DataFrame:
    """path, name, stem, extension, size_bytes, size_mb, content of the files with a known extension."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), (F.col("length") / 1048576).alias("size_mb"), "content")
    out = out.where(F.col("extension").isin(*EXTENSIONS))
    return out.where(F.col("size_bytes") <= most_bytes) if most_bytes else out


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is not valid."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def docx_text(files: DataFrame) -> DataFrame:
    """path, text of word-processor files: paragraphs, then table rows under `Tables:`. Unreadable files give an error."""

    def read(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        words = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
                    text = [words(p) for p in body.findall(f"{w}p") if words(p).strip()]
                    table = [" | ".join(words(c) for c in r.findall(f"{w}tc")) for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")]
                    rows.append((path, "\n".join(text + (["Tables:"] + table if table else [])), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows.append((path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with text, doc_id and chunk_id from JSON lines, and the lines that are broken or lack one of them."""
    schema = "text string, doc_id string, chunk_id string, chunk_index int, word_count int, metadata map<string,string>, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    whole = F.col("_corrupt_record").isNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull()
    return rows.where(whole).drop("_corrupt_record"), rows.where(~whole)


def write_jsonl(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    """Compressed JSON lines; one such file is one task's to read, so files hold LINES lines at most."""
    w = df.write.mode("append" if append else "overwrite").option("compression", "gzip").option("maxRecordsPerFile", LINES)
    (w.partitionBy(*by) if by else w).json(path)


#: the namespace of names in UUIDs of version 5
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The UUID of version 5 that a name has in the DNS namespace: SHA-1 with the version and the variant set; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def stable_id(doc_id: Column, chunk_id: Column) -> Column:
    return uuid5(F.concat_ws("|", doc_id, chunk_id))


def payload_text(text: Column) -> Column:
    return F.when(F.length(text) > PAYLOAD_CHARS, F.concat(F.substring(text, 1, PAYLOAD_CHARS), F.lit("..."))).otherwise(text)


def cache_key(task: str, model: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{task}:{model}:"), content), 256)


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old that new doesn't replace, and new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
