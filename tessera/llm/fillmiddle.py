"""Fill-in-the-middle transformation in Spark SQL expressions.

regexp_extract_all makes the array of units (lines with their line feed), conv over substrings of a sha2
of the document's id gives the cuts and the form, slice and array_join build the arrangement, and the text
is restored from output and form by looking for the sentinels. There is no shuffle and no Python worker.

Units are counted and cut over code points (a line feed is one, so no character is split). A sentinel can be
found again because a text that holds one stays plain, and because none begins inside another or at the
end of a part ('<' stands only at a sentinel's start).

Defined results: a null text is empty, an empty text is plain with n = 0; a null doc_id is hashed as an empty
one; rows that repeat a doc_id are cut by the same hashes; with no units before, between or after the
cuts that part is empty; very long texts are one row like any other. The result is a struct in one
column (`into`), which replaces a column of that name; other columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
#: Of 100 documents so many are rearranged, and of 100 of these so many start with the suffix.
RATE, SPM_RATE = 100, 50


def arranged(text, doc_id, seed: str = "7", rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = UNIT):
    """Steps as lists of (name, Column); each step may use the names of those before it."""
    h = lambda i: F.conv(F.substring("h", 8 * i - 7, 8), 16, 10).cast("long")
    part = lambda start, size: F.array_join(F.slice("units", start, size), "")
    col = F.col
    held = col("text").contains(PREFIX) | col("text").contains(SUFFIX) | col("text").contains(MIDDLE)
    plain = (col("text") == "") | held | (h(3) % 100 >= rate)
    moved = col("form") != "plain"
    return [
        [("text", F.coalesce(text, F.lit(""))), ("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256))],
        [("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0)))],
        [("n", F.size("units").cast("long")), ("form", F.when(plain, "plain").when(h(4) % 100 < spm_rate, "spm").otherwise("psm"))],
        [("cut1", h(1) % (col("n") + 1)), ("cut2", h(2) % (col("n") + 1))],
        [("lo", F.least("cut1", "cut2").cast("int")), ("hi", F.greatest("cut1", "cut2").cast("int"))],
        [
            ("prefix", F.when(moved, part(F.lit(1), col("lo")))), ("middle", F.when(moved, part(col("lo") + 1, col("hi") - col("lo")))),
            ("suffix", F.when(moved, part(col("hi") + 1, col("n").cast("int") - col("hi")))),
        ],
        [
            ("output", F.when(col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
                .when(col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(col("text"))),
            ("prefix_chars", F.length("prefix").cast("long")), ("middle_chars", F.length("middle").cast("long")),
        ],
    ]


def restored(output, form):
    """Column: the text that output was made of, found by its sentinels."""
    # each sentinel stands there once: the middle is behind <M>, before it are two parts, each behind its own
    head = F.substring_index(output, MIDDLE, 1)
    between = lambda first, second: F.regexp_replace(F.substring_index(head, second, 1), f"^{first}", "")
    after = lambda mark: F.substring_index(head, mark, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, after(SUFFIX))
    spm = F.concat(after(PREFIX), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, into: str = "fim", **options) -> DataFrame:
    """docs with a struct column `into`: n, form, prefix_chars, middle_chars (null where plain), output and restored."""
    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))  # in a struct, so no name can clash
    for step in arranged(F.col("row.text"), F.col("row.doc_id"), **options):
        out = out.select("*", *[c.alias(name) for name, c in step])
    result = F.struct("n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("restored")).alias(into)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c.lower() != into.lower()], result)


def op12_fillmiddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return docs.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest("fim.output").alias("output_sha256"), digest("fim.restored").alias("restored_sha256"))


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
  select *, case when t = '' then [] else regexp_extract_all(t, '[^\n]*\n|[^\n]+') end as u,
         list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as hs from d
), f as (
  select doc_id, t, u, len(u) as n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or hs[3] % 100 >= 100 then 'plain' when hs[4] % 100 < 50 then 'spm' else 'psm' end as form,
         least(hs[1] % (len(u) + 1), hs[2] % (len(u) + 1)) as lo, greatest(hs[1] % (len(u) + 1), hs[2] % (len(u) + 1)) as hi from u
), p as (
  select doc_id, t, n, form, coalesce(array_to_string(u[1:lo], ''), '') as p, coalesce(array_to_string(u[lo + 1:hi], ''), '') as m, coalesce(array_to_string(u[hi + 1:], ''), '') as s from f
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256, sha256(t) as restored_sha256
from p
"""
