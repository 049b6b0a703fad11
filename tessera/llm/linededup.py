"""Line dedup by content-defined chunks of lines; DataFrame operations only.

Each line has a hash, and a rolling (polynomial) hash runs over the hashes of two lines. Of each two
neighbouring windows the one with the smaller rolling hash is a boundary: boundaries depend on the lines
around them and not on their place in a text, and every passage of three lines or more holds one that no
line outside it decides (windows of two blank lines are never chosen while another one is near). A
boundary's window leads to its first occurrence, in order of (doc_id, line). From there the chunk grows line
by line on both sides as long as the bytes are those of the same earlier document at the same distance, so a chunk
is a run of lines that one earlier place holds as a whole; runs that touch but stem from different documents are judged apart. Chunks with
MIN_LINES lines or more that aren't blank go.

Two-line passages are found where their one window is a boundary in both texts; op6_linededup takes every window with words as
a boundary, so it finds them all. A hash only proposes: lines are compared as they are.

Defined results: null texts stay null; rows without doc_id pass unchanged and own nothing; rows
that repeat a doc_id with the same text are one document, so all of them keep what it owns, with another text
they are documents of their own (order: by a hash of the text); a text whose lines all
go becomes empty (its row stays); lines are separated by \\n alone. In an own text, a passage's second place goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, materialize, release

#: Lines with words that a chunk must have to go.
MIN_LINES = 2
#: Rolling hash over two lines: BASE * first + second, modulo PRIME; line hashes are the first HEX digits of their MD5.
BASE, PRIME, HEX = 31, 2147483647, 7
#: Lines on each side of a boundary's window that travel with it; most chunks end among them, longer ones are followed through both documents.
NEAR = 4
PAIR = ["doc_id", "v", "o_doc", "o_v", "shift"]
_SOLID = "[^ \\t\\r]"


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, v (hash that tells texts of one doc_id apart) and lines."""
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("v"), F.split("text", "\n", -1).alias("lines"))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose (doc_id, v) is in ids, once each; ids are counted first and broadcast only up to BROADCAST_IDS rows."""
    ids = ids.distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, ["doc_id", "v"], "left_semi").dropDuplicates(["doc_id", "v"])


def _coded(line):
    """Hash of a line whose last bit says whether it has words."""
    return F.xxhash64(line).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.when(line.rlike(_SOLID), 1).otherwise(0).cast("long"))


def boundaries(docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, v, k (the boundary window's first line, from 1), id (hash of its lines), its lines' hashes, and those of NEAR lines before (nearest first) and after; with every, each window that has words is a boundary."""
    number = lambda x: F.conv(F.substring(F.md5(x), 1, HEX), 16, 10).cast("long")
    rows = _documents(docs).where(F.size("lines") >= 2)
    hashed = rows.select("doc_id", "v", F.transform("lines", number).alias("h"), F.transform("lines", _coded).alias("x"))
    rolling = f"transform(sequence(1, size(h) - 1), k -> if((x[k - 1] | x[k]) & 1 = 1, (h[k - 1] * {BASE}L + h[k]) % {PRIME}L, {PRIME}L))"
    chosen = f"filter(sequence(1, size(r)), k -> r[k - 1] < {PRIME}L and (size(r) = 1 or (k < size(r) and r[k - 1] <= r[k]) or (k > 1 and r[k - 1] < r[k - 2])))"
    if every:
        chosen = f"filter(sequence(1, size(r)), k -> r[k - 1] < {PRIME}L)"
    around = f"'before', reverse(slice(x, greatest(1, k - {NEAR}), least(k - 1, {NEAR}))), 'after', slice(x, k + 2, {NEAR})"
    window = f"named_struct('k', k, 'id', xxhash64(x[k - 1], x[k]), 'own', array(x[k - 1], x[k]), {around})"
    each = hashed.withColumn("r", F.expr(rolling)).select("doc_id", "v", F.explode(F.expr(f"transform({chosen}, k -> {window})")).alias("c"))
    return each.select("doc_id", "v", "c.*")


def _agreeing(a: str, b: str):
    """How many leading values of two arrays agree, NEAR at most."""
    return F.expr(f"coalesce(array_min(filter(sequence(0, {NEAR - 1}), i -> not coalesce(i < size({a}) and i < size({b}) and {a}[i] = {b}[i], false))), {NEAR})")


def _grown(pairs: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs (doc_id, v, o_doc, o_v, shift, lo, hi) of lines whose hashes agree along a pair's shift, around one of its boundaries (ks), with MIN_LINES lines that have words."""
    mine = _only(_documents(docs).select("doc_id", "v", F.transform("lines", _coded).alias("x")), pairs.select("doc_id", "v"))
    theirs = sources.select(F.col("doc_id").alias("o_doc"), F.col("v").alias("o_v"), F.transform("lines", _coded).alias("o_x"))
    both = pairs.join(theirs, ["o_doc", "o_v"]).join(mine, ["doc_id", "v"])
    same = "transform(x, (h, i) -> i >= shift and i - shift < size(o_x) and h = get(o_x, i - shift))"
    runs = both.withColumn("e", F.expr(same)).select(
        *PAIR, "x", "ks",
        F.expr("filter(sequence(1, size(e)), k -> e[k - 1] and (k = 1 or not e[k - 2]))").alias("lo"), F.expr("filter(sequence(1, size(e)), k -> e[k - 1] and (k = size(e) or not e[k]))").alias("hi"),
    )
    solid = f"filter(arrays_zip(lo, hi), r -> exists(ks, k -> k >= r.lo and k < r.hi) and size(filter(slice(x, r.lo, r.hi - r.lo + 1), h -> h & 1 = 1)) >= {MIN_LINES})"
    return runs.select(*PAIR, F.explode_outer(F.expr(solid)).alias("c")).select(*PAIR, "c.lo", "c.hi")


def repeated_chunks(docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, v, _gone: first and last lines of the chunks that may go and what the earlier place holds there (a row for each document that has some)."""
    place = F.struct("doc_id", "v", "k")
    found = boundaries(docs, every)
    owners = found.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    owners = materialize(owners.select("id", "first"), "line-owners")
    ids = F.broadcast(owners) if owners.count() <= BROADCAST_IDS else owners
    hits = materialize(found.join(ids, "id"), "line-windows")
    # (written down first: a join alone can split a frequent window's rows over tasks)
    owned = materialize(hits.where(place == F.col("first")).groupBy("id").agg(F.first("before").alias("o_before"), F.first("after").alias("o_after")), "line-owned")
    others = hits.where(place != F.col("first")).join(owned, "id").select(
        "doc_id", "v", F.col("first.doc_id").alias("o_doc"), F.col("first.v").alias("o_v"), (F.col("k") - F.col("first.k")).alias("shift"), "k", "own", "before", "after",
        _agreeing("before", "o_before").alias("left"), _agreeing("after", "o_after").alias("right"),
    )
    others = materialize(others, "line-hits")
    open_ = (F.col("left") == NEAR) | (F.col("right") == NEAR)
    words = F.expr(f"size(filter(concat(own, slice(before, 1, left), slice(after, 1, right)), h -> h & 1 = 1)) >= {MIN_LINES}")
    near = others.where(~open_).where(words).select(*PAIR, (F.col("k") - F.col("left")).alias("lo"), (F.col("k") + 1 + F.col("right")).alias("hi")).distinct()
    # chunks that reach beyond the lines nearby grow over the whole of both documents
    pairs = materialize(others.where(open_).groupBy(*PAIR).agg(F.collect_set("k").alias("ks")), "line-pairs")
    first_ids = pairs.select("o_doc", "o_v").unionByName(near.select("o_doc", "o_v")).select(F.col("o_doc").alias("doc_id"), F.col("o_v").alias("v"))
    sources = materialize(_only(_documents(docs), first_ids), "line-sources")
    runs = materialize(near.unionByName(_grown(pairs, docs, sources)).where("lo is not null"), "line-runs")
    theirs = sources.select(F.col("doc_id").alias("o_doc"), F.col("v").alias("o_v"), F.col("lines").alias("o_lines"))
    held = runs.join(theirs, ["o_doc", "o_v"]).select("doc_id", "v", F.struct("lo", "hi", F.expr("array_join(slice(o_lines, lo - shift, hi - lo + 1), '\n')").alias("bytes")).alias("c"))
    gone = materialize(held.groupBy("doc_id", "v").agg(F.collect_list("c").alias("_gone")), "line-chunks")
    release(owners, hits, owned, others, pairs, sources, runs)
    return gone


def line_dedup(docs: DataFrame, report: bool = True, every: bool = False) -> DataFrame:
    """docs with the repeated chunks' lines taken out of text; with report also _removed_lines and _removed_chunks (runs of lines that went), which replace columns of these names. Other columns, whatever their names, stay. With every, all windows are looked up, so no two-line passage is missed."""
    gone = repeated_chunks(docs.select("doc_id", "text"), every)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")  # in a struct, so no name can clash
    joined = docs.select(row).join(gone, (F.col("_row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64("_row.text") == F.col("v")), "left").select("_row", "_gone")
    out = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("_row.text", "\n", -1)))
    same = "filter(_gone, c -> array_join(slice(_lines, c.lo, c.hi - c.lo + 1), '\n') = c.bytes)"  # hashes proposed, bytes decide
    out = out.withColumn("_drop", F.array_sort(F.array_distinct(F.expr(f"flatten(transform({same}, c -> sequence(c.lo, c.hi)))"))))
    out = out.withColumn("_left", F.expr("case when _gone is not null then array_except(sequence(1, size(_lines)), _drop) end"))
    kept = F.expr("case when _gone is null then _row.text else array_join(transform(_left, i -> _lines[i - 1]), '\n') end")
    columns = [kept.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names if not report or c not in ("_removed_lines", "_removed_chunks")]
    if not report:
        return out.select(*columns)
    runs = F.expr("coalesce(size(filter(transform(_drop, (k, i) -> i = 0 or k - _drop[i - 1] > 1), x -> x)), 0)")
    return out.select(*columns, F.expr("coalesce(size(_drop), 0)").alias("_removed_lines"), runs.alias("_removed_chunks"))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, every=True).select(
        "doc_id", F.col("_removed_lines").cast("long").alias("removed_lines"), F.col("_removed_chunks").cast("long").alias("removed_chunks"),
        F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("kept_bytes"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = rf"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null
), s as (
  select *, regexp_matches(line, '{_SOLID}') as solid from l
), w as (
  select doc_id, k, line || chr(10) || lead(line) over d as bytes, solid or lead(solid) over d as worded from s window d as (partition by doc_id order by k)
), c as (
  select doc_id, k, first_value(doc_id) over p as o_doc, first_value(k) over p as o_k from w
  where bytes is not null and worded window p as (partition by bytes order by doc_id, k)
), p as (
  select distinct doc_id, o_doc, k - o_k as shift from c where (doc_id, k) <> (o_doc, o_k)
), e as (
  select p.*, x.k, x.solid, x.k - row_number() over (partition by p.doc_id, p.o_doc, p.shift order by x.k) as run
  from p join s x on x.doc_id = p.doc_id join l o on o.doc_id = p.o_doc and o.k = x.k - p.shift where o.line = x.line
), g as (
  select doc_id, o_doc, shift, min(k) as lo, max(k) as hi from e group by doc_id, o_doc, shift, run having sum(cast(solid as integer)) >= {MIN_LINES}
), i as (
  select distinct g.doc_id, lo, hi from g join c on c.doc_id = g.doc_id and c.o_doc = g.o_doc and c.k - c.o_k = g.shift and c.k >= g.lo and c.k < g.hi
), m as (
  select l.*, exists (select 1 from i where i.doc_id = l.doc_id and l.k between i.lo and i.hi) as gone from l
), t as (
  select doc_id, count(*) filter (where gone) as removed_lines, count(*) filter (where gone and not coalesce(before, false)) as removed_chunks, coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as kept
  from (select *, lag(gone) over (partition by doc_id order by k) as before from m) group by doc_id
)
select d.doc_id, cast(coalesce(removed_lines, 0) as bigint) as removed_lines, cast(coalesce(removed_chunks, 0) as bigint) as removed_chunks,
       cast(octet_length(encode(coalesce(kept, ''))) as bigint) as kept_bytes, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join t on d.doc_id = t.doc_id
"""
