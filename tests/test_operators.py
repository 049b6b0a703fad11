"""Operators against plain Python, and edge cases."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import classify, cleaning, entities, interpret
from tessera.operators import chunking, fusion, lexical, relations, vectors
from tessera.sources import files, web
from tessera.streaming import ingest


def plain_pack(parts, least, most, overlap):
    out, group, size = [], [], 0
    for p in parts:
        if size + len(p) > most and group and len("\n\n".join(group)) >= least:
            out.append("\n\n".join(group))
            tail = group[-1][-overlap:]
            group, size = [tail, p], len(tail) + len(p)
        else:
            group.append(p)
            size += len(p)
    if group and len("\n\n".join(group)) >= least:
        out.append("\n\n".join(group))
    return out


@pytest.mark.parametrize("sizes", [(60, 120, 10), (10, 50, 200), (600, 1200, 100)])
def test_packing_of_paragraphs(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i, ["x" * rng.randint(1, 90) + str(k) for k in range(rng.randint(0, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, parts array<string>")
    got = {r.id: r.c for r in df.select("id", chunking.pack(F.col("parts"), *sizes).alias("c")).collect()}
    assert got == {i: plain_pack(p, *sizes) for i, p in rows}


def test_chunk_indexes_and_short_documents(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(12))
    out = chunking.chunk(spark.createDataFrame([("d", text), ("s", "short"), ("n", None)], "doc_id string, text string"), 600, 1200, 100).collect()
    assert [r.chunk_id for r in out] == [f"d_chunk_{i}" for i in range(len(out))] and len(out) > 2


def test_cleaning(spark):
    df = spark.createDataFrame([("  educa-\n tion ﬁne “x” … \nPage 3\n<b>y</b>  ©\n\n\n\nGovemment ",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(cleaning.clean(F.col("t"))).collect()]
    assert got == ['education fine "x" ...\ny \n\nGovernment'.replace("y \n", "y\n"), "", None]


def test_entities(spark):
    t = "G.O.Ms.No. 12 and GO No 7, Section 12(a), Rule 5, Rules, 2023 on 3-4-2020 in 2021. The Public Education Act, 2009 applies."
    row = spark.createDataFrame([(t,), ("",)], "t string").select(entities.all_entities(F.col("t")).alias("e")).collect()
    assert row[0].e["go_numbers"] == ["GO.MS.No.12", "GO.MS.No.7"] and row[0].e["years"] == ["2009", "2020", "2021", "2023"]
    assert "Section 12(a)" in row[0].e["sections"] and "Rules, 2023" in row[0].e["rules"] and row[1].e == {}


def test_classification_ties_and_defaults(spark):
    df = spark.createDataFrame([("order order act act",), ("nothing here",), ("section rule act order",)], "t string")
    got = [(r.v.vertical, r.v.confidence) for r in df.select(classify.vertical(F.col("t")).alias("v")).collect()]
    assert got == [("data", 0.3), ("data", 0.3), ("legal", 0.75)]


def test_relations_context_and_first_wins(spark):
    docs = spark.createDataFrame([("a", "This supersedes G.O.MS No. 5. It SUPERSEDES 5 again, as per Rule 9."), ("b", None)], "doc_id string, text string")
    out = relations.deduplicate(relations.extract(docs)).collect()
    assert {(r.relation_type, r.target) for r in out} == {("supersedes", "G.O.MS.No.5"), ("cites", "Rule 9")}
    assert all(r.context in "This supersedes G.O.MS No. 5. It SUPERSEDES 5 again, as per Rule 9." for r in out)


def test_supersession_ignores_loops_and_unknown_targets(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, go_number string")
    rel = spark.createDataFrame([("b", "supersedes", "G.O.MS.No.1"), ("a", "supersedes", "G.O.MS.No.1"), ("c", "supersedes", "G.O.MS.No.99"), ("c", "supersedes", "G.O.MS.No.1")], "source_id string, relation_type string, target string")
    assert [tuple(r) for r in relations.supersession_map(docs, rel).collect()] == [("a", "c")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0, 0.0], [-1.0, 0.0])], "i int, a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.euclidean(F.col("a"), F.col("b")), vectors.good_quality(F.col("a"))).collect()]
    assert got == [(0.96, 2**0.5, True), (0.0, 1.0, False), (0.0, 2.0, True)]
    v = df.select(F.col("i").alias("vec_id"), F.col("a").alias("embedding"))
    q = df.select(F.col("i").alias("query_id"), F.col("b").alias("embedding"))
    one = sorted(tuple(r) for r in vectors.top_k(v, q, 2, 0.3).collect())
    many = sorted(tuple(r) for r in vectors.top_k(v, q, 2, 0.3, block=2).collect())
    assert one == many and one[0][:2] == (1, 1)


def test_mmr_is_greedy(spark):
    rows = [(1, 10, 0.9, [1.0, 0.0]), (1, 11, 0.89, [1.0, 0.01]), (1, 12, 0.5, [0.0, 1.0]), (2, 13, 0.1, [1.0, 1.0])]
    out = fusion.greedy(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, embedding array<double>"), 2, 0.5, 10, "mmr")
    assert sorted((r.query_id, r.pick, r.chunk_id) for r in out.collect()) == [(1, 1, 10), (1, 2, 12), (2, 1, 13)]


def test_fusion_ties_and_single_rows(spark):
    rows = [(1, 2, 0.5), (1, 1, 0.5), (2, 9, 0.3)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, score double")
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in fusion.ranked(df, "score").orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2), (2, 9, 1)]
    assert {r.norm_score for r in fusion.normalize_scores(df).collect()} == {1.0}
    assert {r.norm_score for r in fusion.normalize_scores(df, "z").collect()} == {0.5}


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a a"), (3, "c"), (4, None)], "doc_id int, text string")
    out = lexical.search(docs, spark.createDataFrame([(1, "a b")], "query_id int, query string"), 5).collect()
    assert [r.doc_id for r in out] == [1, 2]


def test_interpretation_of_empty_query(spark):
    q = F.col("q")
    row = spark.createDataFrame([("",)], "q string").select(interpret.query_type(q).alias("t"), interpret.scope(q).alias("s"), interpret.route_v1(q).alias("r")).first()
    assert (row.t.query_type, row.t.confidence, row.s) == ("qa", 0.3, "narrow") and [r.vertical for r in row.r] == ["legal", "go"]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "A b.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "in" / "sub" / "c.txt").write_text("schön")
    (tmp_path / "in" / "x.bin").write_text("no")
    buf = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "in" / "d.docx").write_bytes(buf.getvalue())
    (tmp_path / "in" / "e.docx").write_text("broken")
    found = files.scan(spark, str(tmp_path / "in"))
    text = {r.stem: r.t for r in found.where("extension = 'txt'").select("stem", files.decoded(F.col("content")).alias("t")).collect()}
    assert text == {"A b": "é", "c": "schön"}
    docx = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.docx_text(found.where("extension = 'docx'")).collect()}
    assert docx == {"d.docx": ("Hello\nTables:\na | b", None), "e.docx": (None, "BadZipFile")}
    (tmp_path / "c.jsonl").write_text(json.dumps({"text": "t", "doc_id": "d", "chunk_id": "c"}) + "\n{broken\n" + json.dumps({"text": "t", "doc_id": "d"}) + "\n")
    good, bad = files.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert good.count() == 1 and len(bad.collect()) == 2


def test_html(spark):
    df = spark.createDataFrame([(1, "<nav>n</nav><p>a &amp; b</p><script>x</script><main>m <b>c</b></main>"), (2, "<p>p"), (3, None)], "page_id long, html string")
    assert {r.page_id: (r.text, r.has_main) for r in web.main_content(df).collect()} == {1: ("m c", True), 2: ("p", False), 3: ("", False)}
    assert [r[0] for r in df.select(web.html_to_text(F.col("html"))).collect()] == ["na & bm c", "p", None]
    urls = spark.createDataFrame([("https://a.example.com/x",), ("https://evilexample.com",), ("http://localhost/",), (None,)], "u string")
    assert [r[0] for r in urls.select(web.allowed(F.col("u"), ["example.com"])).collect()] == [True, False, False, None]
    assert [r[0] for r in urls.select(web.safe(F.col("u"))).collect()] == [True, True, False, False]


def test_streaming_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, word in enumerate(("old", "new")):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"doc_id": d, "text": f"{word} " * 60}) for d in (("a", "b") if i == 0 else ("b", "c"))))
        q = ingest.stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 10, 5000, 0)
        q.awaitTermination()
    rows = {r.chunk_id: r.content.split()[0] for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()}
    assert rows == {"a_chunk_0": "old", "b_chunk_0": "new", "c_chunk_0": "new"}


def test_event_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    total = ingest.event_windows(events).agg(F.sum("n")).first()[0]
    assert total == events.count() == ingest.sessions(events).agg(F.sum("n")).first()[0]
