import gzip
import hashlib

from tessera.llm import warc


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    return {warc_id(r): r for r in warc.warc_roundtrip(spark, df).collect()}


def warc_id(row):
    return row.metadata.page_id


def test_roundtrip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200_000
    same = "y" * 100
    rows = [(5, "http://a/", same, "p"), (3, "http://b/\r\nX: y", same, "p"), (9, None, same, "p"), (1, "", None, "p"), (2, "http://c", "", "p"), (4, "u", "z" * 99, "p"), (6, "u", "z" * 99, "p"), (7, "u", long, "p"), (7, "u", long, "p"), (None, "u", "lost", "p")]
    got = run(spark, rows)
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 9]
    kinds = {k: (r.response.record_type, r.response.refers_to) for k, r in got.items()}
    assert kinds[5] == kinds[9] == ("revisit", "<urn:capture:3:response>")
    assert all(kinds[k] == ("response", None) for k in (1, 2, 3, 4, 6, 7))
    for k, html in ((3, same), (5, same), (1, ""), (7, long), (4, "z" * 99)):
        assert got[k].response.payload_bytes == len(html.encode()) and got[k].response.payload_digest == hashlib.sha256(html.encode()).hexdigest()
    assert all(r.request is not None for r in got.values()) and got[1].response.target_uri is None


def test_empty(spark):
    assert run(spark, []) == {}


def record(kind, rid, block, **extra):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in extra.items()}, "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    a = record("warcinfo", "<i>", b"x") + record("response", "<r1>", http, Content_Type="application/http; msgtype=response", WARC_Concurrent_To="<q1>") + record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n")
    b = record("metadata", "<m2>", b"page_id: 8\r\n", WARC_Concurrent_To="<r2>") + record("request", "<q2>", b"GET", WARC_Concurrent_To="<r2>") + record("response", "<r2>", http, Content_Type="application/http") + b"WARC/1.0\r\nbroken"
    (tmp_path / "part-a.gz").write_bytes(gzip.compress(a[:40]) + gzip.compress(a[40:]))
    (tmp_path / "part-b").write_bytes(b)
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path), with_payload=True)).collect()}
    assert set(got) == {"<r1>", "<r2>"} and bytes(got["<r1>"].response.payload) == b"body"
    assert got["<r1>"].request.record_id == "<q1>" and got["<r1>"].metadata is None and got["<r2>"].metadata.page_id == 8


def test_large_payloads_have_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_PAYLOAD", 1000)
    rows = [(i, "u", str(i) * (2000 if i % 3 == 0 else 50), "p") for i in range(1, 13)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_archives(df, str(tmp_path / "w"))
    large = [f for f in (tmp_path / "w" / "large").rglob("part-*")]
    assert len(large) == 4 and all(len(list(warc.parse_archive(f.read_bytes()))) == 3 for f in large)
    got = run(spark, rows)
    assert {k: r.response.payload_bytes for k, r in got.items()} == {i: len(h) for i, _, h, _ in rows}
