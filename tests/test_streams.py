"""Event-time streams through restarts: rows in and out of the watermark, joins of two streams, repeated batches."""

import os

from pyspark.sql import functions as F

from tessera.streaming import events

EVENT = "k string, t timestamp, v int"


def add(spark, folder, name, rows, schema=EVENT):
    """One more file of (key, minute, value) rows."""
    made = spark.createDataFrame(rows, "k string, m int, v int").select("k", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("m"))).alias("t"), "v")
    made.toDF(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema=EVENT):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))


def test_first_rows_within_the_watermark_through_restarts(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = lambda: {(r.k, r.v) for r in spark.read.schema(EVENT).parquet(out).collect()}
    run = lambda: events.drain(events.first_within(stream(spark, source), ["k"], "t", "10 minutes"), out, check)
    add(spark, source, "1", [("a", 0, 1), ("b", 1, 2), (None, 1, 3), (None, 2, 3)])
    run()
    assert seen() == {("a", 1), ("b", 2), (None, 3)}
    add(spark, source, "2", [("a", 8, 4), ("c", 60, 5)])  # a is still known; c moves the watermark to minute 50
    run()
    add(spark, source, "3", [("a", 55, 6), ("d", 2, 7), ("c", 61, 8)])  # a has been forgotten, d is late, c is known
    run()
    run()  # nothing new
    assert seen() == {("a", 1), ("b", 2), (None, 3), ("c", 5), ("a", 6)}


def test_two_streams_meet_across_a_restart(spark, tmp_path):
    left, right, out, check = (str(tmp_path / x) for x in ("left", "right", "out", "check"))
    other = "k string, rt timestamp, w int"

    def run():
        both = events.joined(stream(spark, left), stream(spark, right, other), "k", "t", "rt", "5 minutes", "10 minutes")
        events.drain(both, out, check)

    add(spark, left, "1", [("a", 0, 1), ("b", 0, 2), (None, 0, 3)])
    add(spark, right, "1", [("b", 6, 10), (None, 1, 11)], other)
    run()
    add(spark, right, "2", [("a", 5, 12), ("b", 5, 13), ("a", 90, 14)], other)
    add(spark, left, "2", [("a", 80, 4)])
    run()
    add(spark, right, "3", [("a", 3, 15)], other)  # later than the watermark: its partner is gone
    run()
    assert {(r.k, r.v, r.w) for r in spark.read.parquet(out).collect()} == {("a", 1, 12), ("b", 2, 13)}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    rows = lambda: {r.k: r.v for r in events.table(spark, path).collect()}
    files_of = lambda: {b: sorted(os.listdir(f"{path}/{b}")) for b in os.listdir(path) if b.startswith("bucket=")}
    add(spark, source, "1", [(f"k{i}", 1, i) for i in range(200)] + [(None, 1, 7), ("k0", 0, 99)])
    events.upsert_stream(stream(spark, source), path, check, "k", "t")
    assert rows() == {f"k{i}": i for i in range(200)} | {None: 7}
    before = files_of()
    add(spark, source, "2", [("k5", 2, 50), ("k6", 0, 60), ("k5", 2, 50)])  # newer, and older than what is there
    events.upsert_stream(stream(spark, source), path, check, "k", "t")
    want = {f"k{i}": i for i in range(200)} | {None: 7, "k5": 50}
    assert rows() == want
    after = files_of()
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    again = stream(spark, source)
    events.upsert_stream(again, path, str(tmp_path / "lost-checkpoint"), "k", "t")  # all batches once more
    assert rows() == want
    events.upsert(spark.createDataFrame([], EVENT), path, "k", "t")
    assert rows() == want
