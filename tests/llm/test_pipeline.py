"""The pipeline's stages against plain versions, on a small fixture and on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import test_linededup  # noqa: E402
import test_ngramjoin  # noqa: E402

from tessera.llm import packing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF).cache()
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected

    lines = stage["line dedup"](spark, clean, SF).cache()
    assert lines.columns == COLUMNS
    want = test_linededup.plain([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == want and all(r.n_chars == len(r.text) for r in lines.collect())

    single = stage["n-gram Jaccard join"](spark, lines, SF).cache()
    assert single.columns == COLUMNS
    groups = test_ngramjoin.plain_components([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in single.collect()) == [d for d, _, c in groups if d == c]

    mixed = stage["mixing sources to target weights"](spark, single, SF).cache()
    assert mixed.columns == COLUMNS
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == {r.doc_id for r in single.collect()}
    by_source = {}
    for r in single.collect():
        by_source.setdefault(r.source, []).append(times[r.doc_id])
    assert all(max(t) - min(t) <= 1 for t in by_source.values())

    packed = stage["best-fit packing"](spark, mixed, SF).collect()
    lengths = Counter(r.length for r in packed)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert max(r.offset + r.length for r in packed) <= 4096
    n = len({r.sequence_id for r in packed})
    assert packing.least_bins(dict(lengths), 4096) <= n <= packing.least_bins(dict(lengths), 4096) + 1


def test_run_is_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "lower_bound", "proved"] and out.count() > 0
