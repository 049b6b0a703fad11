import zlib

from tessera.llm import langid

EN = "the house is on the hill and we went there with all of them yesterday {}"
DE = "das haus steht auf dem hügel und wir gingen gestern mit allen dorthin {}"
FR = "la maison est sur la colline et nous sommes allés là avec eux hier {}"
ES = "la casa está en la colina y ayer fuimos allí con todos ellos {}"


def test_families_then_languages(spark):
    rows = [(i, t.format("x" * (i % 5)), lang, "s") for i in range(240) for t, lang in [((EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es"))[i % 4]]]
    rows += [(500, None, "en", "s"), (501, "12 !?", None, "s"), (502, "", None, "s"), (503, EN.format("y") * 3000, None, "s"), (503, EN.format("y"), None, "s"), (None, DE, None, "s")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert all(got[i][0].lang_pred == ("en", "de", "fr", "es")[i % 4] for i in range(240))
    assert {got[i][0].lang_pred for i in (500, 501, 502)} == {"und"}
    assert [r.lang_pred for r in got[503]] == ["en", "en"] and got[None][0].lang_pred == "de"


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_texts_without_letters_have_no_features():
    for t in (None, "", " \n", "12 34", "½ ¼", "² ³", "Ⅷ Ⅳ", "___ --- 5²"):
        assert langid.features(t) is None
    for t in ("a", "é ½", "日本", "x²"):
        assert langid.features(t) is not None
