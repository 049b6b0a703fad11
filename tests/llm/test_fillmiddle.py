import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import fillmiddle


def plain(doc_id, text, seed="7", rate=100, spm_rate=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **options):
    out = fillmiddle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert len(out) == len(rows)
    want = sorted([(d is None, d or 0, *plain(d, t, **options)[:2], plain(d, t, **options)[2:], t or "") for d, t in rows], key=repr)
    got = sorted([(r.doc_id is None, r.doc_id or 0, r.fim.n, r.fim.form, (r.fim.prefix_chars, r.fim.middle_chars, r.fim.output), r.fim.restored) for r in out], key=repr)
    assert got == want
    return out


def test_against_plain_python(spark):
    rows = [(i, "".join(f"line {j} é𝒳\n" * (j % 3) + "\n" for j in range(i % 9)) + ("end" if i % 2 else "")) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\n"), (303, "\n\n\n"), (304, "no feed"), (None, "a\nb"), (5, "same id\nother text"), (5, "same id\nother text")]
    rows += [(400, "has <P> in it\nx"), (401, "<S>"), (402, "a<M>\nb"), (403, "<\nP>\n<S\n>"), (404, "a<\n<\nb\r\nc d\x00\n")]
    out = check(spark, rows)
    assert {r.fim.form for r in out} == {"plain", "psm", "spm"}


def test_rates_and_seed(spark):
    rows = [(i, "a\nb\nc\nd\n") for i in range(300)]
    forms = [r.fim.form for r in check(spark, rows, rate=50, spm_rate=10, seed="other")]
    assert 90 < forms.count("plain") < 210 and forms.count("spm") < 60
    assert {r.fim.form for r in check(spark, rows, rate=0)} == {"plain"}


def test_very_long_text(spark):
    check(spark, [(1, "a line of some words\n" * 200_000), (2, "x" * 3_000_000), (3, "\n" * 500_000)])


def test_empty_table_and_names_that_clash(spark):
    assert fillmiddle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a\nb\nc", 1, "h", "r", None)], "doc_id long, text string, n int, h string, row string, `odd.name` string")
    out = fillmiddle.fill_in_middle(df)
    assert out.columns == [*df.columns, "fim"]
    assert out.drop("fim").collect() == df.collect()
    again = fillmiddle.fill_in_middle(out)
    assert again.columns == out.columns and again.collect() == out.collect()


def test_stays_in_the_jvm(spark):
    plan = fillmiddle.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab<>PSM\né", max_size=40), min_size=1, max_size=60))
def test_any_text_comes_back(spark, texts):
    check(spark, list(enumerate(texts)))
