import hashlib
import random

from tessera.llm import linededup


def rolling(lines):
    """Rolling hash of each window of two lines; windows of blank lines come last."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[: linededup.HEX], 16) for x in lines]
    solid = [bool(x.strip(" \t\r")) for x in lines]
    return [(h[i] * linededup.BASE + h[i + 1]) % linededup.PRIME if solid[i] or solid[i + 1] else linededup.PRIME for i in range(len(lines) - 1)]


def boundaries(lines):
    r = rolling(lines)
    picked = {0} if len(r) == 1 else {i if r[i] <= r[i + 1] else i + 1 for i in range(len(r) - 1)}  # the smaller of each two neighbours
    return sorted(i for i in picked if r[i] < linededup.PRIME)


def plain(rows):
    """Document after document: every boundary's window leads to its first place; from there line by line both ways."""
    texts = {d: t.split("\n") for d, t in rows if d is not None and t is not None}
    first = {}
    for d in sorted(texts):
        for i in boundaries(texts[d]):
            first.setdefault(tuple(texts[d][i : i + 2]), (d, i))
    out = []
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        if t is None:
            out.append((d, None))
            continue
        lines, drop = texts[d], set()
        for i in boundaries(lines):
            o, j = first[tuple(lines[i : i + 2])]
            if (o, j) == (d, i):
                continue
            shift, other = i - j, texts[o]
            agree = [k for k in range(len(lines)) if 0 <= k - shift < len(other) and lines[k] == other[k - shift]]
            for run in runs_of(agree):
                if i in run and i + 1 in run and sum(bool(lines[k].strip(" \t\r")) for k in run) >= linededup.MIN_LINES:
                    drop |= set(run)
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in drop)))
    return out


def runs_of(numbers):
    out = []
    for k in numbers:
        if out and out[-1][-1] == k - 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def every_removed_run_occurs_earlier(rows, got):
    """Independent of any rule: lines that went lie in runs of two lines with words or more that an earlier place holds as a whole."""
    texts = {d: t.split("\n") for d, t in rows if d is not None and t is not None}
    places = {}
    for d in sorted(texts):
        for i, pair in enumerate(zip(texts[d], texts[d][1:])):
            places.setdefault(pair, []).append((d, i))
    for d, t in got:
        if t is None:
            continue
        lines = texts[d]
        kept = t.split("\n")
        can_go = set()
        for i in range(len(lines) - 1):
            for o, j in places[lines[i], lines[i + 1]]:
                if (o, j) < (d, i):
                    lo, hi, other = i, i + 1, texts[o]
                    while lo > 0 and j - (i - lo) > 0 and lines[lo - 1] == other[j - (i - lo) - 1]:
                        lo -= 1
                    while hi + 1 < len(lines) and j + (hi - i) + 1 < len(other) and lines[hi + 1] == other[j + (hi - i) + 1]:
                        hi += 1
                    if sum(bool(x.strip(" \t\r")) for x in lines[lo : hi + 1]) >= 2:
                        can_go |= set(range(lo, hi + 1))
        # what must stay is there in order
        must, at = [x for i, x in enumerate(lines) if i not in can_go], 0
        for x in must:
            at = kept.index(x, at) + 1


def result(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, size int")
    return sorted((r.doc_id, r.text) for r in linededup.line_dedup(df).collect() if r.doc_id is not None)


def test_against_plain_python(spark):
    rng = random.Random(8)
    lines = [f"line {i}" for i in range(30)] + ["", "é ß", "x" * 500]
    shared = [rng.choice(lines) for _ in range(12)]
    rows = []
    for i in range(120):
        body = [rng.choice(lines) + rng.choice(["", str(i)]) for _ in range(rng.randint(0, 15))]
        at = rng.randint(0, len(body))
        rows.append((i, "\n".join(body[:at] + (shared if rng.random() < 0.6 else []) + body[at:])))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1]), (204, "a\nb\n" * 300)]
    assert result(spark, rows) == plain(rows)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert linededup.line_dedup(spark.createDataFrame([], schema)).collect() == []
    out = linededup.line_dedup(spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, "a\nb")], schema)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, "")]


def test_passages_between_other_lines(spark):
    """A passage of three lines or more goes from every document but the first, whatever surrounds it; of two lines, where its window is a boundary."""
    rng = random.Random(3)
    own = lambda: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 10**6)) for _ in range(12))
    rows, clean, pairs, at = [], {}, 0, 0
    for n in [2] * 20 + [3, 4, 5, 6, 7, 8] * 4:
        passage = [own() for _ in range(n)]
        for copy in range(4):
            before, after = [own() for _ in range(rng.randint(0, 4))], [own() for _ in range(rng.randint(1, 4))]
            rows.append((at, "\n".join(before + passage + after)))
            clean[at] = (n, "\n".join(before + after) if copy else rows[-1][1], rows[-1][1])
            at += 1
    for d, t in result(spark, rows):
        n, want, whole = clean[d]
        assert t == want or (n == 2 and t == whole)
        pairs += n == 2 and t == want and want != whole
    assert pairs >= 12


def test_nothing_is_joined_across_documents(spark):
    rows = [(1, "X line\n\nq1"), (2, "q2\n\nY line"), (3, "X line\n\nY line")]
    assert result(spark, rows) == rows


def test_removed_runs_occur_earlier(spark):
    rng = random.Random(11)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    got = result(spark, rows)
    every_removed_run_occurs_earlier(rows, got)
    assert got == plain(rows) and sum(len(t) for _, t in got) < sum(len(t) for _, t in rows) * 0.9


def test_one_doc_id_with_two_texts(spark):
    rows = [(1, "a b\nc d\ne f"), (1, "own line\na b\nc d\ne f\nother line")]
    left = [t for _, t in result(spark, rows)]
    assert sorted(left) in (sorted([rows[0][1], "own line\nother line"]), sorted(["", rows[1][1]]))


def test_very_long_text(spark):
    body = "\n".join(f"line number {i} of a long text" for i in range(30_000))
    assert result(spark, [(1, body), (2, "head\n" + body + "\ntail"), (3, "x" * 2_000_000)]) == [(1, body), (2, "head\ntail"), (3, "x" * 2_000_000)]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b\nc d", "x", 1, 2, 3), (2, "a b\nc d", "y", 4, 5, 6)], "doc_id long, text string, _gone string, _id int, k int, `odd.name` int")
    out = linededup.line_dedup(df)
    assert out.columns[:6] == df.columns
    assert sorted((r.doc_id, r.text, r._gone, r._id, r.k) for r in out.collect()) == [(1, "a b\nc d", "x", 1, 2), (2, "", "y", 4, 5)]


def test_own_columns_named_as_the_report(spark):
    df = spark.createDataFrame([(1, "a b\nc d\ne", 7), (2, "a b\nc d\ne", 8)], "doc_id long, text string, _removed_lines int")
    plain_out = linededup.line_dedup(df, report=False)
    assert plain_out.columns == df.columns and sorted(r._removed_lines for r in plain_out.collect()) == [7, 8]
    assert sorted(r._removed_lines for r in linededup.line_dedup(df).collect()) == [0, 3]


def test_blank_lines_alone_stay(spark):
    rows = [(1, "one\n\n\ntwo"), (2, "three\n\n\nfour\n\nsolo line\n\nfive"), (3, "six\n\nsolo line\n\nseven")]
    assert result(spark, rows) == rows
