import random

from tessera.llm import linededup


def test_every_two_line_passage_goes(spark):
    """op6_linededup's rule: a passage of two lines goes from every document but the first, whatever surrounds it."""
    rng = random.Random(3)
    own = lambda: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 10**6)) for _ in range(12))
    rows, want, at = [], [], 0
    for n in [2] * 20 + [3, 5, 8]:
        passage = [own() for _ in range(n)]
        for copy in range(3):
            before, after = [own() for _ in range(rng.randint(0, 4))], [own() for _ in range(rng.randint(1, 4))]
            rows.append((at, "\n".join(before + passage + after)))
            want.append((at, "\n".join(before + after) if copy else rows[-1][1]))
            at += 1
    rows.append((at, "X line\n\nY line"))  # (nothing is joined that no earlier place holds as a whole)
    want.append(rows[-1])
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
