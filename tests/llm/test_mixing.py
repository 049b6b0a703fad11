from collections import Counter

import pytest

from tessera.llm import mixing


def test_every_block_in_its_window():
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 1000, "b": 1, "c": 1, "d": 333}, {str(i): i + 1 for i in range(30)}):
        slots, period = mixing.quotas(weights, 128)
        assert sum(slots.values()) == period and min(slots.values()) >= 1
        done = Counter()
        for t, (s, k, release, deadline, slot) in enumerate(mixing.schedule(slots, period)):
            assert slot == t and release <= t < deadline and k == done[s]
            done[s] += 1
            for x in slots:
                assert abs(done[x] - (t + 1) * slots[x] / period) < 1
        assert done == slots


def rows_of(spark, sizes, extra=()):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, f"t{i}", 5))
            i += 1
    return spark.createDataFrame(rows + list(extra), "doc_id long, source string, text string, mix int")


def test_mix_tracks_its_target(spark):
    df = rows_of(spark, {"hot": 900, "b": 200, "c": 40, None: 10})
    weights = {"hot": 3.0, "b": 2.0, "c": 1.0, None: 0.5}
    out = mixing.mix(df, weights, block=4, period=64).collect()
    assert {r.doc_id for r in out} == set(range(1150))
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.mix_slot, []).append(r)
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert sorted(by_slot) == list(range(len(by_slot)))
    slots, period = mixing.quotas(weights, 64)
    done = Counter()
    for t in range(len(by_slot)):
        block = by_slot[t]
        assert len({(r.source, r.mix_block, r.mix_epoch) for r in block}) == 1 and sorted(r.mix_seat for r in block) == list(range(len(block)))
        done[block[0].source] += 1
        assert all(abs(done[s] - (t + 1) * slots[s] / period) < 1 for s in slots)
    # the source that its weight asks for latest is used once; none is left out
    assert max(Counter(r.doc_id for r in out if r.source == "hot").values()) == 1 or max(r.mix_epoch for r in out) > 0


def test_default_weights_empty_repeats_and_missing_weight(spark):
    df = rows_of(spark, {"a": 50, "b": 5}, [(None, "a", "x", 1), (3, "a", "t3", 5)])
    out = mixing.mix(df)
    assert out.where("mix_epoch = 0").count() == 57
    assert mixing.mix(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(df, {"a": 1.0}).collect()


def test_schedule_against_a_plain_search():
    """Slot by slot, of all blocks that are released and not yet placed the one with the earliest deadline."""
    for weights in ({"a": 5, "b": 3, "c": 1}, {"a": 100, "b": 1, "c": 33}, {str(i): i + 1 for i in range(9)}):
        slots, period = mixing.quotas(weights, 64)
        names = sorted(slots, key=str)
        left = [(k * period // slots[s], -(-(k + 1) * period // slots[s]), i, k, s) for i, s in enumerate(names) for k in range(slots[s])]
        plain = []
        for slot in range(period):
            best = min((x for x in left if x[0] <= slot), key=lambda x: (x[1], x[2], x[3]))
            left.remove(best)
            plain.append((best[4], best[3], best[0], best[1], slot))
        assert mixing.schedule(slots, period) == plain


def test_names_that_clash_and_a_function_of_sizes(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i, "x") for i in range(40)], "doc_id long, source string, mix_slot int, `_row` string")
    out = mixing.mix(df, mixing.tilted, block=4, period=8)
    assert out.columns[:3] == ["doc_id", "source", "_row"] and out.columns.count("mix_slot") == 1
    assert {r.doc_id for r in out.select("doc_id", "mix_slot").collect()} == set(range(40))
    assert "mix_slot" in mixing.mix(df.limit(0)).columns and mixing.mix(df.limit(0)).count() == 0
    assert mixing.tilted({"a": 100, "b": 100}) != {"a": 100**0.9, "b": 100**0.9} or mixing.TILT == (1.0,)
