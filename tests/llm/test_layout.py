"""Sharding and mixing."""

import collections
import zlib

import numpy as np
import pytest

from pagewright.llm import mixing, sharding


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sharding.STEP + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_its_definition():
    keys = np.array([0, 1, 2, 2**63, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**63, 300)], dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = before != after
    assert set(after[moved]) == {24} and 0.03 < moved.mean() < 0.05


def test_shard_table(spark):
    rows = [(i, f"text {i % 7}", 1) for i in range(3000)] + [(5, "text 5", 2)] * 400 + [(None, None, 0), (-9, None, 0), (-9, "", 0)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, slot int")).collect()
    assert len(out) == len(rows)
    slots = collections.defaultdict(list)
    for r in out:
        key = (r.doc_id or 0) % 2**64
        assert (r.shard, r.grown_shard, r.law) == (slow_jump(key, 24), slow_jump(key, 25), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((d or 0, len(t or "") + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 1}, {"a": 7, "b": 5, "c": 3, "d": 1}, {c: 1 for c in "abcdefg"}, {"a": 500, "b": 499, "c": 1}])
def test_windows_are_met_and_no_source_drifts_by_a_block(weights):
    total = sum(weights.values())
    slots = mixing.pattern(weights, total * 2)
    seen = collections.Counter()
    for t, s in enumerate(slots):
        j = seen[s]
        assert j * total // weights[s] <= t < -(-(j + 1) * total // weights[s])
        seen[s] += 1
        for x, w in weights.items():
            assert abs(seen[x] - (t + 1) * w / total) < 1
    assert slots[:total] == slots[total:]


def slow_schedule(blocks, weights):
    """Phase by phase, slot by slot."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        own = {s: weights[s] for s in left}
        gone = False
        period = mixing.pattern(own, sum(own.values()))
        t = 0
        while not gone:
            s = period[t % len(period)]
            out.append(s)
            left[s] -= 1
            if not left[s]:
                del left[s]
                gone = True
            t += 1
    return out


@pytest.mark.parametrize("blocks,weights", [({"a": 9, "b": 2, "c": 30}, {"a": 2, "b": 3, "c": 5}), ({"a": 1}, {"a": 4}), ({"a": 50, "b": 50, "c": 50}, {"a": 1, "b": 10, "c": 100}), ({"a": 3, "b": 0, None: 4}, {"a": 1, "b": 1, None: 2})])
def test_arithmetic_slots_equal_the_schedule(blocks, weights):
    plan = mixing.plan(blocks, weights)
    got = {mixing.slot_of(plan[s], k)[0]: s for s, n in blocks.items() for k in range(n)}
    assert [got[t] for t in range(len(got))] == slow_schedule(blocks, weights)


def test_mixed_table(spark):
    rows = [(i, "s0" if i % 3 == 0 else f"s{i % 11}", f"t{i}") for i in range(3000)] + [(None, None, None), (7, None, ""), (7, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string").withColumnRenamed("mix_slot", "text")
    out = mixing.scheduled(df, {"s0": 40}, block=8).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        by[r.source].append(r.mix_rank)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    slots = collections.defaultdict(set)
    for r in out:
        slots[r.mix_slot].add((r.source, r.mix_rank // 8))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    order = [r.source for r in mixing.mixed(df, {"s0": 40}, block=8).collect()]
    assert order == [r.source for r in sorted(out, key=lambda r: (r.mix_slot, r.mix_rank))]
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, df.collect()))
    assert mixing.mixed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.scheduled(df, {"s0": 0})


def test_many_sources_are_scheduled_in_levels(spark, monkeypatch):
    rows = [(i, f"s{i % 601}" if i % 2 else f"s{i % 7}") for i in range(6000)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    assert df.select("source").distinct().count() == 602
    for most, fan in ((500, 32), (5, 4)):  # two levels and five
        monkeypatch.setattr(mixing, "MOST_SOURCES", most)
        monkeypatch.setattr(mixing, "FAN", fan)
        out = mixing.scheduled(df, {"s0": 4000}, block=4).collect()
        assert sorted(map(str, ((r.doc_id, r.source) for r in out))) == sorted(map(str, rows))
        ranks, slots = collections.defaultdict(list), collections.defaultdict(set)
        for r in out:
            assert r.mix_release <= r.mix_slot < r.mix_deadline
            ranks[r.source].append(r.mix_rank)
            slots[r.mix_slot].add((r.source, r.mix_rank // 4))
        assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
        assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())


def test_levels_keep_shares():
    """Sources that all last as long: after a tenth of all slots each has about a tenth of its blocks out."""
    weights = {f"s{i}": 1 + i % 3 for i in range(1200)}
    paths = mixing.levels({s: 40 * w for s, w in weights.items()}, weights)
    total = 40 * sum(weights.values())
    for s, w in weights.items():
        out = sum(mixing.place_of(paths[s], k)[0] < total // 10 for k in range(40 * w))
        assert abs(out - 4 * w) <= 3, (s, out)


def test_more_sources_follow_the_same_law(monkeypatch):
    """Beyond 500 sources the schedule is still that of one level, phase by phase, and no constant changes it."""
    weights = {f"s{i}": 1 + i * 7 % 5 for i in range(530)}
    blocks = {s: 1 + i * i % 11 for i, s in enumerate(weights)}
    paths = mixing.levels(blocks, weights)
    got = {mixing.place_of(paths[s], k)[0]: s for s, n in blocks.items() for k in range(n)}
    assert [got[t] for t in range(len(got))] == slow_schedule(blocks, weights)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    assert mixing.levels(blocks, weights) == paths


def test_columns_may_bear_the_operators_names(spark):
    rows = [(i, f"s{i % 3}", i, 2 * i, f"b{i}", 3.5, 7, 8, 9) for i in range(200)]
    names = ["doc_id", "source", "first", "mix_hash", "mix_bucket", "mix_place", "mix_slot", "row", "id"]
    df = spark.createDataFrame(rows, "doc_id long, source string, first int, mix_hash long, mix_bucket string, mix_place double, mix_slot int, row int, id int")
    out = mixing.scheduled(df, block=4)
    assert out.columns == [n for n in names if n != "mix_slot"] + ["mix_slot", "mix_rank", "mix_release", "mix_deadline"]
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [tuple(r[n] for n in names if n != "mix_slot") for r in got] == [r[:6] + r[7:] for r in rows]
    assert sorted({r.mix_slot for r in got}) == list(range(len({r.mix_slot for r in got})))
    assert mixing.mixed(df).columns == names and sorted(map(tuple, mixing.mixed(df).collect())) == sorted(rows)


@pytest.mark.parametrize("weights", [{"a": 3 * 10**12, "b": 10**12}, {"a": 1, "b": 10**6}, {"a": 3 * 10**12 + 1, "b": 10**12, "c": 1}, {f"s{i}": 10 ** (i % 7) + i for i in range(40)}])
def test_weights_of_any_size(weights):
    """No source is a block off its share in any phase, however long the period is."""
    blocks = {s: 30 + 7 * i for i, s in enumerate(weights)}
    plan = mixing.plan(blocks, weights)
    order = dict(sorted((mixing.slot_of(plan[s], k)[0], s) for s, n in blocks.items() for k in range(n)))
    assert list(order) == list(range(sum(blocks.values())))
    left, out, start = dict(blocks), collections.Counter(), 0
    for t, s in order.items():
        out[s] += 1
        total = sum(weights[x] for x in left)
        assert all(abs(out[x] - (t + 1 - start) * weights[x] / total) < 1 + 1e-9 for x in left)
        if out[s] == left[s]:
            left, out, start = {x: n - out[x] for x, n in left.items() if x != s}, collections.Counter(), t + 1


def test_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRETCH", 70)
    rows = [(5, "same")] * 1000 + [(i, f"t{i}") for i in range(100)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == 1100 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_more_shards_than_a_broadcast_holds(spark, monkeypatch):
    rows = [(i * 7919, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, sharding.shard(df, 100).collect()))
    monkeypatch.setattr(sharding, "FEW_BUCKETS", 10)
    assert sorted(map(tuple, sharding.shard(df, 100).collect())) == want
