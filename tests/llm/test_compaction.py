import datetime
import hashlib
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from pagewright.llm import compaction

START = datetime.datetime(2024, 1, 1)
SHAPE = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def first_fit(sizes, most):
    room, bins, places = [], [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(most)
        room[at] -= s
        places.append(bins.count(at))
        bins.append(at)
    return bins, places


def test_blocks_find_the_first_bin():
    r = random.Random(3)
    for n in (0, 1, 2, 5, 50, 400):
        sizes = [r.randint(1, 12) for _ in range(n)]
        assert compaction.packed(sizes, 12) == first_fit(sizes, 12)
        sizes.sort(reverse=True)
        assert compaction.packed(sizes, 30) == first_fit(sizes, 30)


def brute(rows):
    """(day, lot, piece) of each final file -> (ids in order, cents, sources, rewritten), all by hand. Ids are unique in rows."""
    total, s = len(rows), lambda x: 1 + len(rows) // x
    by_day = defaultdict(list)
    for row in rows:
        by_day[None if row[2] is None else (row[2] - datetime.datetime(1970, 1, 1)).days].append(row)
    out = {}
    for day, own in by_day.items():
        files = defaultdict(list)
        for row in own:
            h = zlib.crc32(str("" if row[0] is None else row[0]).encode())
            files[h // 16 % (1 + len(own) // s(200)), min(h % 4, h // 4 % 4)].append(row)
        for f in files.values():
            f.sort(key=lambda x: (x[2] is not None, x[2] or START, x[0] is not None, x[0] or 0))
        small = sorted((k for k in files if len(files[k]) < s(750)), key=lambda k: (-len(files[k]), k))
        bins = defaultdict(list)
        for k, b in zip(small, first_fit([len(files[k]) for k in small], s(400))[0]):
            bins[b].append(k)
        for members in [*bins.values(), *([k] for k in files if k not in small)]:
            got = [x for k in members for x in files[k]]
            worth = sum(math.floor(100 * x[5] + 0.5) for x in got if x[5] is not None and math.isfinite(x[5]))
            out[day, *members[0]] = ([x[0] for x in got], worth, ",".join(f"{a}-{b}" for a, b in members), len(members) > 1)
    assert sum(len(v[0]) for v in out.values()) == total
    return out


def clicks(n, days, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + datetime.timedelta(days=min(days - 1, int(r.random() ** 3 * days)), seconds=r.randrange(50))
        value = r.choice([None, 1.005, -2.5, float("nan"), float("inf"), r.random() * 50])
        rows.append((i, at, None if i % 97 == 5 else at, i % 7, "k", value, '{"a": 1}'))
    return rows


def check(spark, rows, shape=SHAPE):
    df = spark.createDataFrame(rows, shape)
    got = compaction.compact(spark, df).collect()
    want = brute(rows)
    assert {(g.day, g.lot, g.piece) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        ids, worth, sources, rewritten = want[g.day, g.lot, g.piece]
        listed = ",".join("" if i is None else str(i) for i in ids)
        known = [i for i in ids if i is not None]
        assert (g.n_rows, g.cents, g.sources, g.rewritten, g.min_click_id, g.max_click_id) == (len(ids), worth, sources, rewritten, min(known, default=None), max(known, default=None))
        assert g.ids_sha256 == hashlib.sha256(listed.encode()).hexdigest() and g.columns == ",".join(df.columns)
        file = pq.ParquetFile(g.path.removeprefix("file:"))
        assert file.schema_arrow.names == df.columns and file.read().column("click_id").to_pylist() == ids
    if got:
        folder = Path(got[0].path.removeprefix("file:").split("/compaction-")[0]) / ("compaction-" + got[0].path.split("/compaction-")[1].split("/")[0])
        assert {str(p) for p in folder.rglob("*.parquet")} == {g.path.removeprefix("file:") for g in got}
    return got


def test_against_files_by_hand(spark):
    got = check(spark, clicks(1500, 5, 1))
    assert any(g.rewritten for g in got) and not all(g.rewritten for g in got)


def test_one_day_holds_most(spark):
    rows = clicks(150, 2, 2)
    check(spark, rows + [(1000 + i, START, START, 1, None, 1.0, None) for i in range(400)])


def test_columns_of_clashing_names(spark):
    rows = [(*row, i % 3, "x", None, 5) for i, row in enumerate(clicks(300, 3, 4))]
    got = check(spark, rows, SHAPE + ", day long, Lot string, p_row double, _day int")
    assert "/__day=" in got[0].path


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None)], [(7, START, START, 1, "k", 0.125, None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_rows_that_repeat_and_files_left_alone(spark):
    rows = [(i % 40, START, START + datetime.timedelta(seconds=i % 5), 1, "k", 1.0, None) for i in range(200)] + [(None, None, None, 1, "k", None, "x" * 300_000)]
    df = spark.createDataFrame(rows, SHAPE)
    path = compaction.checkpoint_dir(spark) + "/by-hand"
    folders, total = compaction.write_starting(df, path)
    before = {p: p.read_bytes() for p in Path(path).rglob("*.parquet")}
    plan = compaction.merge(spark, df, path, folders, total).collect()
    alone = {Path(p.path.removeprefix("file:")) for p in plan if p.members == 1}
    after = {p: p.read_bytes() for p in Path(path).rglob("*.parquet")}
    assert alone and all(after[p] == before[p] for p in alone) and set(before) & set(after) == alone
    assert sorted(map(repr, spark.read.parquet(path).select(*df.columns).collect())) == sorted(map(repr, df.collect()))
