import datetime
import random
import uuid

from pagewright.operators.crawl import shared_folder
from pagewright.streaming import states

START = datetime.datetime(2024, 3, 1)


def operations(seed, n=300, keys=5):
    r = random.Random(seed)
    at = sorted(START + datetime.timedelta(minutes=r.randrange(60 * 48)) for _ in range(n))
    return [(r.choice([0, 0, 0, r.randrange(keys)]), t, i, r.random() < 0.3, i) for i, t in enumerate(at)]


def by_hand(rows, hours):
    seen, out = {}, []
    for key, at, number, write, content in rows:
        if write:
            seen[key] = (at, content)
        else:
            hit = key in seen and seen[key][0] > at - datetime.timedelta(hours=hours)
            out.append((key, number, hit, seen[key][1] if hit else None))
    return sorted(out)


def test_cache_is_the_same_however_the_stream_is_cut(spark):
    rows = operations(1)
    df = spark.createDataFrame(rows, "key long, at timestamp, number long, write boolean, content long")
    for parts in (1, 4):
        got = states.replayed(df, lambda s: states.cache_reads(s, "3 hours"), f"{shared_folder(spark)}/{uuid.uuid4().hex}", "at", parts)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, 3)
    empty = states.replayed(df.limit(0), lambda s: states.cache_reads(s), f"{shared_folder(spark)}/{uuid.uuid4().hex}", "at", 1)
    assert empty.collect() == []


def test_state_expires_and_a_restart_goes_on(spark):
    """After a day without writes no key has state; the query is started anew for each file."""
    folder, held = f"{shared_folder(spark)}/{uuid.uuid4().hex}", []
    shape = "key long, at timestamp, number long, write boolean, content long"
    spark.createDataFrame([], shape).write.parquet(f"{folder}/in")
    day = lambda d, h=0: START + datetime.timedelta(days=d, hours=h)
    files = [[(k, day(0), k, True, k) for k in range(20)], [(0, day(0, 2), 20, False, None), (0, day(2), 21, False, None)], [(1, day(3), 22, False, None)]]
    with states.timers_store(spark):
        for rows in files:
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = states.cache_reads(spark.readStream.schema(shape).parquet(f"{folder}/in"), "24 hours")
            q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            held.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = {r.number: (r.hit, r.content) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {20: (True, 0), 21: (False, None), 22: (False, None)}
    assert held[0] > 0 and held[-1] == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != states.STORE


def test_runs_end_by_completion_or_idleness(spark):
    m = lambda n: START + datetime.timedelta(minutes=n)
    rows = [(1, m(0), 0, 3, 0), (1, m(1), 1, 0, 2), (1, m(2), 2, 0, 1), (2, m(0), 3, 2, 1), (3, m(0), 4, 1, 0), (3, m(9), 5, 0, 1), (1, m(400), 6, 1, 0), (4, m(500), 7, 5, 1)]
    df = spark.createDataFrame(rows, "run long, at timestamp, number long, found int, finished int")
    got = states.replayed(df, lambda s: states.run_ends(s, "30 minutes"), f"{shared_folder(spark)}/{uuid.uuid4().hex}", "at", 2)
    us = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert sorted(map(tuple, got.collect())) == [(1, us(m(2)), "done", 3), (1, us(m(430)), "idle", 0), (2, us(m(30)), "idle", 1), (3, us(m(9)), "done", 1)]
