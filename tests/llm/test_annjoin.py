import numpy as np
from pyspark.sql import types as T

from pagewright.llm import annjoin

KIND = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(rows, k=5, stride=50):
    """query -> [(row, cosine)] over all pairs, in double precision."""
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, {})[tuple(v)] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in good:
        if q % stride:
            continue
        found = []
        for i, vs in good.items():
            best = [float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) for a in good[q].values() for b in vs.values() if len(a) == len(b)]
            if i != q and best:
                found.append((-max(best), i))
        if found:
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def check(spark, rows, **options):
    got = {}
    for r in annjoin.nearest(spark.createDataFrame(rows, KIND), **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, options.get("k", 5), options.get("stride", 50))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [i for _, i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, _, s in found], [s for _, s in want[q]], rtol=0, atol=1e-15)


def test_against_all_pairs(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(900, 12)).astype(np.float32)
    base[100:160] = base[7]  # ties
    base[300:330] = -base[50]
    rows = [(int(i), v.tolist(), "x") for i, v in enumerate(base)]
    check(spark, rows)
    check(spark, rows, k=1, stride=100)


def test_blocks_don_t_matter(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(int(i), v.tolist(), "x") for i, v in enumerate(r.normal(size=(600, 5)).astype(np.float32))]
    monkeypatch.setattr(annjoin, "QUERY_BLOCK", 3)
    monkeypatch.setattr(annjoin, "ROW_BLOCK", 70)
    monkeypatch.setattr(annjoin, "STEP", 2)
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (50, [0.0, 0.0], "a"), (100, None, "a"), (1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [nan, 1.0], "a"), (3, [inf, 1.0], "a"), (4, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (5, [1.0, 2.0, 3.0], "a"), (6, [-1e30, -2e30], "a"), (150, [3.0, 1.0, 2.0], "a"), (200, [1e-30, 1e-30], "a"), (250, [1.0], "a"), (7, [], "a")]
    check(spark, rows)
    assert annjoin.nearest(spark.createDataFrame([], KIND)).count() == 0
    assert annjoin.nearest(spark.createDataFrame([(0, [1.0], "a")], KIND)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(3)
    x, y = (annjoin._units(r.normal(size=(200, 33)) * 10.0 ** r.integers(-6, 6, (200, 1))) for _ in range(2))
    (a, s, g), (b, t, h) = annjoin.quantised(x), annjoin.quantised(y)
    rough = (a.astype(float) @ b.T.astype(float)) * s[:, None] * t[None]
    assert (np.abs(rough - x @ y.T) <= g[:, None] + h[None] + g[:, None] * h[None] + 1e-12).all()


def test_ids_of_many_vectors_take_one_place(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=8)
    rows = [(0, base.astype(np.float32).tolist(), "x")]
    rows += [(1 + i % 2, (base + r.normal(size=8) * 0.01).astype(np.float32).tolist(), "x") for i in range(40)]  # two ids take all near places
    rows += [(10 + i, v.tolist(), "x") for i, v in enumerate(r.normal(size=(30, 8)).astype(np.float32))]
    check(spark, rows)


def test_magnitudes_of_any_size(spark):
    """Squares of these numbers overflow or vanish; their cosines don't."""
    r = np.random.default_rng(11)
    base = r.normal(size=(40, 6))
    scale = 10.0 ** r.choice([-300, -200, 0, 200, 300], size=40)
    rows = [(i * 10, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, scale))]
    got = annjoin.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 * 5
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for x in got:
        cosine = unit @ unit[x.query_id // 10]
        cosine[x.query_id // 10] = -2
        assert x.vec_id == 10 * int(np.argsort(-cosine)[x["rank"] - 1]) and np.isclose(x.score, cosine[x.vec_id // 10], rtol=1e-9)


def test_merging_several_queries_at_once(spark, monkeypatch):
    r = np.random.default_rng(12)
    df = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, annjoin.nearest(df, stride=7).collect()))
    monkeypatch.setattr(annjoin, "MERGED", 3)
    assert sorted(map(tuple, annjoin.nearest(df, stride=7).collect())) == want
