import random
import re

import numpy as np

from pagewright.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(zip(words, words[1:], words[2:], words[3:], words[4:]))


def brute(rows):
    """doc_id -> (set size, component), all pairs compared."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets}


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute(rows).items()}
    assert got == want


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


def edited(r, base, edits):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = "".join(r.choice("xyz") for _ in range(5))
    return out


def test_shingles_are_the_contracts():
    for t in [None, "", "  ", "A", "a b c d", "a b c d e", "É é\x0bz\x1cq A B c d e", "one two three four five six one two three four five six", " x y z"]:
        assert len(neardup.shingles(t)) == len(shingle_set(t))
    assert (neardup.shingles("A b C d") == neardup.shingles(" a  B c D")).all() and (neardup.shingles("a b c") != neardup.shingles("a b d")).all()


def test_against_all_pairs(spark):
    r = random.Random(1)
    rows, k = [], 0
    shared = words(r, 60)
    for _ in range(40):
        base = words(r, r.randint(6, 140))
        for _ in range(r.randint(1, 6)):
            own = edited(r, base, r.randint(0, max(1, len(base) // 24)))
            rows.append((k * 37 % 997, " ".join(own if r.random() < 0.8 else own + shared)))
            k += 1
    rows += [(2000, ""), (2001, "  "), (2002, "a b"), (2003, "A  B"), (2004, "a b c"), (2005, " ".join(words(r, 3000)))]
    rows.append((2006, rows[-1][1].upper()))
    check(spark, rows)


def test_one_large_group_around_a_hub(spark):
    """Copies that are near their original but hardly near one another, and the original isn't the first."""
    r = random.Random(2)
    base = words(r, 200)
    rows = [(i, " ".join(edited(r, base, 4))) for i in range(150)] + [(500, " ".join(base))] + [(600 + i, " ".join(words(r, 50))) for i in range(20)]
    check(spark, rows)


def test_chains_and_thresholds(spark):
    r = random.Random(3)
    base = words(r, 104)  # 100 shingles
    rows = []
    for i in range(12):  # each drops the first words and gains as many at the end
        rows.append((i, " ".join(base[i * 7 :] + words(random.Random(9), 200)[: i * 7])))
    at = words(r, 29)  # 25 shingles: with 75 of 100 alike a pair is linked, with 74 not
    whole = words(r, 79)
    rows += [(50, " ".join(whole)), (51, " ".join(whole + at[:25])), (52, " ".join(whole + at[:26]))]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1, "x"), (1, None, 1, "x"), (1, None, 1, "x"), (4, "a b c d e f", 2, "y"), (4, "a b c d e f", 2, "y"), (3, "a b c d e f", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, fp string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in neardup.components(spark, df).collect())
    assert got == [(-1, 2, None, True), (1, 0, 1, True), (1, 0, 1, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)]
    assert neardup.components(spark, df.limit(0)).count() == 0


def test_intersections():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 40, r.integers(0, 30)).astype(np.uint64)) for _ in range(2))
        assert neardup.intersection(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_crowded_regions_are_compared_whole(spark, monkeypatch):
    """Pages of one template, alike to 0.72 and so not linked, share most regions; some pairs of them are alike to 0.79."""
    r = random.Random(5)
    base = words(r, 204)  # 200 shingles
    rows = []
    for i in range(240):
        own = words(r, 38)
        rows.append((i * 7 % 1009, " ".join(base + own)))
        if i % 4 == 0:
            rows.append((2000 + i, " ".join(base + own[:12] + words(r, 26))))
    assert sum(d != c for d, (_, c) in brute(rows).items()) == 60
    check(spark, rows)
    monkeypatch.setattr(neardup, "SIDE", 40)
    check(spark, rows)


def test_long_chain_is_one_component(spark):
    """Revisions that are linked to the next one only, with ids in no order."""
    r = random.Random(6)
    stream = words(r, 104 + 300 * 10)
    ids = r.sample(range(5000), 300)
    check(spark, [(d, " ".join(stream[i * 10 : i * 10 + 104])) for i, d in enumerate(ids)])


def test_ids_with_several_texts(spark):
    """Rows of one id are one document: its texts' groups are one. The pipeline goes by text, so that no text is lost."""
    t, u = "one two three four five six seven", "red green blue white black grey pink"
    df = spark.createDataFrame([(3, t), (5, t), (5, u), (7, u), (7, u), (9, "a lone text of some seven words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.components(spark, df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False), (9, 9, True)]
    assert sorted(map(tuple, neardup.dropped_copies(spark, df).collect())) == [(3, t), (5, u), (9, "a lone text of some seven words")]


def test_repeated_rows_leave_one(spark):
    """Also where other columns differ, and where columns have the operator's names."""
    t = "one two three four five six seven"
    df = spark.createDataFrame([(3, t, "a", 1), (3, t, "a", 1), (3, t.upper(), "b", 2), (4, None, "c", 3), (None, t, "d", 4)], "doc_id long, text string, text_hash string, row int")
    got = neardup.dropped_copies(spark, df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect()) == [(0, t), (3, t), (4, "")]


def test_links_in_a_crowd(spark):
    """Documents that share 86 of 104 words, alike to 0.69, with 150 pairs that share 4 words more and are alike to 0.754."""
    r = random.Random(8)
    base = words(r, 86)
    rows = [(i, " ".join(base + words(r, 18))) for i in range(600)]
    for i in range(150):
        own = words(r, 4)
        rows += [(1000 + 2 * i + k, " ".join(base + own + words(r, 14))) for k in range(2)]
    got = {r.doc_id: r.component_id for r in neardup.components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: c for d, c in got.items() if d != c} == {1001 + 2 * i: 1000 + 2 * i for i in range(150)}


def test_neighbours_in_every_order(spark, monkeypatch):
    """Whatever the partitions: rows of regions with several sets, and of those that share a partition the depth in common."""
    r = np.random.default_rng(7)
    sigs = r.integers(0, 3, (200, neardup.TREES, neardup.BASE)).astype(np.uint32)
    rows = [(int(h), int(d), i) for i, s in enumerate(sigs) for h, d in zip(neardup.region_keys(s), neardup.deeper_keys(s))]
    size = {}
    for h, _, _ in rows:
        size[h] = size.get(h, 0) + 1
    want = {(h, i) for h, _, i in rows if size[h] > 1}
    flat = sigs.reshape(200, -1)
    for n in (1, 7):
        got = neardup.neighbours(spark.createDataFrame(rows, "head long, deep long, id long").repartition(n)).collect()
        assert want <= {(x.head, x.id) for x in got}
        assert len(got) <= len(want) + 2 * 8
        met = [x for x in got if x.prev is not None]
        assert len(met) > 0.8 * len(want) / 2
        for x in met:
            tree = next(t for t in range(neardup.TREES) if neardup.region_keys(sigs[x.id])[t] == x.head)
            a, b = (np.roll(flat[i], -tree * neardup.BASE)[: neardup.BASE + neardup.DEEPER] for i in (x.id, x.prev))
            assert x.depth == (len(a) if (a == b).all() else int((a != b).argmax()))


def test_a_very_long_text_without_white_space(spark):
    long = "x" * 3_000_000
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "y"), (4, " ".join(words(random.Random(9), 200_000)))], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.components(spark, df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4)]
