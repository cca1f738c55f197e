import random
import re
from collections import Counter, defaultdict

from pagewright.llm import divergence

SHAPE = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    df, count, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        df.update((key[0], w) for w in set(found))
        count[key].update(found)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), n in df.items() if g == lang and n >= 3]
        own = sorted(s for g, s in groups if g == lang)

        def p_of(counts):
            n = sum(counts[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (counts[w] + 1) // (n + len(kept)) for w in kept}

        p = {s: p_of(count[lang, s]) for s in own}
        q = p_of(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in own if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, i + 1) for i, (w, v) in enumerate(items) if part == "pair" or i < 200]
    return sorted(out)


def check(spark, rows, shape=SHAPE):
    got = divergence.audit(spark, spark.createDataFrame(rows, shape))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


def sample(n, sources, seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Wo", "é", "ß", "zz", "ſ") for b in map(lambda i: "abcdefghij"[i % 10] * (i // 10 + 1), range(60))]
    rows = []
    for i in range(n):
        words = [r.choice(vocab[: 20 + 14 * r.randrange(20)]) for _ in range(r.choice([0, 1, 3, 40, 200]))]
        rows.append((i, r.choice([" ", "-", "1", "[", "\x7f"]).join(words), r.choice(["en", "de", None, ""]), r.choice([None, *(f"s{j}" for j in range(sources)), "s0", "s0", "s0"])))
    return rows


def test_against_counts_by_hand(spark):
    check(spark, sample(400, 6, 1))


def test_blocks_tiles_and_long_texts(spark, monkeypatch):
    rows = sample(150, 9, 2) + [(900, "Lang " * 300_000 + "x" * 200_000, "en", "s1")] * 3
    want = check(spark, rows)
    assert ("en", "s1", "term", "lang") in {w[:4] for w in want}
    monkeypatch.setattr(divergence, "PAIRS", 7)  # all runs are dealt out in tiles
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [])
    check(spark, [(None, None, None, None)])
    check(spark, [(1, None, "en", "a"), (2, "", "en", "b"), (3, "!! 12", "en", None), (4, "one two", "de", "a")])
    check(spark, [(1, "same words here", "en", "a")] * 4 + [(1, "same words here", "en", "b")] * 4)  # ties
    rows = [(*row, 7, "q") for row in sample(40, 2, 5)]
    check(spark, rows, SHAPE + ", n long, p string")
