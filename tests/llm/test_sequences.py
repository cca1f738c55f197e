import itertools
import random
import zlib

import numpy as np
import pytest

from pagewright.llm import crf, langid, toxicity, words

SYLLABLES = {"aa": ["th", "er", "ing", "wh", "on"], "bb": ["sch", "keit", "un", "ü", "ge"], "cc": ["ción", "os", "ll", "ñ", "qu"]}


def text(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) + r.choice(["", "", ".", ","]) for _ in range(n))


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    model = crf.Model(["x", "y", "z"], np.zeros((crf.EMPTY + 1, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([2, 5, 1, 4])
    potential = rng.normal(size=(lengths.sum(), 3)) * 2
    got, log_z = crf.forward_backward(model, potential, lengths)
    for n, end, z in zip(lengths, np.cumsum(lengths), log_z):
        e, total, sums = potential[end - n : end], 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            score = model.start[path[0]] + sum(e[t, k] for t, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(score)
            for t, k in enumerate(path):
                sums[t, k] += np.exp(score)
        assert np.allclose(got[end - n : end], sums / total) and np.isclose(z, np.log(total))


def test_table_survives_trimming():
    rng = np.random.default_rng(2)
    model = crf.Model(["x", "y"], rng.normal(size=(crf.EMPTY + 1, 2)).astype(np.float32), np.zeros((2, 2)), np.zeros(2), {"w7": 1})
    model.weights[crf.EMPTY] = 0
    table = crf.WordTable(model, words.word_of, cap=40)
    r = random.Random(3)
    for _ in range(30):
        tokens = list({f"w{'abcdefg'[r.randrange(7)]}{'hijklmn'[r.randrange(7)] * r.randrange(1, 60)}" for _ in range(25)} | {"12", "!"})
        rows = table.lookup(tokens, np.ones(len(tokens), dtype=np.int64))
        want = crf.potentials(model, [words.word_of(t) or "q" for t in tokens])
        for t, row, w in zip(tokens, rows, want):
            assert row == -2 if not words.word_of(t) else np.allclose(table.log[row], w, atol=1e-4)
        table.trim()


def test_tokens_and_spans_agree():
    for t in ["", " a  b\n", "x" * 130 + " y", "　é\t"]:
        assert [t[a:b] for a, b in words.token_spans(t)] == words.tokens_of(t)


@pytest.fixture(scope="module")
def language():
    r = random.Random(4)
    return langid.fit([(lang, [w for t in text(lang, 60, r).split() if (w := words.word_of(t))]) for lang in SYLLABLES for _ in range(80)])


def test_languages(language):
    r = random.Random(5)
    table = crf.WordTable(language, words.word_of)
    held = [(lang, text(lang, r.randint(3, 300), r)) for lang in SYLLABLES for _ in range(30)]
    got = langid.label_texts(table, [t for _, t in held])
    assert sum(g[0] == lang for g, (lang, _) in zip(got, held)) >= 88
    assert all(0 <= g[1] <= 1 for g in got)
    assert langid.label_texts(table, [None, "", "12 !! 34", " \n"]) == [("und", 0.0, 0, 0)] * 4


def test_code_switching(language):
    r = random.Random(6)
    table = crf.WordTable(language, words.word_of)
    mixed = text("aa", 30, r) + " " + text("bb", 30, r)
    found = langid.spans(table, mixed)
    assert {f[2] for f in found} >= {"aa", "bb"} and found[0][0] == 0 and found[-1][1] == len(mixed)
    edge = len(mixed.split()[0]) and mixed.index(mixed.split()[30])
    right = sum(b - a for a, b, k in found if (k == "aa" and b <= edge + 12) or (k == "bb" and a >= edge - 12))
    assert right > 0.9 * len(mixed)


def _documents(n, seed=7):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        toxic = int(r.random() < 0.25)
        own = text(lang, r.randint(20, 90), r).split()
        for _ in range(3 * toxic):
            own.insert(r.randrange(len(own)), r.choice(["Dolt", "vexo" + r.choice(["s", "ra", "mi", "ta"]), "grub."]))
        out.append((i, " ".join(own), lang, toxic))
    return out


def test_language_table(spark):
    docs = _documents(240)
    rows = [(i, t, lang if i % 9 else None, 1) for i, t, lang, _ in docs] + [(None, None, None, 2), (900, "", "aa", 3), (3, docs[3][1], docs[3][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = langid.identify(spark, df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {i: lang for i, _, lang, _ in docs}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert [r.lang_pred for r in out if r.doc_id in (None, 900)] == ["und", "und"]
    assert langid.identify(spark, df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).where("lang is null")
    assert {r.lang_pred for r in langid.identify(spark, unlabelled).collect()} == {"und"}


def test_held_out_labels_are_not_learned(spark):
    """Labels of held-out rows may be anything: predictions don't change."""
    docs = _documents(200, 8)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in docs], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(i, t, "zz" if held(i) else lang) for i, t, lang, _ in docs], "doc_id long, text string, lang string")
    view = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(spark, df).collect())
    assert view(a) == view(b)


def test_toxicity_table(spark):
    docs = _documents(500, 9)
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in docs] + [(None, None, 0.1), (901, "", 0.1), (2, docs[2][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in docs] + [(901, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.detect(spark, df, labels).collect()
    assert len(out) == 503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: y for i, _, _, y in docs}
    texts = {i: t for i, t, _, _ in docs}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    spans = [texts[r.doc_id][a:b].lower() for r in held if truth[r.doc_id] for a, b in zip(r.span_starts, r.span_ends)]
    assert spans and sum(s.startswith(("dolt", "vexo", "grub")) for s in spans) >= 0.9 * len(spans)
    assert [r.predicted for r in out if r.doc_id in (None, 901)] == [0, 0]
    assert toxicity.detect(spark, df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.detect(spark, df, labels.limit(0)).collect()} == {0.0}


def paths(model, tokens):
    """(weight, labels) of every labelling of words."""
    e = [crf.potentials(model, [w])[0].astype(float) for w in tokens]
    for path in itertools.product(range(len(model.labels)), repeat=len(tokens)):
        yield np.exp(model.start[path[0]] + sum(e[t][k] for t, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:]))), path


def test_language_by_enumeration(language):
    r = random.Random(10)
    table = crf.WordTable(language, words.word_of)
    for _ in range(20):
        t = text(r.choice(list(SYLLABLES)), r.randint(1, 3), r) + " " + text(r.choice(list(SYLLABLES)), r.randint(1, 3), r)
        tokens = words.words_of(t)
        shares, total = np.zeros(len(language.labels)), 0.0
        for w, path in paths(language, tokens):
            total += w
            shares += w * np.bincount(path, minlength=len(shares)) / len(tokens)
        got = langid.label_texts(table, [t])[0]
        assert got[0] == language.labels[int(shares.argmax())] and np.isclose(got[1], shares.max() / total, atol=1e-4) and got[2] == len(tokens)


def test_toxicity_by_enumeration():
    model = toxicity.fit([(y, words.words_of(t)) for _, t, _, y in _documents(300, 11)])
    table = crf.WordTable(model, words.word_of)
    r = random.Random(12)
    for _ in range(30):
        t = " ".join(r.choice(["Dolt,", "vexora", "vexomi", "then 12", "schun", "grub.", text("aa", 1, r)]) for _ in range(r.randint(1, 6)))
        tokens = words.words_of(t)
        clean, total, marks = 0.0, 0.0, np.zeros(len(tokens))
        for w, path in paths(model, tokens):
            total += w
            clean += w * (not any(path))
            marks += w * np.array(path)
        score, spans = toxicity.score_texts(table, [t])[0]
        assert np.isclose(score, 1 - clean / total, atol=1e-4)
        places = [p for p in words.token_spans(t) if words.word_of(t[slice(*p)])]
        sure = np.abs(marks / total - 0.5) > 1e-3
        assert {p for p, m, s in zip(places, marks / total >= 0.5, sure) if m and s} <= set(spans) <= {p for p, m, s in zip(places, marks / total >= 0.5, sure) if m or not s}


def test_expected_counts_by_enumeration():
    """What training takes from chains: marginals, pairs, first words and the chance of the all-clean path."""
    rng = np.random.default_rng(13)
    odds, start, trans = rng.normal(size=(3, 5)), rng.normal(size=2), rng.normal(size=(2, 2))
    real = np.arange(5) < np.array([[5], [3], [1]])
    toxic, pairs, first, clean = toxicity._expected(odds, real, start, trans)
    for i in range(3):
        total, m, p = 0.0, np.zeros(5), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=5):
            if any(k and not ok for k, ok in zip(path, real[i])):
                continue
            w = np.exp(start[path[0]] + sum(o for o, k in zip(odds[i], path) if k) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            m += w * np.array(path)
            for a, b in zip(path, path[1:]):
                p[a, b] += w
        assert np.allclose(toxic[i], m / total) and np.allclose(pairs[i], p / total) and np.allclose(first[i], [1 - m[0] / total, m[0] / total])
        assert np.isclose(clean[i], np.log(np.exp(start[0] + 4 * trans[0, 0]) / total))


def test_long_words_are_summed_stretch_by_stretch(monkeypatch):
    rng = np.random.default_rng(14)
    model = crf.Model(["x", "y"], rng.normal(size=(crf.EMPTY + 1, 2)).astype(np.float32), np.zeros((2, 2)), np.zeros(2), {"ab" * 40: 1})
    model.weights[crf.EMPTY] = 0
    some = ["a", "ab" * 40, "c" * 63, "é" * 64, "abcdefghi" * 30]
    whole = crf.potentials(model, some)
    monkeypatch.setattr(crf, "LONG", 7)
    assert np.allclose(crf.potentials(model, some), whole, atol=1e-3)


def test_one_word_of_millions_of_letters(spark, language):
    long = "sch" * 1_000_000
    table = crf.WordTable(language, words.word_of)
    assert langid.label_texts(table, [long])[0][:1] + langid.label_texts(table, [long])[0][2:] == ("bb", 1, 0)
    assert langid.label_texts(table, [long + " " + text("aa", 200, random.Random(1))])[0][0] == "aa"  # one word, one vote
    table.trim()
    assert max(map(len, table.index)) < crf.LONG
    model = toxicity.fit([(y, words.words_of(t)) for _, t, _, y in _documents(200, 15)])
    table = crf.WordTable(model, words.word_of)
    (clean, none), (bad, spans) = toxicity.score_texts(table, [long, long + " vexora " + text("aa", 50_000, random.Random(2))])
    assert clean < 0.3 and not none and bad >= 0.3 and (len(long) + 1, len(long) + 7) in spans


@pytest.mark.parametrize(("sf", "recall", "false"), [("sf0.01", 0.9, 0.02), ("sf0.1", 0.9, 0.02)])
def test_held_out_toxicity_of_the_given_tables(spark, sf, recall, false):
    read = lambda name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    truth = {r.doc_id: r.toxic for r in read("labels").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in toxicity.detect(spark, read("documents"), read("labels")).where("held_out").collect() if r.doc_id in truth]
    assert sum(p for y, p in held if y) >= recall * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= false * sum(1 - y for y, _ in held)


def test_held_out_languages_of_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    held = [r for r in langid.identify(spark, docs).where("held_out").collect() if r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_number_signs_are_no_letters(language):
    table = crf.WordTable(language, words.word_of)
    for t in ["½ ²", "Ⅷ ①", "12 ٣", "_ - !"]:
        assert words.words_of(t) == [] and langid.label_texts(table, [t])[0][:2] == ("und", 0.0)
    assert words.word_of("x²y½z") == "xyz"


def test_long_words_have_the_features_of_short_ones(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (1, 3, 8, 9, 1023, 1024, 1025, 5000, 70_000)]
    got = crf.affixes(texts)
    monkeypatch.setattr(crf, "LONG", 10**9)
    assert (crf.affixes(texts) == got).all()
    model = toxicity.fit([(y, [w] * 3 + ["ok"]) for y, w in [(1, "x" * 5000 + "bad"), (0, "x" * 5000 + "fine")] * 30])
    table = crf.WordTable(model, words.word_of)
    scores = [s for s, _ in toxicity.score_texts(table, ["ok " + "x" * 5000 + "bad", "ok " + "x" * 5000 + "fine"])]
    assert scores[0] > 0.9 > 0.1 > scores[1]
