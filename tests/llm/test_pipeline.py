"""The pipeline stage by stage on a given table, each held against brute force over its own input."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from pagewright.llm import codec, langid, mixing, neardup
from pagewright.llm.common import table, written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs = table(spark, SF, "documents")
    out = [("documents", docs.collect(), docs.columns)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.collect(), docs.columns))
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_stages_in_order(results):
    assert [n for n, _, _ in results] == ["documents", "toxicity", "language", "near_copies", "mix", "encode"]
    columns = results[0][2]
    assert all(c == columns for _, _, c in results[:5]) and results[5][2][: len(columns)] == columns


def test_filters_keep_rows_as_they_are(results):
    for (_, before, _), (name, after, _) in zip(results[:4], results[1:4]):
        have = by_id(before)
        assert after and all(have[r.doc_id] == r for r in after), name
        assert len(after) >= 0.7 * len(before), name


def test_toxic_documents_go(spark, results):
    words = {"idiot", "moron", "scum", "clown", "pathetic", "worthless", "loser", "disgusting", "trash", "stupid"}
    gone = set(by_id(results[0][1])) - set(by_id(results[1][1]))
    bad = {r.doc_id for r in results[0][1] if len(words & {w.strip(".,").lower() for w in r.text.split()}) >= 2}
    assert len(bad - gone) <= 0.1 * len(bad)
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    clean = [d for d, y in labels.items() if y == 0]
    assert sum(d in gone for d in clean) <= 0.02 * len(clean)


def test_near_copies_go(results):
    from test_neardup import brute

    before, after = results[2][1], results[3][1]
    want = {d for d, (_, c) in brute([(r.doc_id, r.text) for r in before]).items() if d == c}
    assert {r.doc_id for r in after} == want


def test_mixing_keeps_all(results):
    assert sorted(r.doc_id for r in results[3][1]) == sorted(r.doc_id for r in results[4][1])


def test_encoding(results):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(codec.FILE))
    for r in results[5][1]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_run_equals_the_stages(spark, results):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, results[-1][1]))


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", 0), (None, "some words here, and there", None, None, 1), (3, "", "en", "a", 0), (4, "plain words in a row here", "en", "b", 5), (5, "plain words in a row here", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-odd")
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 4]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF), "test-empty")
    assert empty.count() == 0
    assert langid.LEAST_SCORE < 0.5 and neardup.NUMERATOR == 75


def test_clashing_columns(spark):
    """Columns of the operators' own names go through untouched; those named like a digest give way to it at the end."""
    rows = [(1, "plain words in a row here", "en", "b", 5, "z", 7, "r", 3.5, [2]), (2, "some other words, and there", None, None, 1, "y", 6, "q", 2.5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, mix_slot int, `odd name` string, predicted double, n_tokens array<int>")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-clash")
        assert docs.columns == columns + ([] if name != "encode" else ["ids_sha256", "decoded_sha256"])
        if name != "encode":
            assert sorted(map(tuple, docs.collect())) == sorted(rows)


def test_rows_come_in_the_order_of_the_mix(spark, tmp_path):
    """Also where the mix was written as several files, of which the later ones are larger and read first."""
    rows = [(i, f"plain words in a row {i} " * (1 + i % 40), "en", f"s{i % 3 if i % 5 else 0}", 1) for i in range(3000)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "test-order")
    stages = dict(corpus_pipeline.STAGES)
    slots = {r.doc_id: (r.mix_slot, r.mix_rank) for r in mixing.scheduled(docs).collect()}
    mixed = written(stages["mix"](spark, docs, SF), "test-order-mix")
    out = stages["encode"](spark, mixed, SF)
    assert [r.doc_id for r in out.select("doc_id").collect()] == sorted(slots, key=slots.get)


def test_run_comes_in_the_order_of_the_mix(spark):
    got = corpus_pipeline.run(spark, SF)
    slots = {r.doc_id: (r.mix_slot, r.mix_rank) for r in mixing.scheduled(got.select("doc_id", "source")).collect()}
    assert [r.doc_id for r in got.select("doc_id").collect()] == sorted(slots, key=slots.get)
