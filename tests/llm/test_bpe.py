import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from pagewright.llm import codec, tokcount

ALPHABET = [*"  \n\tabcdefgheinorst.,'!?▁éüß日本語\U0001F600\x00<>|0123 ①ﬁ", "  ", "the ", "ing", "    ", "'ll", " 12", "\r\n"]
FIXED = ["", " ", "a" * 70, "ab" * 50, " the" * 200, "<s></s><unk><0x0A>", "a<|endoftext|>  b", "<|endoftext|><|endoftext|>", "<|endoftext", "I'll don't  x", "▁▁▁a", " " * 33 + "x", " 　", "x" * 5000]


def texts(n, seed):
    r = random.Random(seed)
    return FIXED + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return tokcount.counter(P.path(tokcount.MODEL))


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path(tokcount.MODEL))


@pytest.fixture(scope="module")
def own():
    return codec.codec(P.path(codec.FILE))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(codec.FILE))


def test_counts_match_the_library(counter, sp):
    assert [t for t in texts(1500, 1) if counter.count(t) != len(sp.encode(t))] == []


def test_every_prefix(counter, sp):
    for t in texts(120, 2):
        t = t[:150]
        assert counter.prefix_counts(t).tolist() == [len(sp.encode(t[:i])) for i in range(len(t) + 1)], t


def test_budgets(counter, sp):
    for t in texts(60, 3):
        for limit in (1, 3, 10):
            n, kept = counter.fitting(t, limit)
            assert n == len(sp.encode(t))
            if n <= limit:
                assert kept == len(t)
            else:  # no prefix up to this one is over, and one more character is
                counts = counter.prefix_counts(t)
                assert counts[: kept + 1].max() <= limit < counts[kept + 1]


def test_ids_match_the_library(own, library):
    bad = [t for t in texts(1500, 4) if own.encode(t) != library.encode(t, add_special_tokens=False).ids]
    assert bad == []


def test_decoding_matches_the_library(own, library):
    for t in texts(300, 5):
        ids = own.encode(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    r = random.Random(6)
    for _ in range(200):  # any ids, also those that give broken UTF-8
        ids = [r.randrange(50257) for _ in range(r.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_backtracking_equals_merging(own):
    r = random.Random(7)
    merges = own.encoder.merges
    for _ in range(400):
        word = "".join(r.choice("etaoinshrdlu xyzq\xc3\xa9") for _ in range(r.randrange(1, 14)))
        assert own.encoder.encode(word) == merges.merge_all(word)


ROWS = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, None), (None, "", "y"), (3, "a " * 6000, "z")]


def test_count_table(spark, sp):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    out = tokcount.count_tokens(df, P.path(tokcount.MODEL)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        text = next((t for d, t, _ in ROWS if d == r.doc_id), "") or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(sp.encode(text)), len(sp.encode(text)) > 4096)
    assert tokcount.count_tokens(df.limit(0), P.path(tokcount.MODEL)).count() == 0


def test_codec_table(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    for r in codec.round_trip(df, P.path(codec.FILE)).collect():
        text = next((t for d, t, _ in ROWS if d == r.doc_id), "") or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert codec.round_trip(df.limit(0), P.path(codec.FILE)).count() == 0


def test_very_long_texts(own, library, counter, sp):
    """Millions of characters, with and without white space; long words aren't kept in the memo."""
    for t in ("ab1é" * 500_000, "some words here, and there. " * 60_000):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    t = "some words here, and there. " * 60_000
    assert counter.count(t) == len(sp.encode(t))
    t = "xq" * 20_000
    assert counter.count(t) == len(sp.encode(t))
    assert max(map(len, [*own.words, *own.words.old, *counter.size, *counter.size.old])) <= 256


def test_encoded_corpus(spark, library):
    """The corpus with its token ids, other columns as they are; a null text has no tokens."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = codec.encode_documents(df, P.path(codec.FILE)).collect()
    assert len(out) == len(ROWS) and out[0].__fields__ == ["doc_id", "text", "source", "ids"]
    for r in out:
        assert list(r.ids) == (library.encode(r.text, add_special_tokens=False).ids if r.text else [])
