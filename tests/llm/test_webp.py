import hashlib
import math
import sysconfig
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pagewright.llm import media, webp

RNG = np.random.default_rng(5)


def picture(height, width, colours=None):
    """Flat areas, a gradient and noise."""
    y, x = np.mgrid[:height, :width]
    base = np.stack([255 - (x * 3) % 7, (x * 5 + y) % 256, (y * 9) % 256, (x // 4 + y // 3) * 17 % 256], axis=-1)
    base[height // 2 :, : width // 2] = RNG.integers(0, 256, (height - height // 2, width // 2, 4))
    base[: height // 3] = (255, 10, 20, 30)
    if colours:
        table = RNG.integers(0, 256, (colours, 4))
        base = table[(x // 2 * 7 + y * 3) % colours]
    return base.astype(np.uint8)


@pytest.mark.parametrize("sides", [(1, 1), (1, 40), (17, 9), (33, 64)])
@pytest.mark.parametrize("options", [{}, {"copies": False}, {"cache_bits": 1}, {"cache_bits": 6}, {"cache_bits": 11, "copies": False}, {"subtract_green": True}, {"group_bits": 2}, {"group_bits": 4, "cache_bits": 3}])
def test_round_trip(sides, options):
    image = picture(*sides)
    assert (webp.decode(webp.encode(image, **options)) == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    image = picture(21, 19)
    blocks = np.full((webp._rounded(21, 2), webp._rounded(19, 2)), mode)
    assert (webp.decode(webp.encode(image, predictor=(2, blocks))) == image).all()


def test_all_transforms_together():
    image = picture(30, 45)
    modes = RNG.integers(0, 14, (webp._rounded(30, 3), webp._rounded(45, 3)))
    elements = RNG.integers(0, 256, (webp._rounded(30, 4), webp._rounded(45, 4), 4))
    made = webp.encode(image, predictor=(3, modes), cross=(4, elements), subtract_green=True, cache_bits=5, group_bits=3)
    assert (webp.decode(made) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    image = picture(13, 37, colours)
    assert (webp.decode(webp.encode(image, palette=True)) == image).all()


def test_a_stream_of_another_encoder():
    """The transparency of an image that Python's own tests ship: a lossless stream without a header."""
    found = [p for p in (Path(sysconfig.get_paths()["stdlib"]) / f"test/{d}/python.webp" for d in ("test_email/data", "imghdrdata")) if p.exists()]
    found += list(Path("/root/.pyenv/versions").glob("*/lib/python3*/test/*/python.webp"))
    if not found:
        pytest.skip("no such file here")
    data = found[0].read_bytes()
    at = data.index(b"ALPH")
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    alpha = webp.decode_stream(webp.Window(data[at + 9 : at + 8 + size]), 16, 16)[..., 2]
    assert alpha[0].tolist() == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert alpha[15].tolist() == [0, 0, 0, 0, 8, 29, 53, 66, 71, 69, 56, 31, 8, 0, 0, 0]


PAYLOADS = [None, "", "a", "x" * 64, "é" * 999, "ab" * 70_000, "\x00\x01", "tie", "tie", "".join(map(chr, range(1, 2000))), "one two three four " * 400, "0123456789" * 30]


def test_payloads():
    """Read back in step, and alone, and by the plain decoder: always the bytes of the text."""
    stored = media.store(PAYLOADS)
    back = media.load([s for s, *_ in stored], [n for _, _, n, _ in stored])
    for text, (file, raw, size, form), payload in zip(PAYLOADS, stored, back):
        want = (text or "").encode()
        assert raw == len(want) and size % 64 == 0 and size > 0 and size - raw < 64 + (raw == 0) and form in media.FORMS
        assert payload.tobytes() == want + b"\0" * (size - raw)
        assert media._payload(webp.decode(file), size).tobytes() == payload.tobytes()
    assert stored[7] == stored[8]


@pytest.mark.parametrize("form", media.FORMS)
@pytest.mark.parametrize("alone", [0, 1000])
def test_every_form_is_read_back(form, alone, monkeypatch):
    monkeypatch.setattr(media, "ALONE", alone)
    r = np.random.default_rng(3)
    words = [bytes(r.integers(97, 105, r.integers(1, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[i] for i in r.integers(0, 300, n)) for n in (1, 9, 200, 5000)]
    if form == "palette":
        texts = [t.translate(bytes(97 + b % 11 for b in range(256))) for t in texts]
    payloads = [np.frombuffer(t + b"\0" * (-len(t) % 64), dtype=np.uint8) for t in texts]
    if form == "flat":
        payloads = [np.full(64 * n, 65, dtype=np.uint8) for n in (1, 3, 500)]
    files = [f for _, f in media.pack(payloads, [form] * len(payloads))]
    for f, p, got in zip(files, payloads, media.unpack(files, [len(p) for p in payloads])):
        assert (got == p).all() and (media._payload(webp.decode(f), len(p)) == p).all()


@pytest.mark.parametrize("options", [{}, {"copies": False}, {"cache_bits": 1}, {"cache_bits": 11}, {"subtract_green": True, "cache_bits": 4}, {"group_bits": 2}, {"predictor": True, "cross": True}, {"palette": True}])
def test_images_of_another_writer_are_read_in_step(options, monkeypatch):
    """unpack() knows no more than the format: it reads what encode() writes under any features, of images 64 wide."""
    monkeypatch.setattr(media, "ALONE", 0)
    images = [picture(h, 64, 12 if options.get("palette") else None) for h in (1, 5, 40)]
    files = []
    for image in images:
        own = dict(options)
        rows = lambda b: (webp._rounded(image.shape[0], b), webp._rounded(64, b))  # noqa: E731, B023
        if "predictor" in own:
            own |= {"predictor": (3, RNG.integers(0, 14, rows(3))), "cross": (4, RNG.integers(0, 256, (*rows(4), 4)))}
        files.append(webp.encode(image, **own))
    for image, got in zip(images, media.unpack(files, [image.shape[0] * 64 for image in images])):
        assert (got == image[..., 2].reshape(-1)).all()


def test_forms_are_chosen_by_size():
    """Of each kind of payload the estimate picks a form that is smallest, or nearly; repeated passages cost next to nothing."""
    r = np.random.default_rng(4)
    words = [bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8)) for _ in range(400)]
    prose = lambda n: b" ".join(words[i] for i in r.integers(0, 400, n))
    steps = bytes(np.cumsum(r.integers(0, 3, 6400)).astype(np.uint8))
    rows = (bytes(r.integers(0, 256, 64).astype(np.uint8)) + bytes(64)) * 8
    for raw, want in ((prose(300), {"cross"}), (bytes(640), {"flat"}), (bytes(r.integers(0, 3, 6400).astype(np.uint8)), {"palette"}), (steps, {"left"}), (rows, {"top", "cross"}), (prose(40_000), {"pairs", "cross"})):
        p = np.frombuffer(raw + b"\0" * (-len(raw) % 64), dtype=np.uint8)
        form, file = media.pack([p])[0]
        assert form in want
        sizes = {f: len(media.pack([p], [f])[0][1]) for f in media.FORMS if (f != "flat" or form == "flat") and (f != "palette" or len(np.unique(p)) <= 16)}
        assert len(file) <= 1.1 * min(sizes.values()) + 20, sizes
    once = prose(500)
    one, four = (media.pack([np.frombuffer(t + b"\0" * (-len(t) % 64), dtype=np.uint8)])[0][1] for t in (once, once * 4))
    assert len(four) < 1.2 * len(one)


def test_tall_payloads_get_wider():
    assert media.shape_of(64) == (64, 1)
    width, height = media.shape_of(64 * 40_000)
    assert width % 64 == 0 and height <= media.MOST_SIDE and width * height >= 64 * 40_000
    big = np.frombuffer(b"ab" * 32 * 20_000 + b"cde" * 64, dtype=np.uint8)
    for form in ("cross", "palette", "pairs"):
        assert (media.unpack([f for _, f in media.pack([big], [form])], [len(big)])[0] == big).all()


@pytest.mark.parametrize("cut", [0, 5, 11, 19, 30, 60])
def test_broken_streams_raise(cut):
    data = webp.encode(picture(9, 9))
    with pytest.raises(webp.Corrupt):
        webp.decode(data[:cut] if cut < 30 else data[:20] + b"\x2f" + data[21:cut])


def test_cut_streams_raise_in_step():
    file = media.store(["some words that are here and there, here and there"])[0][0]
    for n in (22, 40, len(file) - 4):
        with pytest.raises(webp.Corrupt):
            media.unpack([file[:16] + (n - 20).to_bytes(4, "little") + file[20:n]], [64])


def described(text):
    """The query's columns by plain loops over the bytes."""
    raw = (text or "").encode()
    payload = raw + bytes((64 - len(raw) % 64) % 64 or (0 if raw else 64))
    n, crc = len(payload), 0xFFFFFFFF
    for b in payload[-64:]:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    mean = sum(payload) / n
    dev = math.sqrt(max(0.0, sum(b * b for b in payload) / n - mean * mean))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    steps = [abs(payload[i] - payload[i - 1]) for i in range(n) if i % 64]
    down = [abs(payload[i] - payload[i - 64]) for i in range(64, n)]
    feature = f"mean={mean:.4f};dev={dev:.4f};entropy={max(0.0, entropy):.4f};across={sum(steps) / len(steps):.4f};down={sum(down) / len(down) if down else 0.0:.4f}"
    return len(raw), n, hashlib.sha256(payload).hexdigest(), crc ^ 0xFFFFFFFF, feature


def test_query_against_plain_loops(spark):
    """Every document of a given table: payload, digests, checksum and features are worked out a second time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = media.media(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == described(texts[r.doc_id])
    files = {i: s for i, (s, *_) in zip(texts, media.store(list(texts.values())))}
    assert all((r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest()) for r in out)


def test_table(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, 1), (None, "", 0), (3, "z" * 5000, 7)]
    out = media.media(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in out) == [(0, 0, 64), (1, 3, 64), (1, 3, 64), (2, 0, 64), (3, 5000, 5056)]
    assert len({(r.media_sha256, r.feature) for r in out if r.n_bytes == 0}) == 1
    assert media.media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text():
    long = "x" * 2_000_000 + "".join(map(chr, range(33, 3000))) * 100
    stored = media.store([long, "short"])
    assert [p.tobytes()[: len(t.encode())].decode() for p, t in zip(media.load([s[0] for s in stored], [s[2] for s in stored]), (long, "short"))] == [long, "short"]
