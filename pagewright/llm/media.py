"""Operator 9, media columns: every text as a lossless WebP image, read back and described.

A payload of bytes is the samples of a picture: a grey one with a byte a pixel (red = green = blue), 64 wide, or one with
two bytes a pixel (green, then red), 32 wide. The writer takes, by the estimated size, for each payload one of FORMS:

* `flat`: grey of a single value, no transform;
* `cross`: grey, red and blue taken off by the cross-colour transform, whose multiplier of one says that they equal green;
* `left`, `top`: the predictor transform of that neighbour before `cross`, where neighbours in the picture are alike;
* `palette`: grey of at most 16 values, several pixels bundled in one;
* `pairs`: two bytes a pixel under a colour cache, which learns the common pairs: for long texts.

All but `flat` have back-references where those are smaller. `pack` writes many images at once in numpy. `unpack` reads any
lossless image of one group of prefix codes, many at once: in each step every image reads its next symbol, be it a pixel,
an index of its colour cache or a copy of what stands before; then transforms are inverted in the reverse of their
order, whatever they are. Images with several groups of codes go through `webp.decode` one by one.

Defined results: null text counts as empty: 64 zero bytes. Repeated texts give equal values; null ids stay null; other
columns pass by unread; an empty table gives an empty table. A payload of over 2**28 bytes becomes several images in a row.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import webp
from .common import map_arrow, slices
from .webp import CACHE_HASH, CROSS_COLOUR, NEAR, PALETTE, PREDICTOR, SUBTRACT_GREEN, Corrupt

UNIT = 64  #: payloads are multiples of this
MOST_SIDE = 16384
MOST_PAYLOAD = 1 << 28
WRITE_SAMPLES, READ_SAMPLES, PIXELS = 1_000_000, 16_000_000, 400_000  #: written together, read in step, and turned into payloads together
STEP_IMAGES = 16_000
ALONE = 64  #: images left up to which each goes on alone instead of in step
FORMS = ("flat", "cross", "left", "top", "palette", "pairs")
PAIRS_FROM = 32_768  #: bytes from which a colour cache can win back the cost of its codes
CACHE_BITS = 10
FARTHEST = (1 << 20) - len(NEAR)
LONGEST = 4096
WIDEST = 9  #: bits of the side of a transform's block

#: Of prefix symbols of lengths and distances: least value and extra bits.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
_LOG2 = np.log2(np.maximum(np.arange(1 << 16), 1)).astype(np.float32)  # beyond, a distance costs hardly more
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])


def shape_of(size: int) -> tuple[int, int]:
    """Width and height of the grey image of a payload: 64 wide while that is not too high. One of pairs is half as wide."""
    units = size // UNIT
    across = -(-units // MOST_SIDE)
    return UNIT * across, -(-units // across)


def _prefixed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and its bits of lengths or distances from 1 on."""
    v = n - 1
    high = np.maximum(1, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    symbol = np.where(v < 4, v, 2 * high + (v >> (high - 1) & 1))
    bits = _EXTRA[symbol]
    return symbol, v & ((1 << bits) - 1), bits


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of the symbols counted in each row under a fitted code, with four bits a symbol for the code itself."""
    total = counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(counts > 0, -counts * np.log2(counts / total), 0.0)
    return bits.sum(axis=1) + 4.0 * (counts > 0).sum(axis=1)


class _Batch:
    """Images in a row: pixels by image, their starts and the number of each pixel's image."""

    def __init__(self, images: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in images])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.flat = np.concatenate(images)
        self.owner = np.repeat(np.arange(len(images), dtype=np.int32), self.sizes)

    def fit(self, gram: int) -> np.ndarray:
        """Whether `gram` pixels from each on are of one image."""
        out = np.ones(len(self.flat), dtype=bool)
        last = (self.ends[:, None] - np.arange(1, gram)).reshape(-1)
        out[np.maximum(last, 0)] = False
        return out

    def counts(self, symbols: np.ndarray, alphabet: int, where=slice(None)) -> np.ndarray:
        n = len(self.sizes)
        return np.bincount(self.owner[where] * np.int32(alphabet) + symbols, minlength=n * alphabet).reshape(n, alphabet)


def _earlier(keys: list[np.ndarray], where: np.ndarray, n: int) -> np.ndarray:
    """Distance to the nearest earlier place that agrees in all keys, 0 where there is none; where: the places to look at.

    Sorted by a hash of the keys, then by place: both are parts of one number, which sorts faster than an index.
    """
    low = np.uint64(int(n).bit_length())
    mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15)
    for k in keys[1:]:
        mixed ^= mixed >> np.uint64(31)
        mixed += k
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed >>= low
    mixed <<= low
    mixed |= np.arange(len(mixed), dtype=np.uint64)
    mixed = mixed[where[: len(mixed)]]
    mixed.sort()
    order = (mixed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int32)
    mixed >>= low
    near = (mixed[1:] == mixed[:-1]).nonzero()[0]
    here, there = order[near + 1], order[near]
    for k in keys:
        real = k[here] == k[there]
        here, there = here[real], there[real]
    distance = np.zeros(n + 1, dtype=np.int32)
    distance[here] = here - there
    distance[distance > FARTHEST] = 0
    return distance


def _reach(distance: np.ndarray, place: np.ndarray, gram: int) -> np.ndarray:
    """Length of the copy at each place: as far as the places after it have the same distance, and the last one's gram."""
    n = np.int32(len(place))
    stop = np.where((distance[:-1] > 0) & (distance[1:] == distance[:-1]), n, place)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    return np.minimum(stop - place + np.int32(gram), np.int32(LONGEST))


def _copies(batch: _Batch, units: np.ndarray, unit_bits: int, literal_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, distances) of the copies of a greedy pass.

    Each is from the nearest earlier place of its image with the same 16 bytes, or else with the same six.
    literal_bits: of each image, what a pixel costs otherwise.
    """
    gram, whole = 48 // unit_bits, 128 // unit_bits
    n = len(units)
    none = np.zeros(0, dtype=np.int64)
    if n < 2 * whole:
        return none, none, none
    m = n - gram + 1
    key = batch.owner[:m].astype(np.uint64)
    units = units.astype(np.uint64)
    for k in range(gram):
        key <<= np.uint64(unit_bits)
        key |= units[k : m + k]
    place = np.arange(n, dtype=np.int32)
    distance = _earlier([key], batch.fit(gram), n)
    length = _reach(distance, place, gram)
    size = n - whole + 1
    far = _earlier([key[at : at + size] for at in (0, whole // 2 - gram // 2, whole - gram)], batch.fit(whole), n)
    distance, length = np.where(far > 0, far, distance), np.where(far[:-1] > 0, _reach(far, place, whole), length)
    del key, far
    on = distance[:-1] > 0
    price = literal_bits.astype(np.float32)[batch.owner]
    worth = on & (length * price > 12 + _LOG2[np.minimum(distance[:-1], len(_LOG2) - 1)])
    nxt = np.append(np.minimum.accumulate(np.where(worth, place, np.int32(n))[::-1])[::-1], np.int32(n))
    jump = memoryview(nxt[np.minimum(place + length, n)])
    found, at = [], int(nxt[0])
    while at < n:  # a copy ends before the next one begins, and never leaves its image
        found.append(at)
        at = jump[at]
    places = np.array(found, dtype=np.int64)
    return places, length[places].astype(np.int64), distance[places].astype(np.int64)


def _cache_hits(batch: _Batch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each pixel, whether the cache holds it there when its turn comes)."""
    slots = ((batch.flat.astype(np.uint64) * np.uint64(CACHE_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = np.argsort(batch.owner << bits | slots, kind="stable")
    hit = np.zeros(len(slots), dtype=bool)
    own = batch.owner[order] << bits | slots[order]
    hit[order[1:]] = (own[1:] == own[:-1]) & (batch.flat[order[1:]] == batch.flat[order[:-1]])
    return slots, hit


@functools.cache
def _one_code(only: int) -> tuple[int, int]:
    """The bits of a code of one symbol, and how many."""
    w = webp.Writer()
    webp.write_lengths(w, [int(s == only) for s in range(256)])
    return w.value, w.at


@functools.cache
def _constant(alpha: int, red: int, green: int, blue: int) -> tuple[int, int]:
    """The bits of a small image of one colour, and how many: it takes none beyond its codes."""
    w = webp.Writer()
    w.write(0, 1)
    for only in (green, red, blue, alpha, 0):
        w.write(*_one_code(only))
    return w.value, w.at


def _written(images: list[np.ndarray], widths: list[int], heads: list[webp.Writer], cache_bits: int, unit_bits: int) -> list[bytes]:
    """The chunk's bits of images whose transforms are in `heads`: tokens, codes fitted to them, and all bits at once.

    images: pixels as numbers of which only green varies, or green and red with unit_bits 16.
    """
    batch = _Batch(images)
    pixels, n_images = batch.flat, len(images)
    green, red = (pixels >> 8 & 255).astype(np.int32), (pixels >> 16 & 255).astype(np.int32) if unit_bits == 16 else None
    wide = 280 + (1 << cache_bits if cache_bits else 0)
    symbol, kind = green, np.zeros(len(pixels) if cache_bits else 0, dtype=bool)  # kind: a cache index
    if cache_bits:
        slots, kind = _cache_hits(batch, cache_bits)
        symbol = np.where(kind, 280 + slots, green).astype(np.int32)
    plain = batch.counts(symbol, wide)
    plain_bits = _entropy(plain) + (_entropy(batch.counts(red[~kind], 256, ~kind)) if cache_bits else 0)
    units = green if unit_bits == 8 else green | red << 8
    places, lengths, distances = _copies(batch, units, unit_bits, plain_bits / batch.sizes)
    token = np.ones(len(pixels), dtype=bool)
    near = {w: _near_codes(w) for w in set(widths)}
    if len(places):
        width_of = np.array(widths)[batch.owner[places]]
        code = distances + len(NEAR)
        for w, table in near.items():
            short = np.flatnonzero((width_of == w) & (distances < len(table)))
            own = table[distances[short]]
            code[short[own > 0]] = own[own > 0]
        s_len, x_len, b_len = _prefixed(lengths)
        s_far, x_far, b_far = _prefixed(code)

        def covered(chosen):
            steps = np.zeros(len(pixels) + 1, dtype=np.int8)  # copies don't meet, so their begins differ, and their ends
            steps[places[chosen]] += 1
            steps[places[chosen] + lengths[chosen]] -= 1
            out = np.cumsum(steps[:-1], dtype=np.int8) == 0
            out[places[chosen]] = True
            return out

        whose = batch.owner[places]
        token = covered(slice(None))
        literal = token.copy()
        literal[places] = False
        with_copies = batch.counts(symbol[literal], wide, literal)
        with_copies[:, 256:280] += np.bincount(whose * 24 + s_len, minlength=n_images * 24).reshape(n_images, 24)
        far = np.bincount(whose * 40 + s_far, minlength=n_images * 40).reshape(n_images, 40)
        bits = _entropy(with_copies) + _entropy(far) + np.bincount(whose, weights=b_len + b_far, minlength=n_images)
        if cache_bits:
            own = literal & ~kind
            bits += _entropy(batch.counts(red[own], 256, own))
        better = bits < plain_bits
        if not better.all():
            chosen = np.flatnonzero(better[whose])
            places, s_len, x_len, b_len, s_far, x_far, b_far, lengths = (x[chosen] for x in (places, s_len, x_len, b_len, s_far, x_far, b_far, lengths))
            whose = whose[chosen]
            token = covered(slice(None))
    at = np.flatnonzero(token)
    copy = np.full(len(at), -1)
    if len(places):
        copy[np.searchsorted(at, places)] = np.arange(len(places))
    is_copy = copy >= 0
    symbol = symbol[at].copy()
    if len(places):
        symbol[is_copy] = 256 + s_len
    owner = batch.owner[at]
    reds = ~is_copy & ~kind[at] if cache_bits else np.zeros(len(at), dtype=bool)
    entry = owner * np.int32(wide) + symbol
    first_counts = np.bincount(entry, minlength=n_images * wide).reshape(n_images, wide)
    far_counts = np.bincount(owner[is_copy] * 40 + s_far, minlength=n_images * 40).reshape(n_images, 40) if len(places) else np.zeros((n_images, 40), dtype=np.int64)
    red_counts = np.bincount(owner[reds] * 256 + red[at[reds]], minlength=n_images * 256).reshape(n_images, 256) if cache_bits else None
    tables = {name: (np.zeros((n_images, size), dtype=np.int64), np.zeros((n_images, size), dtype=np.int64)) for name, size in (("first", wide), ("far", 40), ("red", 256))}
    for i, w in enumerate(heads):
        w.write(0, 1)
        w.write(cache_bits > 0, 1)
        if cache_bits:
            w.write(cache_bits, 4)
        w.write(0, 1)  # one group of codes
        first_pixel = int(images[i][0])
        alpha = int(images[i][-1]) >> 24
        for name, counts, only in (("first", first_counts, None), ("red", red_counts, None if cache_bits else first_pixel >> 16 & 255), ("blue", None, first_pixel & 255), ("alpha", None, alpha), ("far", far_counts, None)):
            if only is not None:
                w.write(*_one_code(only))
                continue
            own = webp.code_lengths(counts[i])
            webp.write_lengths(w, own)
            sizes = np.array(own)
            if np.count_nonzero(sizes) > 1:
                tables[name][0][i] = webp.codes_of(sizes)
                tables[name][1][i] = sizes
    value, size = np.zeros((len(at), 3), dtype=np.int64), np.zeros((len(at), 3), dtype=np.int64)
    value[:, 0], size[:, 0] = (t.reshape(-1).take(entry) for t in tables["first"])
    if reds.any():
        value[reds, 1], size[reds, 1] = tables["red"][0][owner[reds], red[at[reds]]], tables["red"][1][owner[reds], red[at[reds]]]
    if len(places):
        value[is_copy, 0] |= x_len << size[is_copy, 0]
        size[is_copy, 0] += b_len
        whose = owner[is_copy]
        value[is_copy, 1], size[is_copy, 1] = tables["far"][0][whose, s_far], tables["far"][1][whose, s_far]
        value[is_copy, 2], size[is_copy, 2] = x_far, b_far
    return _assembled(heads, value.reshape(-1), size.reshape(-1), np.bincount(owner, weights=size.sum(axis=1), minlength=n_images).astype(np.int64), 3 * np.bincount(owner, minlength=n_images))


def _assembled(heads: list[webp.Writer], value: np.ndarray, size: np.ndarray, bits: np.ndarray, items: np.ndarray) -> list[bytes]:
    """The bits of each head, then its items of up to 21 bits each."""
    starts, word = [], 0
    for w, n in zip(heads, bits.tolist()):
        starts.append(word * 32 + w.at)
        word += -(-(w.at + n) // 32) + 1
    ends = np.cumsum(size)
    begin = np.cumsum(items) - items
    base = np.array(starts) - np.where(begin > 0, ends[begin - 1], 0)
    at = ends - size + np.repeat(base, items)
    sums = np.bincount(at >> 5, weights=(value << (at & 31)).astype(np.float64), minlength=word + 1).astype(np.int64)  # bits don't meet, so sums are exact
    words = sums & 0xFFFFFFFF
    words[1:] |= sums[:-1] >> 32
    stream = words.astype("<u4").tobytes()
    out, place = [], 0
    for w, n in zip(heads, bits.tolist()):
        body = bytearray(stream[4 * place : 4 * place + (w.at + n + 7) // 8])
        head = (w.at + 7) // 8
        body[:head] = (int.from_bytes(body[:head], "little") | w.value).to_bytes(head, "little")
        out.append(bytes(body))
        place += -(-(w.at + n) // 32) + 1
    return out


def _near_codes(width: int) -> np.ndarray:
    """Distance in pixels -> code of the near pixel there, 0 where there is none."""
    table = np.zeros(8 * width + 9, dtype=np.int64)
    for k in range(len(NEAR) - 1, -1, -1):
        x, y = NEAR[k]
        table[max(1, x + y * width)] = k + 1
    return table


def _form_of(samples: list[np.ndarray], widths: list[int]) -> list[str]:
    """Of each payload the form of least estimated size."""
    batch = _Batch(samples)
    flat = batch.flat  # of bytes, so that differences wrap
    counts = batch.counts(flat, 256)
    distinct = (counts > 0).sum(axis=1)
    plain = _entropy(counts)
    left = flat.copy()
    left[1:] -= flat[:-1]
    left[batch.starts] = flat[batch.starts]
    top = left.copy()
    for width in set(widths):  # one, unless a payload is very long
        own = np.array([w == width for w in widths])
        under = own[batch.owner] if not own.all() else np.ones(len(flat), dtype=bool)
        under[(batch.starts[own, None] + np.arange(width)).reshape(-1)] = False
        under = under.nonzero()[0]
        top[under] = flat[under] - flat[under - width]
    by_left, by_top = (_entropy(batch.counts(x, 256)) + 60 for x in (left, top))
    out = []
    for i, p in enumerate(samples):
        if distinct[i] == 1:
            out.append("flat")
            continue
        costs = {"cross": plain[i], "left": by_left[i], "top": by_top[i]}
        if distinct[i] <= 16:
            colours = np.flatnonzero(counts[i])
            bundled = _bundled(np.searchsorted(colours, p), widths[i], len(colours))
            costs |= {"cross": _coded_size(counts[i]), "palette": _coded_size(np.bincount(bundled, minlength=256)) + 12 * len(colours)}
        if len(p) >= PAIRS_FROM:
            pairs = np.bincount(p[::2].astype(np.int64) | p[1::2].astype(np.int64) << 8)
            pairs = pairs[pairs > 0]
            costs["pairs"] = float(_entropy(pairs[None])[0]) + 16 * len(pairs)
        out.append(min(costs, key=costs.get))
    return out


def _coded_size(counts: np.ndarray) -> int:
    """_entropy() of few symbols, whose codes lie well above it."""
    return int((counts * webp.code_lengths(counts)).sum()) + 4 * int((counts > 0).sum())


def _bundled(index: np.ndarray, width: int, colours: int) -> np.ndarray:
    wide = webp._palette_bits(colours)
    each, grid = 8 >> wide, index.reshape(-1, width)
    out = np.zeros((len(grid), webp._rounded(width, wide)), dtype=np.int64)
    for x in range(width):
        out[:, x >> wide] |= grid[:, x] << ((x & ((1 << wide) - 1)) * each)
    return out.reshape(-1)


def _residual(samples: np.ndarray, width: int, mode: int) -> np.ndarray:
    grid = samples.astype(np.int64).reshape(-1, width)
    out = grid.copy()
    out[0, 1:] -= grid[0, :-1]
    out[1:, 0] -= grid[:-1, 0]
    out[1:, 1:] -= grid[1:, :-1] if mode == 1 else grid[:-1, 1:]
    return (out & 255).reshape(-1).astype(np.uint32)


def pack(payloads: list[np.ndarray], forms: list[str] | None = None) -> list[tuple[str, bytes]]:
    """(form, WebP file) of each payload (bytes, a positive multiple of 64 up to 2**28). forms: instead of the choice by size."""
    shapes = [shape_of(len(p)) for p in payloads]
    samples = [p if w * h == len(p) else np.concatenate([p, np.zeros(w * h - len(p), dtype=np.uint8)]) for p, (w, h) in zip(payloads, shapes)]
    forms = forms or _form_of(samples, [w for w, _ in shapes])
    images, widths, heads = [], [], []
    opaque = np.uint32(255 << 24)
    for p, (width, height), form in zip(samples, shapes, forms):
        w = webp.Writer()
        heads.append(w)
        v = p.astype(np.uint32)
        if form == "pairs":
            images.append(opaque | v[1::2] << 16 | v[::2] << 8)
            widths.append(width // 2)
        elif form == "flat":
            images.append(opaque | v * 0x010101)
            widths.append(width)
        elif form == "palette":
            colours = np.unique(v)
            w.write(1 | PALETTE << 1, 3)
            w.write(len(colours) - 1, 8)
            colours = colours.astype(np.int64)
            steps = np.diff(colours, prepend=0)
            alphas = np.append(255, np.zeros(len(colours) - 1, dtype=np.int64))
            webp._write_image(w, (alphas << 24 | steps * 0x010101).tolist(), len(colours), False, copies=False)
            bundled = _bundled(np.searchsorted(colours, v), width, len(colours))
            images.append(opaque | bundled.astype(np.uint32) << 8)
            widths.append(webp._rounded(width, webp._palette_bits(len(colours))))
        else:
            if form in ("left", "top"):
                mode = 1 if form == "left" else 2
                w.write(1 | PREDICTOR << 1, 3)
                w.write(WIDEST - 2, 3)
                w.write(*_constant(255, 0, mode, 0))
                v, alpha = _residual(p, width, mode), np.uint32(0)
            else:
                alpha = opaque
            w.write(1 | CROSS_COLOUR << 1, 3)
            w.write(WIDEST - 2, 3)
            w.write(*_constant(255, 0, 32, 32))  # red to blue none; green to blue and green to red one
            images.append(alpha | v << 8)
            widths.append(width)
    chunks: list = [None] * len(payloads)
    for pairs in (False, True):
        own = [i for i, f in enumerate(forms) if (f == "pairs") == pairs]
        if own:
            made = _written([images[i] for i in own], [widths[i] for i in own], [heads[i] for i in own], CACHE_BITS if pairs else 0, 16 if pairs else 8)
            for i, body in zip(own, made):
                width, height = shapes[i]
                chunks[i] = webp._file(webp._head(width // 2 if pairs else width, height) + body)
    return list(zip(forms, chunks))


_READ: dict[tuple[int, int], list] = {}  # sides of a small image -> (its bits, how many, pixels) of those read before
MOST_READ = 16


def _small_image(bits: webp.Window, across: int, down: int) -> np.ndarray:
    """A transform's image. The same bits give the same image, so the few that writers use over and over are read once."""
    known = _READ.setdefault((across, down), []) if across * down <= 64 else None
    for value, n, pixels in known or ():
        if bits.peek(n) == value:
            bits.read(n)
            return pixels.copy()
    start = bits.at
    pixels = webp._channels(webp._read_image(bits, across, down, False), across)
    n = bits.at - start
    if known is not None and n <= 512 and len(known) < MOST_READ and len(_READ) <= 256:
        bits.at = start
        known.append((bits.read(n), n, pixels.copy()))
    return pixels


class _Parsed:
    """An image's header: sides, transforms in the order of the stream, width of the coded image, cache, code lengths, first data bit."""

    def __init__(self, chunk: bytes):
        self.chunk = chunk
        self.width, self.height = webp._sides(chunk)
        bits = webp.Window(chunk, 40)
        self.transforms, self.coded, seen = [], self.width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise Corrupt("a transform stands twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                side = bits.read(3) + 2
                self.transforms.append((kind, _small_image(bits, webp._rounded(self.coded, side), webp._rounded(self.height, side)), side))
            elif kind == PALETTE:
                n = bits.read(8) + 1
                self.transforms.append((kind, np.cumsum(webp._channels(webp._read_image(bits, n, 1, False), n)[0], axis=0) & 255, self.coded))
                self.coded = webp._rounded(self.coded, webp._palette_bits(n))
            else:
                self.transforms.append((kind, None, 0))
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise Corrupt("the colour cache is too large")
        self.several = bool(bits.read(1))
        if not self.several:
            self.codes = [np.array(webp.read_lengths(bits, n)) for n in (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)]
            self.at = bits.at
        self.size = self.coded * self.height


def _table_of(lengths: np.ndarray) -> np.ndarray:
    used = lengths.nonzero()[0]
    if len(used) < 2:
        return np.array([int(used[0]) << 4 if len(used) else 0], dtype=np.int32)
    return webp.code_table(lengths, int(lengths.max()))


def _pixels(images: list[_Parsed]) -> list[np.ndarray]:
    """The coded pixels of images of one group of codes, read in step: a symbol of every image at a time."""
    n = len(images)
    tables, offsets, masks, place = [], np.zeros((5, n), dtype=np.int64), np.zeros((5, n), dtype=np.uint32), 0
    for i, image in enumerate(images):
        for j, lengths in enumerate(image.codes):
            own = _table_of(lengths)
            tables.append(own)
            offsets[j, i], masks[j, i] = place, len(own) - 1
            place += len(own)
    table = np.concatenate(tables)
    single = np.array([[masks[j, i] == 0 for i in range(n)] for j in (1, 2, 3)]).all(axis=0)  # red, blue and alpha take no bits
    constant = (table[offsets[3]].astype(np.int64) >> 4) << 24 | (table[offsets[1]].astype(np.int64) >> 4) << 16 | table[offsets[2]].astype(np.int64) >> 4
    stream = np.frombuffer(b"".join(p.chunk for p in images) + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = stream[:-3] | stream[1:-2] << np.uint32(8) | stream[2:-1] << np.uint32(16) | stream[3:] << np.uint32(24)
    needed, fixed = masks.any(axis=1).tolist(), table[offsets] >> 4
    lengths = np.array([len(p.chunk) for p in images])
    first = np.cumsum(lengths) - lengths
    limit = (first + lengths) * 8
    total = np.array([p.size for p in images])
    ends = np.cumsum(total)
    out = np.zeros(int(ends[-1]), dtype=np.uint32)
    bits = np.array([p.cache_bits for p in images])
    any_cache = bool(bits.any())
    rows = np.cumsum(1 << bits) - (1 << bits)
    cache = np.zeros(int((1 << bits).sum()), dtype=np.uint32)
    near = np.ones((n, len(NEAR) + 1), dtype=np.int64)
    for i, image in enumerate(images):
        near[i, 1:] = _NEAR_STEP if image.coded == UNIT else np.maximum(1, _NEAR_X + _NEAR_Y * image.coded)
    # State of the live images: bit, pixel, end, start, then what is fixed.
    live = np.arange(n)
    at, pos, end, start = first * 8 + np.array([p.at for p in images]), ends - total, ends.copy(), ends - total

    def peek(where):
        return window.take(where >> 3, mode="clip") >> (where & 7).astype(np.uint32)

    def read(where, code, who):
        """Symbols by a code of the images `who`; moves `where` on."""
        if not needed[code]:
            return fixed[code][who]
        e = table.take(offsets[code].take(who) + (peek(where) & masks[code].take(who)))
        where += e & 15
        return e >> 4

    def number(where, symbol):
        extra = _EXTRA.take(symbol)
        got = _LEAST.take(symbol) + (peek(where) & _MASK.take(extra))
        where += extra
        return got

    def remember(where, who):
        """Pixels into their images' caches, in order."""
        p = out[where]
        cache[rows[who] + ((p.astype(np.uint64) * np.uint64(CACHE_HASH) & np.uint64(0xFFFFFFFF)) >> _SHIFT[bits[who]]).astype(np.int64)] = p

    base, mask, plain, all_single = offsets[0], masks[0], constant.copy(), bool(single.all())
    while len(live) > ALONE:
        e = table.take(base + (peek(at) & mask))
        at += e & 15
        s = e >> 4
        other = (s > 255).nonzero()[0]
        value = plain | s << 8
        if not all_single:
            k = ((s < 256) & ~single[live]).nonzero()[0]
            if len(k):
                who, where = live[k], at[k]
                red, blue, alpha = read(where, 1, who), read(where, 2, who), read(where, 3, who)
                value[k] = alpha.astype(np.int64) << 24 | red.astype(np.int64) << 16 | s[k] << 8 | blue
                at[k] = where
        out[pos] = value  # of copies too, for now: what they copy goes over it
        step = 1
        if any_cache:
            k = ((s < 256) & (bits[live] > 0)).nonzero()[0]
            if len(k):
                remember(pos[k], live[k])
        if len(other):
            if any_cache:
                hit = (s >= 280).nonzero()[0]
                if len(hit):
                    out[pos[hit]] = cache[rows[live[hit]] + s[hit] - 280]
                    other = ((s > 255) & (s < 280)).nonzero()[0]
            if len(other):
                step = np.ones(len(live), dtype=np.int64)
                who, where = live[other], at[other]
                length = number(where, s[other] - 256)
                far = number(where, read(where, 4, who))
                far = np.where(far > len(NEAR), far - len(NEAR), near[who, np.minimum(far, len(NEAR))])
                here = pos[other]
                if (far > here - start[other]).any() or (here + length > end[other]).any():
                    raise Corrupt("a back-reference leaves the image")
                at[other] = where
                step[other] = length
                ran = length.cumsum()
                to = (here - ran + length).repeat(length) + np.arange(int(ran[-1]))
                off = to - here.repeat(length)
                if (far < length).any():  # it overlaps itself: the stretch repeats
                    off %= far.repeat(length)
                out[to] = out[(here - far).repeat(length) + off]
                if any_cache:
                    kept = (bits[who] > 0).repeat(length)
                    if kept.any():
                        remember(to[kept], who.repeat(length)[kept])
        pos += step
        going = pos < end
        if not going.all():
            if (at > limit[live]).any():
                raise Corrupt("the stream ends early")
            live, at, pos, end, start, base, mask, plain = (x[going] for x in (live, at, pos, end, start, base, mask, plain))
    for i, bit, here in zip(live.tolist(), at.tolist(), pos.tolist()):
        own = cache[rows[i] : rows[i] + (1 << int(bits[i]))]
        bit = _alone(images[i], window, table, offsets[:, i].tolist(), masks[:, i].tolist(), bit, out[ends[i] - total[i] : ends[i]], here - int(ends[i] - total[i]), own, near[i].tolist())
        if bit > limit[i]:
            raise Corrupt("the stream ends early")
    return np.split(out, ends[:-1])


def _alone(image, window, table, offsets, masks, at, out, pos, cache, near) -> int:
    """Reads the rest of one image, symbol by symbol; returns the bit after its last one."""
    win, tab, px, held = memoryview(window), memoryview(table), memoryview(out), memoryview(cache)
    extras, leasts = _EXTRA.tolist(), _LEAST.tolist()
    bits, end = image.cache_bits, len(out)
    shift = 32 - bits
    (g, r, b, a, d), (gm, rm, bm, am, dm) = offsets, masks
    constant = (tab[a] >> 4) << 24 | (tab[r] >> 4) << 16 | tab[b] >> 4
    single = not (rm or bm or am)
    try:
        while pos < end:
            e = tab[g + (win[at >> 3] >> (at & 7) & gm)]
            at += e & 15
            s = e >> 4
            if s < 256:
                if single:
                    value = constant | s << 8
                else:
                    red = tab[r + (win[at >> 3] >> (at & 7) & rm)]
                    at += red & 15
                    blue = tab[b + (win[at >> 3] >> (at & 7) & bm)]
                    at += blue & 15
                    alpha = tab[a + (win[at >> 3] >> (at & 7) & am)]
                    at += alpha & 15
                    value = (alpha >> 4) << 24 | (red >> 4) << 16 | s << 8 | blue >> 4
                px[pos] = value
                if bits:
                    held[(CACHE_HASH * value & 0xFFFFFFFF) >> shift] = value
                pos += 1
            elif s < 280:
                extra = extras[s - 256]
                length = leasts[s - 256] + (win[at >> 3] >> (at & 7) & ((1 << extra) - 1))
                at += extra
                e = tab[d + (win[at >> 3] >> (at & 7) & dm)]
                at += e & 15
                extra = extras[e >> 4]
                far = leasts[e >> 4] + (win[at >> 3] >> (at & 7) & ((1 << extra) - 1))
                at += extra
                far = far - len(NEAR) if far > len(NEAR) else near[far]
                if far > pos or pos + length > end:
                    raise Corrupt("a back-reference leaves the image")
                out[pos : pos + length] = out[pos - far : pos - far + length] if far >= length else np.resize(out[pos - far : pos], length)
                if bits:
                    for value in out[pos : pos + length].tolist():
                        held[(CACHE_HASH * value & 0xFFFFFFFF) >> shift] = value
                pos += length
            else:
                px[pos] = held[s - 280]
                pos += 1
    except IndexError:
        raise Corrupt("the stream ends early") from None
    return at


_MASK = np.array([(1 << k) - 1 for k in range(20)], dtype=np.uint32)
_SHIFT = np.array([32 - k for k in range(12)], dtype=np.uint64)
_NEAR_X, _NEAR_Y = np.array(NEAR).T
_NEAR_STEP = np.maximum(1, _NEAR_X + _NEAR_Y * UNIT)


def _undone(image: _Parsed, pixels: np.ndarray) -> np.ndarray:
    """height x width x (alpha, red, green, blue), all transforms inverted, the last first."""
    out = webp._channels(pixels.astype(np.int64), image.coded)
    for kind, data, size in reversed(image.transforms):
        if kind == PREDICTOR:
            out = webp.undo_predictor(out, data[..., 2] & 15, size)
        elif kind == CROSS_COLOUR:
            out = webp.cross_colour(out, data, size, True)
        elif kind == SUBTRACT_GREEN:
            out[..., 1] = (out[..., 1] + out[..., 2]) & 255
            out[..., 3] = (out[..., 3] + out[..., 2]) & 255
        else:
            out = webp.from_palette(out, data, size)
    return out


def _uncrossed(images: list[_Parsed], pixels: list[np.ndarray]) -> list[np.ndarray]:
    """_undone() of images whose one transform is cross-colour of one element each, all at once."""
    element = ((np.array([p.transforms[0][1].reshape(-1, 4)[0] for p in images]) ^ 128) - 128).astype(np.int16)
    e = element[np.repeat(np.arange(len(images)), [len(p) for p in pixels])]
    bytes_of = np.concatenate(pixels).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    step = lambda t, c: (t * c.view(np.int8) >> 5).astype(np.uint8)  # noqa: E731  bytes wrap, as the format has it
    green = np.ascontiguousarray(bytes_of[:, 1])
    red = bytes_of[:, 2] + step(e[:, 3], green)
    blue = bytes_of[:, 0] + step(e[:, 2], green) + step(e[:, 1], red)
    out = np.stack([bytes_of[:, 3], red, green, blue], axis=-1)
    ends = np.cumsum([len(p) for p in pixels])[:-1]
    return [x.reshape(-1, p.width, 4) for x, p in zip(np.split(out, ends), images)]


def unpack(files: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The payloads of pack(), each of its size, out of the decoded pixels."""
    parsed = [_Parsed(webp._chunk(f)) for f in files]
    out: list = [None] * len(files)
    together = [i for i, p in enumerate(parsed) if not p.several]
    for cached in (False, True):  # apart, so that images without a cache don't wait for those with one
        own = [i for i in together if bool(parsed[i].cache_bits) == cached]
        if not own:
            continue
        found = dict(zip(own, _pixels([parsed[i] for i in own])))
        simple = [i for i in own if [t[0] for t in parsed[i].transforms] == [CROSS_COLOUR] and (parsed[i].transforms[0][1] == parsed[i].transforms[0][1][0, 0]).all()]
        for lo, hi in slices([parsed[i].size for i in simple], PIXELS):
            part = simple[lo:hi]
            for i, image in zip(part, _uncrossed([parsed[i] for i in part], [found.pop(i) for i in part])):
                out[i] = _payload(image, sizes[i])
        for i in own:
            if out[i] is None:
                out[i] = _payload(_undone(parsed[i], found.pop(i)), sizes[i])
    return [_payload(webp.decode(f), size) if p is None else p for f, size, p in zip(files, sizes, out)]


def _payload(image: np.ndarray, size: int) -> np.ndarray:
    """The samples of a decoded image: green, or green and red of one that is narrower than a grey one."""
    grey = image.shape[1] == shape_of(size)[0]
    return (image[..., 2] if grey else image[..., [2, 1]]).astype(np.uint8).reshape(-1)[:size]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def features_of(payloads: list[np.ndarray]) -> list[str]:
    """Mean, deviation and entropy of each payload's samples, and the mean step between neighbours in a row and in a column."""
    batch = _Batch(payloads)
    flat, n = batch.flat, batch.sizes
    counts = batch.counts(flat, 256)
    values = np.arange(256)
    mean = counts @ values / n
    spread = np.sqrt(np.maximum(0.0, counts @ (values * values) / n - mean * mean))
    p = counts / n[:, None]
    entropy = np.maximum(0.0, -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1))
    rows = flat.reshape(-1, UNIT)
    per_row = np.abs(np.diff(rows.astype(np.int16), axis=1)).sum(axis=1, dtype=np.int64)
    first = batch.starts // UNIT
    across = np.add.reduceat(per_row, first) / (n // UNIT * (UNIT - 1))
    under = np.zeros(len(rows), dtype=np.int64)
    under[1:] = np.abs(np.diff(rows.astype(np.int16), axis=0)).sum(axis=1, dtype=np.int64)
    under[first] = 0
    down = np.add.reduceat(under, first) / np.maximum(1, n - UNIT)
    return [f"mean={a:.4f};dev={b:.4f};entropy={c:.4f};across={d:.4f};down={e:.4f}" for a, b, c, d, e in zip(mean, spread, entropy, across, down)]


def store(texts: list[str | None]) -> list[tuple[bytes, int, int, str]]:
    """(stored form, bytes of the text, bytes of the payload, name of the form) of each text."""
    out: list = [None] * len(texts)
    made = [payload_of(t) for t in texts]
    for lo, hi in slices([len(p) + WRITE_SAMPLES // STEP_IMAGES for p, _ in made], WRITE_SAMPLES):
        parts = [(i, np.frombuffer(made[i][0][k : k + MOST_PAYLOAD], dtype=np.uint8)) for i in range(lo, hi) for k in range(0, len(made[i][0]), MOST_PAYLOAD)]
        files: dict[int, list] = {}
        for (i, _), f in zip(parts, pack([p for _, p in parts])):
            files.setdefault(i, []).append(f)
        for i, f in files.items():
            out[i] = (b"".join(x for _, x in f), made[i][1], len(made[i][0]), f[0][0])
    return out


def _files(stored: bytes) -> list[bytes]:
    out = []
    while stored:
        size = 8 + int.from_bytes(stored[4:8], "little")
        out.append(stored[:size])
        stored = stored[size:]
    return out


def load(stored: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The payloads of store(), from the stored bytes and the payloads' sizes."""
    out: list = [None] * len(stored)
    order = sorted(range(len(stored)), key=lambda i: -sizes[i])
    for lo, hi in slices([sizes[i] + READ_SAMPLES // STEP_IMAGES for i in order], READ_SAMPLES):
        parts = []
        for i in order[lo:hi]:
            files = _files(stored[i])
            parts += [(i, f, min(MOST_PAYLOAD, sizes[i] - k * MOST_PAYLOAD)) for k, f in enumerate(files)]
        joined: dict[int, list] = {}
        for (i, _, _), p in zip(parts, unpack([f for _, f, _ in parts], [n for _, _, n in parts])):
            joined.setdefault(i, []).append(p)
        for i, p in joined.items():
            out[i] = p[0] if len(p) == 1 else np.concatenate(p)
    return out


def media(documents: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back and describes them; `form` names the writer's choice."""

    def run(c):
        stored = store(c["text"])
        back = load([s for s, _, _, _ in stored], [n for _, _, n, _ in stored])
        raw = [p.tobytes() for p in back]
        return {
            "doc_id": c["doc_id"],
            "n_bytes": [n for _, n, _, _ in stored],
            "payload_bytes": list(map(len, raw)),
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in raw],
            "tail_crc32": [zlib.crc32(p[-UNIT:]) for p in raw],
            "media_bytes": [len(s) for s, _, _, _ in stored],
            "media_sha256": [hashlib.sha256(s).hexdigest() for s, _, _, _ in stored],
            "feature": [f for lo, hi in slices(list(map(len, back)), PIXELS) for f in features_of(back[lo:hi])],
            "form": [f for _, _, _, f in stored],
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, form string"
    return map_arrow(documents.select("doc_id", "text"), run, schema, most=READ_SAMPLES)
