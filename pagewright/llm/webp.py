"""Lossless WebP (VP8L), the format of operator 9 (`media.py`).

`decode` reads any lossless stream: prefix codes (simple and normal, one group or many), back-references with the near
distance map, the colour cache, and the inverse predictor, cross-colour, subtract-green and palette transforms; it gives
an array of height x width pixels of alpha, red, green, blue. `encode` writes such streams with any of these features, one
image at a time and as it is told. `media.py` does both for many images at once.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np

LIMIT = 11  #: longest prefix code that is written

#: Fixed values of the format: order in which lengths of the code-length code stand, and the near pixels (x, y) of distance codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Corrupt(ValueError):
    """The stream breaks the format."""


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def peek(self, n: int) -> int:
        return (self.value >> self.at) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise Corrupt("the stream ends early")
        return got


class Window:
    """Like Bits, over a long stream: keeps a stretch of it as a number, so that reading takes the same time anywhere."""

    STRETCH = 512

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.size, self.at = data, 8 * len(data), at
        self.base, self.value = -1, 0

    def peek(self, n: int) -> int:
        base = self.at >> 3 >> 8 << 8
        if base != self.base:
            self.base, self.value = base, int.from_bytes(self.data[base : base + self.STRETCH], "little")
        return (self.value >> (self.at - 8 * base)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise Corrupt("the stream ends early")
        return got


def _reversed_bits(width: int) -> np.ndarray:
    x = np.arange(1 << width)
    out = np.zeros_like(x)
    for i in range(width):
        out |= (x >> i & 1) << (width - 1 - i)
    return out


_REVERSED = {w: _reversed_bits(w) for w in range(16)}


def code_table(lengths, width: int) -> np.ndarray:
    """symbol << 4 | length for each value of the next `width` bits. A code of one symbol has length 0."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.full(1 << width, (int(used[0]) << 4) if len(used) else 0, dtype=np.int32)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (width - lengths[order].astype(np.int64))
    if spans.sum() != 1 << width:
        raise Corrupt("a prefix code isn't complete")
    return np.repeat((order << 4 | lengths[order]).astype(np.int32), spans)[_REVERSED[width]]


class Code:
    """A prefix code for reading symbol by symbol."""

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths)
        used = np.flatnonzero(self.lengths)
        self.single = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.width = int(self.lengths.max()) if len(used) else 0
        self.table = code_table(self.lengths, self.width).tolist() if self.single is None else None

    def read(self, bits) -> int:
        if self.table is None:
            return self.single
        got = self.table[bits.peek(self.width)]
        bits.at += got & 15
        return got >> 4


def read_lengths(bits, alphabet: int) -> list[int]:
    out = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise Corrupt("a symbol lies outside of its alphabet")
            out[s] = 1
        return out
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, at, before = Code(first), 0, 8
    table, mask, single = code.table, (1 << code.width) - 1, code.single
    place, base, value = bits.at, -1 << 20, 0  # bits are read here, without a call for each
    while at < alphabet and left > 0:
        left -= 1
        if place - base > 1024:
            bits.at = base = place
            value = bits.peek(1024 + 32)
        v = value >> (place - base)
        if table is None:
            s = single
        else:
            s = table[v & mask]
            place += s & 15
            v >>= s & 15
            s >>= 4
        if s < 16:
            out[at] = s
            at += 1
            before = s or before
            continue
        n = 3 + (v & 3) if s == 16 else 3 + (v & 7) if s == 17 else 11 + (v & 127)
        place += 2 if s == 16 else 3 if s == 17 else 7
        if at + n > alphabet:
            raise Corrupt("code lengths run over their alphabet")
        if s == 16:
            out[at : at + n] = [before] * n
        at += n
    bits.at = place
    if place > bits.size:
        raise Corrupt("the stream ends early")
    return out


def _number(bits, code: int) -> int:
    """Length or distance that a prefix symbol begins."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _rounded(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_image(bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as numbers of alpha, red, green, blue from the highest byte down."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("the colour cache is too large")
    group_of, group_bits, groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        group_of = (_read_image(bits, _rounded(width, group_bits), _rounded(height, group_bits), False) >> 8) & 0xFFFF
        groups = int(group_of.max()) + 1
        group_of = group_of.reshape(_rounded(height, group_bits), -1).tolist()
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Code(read_lengths(bits, n)) for n in sizes] for _ in range(groups)]
    total = width * height
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, seen = 32 - cache_bits, 0  # pixels up to `seen` are in the cache
    green, red, blue, alpha, distance = codes[0]
    while len(out) < total:
        if group_of is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, distance = codes[group_of[y >> group_bits][x >> group_bits]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _number(bits, s - 256)
            d = _number(bits, distance.read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > len(out) or len(out) + n > total:
                raise Corrupt("a back-reference leaves the image")
            start = len(out) - d
            if d >= n:
                out += out[start : start + n]
            else:  # it overlaps itself: the stretch repeats
                out += (out[start:] * (n // d + 1))[:n]
        else:
            for p in out[seen:]:
                cache[(CACHE_HASH * p & 0xFFFFFFFF) >> shift] = p
            seen = len(out)
            if cache is None or s - 280 >= len(cache):
                raise Corrupt("a colour-cache index lies outside of the cache")
            out.append(cache[s - 280])
    if bits.at > bits.size:
        raise Corrupt("the stream ends early")
    return np.array(out, dtype=np.int64)


def _channels(pixels: np.ndarray, width: int) -> np.ndarray:
    """height x width x (alpha, red, green, blue)"""
    return np.stack([(pixels >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).reshape(-1, width, 4)


def _half(a, b):
    return (a + b) >> 1


def _toward_zero_half(x):
    return (x + (x < 0)) >> 1


def predicted(mode: int, left, top, top_left, top_right):
    """A pixel's prediction from its neighbours, each (..., 4)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(left))
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 11:
        guess = left + top - top_left
        return np.where((np.abs(guess - left).sum(-1) < np.abs(guess - top).sum(-1))[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        return np.clip(mean + _toward_zero_half(mean - top_left), 0, 255)
    return {
        5: lambda: _half(_half(left, top_right), top),
        6: lambda: _half(left, top_left),
        7: lambda: _half(left, top),
        8: lambda: _half(top_left, top),
        9: lambda: _half(top, top_right),
        10: lambda: _half(_half(left, top_left), _half(top, top_right)),
    }[mode]()


_BLACK = np.array([255, 0, 0, 0])


def _neighbours(image: np.ndarray, y: int, x: int):
    """Left, top, top left, top right; right of the last column stands the row's own first pixel."""
    w = image.shape[1]
    return image[y, x - 1], image[y - 1, x], image[y - 1, x - 1], image[y - 1, x + 1] if x + 1 < w else image[y, 0]


def _mode_at(image, modes, bits, y, x):
    if y == 0:
        return np.array([255, 0, 0, 0]) if x == 0 else image[0, x - 1]
    if x == 0:
        return image[y - 1, 0]
    return predicted(int(modes[y >> bits, x >> bits]), *_neighbours(image, y, x))


_FROM_ABOVE = {2, 3, 4, 8, 9}  # modes that look at the row above only


def undo_predictor(residual: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Row by row; within a row, blocks whose mode needs no neighbour that is decoded just before go in one step."""
    out = residual.astype(np.int64)
    height, width = out.shape[:2]
    out[0, 0] += _BLACK
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for block in range(modes.shape[1]):
            lo, hi = max(1, block << bits), min(width, (block + 1) << bits)
            mode = int(modes[y >> bits, block])
            if lo >= hi:
                continue
            if mode == 1:
                out[y, lo:hi] = (out[y, lo - 1] + np.cumsum(out[y, lo:hi], axis=0)) & 255
            elif mode == 0 or mode > 13:
                out[y, lo:hi] = (out[y, lo:hi] + _BLACK) & 255
            elif mode in _FROM_ABOVE:
                above = np.concatenate([out[y - 1], out[y, :1]])  # right of the last column stands the row's own first pixel
                out[y, lo:hi] = (out[y, lo:hi] + predicted(mode, None, above[lo:hi], above[lo - 1 : hi - 1], above[lo + 1 : hi + 1])) & 255
            else:
                for x in range(lo, hi):
                    out[y, x] = (out[y, x] + predicted(mode, *_neighbours(out, y, x))) & 255
    return out


def do_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    out = image.copy()
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            out[y, x] = (image[y, x] - _mode_at(image, modes, bits, y, x)) & 255
    return out


def _signed(x):
    return (x ^ 128) - 128


def _spread(blocks: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]


def cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """elements: blocks x (alpha, red to blue, green to blue, green to red)"""
    e = _signed(_spread(elements, bits, *image.shape[:2]))
    delta = lambda t, c: (t * _signed(c)) >> 5
    out = image.copy()
    green, sign = image[..., 2], 1 if undo else -1
    out[..., 1] = (image[..., 1] + sign * delta(e[..., 3], green)) & 255
    red = out[..., 1] if undo else image[..., 1]  # the decoded red on either side
    out[..., 3] = (image[..., 3] + sign * (delta(e[..., 2], green) + delta(e[..., 1], red))) & 255
    return out


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def from_palette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Colours of bundled indexes; an index beyond the palette is transparent black."""
    wide = _palette_bits(len(table))
    x = np.arange(width)
    each = 8 >> wide
    index = (image[:, x >> wide, 2] >> ((x & ((1 << wide) - 1)) * each)) & ((1 << each) - 1)
    whole = np.zeros((256, 4), dtype=np.int64)
    whole[: len(table)] = table
    return whole[index]


def decode_stream(bits, width: int, height: int) -> np.ndarray:
    """The image after the header: transforms, pixels, transforms undone."""
    undo, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Corrupt("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            blocks = _channels(_read_image(bits, _rounded(coded, size), _rounded(height, size), False), _rounded(coded, size))
            undo.append((kind, blocks, size))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, n, 1, False), n)[0], axis=0) & 255
            undo.append((kind, table, coded))
            coded = _rounded(coded, _palette_bits(n))
        else:
            undo.append((kind, None, 0))
    image = _channels(_read_image(bits, coded, height, True), coded)
    for kind, data, size in reversed(undo):
        if kind == PREDICTOR:
            image = undo_predictor(image, data[..., 2] & 15, size)
        elif kind == CROSS_COLOUR:
            image = cross_colour(image, data, size, True)
        elif kind == SUBTRACT_GREEN:
            image[..., 1] = (image[..., 1] + image[..., 2]) & 255
            image[..., 3] = (image[..., 3] + image[..., 2]) & 255
        else:
            image = from_palette(image, data, size)
    return image


def _chunk(data: bytes) -> bytes:
    """The VP8L chunk of a file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupt("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise Corrupt("the file ends early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise Corrupt("no lossless image in the file")


def _sides(chunk: bytes) -> tuple[int, int]:
    if len(chunk) < 6 or chunk[0] != 0x2F or chunk[4] >> 5:
        raise Corrupt("no lossless header")
    v = int.from_bytes(chunk[1:5], "little")
    return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1


def decode(data: bytes) -> np.ndarray:
    chunk = _chunk(data)
    width, height = _sides(chunk)
    return decode_stream(Window(chunk, 40), width, height).astype(np.uint8)


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= int(value) << self.at
        self.at += n


def code_lengths(counts, limit: int = LIMIT) -> list[int]:
    """Huffman code lengths of at most `limit`; counts are flattened until they fit.

    Symbols by count and merged nodes by the order of merging are both sorted, so the next two are at the two heads.
    """
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out.tolist()
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].tolist()
    n = len(weights)
    while True:
        nodes, parent = weights + [0] * (n - 1), [0] * (2 * n - 1)
        leaf, inner = 0, n
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner >= made or nodes[leaf] <= nodes[inner]):
                    total += nodes[leaf]
                    parent[leaf] = made
                    leaf += 1
                else:
                    total += nodes[inner]
                    parent[inner] = made
                    inner += 1
            nodes[made] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= limit:
            out[order] = depth[:n]
            return out.tolist()
        weights = [(w + 1) // 2 for w in weights]


def codes_of(lengths) -> np.ndarray:
    """The bits of each symbol's code, in the order in which they are written."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.zeros(len(lengths), dtype=np.int64)
    order = lengths.nonzero()[0]
    if len(order) < 2:
        return out
    order = order[lengths[order].argsort(kind="stable")]
    spans = 1 << (15 - lengths[order])
    out[order] = _REVERSED[15][spans.cumsum() - spans]  # left-aligned in 15 bits
    return out


def write_lengths(w: Writer, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(used[0] > 1, 1)
        w.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.write(used[1], 8)
        return
    steps, place = [], 0  # symbol, extra value, its bits
    for own, run in groupby(lengths[: used[-1] + 1]):
        n = len(list(run))
        place += n
        if own == 0:
            while n > 2:
                part = min(n, 138)
                steps.append((17, part - 3, 3) if part <= 10 else (18, part - 11, 7))
                n -= part
        elif n > 3:
            steps.append((own, 0, 0))
            n -= 1
            while n > 2:
                part = min(n, 6)
                steps.append((16, part - 3, 2))
                n -= part
        steps += [(own, 0, 0)] * n
    counts = [0] * 19
    for s, _, _ in steps:
        counts[s] += 1
    first = code_lengths(counts, 7)
    own = codes_of(first).tolist()
    last = max(k for k, s in enumerate(LENGTH_ORDER) if first[s])
    w.write(0, 1)
    w.write(max(0, last - 3), 4)
    for s in LENGTH_ORDER[: max(4, last + 1)]:
        w.write(first[s], 3)
    w.write(1, 1)  # how many steps follow: at least 2
    steps += [(0, 0, 0)] * (2 - len(steps)) if first[0] else []
    nbits = max(2, (len(steps) - 2).bit_length() + 1 & ~1)
    w.write((nbits - 2) // 2, 3)
    w.write(len(steps) - 2, nbits)
    sizes = first if sum(1 for n in first if n) > 1 else [0] * 19
    value = at = 0
    for s, extra, n in steps:
        value |= (own[s] | extra << sizes[s]) << at
        at += sizes[s] + n
    w.write(value, at)


def _file(chunk: bytes) -> bytes:
    body = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + body


def _head(width: int, height: int) -> bytes:
    return b"\x2f" + (width - 1 | (height - 1) << 14 | 1 << 28).to_bytes(4, "little")


def _coded_number(n: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and its bits of a length or distance from 1 on."""
    v = n - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1


def _write_image(w: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, copies: bool = True, group_bits: int | None = None) -> None:
    """Tokens (literals, cache hits, copies of what stood before), then codes fitted to them, then the bits."""
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    cache = [0] * (1 << cache_bits) if cache_bits else None
    last: dict[tuple, int] = {}
    tokens, i = [], 0
    while i < len(pixels):
        key = tuple(pixels[i : i + 3])
        start, n = last.get(key) if copies and len(key) == 3 else None, 0
        while start is not None and n < 4096 and i + n < len(pixels) and pixels[start + n] == pixels[i + n]:
            n += 1
        slot = (CACHE_HASH * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            tokens.append((i, "copy", n, near.get(i - start, i - start + len(NEAR))))
        elif cache is not None and cache[slot] == pixels[i] and i:
            tokens.append((i, "cache", slot, 0))
        else:
            tokens.append((i, "pixel", pixels[i], 0))
        for j in range(i, i + max(1, n if n >= 3 else 1)):
            last[tuple(pixels[j : j + 3])] = j
            if cache is not None:
                cache[(CACHE_HASH * pixels[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[j]
        i += n if n >= 3 else 1
    w.write(cache_bits > 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    groups = 1
    group_at = lambda at: 0
    if main:
        w.write(group_bits is not None, 1)
        if group_bits is not None:
            groups, across = 2, _rounded(width, group_bits)
            w.write(group_bits - 2, 3)
            chosen = [(x + y) % 2 for y in range(_rounded(len(pixels) // width, group_bits)) for x in range(across)]
            _write_image(w, [255 << 24 | g << 8 for g in chosen], across, False)
            group_at = lambda at: chosen[(at // width >> group_bits) * across + (at % width >> group_bits)]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]

    def symbols(kind, a, b):
        """(which code, symbol, extra value, extra bits) of a token."""
        if kind == "pixel":
            return [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + a, 0, 0)]
        (s, e, n), (t, f, m) = _coded_number(a), _coded_number(b)
        return [(0, 256 + s, e, n), (4, t, f, m)]

    for at, *token in tokens:
        for code, s, _, _ in symbols(*token):
            counts[group_at(at)][code][s] += 1
    lengths = [[code_lengths(c, 15) for c in g] for g in counts]
    for g in lengths:
        for own in g:
            write_lengths(w, own)
    codes = [[codes_of(own).tolist() for own in g] for g in lengths]
    for at, *token in tokens:
        g = group_at(at)
        for code, s, extra, n in symbols(*token):
            if sum(map(bool, lengths[g][code])) > 1:
                w.write(codes[g][code][s], lengths[g][code][s])
            w.write(extra, n)


def _numbers(image: np.ndarray) -> list[int]:
    x = image.astype(np.int64).reshape(-1, 4)
    return (x[:, 0] << 24 | x[:, 1] << 16 | x[:, 2] << 8 | x[:, 3]).tolist()


def encode(image: np.ndarray, predictor: tuple | None = None, cross: tuple | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = True, group_bits: int | None = None) -> bytes:
    """A WebP file of height x width x (alpha, red, green, blue) under the transforms asked for, in this order.

    predictor: (block bits, modes by block); cross: (block bits, elements by block). For images of moderate size.
    """
    height, width = image.shape[:2]
    w, out = Writer(), image.astype(np.int64)
    if predictor:
        bits, modes = predictor
        w.write(1 | PREDICTOR << 1, 3)
        w.write(bits - 2, 3)
        _write_image(w, [255 << 24 | int(m) << 8 for m in modes.reshape(-1)], modes.shape[1], False)
        out = do_predictor(out, modes, bits)
    if cross:
        bits, elements = cross
        w.write(1 | CROSS_COLOUR << 1, 3)
        w.write(bits - 2, 3)
        _write_image(w, _numbers(elements), elements.shape[1], False)
        out = cross_colour(out, elements.astype(np.int64), bits, False)
    if subtract_green:
        w.write(1 | SUBTRACT_GREEN << 1, 3)
        out = out.copy()
        out[..., 1] = (out[..., 1] - out[..., 2]) & 255
        out[..., 3] = (out[..., 3] - out[..., 2]) & 255
    coded = width
    if palette:
        colours, index = np.unique(out.reshape(-1, 4), axis=0, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        w.write(1 | PALETTE << 1, 3)
        w.write(len(colours) - 1, 8)
        _write_image(w, _numbers(np.diff(colours, axis=0, prepend=0) & 255), len(colours), False)
        wide = _palette_bits(len(colours))
        index = index.reshape(height, width)
        coded = _rounded(width, wide)
        green = np.zeros((height, coded), dtype=np.int64)
        for x in range(width):
            green[:, x >> wide] |= index[:, x] << ((x & ((1 << wide) - 1)) * (8 >> wide))
        out = np.zeros((height, coded, 4), dtype=np.int64)
        out[..., 0], out[..., 2] = 255, green
    w.write(0, 1)
    _write_image(w, _numbers(out), coded, True, cache_bits, copies, group_bits)
    return _file(_head(width, height) + w.value.to_bytes((w.at + 7) // 8, "little"))
