"""Operator 6: a lossless WebP (VP8L) codec in numpy and Python, for media columns.

decode() reads prefix codes (simple and normal, several groups), back-references, the colour cache and the four transforms
(predictor, cross-colour, subtract-green, colour indexing), in plain and extended files, and gives pixels as (height, width, 4) uint8 in R, G, B, A
order. Images with one group of codes are parsed by arrays: what a token would be is looked up at every bit of a window at once, and the
tokens that are there are then found by following each one's end. encode() writes the same features, each by an option. store_bytes()
and unpack_bytes() keep byte strings as green samples, 64 a row, in as many images of at most 64 x 16384 as it takes: Huffman codes,
back-references, and the transforms and colour cache that pay for the image.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from functools import lru_cache
from math import log2

import numpy as np

ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)  # fixed by the format
CACHE_MULTIPLIER = 0x1E35A7BD  # fixed by the format
ROW, MOST_ROWS = 64, 16384
#: Shorter back-references cost as much as their pixels; farther ones have no code; cache sizes that are tried; the largest tiles of transforms; lengths up to here are found by arrays.
LEAST_RUN, MOST_FAR, CACHES, WIDEST, FIRST_RUN = 5, (1 << 20) - 120, (2, 5), 9, 20
#: Bits that are parsed together; smaller images are read token by token.
WINDOW, SMALL_IMAGE = 1 << 17, 200
#: More bits than any token has.
BEYOND = 64


def distance_map() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: by distance, then by rows up, then from right to left."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


NEAR = distance_map()


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.n = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        at = self.pos >> 3
        value = int.from_bytes(self.data[at : at + 5], "little") >> (self.pos & 7)
        self.pos += n
        if self.pos > self.n:
            raise ValueError("the stream ends too early")
        return value & ((1 << n) - 1)

    def peek(self) -> int:
        """The next 15 bits at least; zeros beyond the end."""
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 4], "little") >> (self.pos & 7)


class BitWriter:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 512:
            self.put_whole()

    def put_many(self, pairs) -> None:
        """Many (value, n), gathered in one integer."""
        value, n = self.value, self.n
        for v, k in pairs:
            value |= v << n
            n += k
        self.value, self.n = value, n
        self.put_whole()

    def put_array(self, bits: np.ndarray) -> None:
        """Many single bits (uint8 of 0 and 1)."""
        head = [(self.value >> i) & 1 for i in range(self.n)]
        every = np.concatenate([np.array(head, np.uint8), bits.astype(np.uint8, copy=False)])
        whole = len(every) // 8 * 8
        self.parts.append(np.packbits(every[:whole], bitorder="little").tobytes())
        rest = every[whole:]
        self.value, self.n = sum(int(b) << i for i, b in enumerate(rest)), len(rest)

    def put_fields(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many values of up to 18 bits: summed into 32-bit words, where their bits don't meet."""
        self.put_whole()
        v, b = np.concatenate([[self.value], values]).astype(np.uint64), np.concatenate([[self.n], sizes])
        ends = b.cumsum()
        at, total = ends - b, int(ends[-1])
        word = at >> 5
        fresh = np.ones(len(word), bool)
        np.not_equal(word[1:], word[:-1], out=fresh[1:])
        starts = np.flatnonzero(fresh)
        sums, word = np.add.reduceat(v << (at & 31).view(np.uint64), starts), word[starts]
        out = np.zeros(total // 32 + 3, np.uint64)
        out[word] += sums & np.uint64(0xFFFFFFFF)
        out[word + 1] += sums >> np.uint64(32)
        data, whole = out.astype("<u4").tobytes(), total // 8
        self.parts.append(data[:whole])
        self.n = total - 8 * whole
        self.value = data[whole] & ((1 << self.n) - 1)

    def put_whole(self) -> None:
        whole = self.n // 8
        self.parts.append((self.value & ((1 << whole * 8) - 1)).to_bytes(whole, "little"))
        self.value >>= whole * 8
        self.n -= whole * 8

    def done(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) // 8, "little")


@lru_cache(maxsize=16)
def _reversal(n: int) -> np.ndarray:
    """Each number of n bits with its bits in reverse."""
    x = np.arange(1 << n)
    return sum((((x >> i) & 1) << (n - 1 - i) for i in range(n)), np.zeros(1 << n, np.int64))


def canonical(lengths) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol its code as the stream has it, and its length. A lone symbol needs no bits."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    codes = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return codes, np.zeros(len(lengths), np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths[order[-1]])
    room = np.left_shift(1, width - lengths[order])
    ends = room.cumsum()
    if ends[-1] != 1 << width:
        raise ValueError("a prefix code isn't complete")
    codes[order] = _reversal(width)[ends - room]
    return codes, lengths


NOTHING = np.zeros(1, np.int64)


class Prefix:
    """A prefix code for reading. only: its lone symbol, or None; symbols, sizes: by the next `width` bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only, self.pairs, self.width = (used[0] if used else 0) if len(used) < 2 else None, None, 0
        if self.only is not None:
            self.symbols, self.sizes = np.array([self.only]), NOTHING
            return
        n, used = np.array([lengths[s] for s in used]), np.array(used)
        order = np.argsort(n, kind="stable")
        n, used = n[order], used[order]
        self.width = int(n[-1])
        room = np.left_shift(1, self.width - n)
        if room.sum() != 1 << self.width:
            raise ValueError("a prefix code isn't complete")
        turned = _reversal(self.width)
        self.symbols, self.sizes = used.repeat(room)[turned], n.repeat(room)[turned]

    def read(self, bits: Bits) -> int:
        if self.pairs is None:
            self.pairs = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        s, n = self.pairs[bits.peek() & ((1 << self.width) - 1)]
        bits.pos += n
        return s


@lru_cache(maxsize=64)
def _prefix_of(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(list(lengths))


@lru_cache(maxsize=256)
def _lone(symbol: int) -> Prefix:
    return Prefix([0] * symbol + [1])


@lru_cache(maxsize=64)
def _code_of(held: int) -> Prefix:
    """The code of codes' lengths from its own lengths, 3 bits each, in ORDER."""
    own = [0] * 19
    for i, k in enumerate(ORDER):
        own[k] = held >> 3 * i & 7
    return _prefix_of(tuple(own))


def _read_prefix(bits: Bits, alphabet: int) -> Prefix:
    if bits.read(1):
        n = bits.read(1) + 1
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if n == 2:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise ValueError("a symbol beyond the alphabet")
        return _prefix_of(tuple(int(s in symbols) for s in range(max(symbols) + 1))) if n == 2 else _lone(symbols[0])
    n, lengths = 3 * (4 + bits.read(4)), [0] * alphabet
    first = bits.pos >> 3
    code = _code_of((int.from_bytes(bits.data[first : first + 9], "little") >> (bits.pos & 7)) & ((1 << n) - 1))
    bits.pos += n
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    if code.only is not None and code.only < 16:  # one length for all
        n = min(left, alphabet)
        lengths[:n] = [code.only] * n
        return Prefix(lengths)
    pairs, mask = list(zip(code.symbols.tolist(), code.sizes.tolist(), strict=True)), (1 << code.width) - 1
    first = bits.pos >> 3
    held = int.from_bytes(bits.data[first : first + 2 * alphabet], "little") >> (bits.pos & 7)  # 14 bits at most for each length
    while at < alphabet and left:
        left -= 1
        s, n = pairs[held & mask]
        held >>= n
        bits.pos += n
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            least, more = ((3, 2), (3, 3), (11, 7))[s - 16]
            n = least + (held & ((1 << more) - 1))
            held >>= more
            bits.pos += more
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            if s == 16:
                lengths[at : at + n] = [last] * n
            at += n
    if bits.pos > bits.n:
        raise ValueError("the stream ends too early")
    return Prefix(lengths)


#: The least value and the number of extra bits of each prefix of lengths and distances.
EXTRA = np.array([(p + 1, 0) if p < 4 else (((2 + (p & 1)) << ((p - 2) >> 1)) + 1, (p - 2) >> 1) for p in range(40)])
LEAST, MORE = np.ascontiguousarray(EXTRA.T)


def _followed(end: np.ndarray, first: int, n: int) -> np.ndarray:
    """first, end[first], end[end[first]] and so on, as far as below n. From n on, end holds its own places. Every eighth step is found first."""
    eighth = end.take(end)
    eighth = eighth.take(eighth)
    steps, heads, p = memoryview(eighth.take(eighth)), [], first
    while p < n:
        heads.append(p)
        p = steps[p]
    rows = np.empty((8, len(heads)), np.int64)
    rows[0] = heads
    for k in range(1, 8):
        rows[k] = end.take(rows[k - 1])
    starts = rows.T.reshape(-1)
    return starts[: np.searchsorted(starts, n)]


def _parsed(bits: Bits, group, count: int):
    """The tokens of an image with one group of codes: green symbols, runs (1 unless a back-reference), distance codes, and the pixels' other channels."""
    green, far = group[0], group[4]
    others = [None if c.only is not None else c for c in group[1:4]]
    most, tail = int(green.symbols.max()), far.sizes + MORE[far.symbols]  # bits of a distance, by its next bits
    parts, done, pos = [], 0, bits.pos
    while done < count:
        low = pos >> 3
        high = min(len(bits.data), low + WINDOW // 8)
        if high <= low:
            raise ValueError("the stream ends too early")
        words = np.ndarray((high - low + 16,), "<u8", bits.data[low : high + 24] + bytes(24 - max(0, min(24, len(bits.data) - high))), strides=(1,)).copy()
        at = lambda p: words[p >> 3] >> (p & 7).view(np.uint64)  # noqa: B023, E731
        n = 8 * (high - low)
        # what would begin at each bit
        index = ((words[: high - low, None] >> np.arange(8, dtype=np.uint64)).reshape(-1) & np.uint64((1 << green.width) - 1)).view(np.int64)
        symbol, end = green.symbols.take(index), np.arange(n + BEYOND)
        end[:n] += green.sizes.take(index)
        channels = []
        if any(others):
            pixel = np.flatnonzero(symbol < 256)
            p = end[pixel]
            for c in others:
                channels.append(np.zeros(n, np.int64))
                if c:
                    index = (at(p) & np.uint64((1 << c.width) - 1)).view(np.int64)
                    channels[-1][pixel] = c.symbols[index]
                    p = p + c.sizes[index]
            end[pixel] = p

        def referred(link, p):
            """Of back-references whose symbol ends at p: lengths, distances."""
            prefix = symbol[link] - 256  # noqa: B023
            least, more = LEAST[prefix], MORE[prefix]
            run = least + (at(p) & ((1 << more) - 1).view(np.uint64)).view(np.int64)  # noqa: B023
            p = p + more
            index = (at(p) & np.uint64((1 << far.width) - 1)).view(np.int64)  # noqa: B023
            prefix = far.symbols[index]
            least, more = LEAST[prefix], MORE[prefix]
            p = p + far.sizes[index]
            return run, least + (at(p) & ((1 << more) - 1).view(np.uint64)).view(np.int64)  # noqa: B023

        link = np.flatnonzero(symbol >= 256)
        if most >= 280:
            link = link[symbol[link] < 280]
        if len(link):
            p = end[link] + MORE[symbol[link] - 256]
            end[link] = p + tail[(at(p) & np.uint64((1 << far.width) - 1)).view(np.int64)]
        # what does begin
        starts = _followed(end, pos - 8 * low, n)
        p, found = int(end[starts[-1]]), symbol[starts]
        run, distance, own = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64), np.flatnonzero((found >= 256) & (found < 280))
        if len(own):
            run[own], distance[own] = referred(starts[own], starts[own] + green.sizes[(at(starts[own]) & np.uint64((1 << green.width) - 1)).view(np.int64)])
        total = run.cumsum()
        if done + total[-1] >= count:
            last = int(np.searchsorted(total, count - done))
            if done + total[last] != count:
                raise ValueError("a back-reference leaves the image")
            starts = starts[: last + 1]
            p = int(end[starts[-1]])
        k = len(starts)
        parts.append([found[:k], run[:k], distance[:k], *[x[starts] for x in channels]])
        done, pos = done + int(total[k - 1]), 8 * low + p
    bits.pos = pos
    if bits.pos > bits.n:
        raise ValueError("the stream ends too early")
    symbol, run, distance, *channels = (np.concatenate(x) for x in zip(*parts, strict=True))
    return symbol, run, distance, [channels[k] if c else np.full(len(symbol), group[1 + k].only) for k, c in enumerate(others)] if channels else [np.int64(c.only) for c in group[1:4]]


@lru_cache(maxsize=64)
def _near_pixels(width: int) -> np.ndarray:
    """By distance code, from 1 on."""
    return np.array([1, *(max(1, dx + dy * width) for dx, dy in NEAR)])


def _far(distance: np.ndarray, width: int) -> np.ndarray:
    """Distance codes to distances in pixels."""
    return np.where(distance <= 120, _near_pixels(width)[np.minimum(distance, 120)], distance - 120)


def _resolved(symbol, run, distance, channels, width: int, count: int, cache_bits: int) -> np.ndarray:
    """Tokens to pixels as (count, 4)."""
    red, blue, alpha = channels
    at, link = run.cumsum() - run, symbol >= 256
    grey = np.isscalar(red) and not cache_bits
    if cache_bits:
        return _with_cache((alpha << 24 | red << 16 | symbol << 8 | blue) + np.zeros_like(symbol), symbol, run, _far(distance, width), cache_bits)
    if (symbol >= 280).any():
        raise ValueError("a cache symbol without a cache")
    pixels = np.zeros(count, np.uint8 if grey else np.uint32)
    pixels[at[~link]] = symbol[~link] if grey else (alpha << 24 | red << 16 | symbol << 8 | blue)[~link]
    far, at, run = _far(distance[link], width), at[link], run[link]
    if (far > at).any():
        raise ValueError("a back-reference leaves the image")
    if len(run):
        # each pixel's source; then the source's source, and so on, twice as far each time, up to a pixel of its own
        source, ends = np.arange(count), run.cumsum()
        place = np.arange(ends[-1]) + (at - ends + run).repeat(run)
        source[place] -= far.repeat(run)
        while len(place):
            one = source.take(place)
            two = source.take(one)
            moved = two != one
            place = place[moved]
            source[place] = two[moved]
        pixels = pixels.take(source)
    if grey:
        return (pixels.astype("<u4") << np.uint32(8) | np.uint32(int(alpha) << 24 | int(blue) << 16 | int(red))).view(np.uint8).reshape(-1, 4)
    return _rgba(pixels)


def _rgba(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]])


def _with_cache(colours: np.ndarray, symbol: np.ndarray, run: np.ndarray, far: np.ndarray, cache_bits: int) -> np.ndarray:
    cache, shift, pixels, done = [0] * (1 << cache_bits), 32 - cache_bits, [], 0
    for colour, s, n, d in zip(colours.tolist(), symbol.tolist(), run.tolist(), far.tolist(), strict=True):
        if s < 256:
            pixels.append(colour)
        elif s < 280:
            at = len(pixels)
            if d > at:
                raise ValueError("a back-reference leaves the image")
            pixels += pixels[at - d : at - d + n] if d >= n else (pixels[at - d :] * (n // d + 1))[:n]
        else:
            # colours enter the cache as they are decoded; those since the last look-up first
            for p in pixels[done:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
            done = len(pixels)
            pixels.append(cache[s - 280])
    return _rgba(np.array(pixels, np.uint32))


def _extra(bits: Bits, prefix: int) -> int:
    least, n = EXTRA[prefix]
    return int(least) + bits.read(int(n))


def _read_image(bits: Bits, width: int, height: int, main: bool, told: dict | None = None) -> np.ndarray:
    """An entropy-coded image: (width * height, 4) in R, G, B, A. told: gets the numbers of its tokens."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    tiles, tile_bits, across = None, 0, 0
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        across, down = -(-width >> tile_bits), -(-height >> tile_bits)
        found = _read_image(bits, across, down, False).astype(np.int32)
        tiles = (found[:, 0] * 256 + found[:, 1]).tolist()
    groups = [[_read_prefix(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(max(tiles) + 1 if tiles else 1)]
    count = width * height
    if not tiles and all(c.only is not None for c in groups[0][:4]) and groups[0][0].only < 256:
        return np.tile(np.array([groups[0][k].only for k in (1, 0, 2, 3)], np.uint8), (count, 1))
    if not tiles and groups[0][0].only is None and count > SMALL_IMAGE:
        tokens = _parsed(bits, groups[0], count)
        if told is not None:
            told["links"] = told.get("links", 0) + int(((tokens[0] >= 256) & (tokens[0] < 280)).sum())
            told["cached"] = told.get("cached", 0) + int((tokens[0] >= 280).sum())
            told["literals"] = told.get("literals", 0) + int((tokens[0] < 256).sum())
        return _resolved(*tokens, width, count, cache_bits)
    pixels, group, shift = [0] * count, groups[0], 32 - cache_bits
    at = done = 0
    mask = (1 << tile_bits) - 1
    while at < count:
        if tiles and (at % width) & mask == 0 or tiles and group is None:
            group = groups[tiles[(at // width >> tile_bits) * across + (at % width >> tile_bits)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            pixels[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = _extra(bits, s - 256)
            far = _extra(bits, group[4].read(bits))
            if far <= 120:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= 120
            if far > at or at + n > count:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + n):
                pixels[i] = pixels[i - far]
            at += n
            group = None if tiles else group
        else:
            # colours enter the cache as they are decoded; those since the last look-up first
            for p in pixels[done:at]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
            done = at
            pixels[at] = cache[s - 280]
            at += 1
        if bits.pos > bits.n + 32:
            raise ValueError("the stream ends too early")
    if bits.pos > bits.n:
        raise ValueError("the stream ends too early")
    return _rgba(np.array(pixels, np.uint32))


def _guess(mode: int, left, up, corner, right) -> np.ndarray:
    """Predictions of pixels, (n, 4) int16 each, by one of the format's 14 modes."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        # |p - left| with p = left + up - corner
        nearer = np.abs(up - corner).sum(1) < np.abs(left - corner).sum(1)
        return np.where(nearer[:, None], left, up)
    if mode == 13:
        m = mean(left, up)
        return np.clip(m + ((m - corner + (m < corner)) >> 1), 0, 255)
    made = {
        1: lambda: left, 2: lambda: up, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), up), 6: lambda: mean(left, corner), 7: lambda: mean(left, up), 8: lambda: mean(corner, up),
        9: lambda: mean(up, right), 10: lambda: mean(mean(left, corner), mean(up, right)), 12: lambda: np.clip(left + up - corner, 0, 255),
    }.get(mode)
    return made() if made else np.array([0, 0, 0, 255], np.int16) + np.zeros_like(left)


def _residual(pixels: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Pixels less their predictions by one mode, by array operations."""
    if mode in (1, 2):
        p = pixels.reshape(-1, width, 4)
        out = p.copy()
        out[0, :1, 3] += np.uint8(1)
        out[0, 1:] -= p[0, :-1]
        out[1:, 0] -= p[:-1, 0]
        out[1:, 1:] -= p[1:, :-1] if mode == 1 else p[:-1, 1:]
        return out.reshape(-1, 4)
    p = pixels.astype(np.int16)
    guess = np.empty_like(p)
    guess[0] = (0, 0, 0, 255)
    guess[1:width] = p[: width - 1]
    guess[width::width] = p[:-width:width]
    i = np.arange(width, len(p))
    i = i[i % width > 0]
    guess[i] = _guess(mode, p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
    return ((p - guess) & 255).astype(np.uint8)


def _predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, size_bits: int, invert: bool) -> np.ndarray:
    """Add (invert) or take away the predictions. modes: the green channel of the transform's image."""
    only = int(modes[0]) & 15 if len(modes) and (modes == modes[0]).all() else None
    if only is not None and not invert:
        return _residual(pixels.reshape(-1, 4), width, only)
    if only in (1, 2):
        p = pixels.reshape(height, width, 4).copy()
        p[0, :1, 3] += np.uint8(255)
        edge, way = (p[:, 0], 1) if only == 1 else (p[0], 0)
        edge[:] = edge.cumsum(0, dtype=np.uint8)
        return p.cumsum(way, dtype=np.uint8).reshape(-1, 4)
    given, across, n = pixels.reshape(-1, 4).astype(np.int16), -(-width >> size_bits), width * height
    y, x = np.divmod(np.arange(n), width)
    mode = np.where((x > 0) & (y > 0), modes.astype(np.int64)[(y >> size_bits) * across + (x >> size_bits)] & 15, 14)
    if not invert:
        out = np.empty_like(given)
        for m in np.unique(mode):
            i = np.flatnonzero(mode == m)
            out[i] = given[i] - _at(given, i, int(m), width)
        return (out & 255).astype(np.uint8)
    # pixels of one front, x + 2 y, need only those of earlier fronts
    out, front = np.zeros_like(given), x + 2 * y
    order = np.lexsort((mode, front))
    key = front[order] * 16 + mode[order]
    for some in np.split(order, np.flatnonzero(np.diff(key)) + 1):
        out[some] = (given[some] + _at(out, some, int(mode[some[0]]), width)) & 255
    return out.astype(np.uint8)


def _at(p: np.ndarray, i: np.ndarray, mode: int, width: int) -> np.ndarray:
    """Predictions of the pixels i from p. Mode 14: the first row and column. Right of the last column is the first pixel of the row at hand."""
    if mode < 14:
        return _guess(mode, p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
    return np.where((i == 0)[:, None], np.array([0, 0, 0, 255], np.int16), p[np.where(i < width, i - 1, i - width)])


def _cross_colour(pixels: np.ndarray, width: int, height: int, elements: np.ndarray, size_bits: int, invert: bool) -> np.ndarray:
    """elements: the transform's image; blue, green, red hold green-to-red, green-to-blue, red-to-blue."""
    at = np.arange(width * height)
    tile = (at // width >> size_bits) * -(-width >> size_bits) + (at % width >> size_bits)
    e, p = elements.astype(np.int8).astype(np.int32)[tile], pixels.astype(np.int32)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, c: (t * signed(c)) >> 5
    sign, out = 1 if invert else -1, p.copy()
    out[:, 0] = (p[:, 0] + sign * delta(e[:, 2], p[:, 1])) & 255
    red = out[:, 0] if invert else p[:, 0]
    out[:, 2] = (p[:, 2] + sign * (delta(e[:, 1], p[:, 1]) + delta(e[:, 0], red))) & 255
    return out.astype(np.uint8)


def _bundle_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes, told: dict | None = None) -> np.ndarray:
    """A RIFF/WebP file with one lossless image to (height, width, 4) uint8. told: gets the numbers of tokens and the transforms."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    at = 12
    while data[at : at + 4] != b"VP8L":  # extended files have other chunks around it
        if at + 8 > len(data):
            raise ValueError("not a lossless WebP")
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        at += 8 + n + n % 2
    bits = Bits(data[at + 8 : at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            size_bits = bits.read(3) + 2
            undo.append((kind, width, size_bits, _read_image(bits, -(-width >> size_bits), -(-height >> size_bits), False)))
        elif kind == 2:
            undo.append((kind, width, 0, None))
        else:
            size = bits.read(8) + 1
            palette = np.cumsum(_read_image(bits, size, 1, False), 0, dtype=np.uint8)
            undo.append((kind, width, _bundle_bits(size), palette))
            width = -(-width >> _bundle_bits(size))
    pixels = _read_image(bits, width, height, True, told)
    if told is not None:
        told.setdefault("transforms", set()).update(("predictor", "cross-colour", "subtract-green", "palette")[k] for k, *_ in undo)
    for kind, wide, size_bits, image in reversed(undo):
        if kind == 0:
            pixels = _predictor(pixels, wide, height, image[:, 1], size_bits, True)
        elif kind == 1:
            pixels = _cross_colour(pixels, wide, height, image, size_bits, True)
        elif kind == 2:
            pixels = pixels.copy()
            pixels[:, 0] += pixels[:, 1]
            pixels[:, 2] += pixels[:, 1]
        else:
            index = pixels[:, 1].reshape(height, -1)
            if size_bits:
                each = 8 >> size_bits
                index = ((index[:, :, None] >> (np.arange(1 << size_bits) * each).astype(np.uint8)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            full = np.zeros((256, 4), np.uint8)  # beyond the palette: transparent black
            full[: len(image)] = image
            pixels = full[index.reshape(-1)]
    return pixels.reshape(height, wide, 4)


def code_lengths(counts, most: int = 15) -> list[int]:
    """Lengths of a Huffman code of at most `most` bits: counts are flattened until it fits. Leaves and inner nodes are two queues in order of weight."""
    return _code_lengths(np.asarray(counts), most).tolist()


#: More than any sum of counts: the end of a queue.
NO_MORE = 1 << 62


def _code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    lengths, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights, m = counts[order].tolist(), len(order)
    while True:
        w, made, parent, leaf, inner = [*weights, NO_MORE], [NO_MORE] * m, [0] * (2 * m - 1), 0, 0
        for k in range(m - 1):
            first, other = w[leaf], made[inner]
            if first <= other:
                parent[leaf] = k
                leaf += 1
            else:
                first = other
                parent[m + inner] = k
                inner += 1
            second, other = w[leaf], made[inner]
            if second <= other:
                parent[leaf] = k
                leaf += 1
            else:
                second = other
                parent[m + inner] = k
                inner += 1
            made[k] = first + second
        depth = [0] * (m - 1)
        for k in range(m - 3, -1, -1):
            depth[k] = depth[parent[m + k]] + 1
        own = [depth[k] + 1 for k in parent[:m]]
        if max(own) <= most:
            lengths[order] = own
            return lengths
        weights = [(c + 1) // 2 for c in weights]


def _put_simple(w: BitWriter, symbols: list[int]) -> None:
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    wide = symbols[0] > 1
    w.put(int(wide), 1)
    w.put(symbols[0], 8 if wide else 1)
    if len(symbols) == 2:
        w.put(symbols[1], 8)


#: The code in which codes' lengths (0 to 15, and runs 16 to 18) are written: one for all images, as making one for each takes longer than its some ten bytes
#: are worth. Lengths of 5 to 8 are the commonest.
LENGTHS = (4, 6, 6, 5, 4, 3, 3, 3, 3, 4, 5, 6, 6, 6, 7, 7, 5, 4, 4)
LAST = max(i for i, k in enumerate(ORDER) if LENGTHS[k]) + 1


@lru_cache(maxsize=1)
def _length_code() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Its codes with their sizes, and what it is written as."""
    codes, sizes = canonical(LENGTHS)
    head = [(max(LAST, 4) - 4, 4), *((LENGTHS[k], 3) for k in ORDER[: max(LAST, 4)]), (0, 1)]
    return list(zip(codes.tolist(), sizes.tolist(), strict=True)), head


def _put_prefix(w: BitWriter, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Write a code's lengths; gives canonical(lengths)."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        _put_simple(w, used.tolist() or [0])
        return canonical(lengths)
    w.put(0, 1)
    at, (codes, head) = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist()], _length_code()
    fields, at_end = list(head), [*at[1:], len(lengths)]

    def put(k, extra, more):
        code, size = codes[k]
        fields.append((code | extra << size, size + more))

    for value, a, b in zip(lengths[at].tolist(), at, at_end, strict=True):
        n = b - a
        if value:
            fields.append(codes[value])
            n -= 1
            while n >= 3:
                put(16, min(n, 6) - 3, 2)
                n -= min(n, 6)
        else:
            while n >= 3:
                take = min(n, 138)
                put(*((17, take - 3, 3) if take <= 10 else (18, take - 11, 7)))
                n -= take
        if n > 0:
            fields += [codes[value]] * n
    w.put_many(fields)
    return canonical(lengths)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values >= 1 as prefixes, extra bits' values, their numbers."""
    prefix = np.searchsorted(LEAST, values, "right") - 1
    return prefix, values - LEAST[prefix], MORE[prefix]


@lru_cache(maxsize=64)
def _near_codes(width: int) -> np.ndarray:
    """The code of each distance that has a short one, else 0."""
    back = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR)))}
    out = np.zeros(max(back) + 1, np.int64)
    for far, code in back.items():
        out[far] = code
    return out


def _links(argb: np.ndarray) -> np.ndarray:
    """Back-references (start, length, distance), greedy from the left: each to the last place with the same next 4 pixels."""
    n, out = len(argb), []
    if n <= LEAST_RUN:
        return np.empty((0, 3), np.int64)
    key = argb[: n - 3].copy()
    for k in (1, 2, 3):
        key = (key ^ key >> np.uint32(15)) * np.uint32(0x9E3779B1) + argb[k : n - 3 + k]
    key *= np.uint32(0x85EBCA6B)
    if n <= 1 << 14:
        key = (key >> np.uint32(16)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    i, was = order[same + 1], order[same]
    good = i - was <= MOST_FAR
    for k in range(4):
        good &= argb[i + k] == argb[was + k]
    i, was = i[good], was[good]
    order = np.argsort(i)
    i, was = i[order], was[order]
    run, going, ended = np.full(len(i), 4), np.arange(len(i)), np.append(argb, ~argb[-1])
    for k in range(4, FIRST_RUN):
        going = going[ended[i[going] + k] == argb[was[going] + k]]
        if not len(going):
            break
        run[going] = k + 1
        going = going[i[going] + k + 1 < n]
    some = run >= LEAST_RUN
    starts, sources, runs, data, k = i[some].tolist(), was[some].tolist(), run[some].tolist(), None, 0
    while k < len(starts):
        at, was, run = starts[k], sources[k], runs[k]
        if run == FIRST_RUN:
            data, most = data or argb.tobytes(), min(4096, n - at)
            while run < most:
                x = data[4 * (at + run) : 4 * (at + run + 64)]
                y = data[4 * (was + run) : 4 * (was + run) + len(x)]
                if x != y:
                    d = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
                    run += (d & -d).bit_length() - 1 >> 5
                    break
                run += len(x) // 4
            run = min(run, most)
        out.append((at, run, at - was))
        k = bisect_left(starts, at + run, k + 1)
    return np.array(out, np.int64).reshape(-1, 3)


def _cost(values: np.ndarray, size: int = 256) -> float:
    """Bits of values in an ideal prefix code, and some for the code itself."""
    c = np.bincount(values, minlength=size)
    c = c[c > 0]
    return len(values) * log2(len(values)) - float(c @ np.log2(c)) + 5 * len(c) if len(c) > 1 else 0.0


def _cache_hits(argb: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot, and whether the last pixel of that slot has its colour."""
    slots = (argb * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    hits = np.zeros(len(argb), bool)
    hits[order[1:]] = (slots[order[1:]] == slots[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    return slots.astype(np.int64), hits


def _put_image(w: BitWriter, pixels: np.ndarray, width: int, main: bool, cache_bits: int | None = 0, links: bool = False, tile_bits: int = 0) -> None:
    """Any image, in tokens with Huffman codes. cache_bits: None takes the cheapest of CACHES; tile_bits: several groups of codes, dealt to tiles in turn."""
    p = pixels.astype(np.uint32)
    argb = p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]
    n = len(argb)
    linked = _links(argb) if links else np.empty((0, 3), np.int64)
    inside = np.zeros(n + 1, np.int8)
    inside[linked[:, 0]] += 1
    np.subtract.at(inside, linked[:, 0] + linked[:, 1], 1)
    single = np.flatnonzero(inside[:n].cumsum(dtype=np.int8) == 0)
    channels = [p[single, k].astype(np.int64) for k in (1, 0, 2, 3)]
    if cache_bits is None:
        costs = {0: sum(map(_cost, channels))}
        for c in CACHES:
            slots, hits = (x[single] for x in _cache_hits(argb, c))
            costs[c] = _cost(np.where(hits, 280 + slots, channels[0])) + sum(_cost(x[~hits]) for x in channels[1:])
        cache_bits = min(costs, key=lambda c: (costs[c], c))
    hit = np.zeros(len(single), bool)
    if cache_bits:
        slots, hits = (x[single] for x in _cache_hits(argb, cache_bits))
        hit, channels[0] = hits, np.where(hits, 280 + slots, channels[0])
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    n_groups, across = 1, 0
    if main:
        w.put(int(tile_bits > 0), 1)
        if tile_bits:
            across, down = -(-width >> tile_bits), -(-(n // width) >> tile_bits)
            n_groups = min(2, across * down)
            w.put(tile_bits - 2, 3)
            deal = np.zeros((across * down, 4), np.uint8)
            deal[:, 1], deal[:, 3] = np.arange(across * down) % n_groups, 255
            _put_image(w, deal, across, False)
    near = _near_codes(width)
    far = linked[:, 2]
    far = np.where((far < len(near)) & (near[np.minimum(far, len(near) - 1)] > 0), near[np.minimum(far, len(near) - 1)], far + 120)
    (run_code, run_extra, run_bits), (far_code, far_extra, far_bits) = _prefixes(linked[:, 1]), _prefixes(far)
    at = np.concatenate([single, linked[:, 0]])
    group = ((at // width >> tile_bits) * across + (at % width >> tile_bits)) % n_groups if tile_bits else np.zeros(len(at), np.int64)
    # four fields a token: green, red, blue, alpha or a cache slot; or length, its extra bits, distance, its extra bits
    value, size = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)
    m = len(single)
    value[m:, 1], size[m:, 1], value[m:, 3], size[m:, 3] = run_extra, run_bits, far_extra, far_bits
    first = np.concatenate([channels[0], 256 + run_code])
    for g in range(n_groups):
        own = group == g
        pixel, link = np.flatnonzero(own[:m] & ~hit), np.flatnonzero(own[m:])
        fields = [(np.flatnonzero(own), 0, first[own], 280 + (1 << cache_bits if cache_bits else 0))]
        fields += [(pixel, k, channels[k][pixel], 256) for k in (1, 2, 3)] + [(m + link, 2, far_code[link], 40)]
        for rows, k, symbols, alphabet in fields:
            counts = np.bincount(symbols, minlength=alphabet)
            used = np.flatnonzero(counts).tolist()
            if len(used) < 2 and (not used or used[0] < 256):
                _put_simple(w, used or [0])
                continue
            codes, sizes = _put_prefix(w, code_lengths(counts))
            value[rows, k], size[rows, k] = codes[symbols], sizes[symbols]
    order = np.argsort(at, kind="stable")
    for lo in range(0, len(order), 1 << 16):
        some = order[lo : lo + (1 << 16)]
        v, b = value[some].reshape(-1), size[some].reshape(-1)
        v, b = v[b > 0], b[b > 0]
        w.put_fields(v, b)


def _riff(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def _head(width: int, height: int) -> BitWriter:
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def encode(image: np.ndarray, *, predictor: int | None = None, cross=None, subtract_green=False, palette=False, cache_bits: int | None = 0, links=False, tile_bits=0, size_bits=2) -> bytes:
    """(height, width, 4) uint8 to a lossless WebP. predictor: a mode, or -1 for all in turn; cross: (green-to-red, green-to-blue, red-to-blue)."""
    height, width = image.shape[:2]
    w, pixels = _head(width, height), np.ascontiguousarray(image).reshape(-1, 4)
    tiles = -(-width >> size_bits) * -(-height >> size_bits)
    if palette:
        colours, index = np.unique(pixels.view(np.uint32).reshape(-1), return_inverse=True)
        colours = colours.view(np.uint8).reshape(-1, 4)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(colours) - 1, 8)
        _put_image(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8), len(colours), False)
        pixels, width = _indexed(index.reshape(-1).astype(np.uint8), width, height, len(colours))
        pixels = np.stack([np.zeros_like(pixels), pixels, np.zeros_like(pixels), np.full_like(pixels, 255)], 1)
    if predictor is not None:
        tiles = -(-width >> size_bits) * -(-height >> size_bits)
        modes = np.arange(tiles) % 14 if predictor < 0 else np.full(tiles, predictor)
        shown = np.zeros((tiles, 4), np.uint8)
        shown[:, 1], shown[:, 3] = modes, 255
        w.put(1, 1)
        w.put(0, 2)
        w.put(size_bits - 2, 3)
        _put_image(w, shown, -(-width >> size_bits), False)
        pixels = _predictor(pixels, width, height, modes, size_bits, False)
    if cross is not None:
        shown = np.zeros((tiles, 4), np.uint8)
        shown[:] = np.array([cross[2], cross[1], cross[0], -1]).astype(np.int8).view(np.uint8)
        w.put(1, 1)
        w.put(1, 2)
        w.put(size_bits - 2, 3)
        _put_image(w, shown, -(-width >> size_bits), False)
        pixels = _cross_colour(pixels, width, height, shown, size_bits, False)
    if subtract_green:
        w.put(1, 1)
        w.put(2, 2)
        pixels = pixels.copy()
        pixels[:, 0] -= pixels[:, 1]
        pixels[:, 2] -= pixels[:, 1]
    w.put(0, 1)
    _put_image(w, pixels, width, True, cache_bits, links, tile_bits)
    return _riff(w.done())


def _indexed(index: np.ndarray, width: int, height: int, size: int) -> tuple[np.ndarray, int]:
    """Palette indices, bundled as the format asks for small palettes."""
    b = _bundle_bits(size)
    if not b:
        return index, width
    across, each = -(-width >> b), 8 >> b
    full = np.zeros((height, across << b), np.uint8)
    full[:, :width] = index.reshape(height, width)
    full = full.reshape(height, across, 1 << b) << (np.arange(1 << b) * each).astype(np.uint8)
    return np.bitwise_or.reduce(full, 2).reshape(-1), across


def chosen(image: np.ndarray) -> dict:
    """Options of encode() for an image: palette, or the predictor and colour transform of the least entropy.

    All 14 predictors are tried where one of left and up beats no predictor."""
    height, width = image.shape[:2]
    pixels = np.ascontiguousarray(image).reshape(-1, 4)
    packed = pixels.view(np.uint32).reshape(-1)
    one_channel = not np.any(packed & np.frombuffer(b"\xff\0\xff\0", np.uint32)) and (pixels[:, 3] == 255).all()

    def coloured(p):
        base = {"cross": None, "subtract_green": False}
        if one_channel:  # red and blue are 0: colour transforms can only add to them
            return _cost(p[:, 1]), base
        options = [(sum(_cost(p[:, k]) for k in range(4)), base)]
        if p[:, 0].any() or p[:, 2].any():
            q = p.copy()
            q[:, 0] -= q[:, 1]
            q[:, 2] -= q[:, 1]
            options.append((sum(_cost(q[:, k]) for k in range(4)), base | {"subtract_green": True}))
            green, red, blue = (p[:, k].astype(np.int8).astype(np.float64) for k in (1, 0, 2))
            fit = lambda y, x: int(np.clip(np.round(32 * (x @ y) / max(1.0, x @ x)), -128, 127))
            to_red, to_blue = fit(red, green), fit(blue, green)
            cross = (to_red, to_blue, fit(blue - green * to_blue / 32, red))
            tiles = -(-width >> WIDEST) * -(-height >> WIDEST)
            element = np.tile(np.array([cross[2], cross[1], cross[0], -1]).astype(np.int8).view(np.uint8), (tiles, 1))
            q = _cross_colour(p, width, height, element, WIDEST, False)
            options.append((sum(_cost(q[:, k]) for k in range(4)) + 60, base | {"cross": cross}))
        return min(options, key=lambda o: o[0])

    tried = [(*coloured(pixels), None)]
    tried += [(*coloured(_residual(pixels, width, mode)), mode) for mode in (1, 2)]
    if min(tried[1:], key=lambda o: o[0])[0] < tried[0][0]:
        tried += [(*coloured(_residual(pixels, width, mode)), mode) for mode in (0, *range(3, 14))]
    cost, options, mode = min(tried, key=lambda o: o[0])
    colours = np.flatnonzero(np.bincount(pixels[:, 1], minlength=256)) if one_channel else np.unique(packed)
    if len(colours) <= 256:
        to_index = np.zeros(256, np.uint8)
        if one_channel:
            to_index[colours] = np.arange(len(colours))
        index = to_index[pixels[:, 1]] if one_channel else np.searchsorted(colours, packed).astype(np.uint8)
        bundled, _ = _indexed(index, width, height, len(colours))
        if _cost(bundled) + 5 * len(colours) < cost:
            return {"palette": True}
    return options | {"predictor": mode}


def _byte_links(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references of bytes (starts, lengths, distances), greedy from the left: each to the last place with the same next 5 bytes; one is
    left out where the next byte's is longer by two."""
    n, none = len(x), np.empty(0, np.int64)
    m = n - LEAST_RUN
    if m < 1:
        return none, none, none
    data = x.tobytes()
    words = np.ndarray((n + 24,), "<u8", data + bytes(32), strides=(1,)).copy()
    # places in order of (the next 5 bytes, place): 40 and 20 bits
    order = np.sort((words[:m] & np.uint64((1 << 40) - 1)) << np.uint64(20) | np.arange(m, dtype=np.uint64))
    same = np.flatnonzero((order[1:] ^ order[:-1]) < (1 << 20))
    at = (order & np.uint64((1 << 20) - 1)).view(np.int64)
    was = np.full(m, -1)
    was[at[same + 1]] = at[same]
    starts = np.flatnonzero(was >= 0)
    if not len(starts):
        return none, none, none
    was = was[starts]
    starts, was = starts[starts - was <= MOST_FAR], was[starts - was <= MOST_FAR]
    run, going = np.full(len(starts), LEAST_RUN), np.arange(len(starts))
    for k in (LEAST_RUN, LEAST_RUN + 8):
        differ = words[starts[going] + k] ^ words[was[going] + k]
        same = np.bitwise_count(~differ & (differ - np.uint64(1))) >> np.uint8(3)  # equal bytes of 8
        run[going] += same
        going = going[same == 8]
    run = np.minimum(run, n - starts)
    later = np.flatnonzero((np.diff(starts) == 1) & (run[1:] > run[:-1] + 1))
    keep = np.ones(len(starts), bool)
    keep[later] = False
    starts, was, run = starts[keep], was[keep], run[keep]
    before = np.zeros(n + 1, np.int64)  # how many places come before each byte
    before[starts + 1] = 1
    after = before.cumsum().take(starts + run)
    after[run >= LEAST_RUN + 16] = -1  # may go on
    after, first, sources, runs, k, picked, longer = memoryview(after), memoryview(starts), memoryview(was), memoryview(run), 0, [], []
    last = len(first)
    while k < last:
        picked.append(k)
        following = after[k]
        if following >= 0:
            k = following
            continue
        at, source, n_same, most = first[k], sources[k], runs[k], min(4096, n - first[k])
        while n_same < most:
            a, b = data[at + n_same : at + n_same + 64], data[source + n_same : source + n_same + 64]
            if a[: len(b)] != b[: len(a)] or len(a) < 64:
                d = int.from_bytes(a, "little") ^ int.from_bytes(b[: len(a)], "little")
                n_same += (d & -d).bit_length() - 1 >> 3 if d else len(a)
                break
            n_same += 64
        n_same = min(n_same, most)
        longer.append((len(picked) - 1, n_same))
        k = bisect_left(first, at + n_same, k + 1)
    picked = np.array(picked)
    starts, was, run = starts.take(picked), was.take(picked), run.take(picked)
    for i, n_same in longer:
        run[i] = n_same
    return starts, run, starts - was


#: The slot of each grey sample in the smallest cache.
GREY_SLOTS = ((np.uint32(0xFF000000) | np.arange(256, dtype=np.uint32) << np.uint32(8)) * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - CACHES[0])).astype(np.uint8)


def _cache_pays(x: np.ndarray) -> bool:
    """Whether the smallest cache would make the literals' code cheaper."""
    if len(x) < 64:
        return False
    slots = GREY_SLOTS.take(x)
    order = np.argsort(slots, kind="stable")
    ordered = x.take(order)
    hits = np.zeros(len(x), bool)
    hits[order[1:]] = ordered[1:] == ordered[:-1]  # equal colours have equal slots
    return bool(hits.any()) and _cost(np.where(hits, np.int64(280) + slots, x)) < _cost(x)


def _put_channel(w: BitWriter, x: np.ndarray, width: int) -> bool:
    """The main image where only green varies, in one group of codes. False, with nothing written, where a cache would pay."""
    starts, runs, fars = _byte_links(x)
    n = len(x)
    free, ends = np.ones(n, bool), runs.cumsum()
    free[np.arange(runs.sum()) + (starts - ends + runs).repeat(runs)] = False
    literals = x[free]
    if _cache_pays(literals):
        return False
    near = _near_codes(width)
    short = near[np.minimum(fars, len(near) - 1)]
    (run_code, run_extra, run_bits), (far_code, far_extra, far_bits) = _prefixes(runs), _prefixes(np.where((fars < len(near)) & (short > 0), short, fars + 120))
    w.put(0, 2)  # neither cache nor groups
    green = np.concatenate([np.bincount(literals, minlength=256), np.bincount(run_code, minlength=24)])
    codes, sizes = _put_prefix(w, _code_lengths(green))
    _put_simple(w, [0])
    _put_simple(w, [0])
    _put_simple(w, [255])
    far_codes, far_sizes = _put_prefix(w, _code_lengths(np.bincount(far_code, minlength=40)))
    # a back-reference takes two fields, at its first two pixels
    index = x.astype(np.intp)
    value, size = codes.take(index), sizes.take(index) * free
    value[starts], size[starts] = codes[256 + run_code] | run_extra << sizes[256 + run_code], sizes[256 + run_code] + run_bits
    value[starts + 1], size[starts + 1] = far_codes[far_code] | far_extra << far_sizes[far_code], far_sizes[far_code] + far_bits
    some = np.flatnonzero(size)
    for low in range(0, len(some), 1 << 16):
        part = some[low : low + (1 << 16)]
        w.put_fields(value.take(part), size.take(part))
    return True


def _plain(samples: np.ndarray) -> bool:
    """Whether neither palette nor predictor makes grey samples cheaper: then chosen() needs no look at whole pixels."""
    n, x, every = len(samples), samples.reshape(-1, ROW), np.empty((3, len(samples)), np.uint8)
    every[:] = samples
    left, up = every[1:].reshape(2, -1, ROW)
    left[:, 1:] -= x[:, :-1]
    left[1:, 0] -= x[:-1, 0]
    up[1:] -= x[:-1]
    up[0, 1:] -= x[0, :-1]
    # the three _cost(), counted together
    counts = np.bincount((every + np.array([[0], [256], [512]])).reshape(-1), minlength=768).reshape(3, 256)
    used, same = np.count_nonzero(counts, 1).tolist(), (counts * np.log2(np.maximum(counts, 1))).sum(1).tolist()
    cost, *others = (n * log2(n) - e + 5 * m if m > 1 else 0.0 for e, m in zip(same, used, strict=True))
    return used[0] > 16 and cost <= min(others)


def store_rows(samples: np.ndarray) -> bytes:
    """A multiple of 64 samples (at most 64 x 16384) to one image in green, with the options chosen for it, back-references and a colour cache where it pays."""
    if _plain(samples):
        w = _head(ROW, len(samples) // ROW)
        w.put(0, 1)
        if _put_channel(w, samples, ROW):
            return _riff(w.done())
    image = np.zeros((len(samples) // ROW, ROW, 4), np.uint8)
    image[:, :, 1], image[:, :, 3] = samples.reshape(-1, ROW), 255
    return encode(image, **chosen(image), links=True, cache_bits=None, size_bits=WIDEST)


def store_bytes(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as one or more images, one after the other."""
    return _in_images(payload, store_rows)


def _in_images(payload: bytes, one) -> bytes:
    if not payload or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    samples, most = np.frombuffer(payload, np.uint8), ROW * MOST_ROWS
    return b"".join(one(samples[i : i + most]) for i in range(0, len(samples), most))


def images(media: bytes, told: dict | None = None):
    """The images of a media value, decoded."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield decode(media[at : at + size], told)
        at += size


def unpack_bytes(media: bytes, told: dict | None = None) -> np.ndarray:
    """The grey samples of all images."""
    return np.concatenate([np.ascontiguousarray(p[:, :, 1]).reshape(-1) for p in images(media, told)])
