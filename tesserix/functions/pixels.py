"""Image kernels in numpy: degradations of RGB images (height, width, 3) of uint8, and forensic statistics.

Codecs and resamplers follow their textbook definitions; results are close to those of image libraries, not equal to the bit.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np

LUMA = np.array([0.299, 0.587, 0.114])
#: Quantisation tables of the JPEG standard's annex K (fixed values), row by row.
Q_LUMA = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
).reshape(8, 8)
Q_CHROMA = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32).reshape(8, 8)
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
TO_RGB = np.linalg.inv(TO_YCC)


def dct_matrix(n: int = 8) -> np.ndarray:
    u, r = np.mgrid[:n, :n]
    return np.where(u == 0, math.sqrt(1 / n), math.sqrt(2 / n)) * np.cos(math.pi * (2 * r + 1) * u / (2 * n))


DCT, DCT_32 = dct_matrix(), dct_matrix(32)


def rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    b = blocks_of(np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge"))
    c = np.rint(DCT @ b @ DCT.T / table) * table
    back = DCT.T @ c @ DCT
    return back.swapaxes(1, 2).reshape(b.shape[0] * 8, -1)[:h, :w]


def jpeg(image: np.ndarray, quality: float) -> np.ndarray:
    """What quantisation at a quality leaves: 8 x 8 DCT per plane, chroma at half size."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((q * scale + 50) / 100), 1, 255) for q in (Q_LUMA, Q_CHROMA)]
    ycc = image.astype(np.float64) @ TO_YCC.T
    h, w = image.shape[:2]
    out = [_quantised(ycc[:, :, 0] - 128, tables[0]) + 128]
    for k in (1, 2):
        p = np.pad(ycc[:, :, k], ((0, h % 2), (0, w % 2)), "edge")
        half = _quantised(p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)), tables[1])
        out.append(half.repeat(2, 0).repeat(2, 1)[:h, :w])
    return rounded(np.stack(out, 2) @ TO_RGB.T)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of 2 max(1, round(3 sigma)) + 1 taps; borders mirrored without repeating the edge."""
    r = max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return rounded(_separable(image.astype(np.float64), k / k.sum()))


def _separable(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    r = len(k) // 2
    for axis in (0, 1):
        n = x.shape[axis]
        at = np.abs(np.arange(-r, n + r))
        at = np.where(at >= n, np.maximum(0, 2 * n - 2 - at), at) if n > 1 else np.zeros(n + 2 * r, int)
        p = np.take(x, at, axis)
        x = sum(w * np.take(p, np.arange(i, i + n), axis) for i, w in enumerate(k))
    return x


def _triangle(t: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(t))


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a, 0))


def _lanczos(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)


#: Resampling filters and how far they reach at the scale of the smaller step.
FILTERS = {"bilinear": (_triangle, 1), "bicubic": (_cubic, 2), "lanczos": (_lanczos, 3)}


@lru_cache(64)
def _resampling(n: int, size: int, kind: str) -> np.ndarray:
    of, _ = FILTERS[kind]
    step = n / size
    wide = max(1.0, step)
    centre = (np.arange(size) + 0.5) * step
    weights = of(((np.arange(n) + 0.5)[None, :] - centre[:, None]) / wide)
    return weights / weights.sum(1, keepdims=True)


def resample(image: np.ndarray, height: int, width: int, kind: str = "bilinear") -> np.ndarray:
    """By a filter of FILTERS, as wide as the step when shrinking."""
    x = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        x = np.moveaxis(np.tensordot(_resampling(x.shape[axis], size, kind), x, (1, axis)), 0, axis)
    return rounded(x)


def down_up(image: np.ndarray, scale: float, kind: str = "bilinear") -> np.ndarray:
    """Shrunk by one of FILTERS, then scaled back."""
    h, w = image.shape[:2]
    return resample(resample(image, max(1, round(h * scale)), max(1, round(w * scale)), kind), h, w)


def reencoded(image: np.ndarray, generations: int, quality: float = 95) -> np.ndarray:
    """What so many compressions in turn leave."""
    for _ in range(generations):
        image = jpeg(image, quality)
    return image


def noise(image: np.ndarray, sigma: float, seed: int | None = None) -> np.ndarray:
    """Gaussian noise on [0, 1]; the seed is the content's CRC unless given; values are cut, not rounded."""
    rng = np.random.Generator(np.random.Philox(zlib.crc32(np.ascontiguousarray(image).tobytes()) if seed is None else seed))
    return (np.clip(image / 255 + rng.normal(0, sigma, image.shape), 0, 1) * 255).astype(np.uint8)


def jitter(image: np.ndarray, amount: float) -> np.ndarray:
    """Brightness, then contrast, then saturation, each by 1 + amount."""
    f = 1 + amount
    x = rounded(image * f).astype(np.float64)
    x = rounded(np.rint((x @ LUMA).mean()) * (1 - f) + x * f).astype(np.float64)
    return rounded((x @ LUMA)[:, :, None] * (1 - f) + x * f)


def crop(image: np.ndarray, ratio: float) -> np.ndarray:
    """The centre, scaled back to the whole size."""
    return multi_crops(image, 1, ratio)[0]


def multi_crops(image: np.ndarray, n: int, scale: float = 0.8) -> list[np.ndarray]:
    """1: centre; 2 to 4: corners; 5 and more: four corners and the centre; each scaled back to the whole size. Sides are rounded to the nearest
    (halves to even), 1 at least."""
    h, w = image.shape[:2]
    tall, wide = (max(1, round(side * scale)) for side in (h, w))
    bottom, right = h - tall, w - wide
    places = [(y, x) for y in (0, bottom) for x in (0, right)][: max(0, n)] if n != 1 else []
    if n == 1 or n >= 5:
        places.append((bottom // 2, right // 2))
    return [resample(image[y : y + tall, x : x + wide], h, w) for y, x in places]


OPS = {"jpeg": jpeg, "blur": blur, "resize": down_up, "noise": noise, "jitter": jitter, "crop": crop}


def apply(image: np.ndarray, op: str | None, param: float | None = None) -> np.ndarray:
    """A degradation by name; no name is the identity, an unknown one an error."""
    if op is None:
        return image
    if op not in OPS:
        raise ValueError(f"unknown degradation {op}")
    return OPS[op](image, param)


def apply_chain(image: np.ndarray, steps) -> np.ndarray:
    """Degradations in order; order matters."""
    for op, param in steps:
        image = apply(image, op, param)
    return image


def fit_square(image: np.ndarray, side: int = 512) -> np.ndarray:
    return resample(image, side, side, "bicubic")


def grey_centre(image: np.ndarray, size: int = 256) -> np.ndarray:
    """Luma of the centre at its own scale, with its corner on the 8-pixel grid."""
    g = image.astype(np.float64) @ LUMA
    s = min(size, *g.shape)
    top, left = (np.array(g.shape) - s) // 2
    return g[top - top % 8 :, left - left % 8 :][:s, :s]


def blockiness(image: np.ndarray) -> float:
    """Mean step across 8-pixel borders less the mean step elsewhere, along both axes."""
    g, out = grey_centre(image), 0.0
    for axis in (0, 1):
        d = np.abs(np.diff(g, axis=axis)).mean(1 - axis)
        border = (np.arange(len(d)) + 1) % 8 == 0
        out += float(d[border].mean() - d[~border].mean()) if border.any() and (~border).any() else 0.0
    return out


def laplacian(g: np.ndarray) -> np.ndarray:
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


def laplacian_energy(image: np.ndarray) -> float:
    return float(np.abs(laplacian(grey_centre(image))).mean())


def centre_square(image: np.ndarray, size: int = 256) -> np.ndarray:
    """The centre of size x size; smaller images are mirrored outwards first."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n < size:
            before = (size - n) // 2
            wide = [(0, 0)] * 3
            wide[axis] = (before, size - n - before)
            image = np.pad(image, wide, "symmetric")
    y, x = (image.shape[0] - size) // 2, (image.shape[1] - size) // 2
    return image[y : y + size, x : x + size]


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    sa, sb = a.std(), b.std()
    return 0.0 if sa < 1e-8 or sb < 1e-8 else float(((a - a.mean()) * (b - b.mean())).mean() / (sa * sb))


def _patterns(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and how often each occurs."""
    return np.unique(rows, axis=0, return_counts=True)


class _Axis:
    """One axis of centre_square() for an image of n pixels: what its places show, each different neighbourhood once with its count. A small image is mirrored many times over, so
    there are few of them; sums over the square are sums over these."""

    def __init__(self, n: int, size: int = 256):
        before = (size - n) // 2
        self.at = at = np.pad(np.arange(n), (before, size - n - before), "symmetric") if n < size else np.arange(n)[(n - size) // 2 :][:size]
        self.counts = np.bincount(at, minlength=n).astype(np.float64)
        self.blocks, self.block_counts = _patterns(at.reshape(-1, 8))
        around = np.abs(np.arange(size)[:, None] + np.arange(-2, 3))
        near = at[np.where(around >= size, 2 * size - 2 - around, around)]
        near[:, [0, 4]], near[:, [1, 3]] = np.sort(near[:, [0, 4]]), np.sort(near[:, [1, 3]])  # both kernels are symmetric
        wide, self.wide_counts = _patterns(near)
        k = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
        self.wide_centre, self.smooth = wide[:, 2], np.zeros((len(wide), n))
        for i, w in enumerate(k / k.sum()):
            np.add.at(self.smooth, (np.arange(len(wide)), wide[:, i]), w)
        close, self.close_counts = _patterns(near[1:-1, 1:4])
        self.close_centre, self.beside = close[:, 1], np.zeros((len(close), n))
        for i in (0, 2):
            np.add.at(self.beside, (np.arange(len(close)), close[:, i]), 1.0)


_axis = lru_cache(64)(_Axis)


@lru_cache(1)
def _rings(n: int = 256) -> np.ndarray:
    """Weights of six ring means of a spectrum of n x n, on the half that a real transform gives."""
    yy, xx = np.fft.fftfreq(n, 1 / n)[:, None], np.arange(n // 2 + 1)[None, :]
    far = np.hypot(yy, xx) / (n / 2)
    times = np.where((xx == 0) | (xx == n // 2), 1.0, 2.0)
    rings = np.stack([((far >= a) & (far < b)) * times for a, b in ((0, 0.125), (0.125, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1), (1, 1.5))])
    return (rings / rings.sum((1, 2), keepdims=True)).reshape(6, -1)


def _weighted(values: np.ndarray, counts: np.ndarray, at: tuple[int, ...]) -> tuple[float, float, list[float]]:
    """Mean, deviation and percentiles of values that each stand for so many."""
    v, n = values.ravel(), counts.ravel()
    order, total = np.argsort(v), int(n.sum())
    upto, mean = np.cumsum(n[order]), float(v @ n) / total
    place = np.array(at) / 100 * (total - 1)
    low = np.floor(place)
    a, b = (v[order[np.searchsorted(upto, p, side="right")]] for p in (low, np.minimum(low + 1, total - 1)))
    return mean, math.sqrt(float((v - mean) ** 2 @ n) / total), (a + (b - a) * (place - low)).tolist()


def forensic(image: np.ndarray) -> np.ndarray:
    """28 statistics of the centre: residual 5, block DCT 5, spectrum 6, colour 9, Laplacian variance and luma 3.

    They are those of centre_square(image); what its mirrored parts repeat is computed once and counted."""
    y, x = _axis(image.shape[0]), _axis(image.shape[1])
    rgb = image.astype(np.float64) / 255
    g = rgb @ LUMA
    r = g[y.wide_centre[:, None], x.wide_centre] - y.smooth @ g @ x.smooth.T
    times = np.outer(y.wide_counts, x.wide_counts)
    r_mean, r_std, r_at = _weighted(r, times, (5, 95))
    c = np.abs(DCT @ g[y.blocks[:, None, :, None], x.blocks[None, :, None, :]] @ DCT.T)
    ratio = c[:, :, 2:, 2:].mean((2, 3)) / (c[:, :, :2, :2].mean((2, 3)) + 1e-6)
    ratio_mean, ratio_std, ratio_at = _weighted(ratio, np.outer(y.block_counts, x.block_counts), (25, 75, 95))
    # rows are transformed once each, then put where they are shown
    f = np.fft.fft(np.fft.rfft(g[:, x.at], axis=1)[y.at], axis=0)
    rings = _rings() @ np.log(1 + np.sqrt(f.real * f.real + f.imag * f.imag)).ravel()
    w = np.outer(y.counts, x.counts).ravel() / (len(y.at) * len(x.at))
    four = np.column_stack([rgb.reshape(-1, 3), g.ravel()])
    means = w @ four
    off = four - means
    cov = (off * w[:, None]).T @ off
    std = np.sqrt(np.diag(cov))
    alike = [0.0 if std[a] < 1e-8 or std[b] < 1e-8 else cov[a, b] / (std[a] * std[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    lap = (y.beside @ g)[:, x.close_centre] + g[y.close_centre] @ x.beside.T - 4 * g[y.close_centre[:, None], x.close_centre]
    lap_n = np.outer(y.close_counts, x.close_counts)
    lap_mean = (lap * lap_n).sum() / lap_n.sum()
    lap_var = ((lap - lap_mean) ** 2 * lap_n).sum() / lap_n.sum()
    out = [
        r_mean, r_std, (np.abs(r) * times).sum() / times.sum(), *r_at, ratio_mean, ratio_std, *ratio_at, *rings,
        *means[:3], *std[:3], *alike, lap_var, means[3], std[3],
    ]
    return np.nan_to_num(np.array(out), nan=0.0, posinf=0.0, neginf=0.0)


def corner_summary(image: np.ndarray) -> np.ndarray:
    """Deviation and maximum of the statistics of the four corners, 56 numbers."""
    h, w = image.shape[:2]
    ch, cw = min(h, 256), min(w, 256)
    f = np.stack([forensic(image[y : y + ch, x : x + cw]) for y, x in ((0, 0), (0, w - cw), (h - ch, 0), (h - ch, w - cw))])
    return np.concatenate([f.std(0), f.max(0)])


def dhash(image: np.ndarray) -> int:
    """64 bits: of a 9 x 8 grey version, whether each pixel is darker than its right neighbour."""
    g = resample((image.astype(np.float64) @ LUMA)[:, :, None], 8, 9)[:, :, 0].astype(int)
    return int.from_bytes(np.packbits(g[:, 1:] > g[:, :-1]).tobytes(), "big")


def phash(image: np.ndarray) -> int:
    """64 bits: of the 8 x 8 lowest frequencies of a 32 x 32 grey version, which are above the median of all but the first."""
    g = resample((image.astype(np.float64) @ LUMA)[:, :, None], 32, 32)[:, :, 0].astype(np.float64)
    d = DCT_32
    c = (d @ g @ d.T)[:8, :8].ravel()
    return int.from_bytes(np.packbits(c > np.median(c[1:])).tobytes(), "big")


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """Undo an EXIF orientation (1 to 8)."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(orientation, ())
    return np.ascontiguousarray(np.flip(image, flips)) if flips else image


def exif_orientation(data: bytes) -> int:
    """The orientation in a JPEG's EXIF segment; 1 if there is none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + size]
            order = "little" if t[:2] == b"II" else "big"
            num = lambda o, n: int.from_bytes(t[o : o + n], order)  # noqa: B023, E731
            first = num(4, 4)
            for i in range(num(first, 2)):
                e = first + 2 + 12 * i
                if num(e, 2) == 0x0112:
                    value = num(e + 8, 2)
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def generated(seed: int, height: int = 64, width: int = 64, natural: bool = True) -> np.ndarray:
    """A procedural image from whole-number formulas: a noisy gradient, or a regular pattern."""
    y, x = np.mgrid[:height, :width]
    if natural:
        base = np.stack([(x * 3 + y * 2 + seed * 17) % 256, (x * 2 + y * 5 + seed * 29) % 256, (x + y * 3 + seed * 7) % 256], 2)
        return ((base + (x * 7919 + y * 104729 + seed * 31)[:, :, None] % 23) % 256).astype(np.uint8)
    wave = ((x // 8 + y // 8 + seed) % 2 * 120 + (x * y + seed) % 64)[:, :, None] + np.array([0, 20, 40])
    return (wave % 256).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A lossless PNG: 8-bit RGB, each row as differences from the one above."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    flat = np.ascontiguousarray(image).reshape(h, -1)
    rows[:, 0], rows[0, 1:], rows[1:, 1:] = 2, flat[0], flat[1:] - flat[:-1]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def zigzag(n: int = 8) -> np.ndarray:
    """Flat places of a block's coefficients, by anti-diagonals in turns."""
    return np.array([y * n + x for y, x in sorted(((y, x) for y in range(n) for x in range(n)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


def _jpeg_symbols(blocks: np.ndarray) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per block (zigzag order, whole numbers): its DC and AC symbols as (symbol, bits, number of bits)."""
    def coded(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    out, last = [], 0
    for b in blocks.tolist():
        n, bits = coded(b[0] - last)
        last, ac, zeros = b[0], [], 0
        end = max((i for i in range(1, 64) if b[i]), default=0)
        for v in b[1 : end + 1]:
            if not v:
                zeros += 1
                continue
            ac += [(0xF0, 0, 0)] * (zeros // 16)
            size, value = coded(v)
            ac.append((zeros % 16 << 4 | size, value, size))
            zeros = 0
        out.append(([(n, bits, n)], ac + ([(0, 0, 0)] if end < 63 else [])))
    return out


def _huffman(counts: dict[int, int], most: int = 16) -> list[tuple[int, int]]:
    """(symbol, length), shortest first, of a code in which no word is all ones: one more symbol, the rarest, takes that place."""
    weights = dict(counts)
    while True:
        nodes = sorted([(w, [s]) for s, w in weights.items()] + [(0, [-1])], key=lambda t: t[0])
        length = {s: 0 for s in (*weights, -1)}
        while len(nodes) > 1:
            (a, x), (b, y) = nodes[:2]
            for s in x + y:
                length[s] += 1
            nodes = sorted([*nodes[2:], (a + b, x + y)], key=lambda t: t[0])
        longest = max(length.values())
        if longest <= most:
            # the spare symbol is among the longest, so it can be the last of them
            return sorted(((s, n) for s, n in length.items() if s >= 0), key=lambda t: (t[1], t[0]))
        weights = {s: (w + 1) // 2 for s, w in weights.items()}


def jpeg_file(image: np.ndarray, quality: float = 95) -> bytes:
    """A baseline JPEG without subsampling, with Huffman tables made for the image."""
    ycc = image.astype(np.float64) @ TO_YCC.T
    return _jpeg_bytes([ycc[:, :, 0] - 128, ycc[:, :, 1], ycc[:, :, 2]], [0, 1, 1], quality)


def ink_file(inks: np.ndarray, quality: float = 95) -> bytes:
    """A baseline JPEG of four inks (height, width, CMYK), inverted as Adobe's files are, with its mark."""
    mark = b"Adobe" + bytes([0, 100, 0, 0, 0, 0, 0])
    return _jpeg_bytes([127.0 - inks[:, :, k] for k in range(4)], [0, 0, 0, 0], quality, b"\xff\xee" + (len(mark) + 2).to_bytes(2, "big") + mark)


def _jpeg_bytes(centred: list[np.ndarray], kinds: list[int], quality: float, before: bytes = b"") -> bytes:
    """A baseline JPEG of planes around 0. kinds: each plane's tables, 0 (luma) or 1 (chroma)."""
    h, w = centred[0].shape
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    order, used_kinds = zigzag(), sorted(set(kinds))
    tables = [np.clip(np.floor((q * scale + 50) / 100), 1, 255).astype(int) for q in (Q_LUMA, Q_CHROMA)]
    planes = []
    for k, plane in zip(kinds, centred, strict=True):
        c = np.rint(DCT @ blocks_of(np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge")) @ DCT.T / tables[k]).astype(int)
        planes.append(_jpeg_symbols(c.reshape(-1, 64)[:, order]))
    segment = lambda mark, data: bytes([0xFF, mark]) + (len(data) + 2).to_bytes(2, "big") + data
    out = b"\xff\xd8" + before + b"".join(segment(0xDB, bytes([i]) + bytes(tables[i].ravel()[order].tolist())) for i in used_kinds)
    out += segment(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + bytes(x for i, k in enumerate(kinds) for x in (i + 1, 0x11, k)))
    codes = {}
    for i in used_kinds:
        for kind in (0, 1):
            counts: dict[int, int] = {}
            for plane in [p for p, k in zip(planes, kinds, strict=True) if k == i]:
                for block in plane:
                    for s, _, _ in block[kind]:
                        counts[s] = counts.get(s, 0) + 1
            used, code, last, words = _huffman(counts or {0: 1}), 0, 0, {}
            for s, n in used:
                code <<= n - last
                words[s], last = (code, n), n
                code += 1
            codes[i, kind] = words
            out += segment(0xC4, bytes([kind << 4 | i]) + bytes(sum(n == m for _, n in used) for m in range(1, 17)) + bytes(s for s, _ in used))
    out += segment(0xDA, bytes([len(planes)]) + bytes(x for i, k in enumerate(kinds) for x in (i + 1, k << 4 | k)) + bytes([0, 63, 0]))
    bits: list[str] = []
    for blocks in zip(*planes, strict=True):
        for k, block in zip(kinds, blocks, strict=True):
            for kind in (0, 1):
                for s, value, n in block[kind]:
                    code, length = codes[k, kind][s]
                    bits.append(f"{code:0{length}b}" + (f"{value:0{n}b}" if n else ""))
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
    return out + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
