"""A reader of baseline JPEG files with one, three or four components, for files that the JVM's reader refuses (four components: CMYK and YCCK).

A file that ends too early keeps what was read; the rest of it is grey. Progressive and arithmetic-coded files give None.
"""

from __future__ import annotations

import numpy as np

from tesserix.functions.pixels import DCT, TO_YCC, rounded, zigzag

SOF, SOF_OTHER, DHT, DQT, DRI, SOS, EOI, APP14 = 0xC0, set(range(0xC2, 0xD0)) - {0xC4, 0xC8, 0xCC}, 0xC4, 0xDB, 0xDD, 0xDA, 0xD9, 0xEE


def _code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits that may come next: 256 x length of the code word + symbol; 0 where no word fits."""
    out, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            low, wide = code << (16 - length), 1 << (16 - length)
            out[low : low + wide] = [length << 8 | symbols[at]] * wide
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """The bits of one restart interval; reading beyond them raises EOFError."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\x00\x00\x00", np.uint8).astype(np.uint32)
        three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        self.next = (three[:, None] >> (8 - np.arange(8, dtype=np.uint32)) & 0xFFFF).reshape(-1).tolist()
        self.at, self.end = 0, 8 * (len(raw) - 3)

    def symbol(self, table: list[int]) -> int:
        found = table[self.next[self.at]] if self.at < self.end else 0
        if not found:
            raise EOFError
        self.at += found >> 8
        return found & 255

    def number(self, size: int) -> int:
        if not size:
            return 0
        if self.at + size > self.end:
            raise EOFError
        v = self.next[self.at] >> (16 - size)
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def _block(bits: _Bits, dc: list[int], ac: list[int], last: int, out: np.ndarray) -> int:
    """One block's coefficients in zigzag order; gives its first."""
    first = last + bits.number(bits.symbol(dc))
    out[0], k = first, 1
    while k < 64:
        s = bits.symbol(ac)
        if s == 0:
            break
        k += s >> 4
        if s & 15:
            if k > 63:
                raise EOFError
            out[k] = bits.number(s & 15)
        k += 1
    return first


def components(head: bytes) -> int:
    """How many components a JPEG file has, by its header; 0 if that isn't seen."""
    at = 2 if head[:2] == b"\xff\xd8" else len(head)
    while at + 9 < len(head) and head[at] == 0xFF:
        if head[at + 1] in SOF_OTHER | {SOF, 0xC1}:
            return head[at + 9]
        at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return 0


def read_jpeg(data: bytes) -> np.ndarray | None:
    """RGB pixels, or None if this isn't a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    at, quant, codes, parts, interval, adobe, frame = 2, {}, {}, [], 0, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == EOI:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark in SOF_OTHER or (mark in (SOF, 0xC1) and body[:1] != b"\x08"):
            return None
        if mark in (SOF, 0xC1):
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not h or not w or len(frame) not in (1, 3, 4):
                return None
            across, down = max(f[1] for f in frame), max(f[2] for f in frame)
            cols, rows = -(-w // (8 * across)), -(-h // (8 * down))
            parts = [np.zeros((rows * f[2], cols * f[1], 64), np.int32) for f in frame]
        elif mark == DQT:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif mark == DHT:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == DRI:
            interval = int.from_bytes(body[:2], "big")
        elif mark == APP14 and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == SOS:
            if frame is None:
                return None
            names = [f[0] for f in frame]
            scan = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            end = at
            while end + 1 < len(data) and (data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            try:
                _scan(data[at : end if end + 1 < len(data) else len(data)], scan, frame, parts, codes, interval, (h, w, across, down))
            except EOFError:
                break  # what was read stays
            at = end
    return None if frame is None or any(f[3] not in quant for f in frame) else _pixels(frame, parts, quant, adobe, h, w, across, down)


def _scan(data: bytes, scan, frame, parts, codes, interval: int, size) -> None:
    h, w, across, down = size
    if len(scan) == 1:  # its blocks in rows, without those that only fill up
        k = scan[0][0]
        wide, high = -(-w * frame[k][1] // (8 * across)), -(-h * frame[k][2] // (8 * down))
        units = [[(k, y, x)] for y in range(high) for x in range(wide)]
    else:
        rows, cols = len(parts[0]) // frame[0][2], parts[0].shape[1] // frame[0][1]
        units = [[(k, my * frame[k][2] + y, mx * frame[k][1] + x) for k, _ in scan for y in range(frame[k][2]) for x in range(frame[k][1])] for my in range(rows) for mx in range(cols)]
    tables = {k: (codes[t >> 4], codes[16 | t & 15]) for k, t in scan}
    pieces, start = [], 0
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            pieces.append(data[start:i])
            start = i + 2
    pieces.append(data[start:])
    step = interval or len(units)
    for n, piece in enumerate(pieces):
        bits, last = _Bits(piece), dict.fromkeys(tables, 0)
        for unit in units[n * step : (n + 1) * step]:
            for k, y, x in unit:
                last[k] = _block(bits, *tables[k], last[k], parts[k][y, x])


def _pixels(frame, parts, quant, adobe, h: int, w: int, across: int, down: int) -> np.ndarray:
    place, planes = zigzag(), []
    for (_, fx, fy, q), c in zip(frame, parts, strict=True):
        flat = np.zeros(c.shape)
        flat[..., place] = c * quant[q]
        blocks = DCT.T @ flat.reshape(*c.shape[:2], 8, 8) @ DCT
        plane = blocks.swapaxes(1, 2).reshape(c.shape[0] * 8, c.shape[1] * 8) + 128
        planes.append(plane.repeat(down // fy, 0).repeat(across // fx, 1)[:h, :w])
    a = np.stack(planes, 2)
    if len(frame) == 1:
        return rounded(np.repeat(a, 3, 2))
    back = np.linalg.inv(TO_YCC)
    if len(frame) == 3:
        return rounded((a - [0, 128, 128]) @ back.T) if adobe != 0 else rounded(a)
    if adobe == 2:
        a[:, :, :3] = 255 - (a[:, :, :3] - [0, 128, 128]) @ back.T
    a = np.clip(a, 0, 255)
    ink = 255 - a if adobe is not None else a  # Adobe's files hold inverted inks
    return rounded((255 - ink[:, :, :3]) * (255 - ink[:, :, 3:]) / 255)
