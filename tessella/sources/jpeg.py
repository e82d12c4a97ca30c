"""Baseline JPEG: headers, restart index, tiles cut from restart intervals, decoding and encoding."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

from tessella.functions.huffman import canonical, code_lengths

# Fixed values of ISO/IEC 10918-1, table K.1: quantiser steps of luma, row by row.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def zigzag(n: int = 8) -> list[int]:
    """Row-major places of an n x n block along its anti-diagonals, in turning directions."""
    order = sorted(((y + x, y if (y + x) % 2 else x, y, x) for y in range(n) for x in range(n)), key=lambda t: (t[0], t[1]))
    return [y * n + x for _, _, y, x in order]


ZIGZAG = zigzag()
_BASIS = np.array([[math.sqrt((1 if k else 0.5) / 4) * math.cos((2 * x + 1) * k * math.pi / 16) for x in range(8)] for k in range(8)])


@dataclass
class Component:
    id: int
    h: int
    v: int
    q: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    width: int = 0
    height: int = 0
    bits: int = 8
    sof: int = 0
    sof_at: int = 0
    restart: int = 0
    scan_at: int = 0
    adobe: int | None = None
    components: list[Component] = field(default_factory=list)
    quant: dict[int, list[int]] = field(default_factory=dict)
    huffman: dict[tuple[int, int], dict[tuple[int, int], int]] = field(default_factory=dict)

    @property
    def mcu(self) -> tuple[int, int]:
        if len(self.components) == 1:
            return 8, 8
        return 8 * max(c.h for c in self.components), 8 * max(c.v for c in self.components)

    @property
    def mcus(self) -> tuple[int, int]:
        return -(-self.width // self.mcu[0]), -(-self.height // self.mcu[1])


def _huffman_tables(body: bytes) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """(class, slot) -> (length, code) -> symbol."""
    p, out = 0, {}
    while p < len(body):
        kind, counts = body[p], body[p + 1 : p + 17]
        p += 17
        code, table = 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[p]
                p, code = p + 1, code + 1
            code <<= 1
        out[kind >> 4, kind & 15] = table
    return out


def read_header(data: bytes, most: int = 1 << 20) -> Header:
    """Everything up to the first scan; the entropy-coded data are not looked at."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, h = 2, Header()
    while at + 4 <= min(len(data), most):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker in (0xC0, 0xC1, 0xC2):
            h.sof, h.sof_at = marker, at
            h.bits, h.height, h.width, n = struct.unpack_from(">BHHB", body)
            h.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"frame type {marker:02X} is not decoded")
        elif marker == 0xCC:
            raise ValueError("arithmetic coding is not decoded")
        elif marker == 0xDB:
            p = 0
            while p < len(body):
                wide, t = body[p] >> 4, body[p] & 15
                h.quant[t] = list(struct.unpack_from(">64H" if wide else "64B", body, p + 1))
                p += 1 + (128 if wide else 64)
        elif marker == 0xC4:
            h.huffman.update(_huffman_tables(body))
        elif marker == 0xDD:
            h.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            h.adobe = body[11]
        elif marker == 0xDA:
            for i in range(body[0]):
                c = next(c for c in h.components if c.id == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            h.scan_at = at + 2 + size
            return h
        at += 2 + size
    raise ValueError("no scan")


def restart_starts(data: bytes, scan_at: int) -> list[int]:
    """Offsets of the restart intervals of a scan: its start, and after each restart marker."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw[scan_at:-1] == 0xFF) & (raw[scan_at + 1 :] >= 0xD0) & (raw[scan_at + 1 :] <= 0xD7)) + scan_at
    return [scan_at, *(at + 2).tolist()]


def check_starts(data: bytes, starts: list[int]) -> bool:
    """Whether recorded interval offsets do follow restart markers."""
    return all(s >= 2 and data[s - 2] == 0xFF and 0xD0 <= data[s - 1] <= 0xD7 for s in starts[1:])


def cut_tile(data: bytes, header: Header, starts: list[int], tile: int) -> bytes:
    """One restart interval as an image of its own: the header with its size rewritten, the interval, the end marker."""
    per_row = header.mcus[0] // header.restart
    if header.mcus[0] % header.restart:
        raise ValueError("restart intervals do not divide rows")
    end = starts[tile + 1] - 2 if tile + 1 < len(starts) else len(data)
    body = data[starts[tile] : end]
    if body[-2:] == b"\xff\xd9":
        body = body[:-2]
    head = bytearray(data[: header.scan_at])
    width = header.restart * header.mcu[0]
    column, row = tile % per_row, tile // per_row
    w, h = min(width, header.width - column * width), min(header.mcu[1], header.height - row * header.mcu[1])
    struct.pack_into(">HH", head, header.sof_at + 5, h, w)
    return bytes(head) + body + b"\xff\xd9"


class _Reader:
    def __init__(self, data: bytes):
        self.bits, self.n, self.data, self.at = 0, 0, data, 0

    def _fill(self) -> None:
        b = self.data[self.at] if self.at < len(self.data) else 0
        self.at += 1 + (b == 0xFF)  # a stuffed zero follows
        self.bits = (self.bits << 8 | b) & 0xFFFFFFFF
        self.n += 8

    def get(self, n: int) -> int:
        while self.n < n:
            self._fill()
        self.n -= n
        return self.bits >> self.n & ((1 << n) - 1)

    def symbol(self, table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.get(1)
            if (s := table.get((length, code))) is not None:
                return s
        raise ValueError("broken Huffman code")

    def value(self, n: int) -> int:
        v = self.get(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _scans(data: bytes, h: Header):
    """(components, first, last, high, low, start, end) of each scan; tables between scans are taken into ``h``."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF):
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            return
        if 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        start = at + 2 + size
        if marker == 0xC4:
            h.huffman.update(_huffman_tables(body))
        elif marker == 0xDD:
            h.restart = struct.unpack(">H", body[:2])[0]
        if marker != 0xDA:
            at = start
            continue
        n = body[0]
        parts = []
        for i in range(n):
            k = next(k for k, c in enumerate(h.components) if c.id == body[1 + 2 * i])
            parts.append((k, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        end = start
        while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
            end += 1
        yield parts, first, last, approx >> 4, approx & 15, start, end
        at = end


def _progressive(data: bytes, h: Header, planes: list[np.ndarray]) -> None:
    """All scans of a progressive frame: bands of coefficients, coarse bits first, then one bit at a time."""
    nx, ny = h.mcus
    most_h, most_v = max(c.h for c in h.components), max(c.v for c in h.components)
    for parts, first, last, high, low, start, end in _scans(data, h):
        if len(parts) == 1:
            k = parts[0][0]
            c = h.components[k]
            w, t = -(-(-(-h.width * c.h // most_h)) // 8), -(-(-(-h.height * c.v // most_v)) // 8)
            units = [[(k, *parts[0][1:], y, x)] for y in range(t) for x in range(w)]
        else:
            units = [[(k, d, a, my * h.components[k].v + b // h.components[k].h, mx * h.components[k].h + b % h.components[k].h) for k, d, a in parts for b in range(h.components[k].h * h.components[k].v)] for my in range(ny) for mx in range(nx)]
        section = data[start:end]
        starts = [0] + [s for s in restart_starts(section, 0)[1:]] if h.restart else [0]
        step = h.restart or len(units)
        for i, begin in enumerate(starts):
            stop = starts[i + 1] - 2 if i + 1 < len(starts) else len(section)
            reader, dc, skip = _Reader(section[begin:stop]), [0] * len(h.components), 0
            for unit in units[i * step : (i + 1) * step]:
                for k, d, a, y, x in unit:
                    out = planes[k][y, x]
                    if first == 0:
                        if high:
                            out[0] |= reader.get(1) << low
                        else:
                            dc[k] += reader.value(reader.symbol(h.huffman[0, d]))
                            out[0] = dc[k] << low
                    elif high:
                        skip = _refine(reader, h.huffman[1, a], out, first, last, 1 << low, skip)
                    elif skip:
                        skip -= 1
                    else:
                        skip = _first_pass(reader, h.huffman[1, a], out, first, last, low)


def _first_pass(reader, table, out, at: int, last: int, low: int) -> int:
    """Coarse bits of a band; the number of further blocks whose bands are empty."""
    while at <= last:
        s = reader.symbol(table)
        run, n = s >> 4, s & 15
        if not n:
            if run < 15:
                return (1 << run) - 1 + reader.get(run)
            at += 16
            continue
        at += run
        if at > 63:
            raise ValueError("too many coefficients")
        out[ZIGZAG[at]] = reader.value(n) * (1 << low)
        at += 1
    return 0


def _refine(reader, table, out, at: int, last: int, bit: int, skip: int) -> int:
    """One more bit of a band: known coefficients are corrected as the run passes them, new ones are placed."""

    def correct(place: int) -> None:
        if reader.get(1) and not abs(int(out[place])) & bit:
            out[place] += bit if out[place] > 0 else -bit

    if not skip:
        while at <= last:
            s = reader.symbol(table)
            run, n = s >> 4, s & 15
            value = 0
            if n:
                value = bit if reader.get(1) else -bit
            elif run < 15:
                skip = (1 << run) + reader.get(run)
                break
            while at <= last:
                place = ZIGZAG[at]
                at += 1
                if out[place]:
                    correct(place)
                elif run:
                    run -= 1
                else:
                    if value:
                        out[place] = value
                    break
    if skip:
        for place in (ZIGZAG[i] for i in range(at, last + 1)):
            if out[place]:
                correct(place)
        skip -= 1
    return skip


def coefficients(data: bytes) -> tuple[Header, list[np.ndarray]]:
    """(header, quantised coefficients of each component: block rows x block columns x 64, natural order)."""
    h = read_header(data)
    if h.bits != 8:
        raise ValueError(f"{h.bits} bits a sample")
    single = len(h.components) == 1
    nx, ny = h.mcus
    planes = [np.zeros((ny * (1 if single else c.v), nx * (1 if single else c.h), 64), np.int32) for c in h.components]
    if h.sof == 0xC2:
        _progressive(data, h, planes)
        return h, planes
    starts = restart_starts(data, h.scan_at)
    step = h.restart or nx * ny
    for k, start in enumerate(starts):
        end = starts[k + 1] - 2 if k + 1 < len(starts) else len(data)
        reader, dc = _Reader(data[start:end]), [0] * len(h.components)
        for m in range(k * step, min((k + 1) * step, nx * ny)):
            my, mx = divmod(m, nx)
            for i, c in enumerate(h.components):
                hs, vs = (1, 1) if single else (c.h, c.v)
                for b in range(hs * vs):
                    out = planes[i][my * vs + b // hs, mx * hs + b % hs]
                    dc[i] += reader.value(reader.symbol(h.huffman[0, c.dc]))
                    out[0] = dc[i]
                    at, table = 1, h.huffman[1, c.ac]
                    while at < 64:
                        s = reader.symbol(table)
                        if not s:
                            break
                        at += s >> 4
                        if s & 15:
                            if at > 63:
                                raise ValueError("too many coefficients")
                            out[ZIGZAG[at]] = reader.value(s & 15)
                        at += 1
        if not h.restart:
            break
    return h, planes


def decode(data: bytes, rgb: bool = True) -> np.ndarray:
    """Height x width x channels, 8 bits; YCbCr becomes RGB unless the file says it is none."""
    h, planes = coefficients(data)
    out = []
    for c, q in zip(h.components, planes, strict=True):
        steps = np.zeros(64)
        steps[ZIGZAG] = h.quant[c.q]
        blocks = (q * steps).reshape(*q.shape[:2], 8, 8)
        pixels = np.clip(np.floor(_BASIS.T @ blocks @ _BASIS + 128.5), 0, 255)
        plane = pixels.swapaxes(1, 2).reshape(q.shape[0] * 8, q.shape[1] * 8)
        if len(h.components) > 1:
            plane = plane.repeat(max(x.v for x in h.components) // c.v, 0).repeat(max(x.h for x in h.components) // c.h, 1)
        out.append(plane[: h.height, : h.width])
    if len(out) == 3 and rgb and h.adobe != 0:
        y, u, v = out[0], out[1] - 128, out[2] - 128
        out = [np.clip(np.floor(p + 0.5), 0, 255) for p in (y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u)]
    return np.stack(out, axis=2).astype(np.uint8)


def _tokens(coef: np.ndarray, dc: int):
    """(symbol, value bits, raw) of a block in scan order, and the new DC."""
    def sized(v):
        n = int(abs(v)).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    n, raw = sized(int(coef[0]) - dc)
    out, run = [(0, n, n, raw)], 0
    for place in ZIGZAG[1:]:
        v = int(coef[place])
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        n, raw = sized(v)
        out.append((1, run << 4 | n, n, raw))
        run = 0
    if run:
        out.append((1, 0, 0, 0))
    return out, int(coef[0])


def _write_scan(parts, groups, first: int, last: int, high: int, low: int) -> list[bytes]:
    """Tables fitted to the tokens of a scan, its header and its data; tokens are (kind, symbol, bits, raw) or bare (None, 0, bits, raw)."""
    seg = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out, codes = [], {}
    for kind in (0, 1):
        counts: dict[int, int] = {}
        for g in groups:
            for k, s, _, _ in g:
                if k == kind:
                    counts[s] = counts.get(s, 0) + 1
        if counts:
            codes[kind], body = _table(counts)
            out.append(seg(0xC4, bytes([kind << 4]) + body))
    out.append(seg(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low])))
    for i, g in enumerate(groups):
        acc, length = 0, 0
        for kind, s, bits, raw in g:
            if kind is not None:
                code, size = codes[kind][s]
                acc, length = acc << size | code, length + size
            acc, length = acc << bits | raw, length + bits
        pad = -length % 8
        body = ((acc << pad) | ((1 << pad) - 1)).to_bytes((length + pad) // 8, "big").replace(b"\xff", b"\xff\0")
        out.append(body + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(groups) else b""))
    return out


def _table(counts: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """(codes, the table as it is stored); one more symbol keeps the all-ones code free."""
    lengths = code_lengths(counts | {256: 1}, 16)
    longest = max(lengths.values())
    if lengths[256] < longest:
        other = next(s for s, v in lengths.items() if v == longest and s != 256)
        lengths[256], lengths[other] = longest, lengths[256]
    table = canonical(lengths)
    del table[256]
    ordered = sorted((v, s) for s, (_, v) in table.items())
    return table, bytes(sum(v == k for v, _ in ordered) for k in range(1, 17)) + bytes(s for _, s in ordered)


def _progressive_scans(coef: list[np.ndarray]) -> list[bytes]:
    """Two bits of precision are held back: DC, then each component's AC, coarse first and refined once."""
    sized = lambda v: (int(abs(v)).bit_length(), v if v >= 0 else v + (1 << int(abs(v)).bit_length()) - 1)
    flat = [c.reshape(-1, 64) for c in coef]
    everyone = list(range(len(coef)))
    tokens, dc = [], [0] * len(coef)
    for m in range(len(flat[0])):
        for c in everyone:
            n, raw = sized((int(flat[c][m, 0]) >> 1) - dc[c])
            dc[c] = int(flat[c][m, 0]) >> 1
            tokens.append((0, n, n, raw))
    out = _write_scan(everyone, [tokens], 0, 0, 0, 1)
    for c in everyone:
        tokens = []
        for block in flat[c]:
            run = 0
            for place in ZIGZAG[1:]:
                v = int(block[place])
                v = (abs(v) >> 1) * (1 if v > 0 else -1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    tokens.append((1, 0xF0, 0, 0))
                    run -= 16
                n, raw = sized(v)
                tokens.append((1, run << 4 | n, n, raw))
                run = 0
            if run:
                tokens.append((1, 0, 0, 0))
        out += _write_scan([c], [tokens], 1, 63, 0, 1)
    out += _write_scan(everyone, [[(None, 0, 1, int(flat[c][m, 0]) & 1) for m in range(len(flat[0])) for c in everyone]], 0, 0, 1, 0)
    for c in everyone:
        tokens = []
        for block in flat[c]:
            run, held = 0, []
            values = [int(block[p]) for p in ZIGZAG[1:]]
            final = max((i for i, v in enumerate(values) if abs(v) == 1), default=-1)
            for i, v in enumerate(values):
                a = abs(v)
                if a > 1:
                    held.append((None, 0, 1, a & 1))
                    continue
                if i <= final and run == 15 and not a:
                    tokens += [(1, 0xF0, 0, 0), *held]
                    run, held = 0, []
                    continue
                if not a:
                    run += 1
                    continue
                tokens += [(1, run << 4 | 1, 1, int(v > 0)), *held]
                run, held = 0, []
            if run or held:
                tokens += [(1, 0, 0, 0), *held]
        out += _write_scan([c], [tokens], 1, 63, 1, 0)
    return out


def encode(image: np.ndarray, quality: int = 90, restart: int = 0, rgb: bool = True, progressive: bool = False) -> bytes:
    """A baseline or progressive file of a height x width x (1 or 3) image with codes fitted to it; no subsampling."""
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, n = image.shape
    planes = [image[:, :, c].astype(float) for c in range(n)]
    if n == 3 and rgb:
        r, g, b = planes
        planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip((np.array(LUMA_STEPS) * scale + 50) // 100, 1, 255).astype(int)
    nx, ny = -(-w // 8), -(-h // 8)
    coef = []
    for p in planes:
        wide = np.pad(p, ((0, ny * 8 - h), (0, nx * 8 - w)), mode="edge") - 128
        blocks = wide.reshape(ny, 8, nx, 8).swapaxes(1, 2)
        coef.append(np.rint(_BASIS @ blocks @ _BASIS.T / steps.reshape(8, 8)).astype(int).reshape(ny, nx, 64))
    groups, current, dc = [], [], [0] * n
    for m in range(nx * ny):
        if restart and m and m % restart == 0:
            groups.append(current)
            current, dc = [], [0] * n
        for c in range(n):
            out, dc[c] = _tokens(coef[c][m // nx, m % nx], dc[c])
            current += out
    groups.append(current)
    out = [b"\xff\xd8"]
    seg = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    if n == 3 and not rgb:
        out.append(seg(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, 0])))
    out.append(seg(0xDB, bytes([0]) + bytes(int(steps[z]) for z in ZIGZAG)))
    out.append(seg(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))))
    if restart and not progressive:
        out.append(seg(0xDD, struct.pack(">H", restart)))
    out += _progressive_scans(coef) if progressive else _write_scan(range(n), groups, 0, 63, 0, 0)
    out.append(b"\xff\xd9")
    return b"".join(out)
