"""JPEG 2000 codestreams: headers, tile index, packets, lossless and lossy coding, JP2 boxes.

Tiles, quality layers, precincts, all five progression orders, component transforms,
both wavelets, subsampled components, packet markers, regions and reduced resolutions
are written or read, and so are overrides for components and tiles, changes of
progression and regions of interest.  Packed packet headers, bypass and terminated
passes are refused by name.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from tessella.functions import wavelet
from tessella.functions.mq import CAUSAL, RESET, SEGMENT_MARKS, BlockDecoder, BlockEncoder

# Markers.
SOC, SOT, SOD, EOC, SIZ, COD, COC, QCD, QCC, RGN, POC = 0xFF4F, 0xFF90, 0xFF93, 0xFFD9, 0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5E, 0xFF5F
PACKED = (0xFF60, 0xFF61)
PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
GUARD = 2
#: log2 of the L2 norms' ratio is left to the step: one base step for all bands, by quality.
GAIN = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}


class Unsupported(ValueError):
    """A feature that is recognised but not decoded."""


@dataclass
class Header:
    width: int
    height: int
    x0: int
    y0: int
    tile_w: int
    tile_h: int
    tile_x0: int
    tile_y0: int
    bits: list[int]
    signed: list[bool]
    sub: list[tuple[int, int]]
    progression: str = "LRCP"
    layers: int = 1
    transform: bool = False
    levels: int = 0
    block: tuple[int, int] = (64, 64)
    reversible: bool = True
    style: int = 0
    sop: bool = False
    eph: bool = False
    precincts: list[tuple[int, int]] = field(default_factory=list)  # (log2 w, log2 h) by resolution; none: 2^15
    quant: int = 0
    guard: int = GUARD
    steps: list[tuple[int, int]] = field(default_factory=list)  # (exponent, mantissa)

    roi: int = 0
    changes: list[tuple[int, int, int, int, int, str]] = field(default_factory=list)  # (res, comp, layer end, res end, comp end, order)
    overrides: dict[tuple[int, int], list[dict]] = field(default_factory=dict)  # (tile or -1, component or -1) -> fields

    def view(self, tile: int, comp: int = -1) -> Header:
        """The header that holds for a tile and component: main, main component, tile, tile component, each over the one before."""
        keys = [(-1, comp), (tile, -1), (tile, comp)] if comp >= 0 else [(tile, -1)]
        fields = {k: v for key in keys for d in self.overrides.get(key, ()) for k, v in d.items()}
        return replace(self, **fields) if fields else self

    @property
    def grid(self) -> tuple[int, int]:
        return -(-(self.width - self.tile_x0) // self.tile_w), -(-(self.height - self.tile_y0) // self.tile_h)

    def tile_rect(self, t: int) -> tuple[int, int, int, int]:
        p, q = t % self.grid[0], t // self.grid[0]
        x, y = self.tile_x0 + p * self.tile_w, self.tile_y0 + q * self.tile_h
        return max(x, self.x0), max(y, self.y0), min(x + self.tile_w, self.width), min(y + self.tile_h, self.height)


@dataclass
class TilePart:
    tile: int
    part: int
    start: int
    end: int


def is_codestream(data: bytes) -> bool:
    return data[:4] == b"\xff\x4f\xff\x51"


def parse(data: bytes, at: int = 0, end: int | None = None) -> tuple[Header, list[TilePart], list[str]]:
    """(header, tile parts with the byte ranges of their bodies, warnings); no body is read."""
    end = len(data) if end is None else end
    if data[at : at + 2] != b"\xff\x4f":
        raise ValueError("no start of codestream")
    at += 2
    header, parts, warnings = None, [], []
    while at + 4 <= end:
        marker, size = struct.unpack_from(">HH", data, at)
        body = data[at + 4 : at + 2 + size]
        if marker == SIZ:
            v = struct.unpack_from(">HIIIIIIIIH", body)
            comps = [body[36 + 3 * i : 39 + 3 * i] for i in range(v[9])]
            header = Header(*v[1:9], [(c[0] & 0x7F) + 1 for c in comps], [bool(c[0] >> 7) for c in comps], [(c[1], c[2]) for c in comps])
            if not header.tile_w or not header.tile_h:
                raise ValueError("empty tiles")
        elif marker in (COD, COC, QCD, QCC, RGN, POC):
            _style(header, marker, body, -1)
        elif marker in PACKED:
            raise Unsupported("packed packet headers")
        elif marker == SOT:
            tile, length, part, _ = struct.unpack(">HIBB", body)
            stop = end if length == 0 else at + length
            k = at + 12
            while data[k : k + 2] != b"\xff\x93":
                if k + 4 > end:
                    warnings.append(f"tile {tile}: its header is cut off")
                    break
                marker, size = struct.unpack_from(">HH", data, k)
                if marker in PACKED:
                    raise Unsupported("packed packet headers")
                if marker in (COD, COC, QCD, QCC, RGN, POC):
                    _style(header, marker, data[k + 4 : k + 2 + size], tile)
                k += 2 + size
            if stop > end:
                warnings.append(f"tile {tile}: {stop - end} bytes are missing")
                stop = end
            if length == 0 and data[stop - 2 : stop] == b"\xff\xd9":
                stop -= 2
            parts.append(TilePart(tile, part, min(k + 2, stop), stop))
            at = stop
            continue
        elif marker == EOC:
            break
        at += 2 + size
    if header is None:
        raise ValueError("no image size")
    return header, parts, warnings


def _coding(body: bytes, custom: int) -> dict:
    levels, bw, bh, style, wave = body[:5]
    return {"levels": levels, "block": (4 << bw, 4 << bh), "style": style, "reversible": wave == 1, "precincts": [(b & 15, b >> 4) for b in body[5 : 6 + levels]] if custom else []}


def _quantiser(body: bytes) -> dict:
    kind = body[0] & 31
    steps = [(b >> 3, 0) for b in body[1:]] if kind == 0 else [(v >> 11, v & 2047) for (v,) in struct.iter_unpack(">H", body[1:])]
    return {"quant": kind, "guard": body[0] >> 5, "steps": steps}


def _style(header: Header, marker: int, body: bytes, tile: int) -> None:
    """Take a marker segment into the main header, or into the overrides of its tile and component."""
    wide = 2 if len(header.bits) > 256 else 1
    number = lambda at: int.from_bytes(body[at : at + wide], "big")
    comp, fields = -1, {}
    if marker == COD:
        scod, prog, layers, mct = struct.unpack_from(">BBHB", body)
        fields = {"progression": PROGRESSIONS[prog], "layers": layers, "transform": bool(mct), "sop": bool(scod & 2), "eph": bool(scod & 4)} | _coding(body[5:], scod & 1)
    elif marker == QCD:
        fields = _quantiser(body)
    elif marker == COC:
        comp, fields = number(0), _coding(body[wide + 1 :], body[wide] & 1)
    elif marker == QCC:
        comp, fields = number(0), _quantiser(body[wide:])
    elif marker == RGN:
        comp, fields = number(0), {"roi": body[wide + 1]}
    else:
        size, changes = 5 + 2 * wide, []
        for at in range(0, len(body) - size + 1, size):
            changes.append((body[at], number(at + 1), struct.unpack_from(">H", body, at + 1 + wide)[0], body[at + 3 + wide], number(at + 4 + wide) or 256, PROGRESSIONS[body[at + 4 + 2 * wide]]))
        fields = {"changes": changes}
    if tile < 0 and comp < 0:
        for k, v in fields.items():
            setattr(header, k, v)
    else:
        header.overrides.setdefault((tile, comp), []).append(fields)


# ---- geometry


def _ceil(a: int, n: int) -> int:
    return -(-a >> n) if n < 0 else (a + (1 << n) - 1) >> n


def bands_of(rect: tuple[int, int, int, int], levels: int):
    """(resolution, band, x0, y0, x1, y1) from the coarsest resolution on."""
    out = [(0, "LL", *(_ceil(v, levels) for v in rect))]
    for r in range(1, levels + 1):
        nb = levels - r + 1
        for band, xo, yo in (("HL", 1, 0), ("LH", 0, 1), ("HH", 1, 1)):
            half = 1 << (nb - 1)
            out.append((r, band, *(_ceil(v - half * o, nb) for v, o in zip(rect, (xo, yo, xo, yo), strict=True))))
    return out


@dataclass
class Block:
    column: int
    row: int
    rect: tuple[int, int, int, int]
    planes: int = 0
    passes: int = 0
    data: bytes = b""
    bits: int = 3
    seen: bool = False


@dataclass
class Part:
    """A band's share of a precinct: its blocks, their grid and its tag trees."""

    band: int
    name: str
    limit: int
    blocks: list[Block]
    grid: tuple[int, int]
    included: TagTree | None = None
    missing: TagTree | None = None


@dataclass
class Precinct:
    res: int
    comp: int
    number: int
    at: tuple[int, int]  # row and column on the reference grid where a position order meets it
    parts: list[Part]


def component_rect(header: Header, c: int, rect: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    dx, dy = header.sub[c]
    return -(-rect[0] // dx), -(-rect[1] // dy), -(-rect[2] // dx), -(-rect[3] // dy)


def precincts_of(main: Header, t: int) -> list[Precinct]:
    """All precincts of a tile with their code blocks."""
    out, rect = [], main.tile_rect(t)
    for c in range(len(main.bits)):
        header = main.view(t, c)
        levels = header.levels
        own = component_rect(header, c, rect)
        layout = bands_of(own, levels)
        dx, dy = header.sub[c]
        for r in range(levels + 1):
            pw, ph = header.precincts[r] if header.precincts else (15, 15)
            x0, y0, x1, y1 = (_ceil(v, levels - r) for v in own)
            if x1 <= x0 or y1 <= y0:
                continue
            cols, rows = range(x0 >> pw, _ceil(x1, pw)), range(y0 >> ph, _ceil(y1, ph))
            for number, (py, px) in enumerate((j, i) for j in rows for i in cols):
                at = (max(rect[1], dy * (py << ph) << (levels - r)), max(rect[0], dx * (px << pw) << (levels - r)))
                parts = []
                half = int(r > 0)
                for index, (res, name, *band) in enumerate(layout):
                    if res != r:
                        continue
                    # the precinct's window on the band, and the code blocks inside it
                    wx, wy = 1 << (pw - half), 1 << (ph - half)
                    bx0, by0, bx1, by1 = max(band[0], px * wx), max(band[1], py * wy), min(band[2], px * wx + wx), min(band[3], py * wy + wy)
                    w, h = min(header.block[0], wx), min(header.block[1], wy)
                    blocks, grid = [], (0, 0)
                    if bx1 > bx0 and by1 > by0:
                        cx0, cy0, cx1, cy1 = bx0 // w, by0 // h, -(-bx1 // w), -(-by1 // h)
                        grid = (cx1 - cx0, cy1 - cy0)
                        blocks = [Block(cx - cx0, cy - cy0, (max(bx0, cx * w), max(by0, cy * h), min(bx1, cx * w + w), min(by1, cy * h + h))) for cy in range(cy0, cy1) for cx in range(cx0, cx1)]
                    parts.append(Part(index, name, header.guard + _exponent(header, index) - 1 + header.roi, blocks, grid))
                out.append(Precinct(r, c, number, at, parts))
    return out


#: Sort keys of the packets (layer, precinct) of a tile by progression.
ORDERS = {
    "LRCP": lambda n, p: (n, p.res, p.comp, p.number),
    "RLCP": lambda n, p: (p.res, n, p.comp, p.number),
    "RPCL": lambda n, p: (p.res, p.at, p.comp, p.number, n),
    "PCRL": lambda n, p: (p.at, p.comp, p.res, p.number, n),
    "CPRL": lambda n, p: (p.comp, p.at, p.res, p.number, n),
}


def packet_sequence(header: Header, precincts: list[Precinct]) -> list[tuple[int, Precinct]]:
    """Packets in the order they are stored; with changes of progression, each comes where it is first due."""
    every = [(n, p) for n in range(header.layers) for p in precincts]
    if not header.changes:
        return sorted(every, key=lambda t: ORDERS[header.progression](*t))
    out, seen = [], set()
    for r0, c0, layers, r1, c1, order in header.changes:
        part = [(n, p) for n, p in every if r0 <= p.res < r1 and c0 <= p.comp < c1 and n < layers and (n, id(p)) not in seen]
        out += sorted(part, key=lambda t, order=order: ORDERS[order](*t))
        seen.update((n, id(p)) for n, p in part)
    return out


# ---- packet headers


class _BitWriter:
    def __init__(self):
        self.out, self.acc, self.free = bytearray(), 0, 8

    def put(self, value: int, n: int = 1) -> None:
        for i in range(n - 1, -1, -1):
            self.free -= 1
            self.acc |= (value >> i & 1) << self.free
            if not self.free:
                self.out.append(self.acc)
                self.free = 7 if self.acc == 0xFF else 8
                self.acc = 0

    def finish(self) -> bytes:
        if self.free < 8 and not (self.free == 7 and self.out and self.out[-1] == 0xFF):
            self.out.append(self.acc)
            if self.acc == 0xFF:
                self.out.append(0)
        elif self.out and self.out[-1] == 0xFF:
            self.out.append(0)
        return bytes(self.out)


class _BitReader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.acc, self.left = data, at, 0, 0

    def get(self, n: int = 1) -> int:
        v = 0
        for _ in range(n):
            if not self.left:
                stuffed = self.acc == 0xFF
                self.acc = self.data[self.at] if self.at < len(self.data) else 0
                self.at += 1
                self.left = 7 if stuffed else 8
            self.left -= 1
            v = v << 1 | self.acc >> self.left & 1
        return v

    def finish(self) -> int:
        if self.acc == 0xFF:
            self.at += 1
        return self.at


class TagTree:
    """Quadtree of minima, coded threshold by threshold."""

    def __init__(self, w: int, h: int, values: list[int] | None = None):
        self.sizes = [(w, h)]
        while self.sizes[-1] != (1, 1):
            a, b = self.sizes[-1]
            self.sizes.append(((a + 1) // 2, (b + 1) // 2))
        self.value = [[0] * (a * b) for a, b in self.sizes]
        self.low = [[0] * (a * b) for a, b in self.sizes]
        self.known = [[False] * (a * b) for a, b in self.sizes]
        if values is not None:
            self.value[0] = list(values)
            for k in range(1, len(self.sizes)):
                (a, b), (w, h) = self.sizes[k], self.sizes[k - 1]
                self.value[k] = [min(self.value[k - 1][y * w + x] for y in range(2 * j, min(2 * j + 2, h)) for x in range(2 * i, min(2 * i + 2, w))) for j in range(b) for i in range(a)]

    def code(self, x: int, y: int, threshold: int, bit) -> bool:
        """Settle whether leaf (x, y) is below ``threshold``; ``bit(node value or None)`` codes or reads."""
        low = 0
        for k in range(len(self.sizes) - 1, -1, -1):
            at = (y >> k) * self.sizes[k][0] + (x >> k)
            low = max(low, self.low[k][at])
            while low < threshold and not self.known[k][at]:
                if bit(k, at, low):
                    self.known[k][at] = True
                    self.value[k][at] = low
                else:
                    low += 1
            self.low[k][at] = low
        return self.known[0][at] and self.value[0][at] < threshold

    def write(self, out: _BitWriter, x: int, y: int, threshold: int) -> None:
        def bit(k, at, low):
            b = int(self.value[k][at] == low)
            out.put(b)
            return b

        self.code(x, y, threshold, bit)

    def read(self, source: _BitReader, x: int, y: int, threshold: int) -> bool:
        return self.code(x, y, threshold, lambda k, at, low: source.get())


def _put_passes(out: _BitWriter, n: int) -> None:
    if n == 1:
        out.put(0)
    elif n == 2:
        out.put(2, 2)
    elif n <= 5:
        out.put(3, 2)
        out.put(n - 3, 2)
    elif n <= 36:
        out.put(15, 4)
        out.put(n - 6, 5)
    else:
        out.put(511, 9)
        out.put(n - 37, 7)


def _get_passes(source: _BitReader) -> int:
    if not source.get():
        return 1
    if not source.get():
        return 2
    if (v := source.get(2)) < 3:
        return 3 + v
    if (v := source.get(5)) < 31:
        return 6 + v
    return 37 + source.get(7)


# ---- encoder


def _steps(levels: int, bits: int, reversible: bool, transform: bool, base: float) -> list[tuple[int, int]]:
    """(exponent, mantissa) of each band."""
    out = []
    for r, band, *_ in bands_of((0, 0, 1, 1), levels):
        gain = GAIN[band]
        if reversible:
            out.append((bits + gain + int(transform), 0))
            continue
        step, exponent = base * 2.0 ** (-0.5 * (levels - max(r, 1))), 0
        target = step / 2.0 ** (bits + gain)
        while target < 1 and exponent < 31:
            target, exponent = target * 2, exponent + 1
        out.append((exponent, min(2047, int((target - 1) * 2048))))
    return out


def _step_size(header: Header, index: int, band: str, comp: int) -> float:
    e, m = header.steps[index] if header.quant != 1 else (header.steps[0][0] - max(0, (index - 1) // 3), header.steps[0][1])
    return 2.0 ** (header.bits[comp] + GAIN[band] - e) * (1 + m / 2048)


def _exponent(header: Header, index: int) -> int:
    return header.steps[index][0] if header.quant != 1 else header.steps[0][0] - max(0, (index - 1) // 3)


def component_transform(planes: list[np.ndarray], reversible: bool) -> list[np.ndarray]:
    from tessella.functions.colour import ICT

    r, g, b = planes[:3]
    if reversible:
        return [(r + 2 * g + b) >> 2, b - g, r - g, *planes[3:]]
    return [k[0] * r + k[1] * g + k[2] * b for k in ICT] + planes[3:]


def inverse_component_transform(planes: list[np.ndarray], reversible: bool) -> list[np.ndarray]:
    y, u, v = planes[:3]
    if reversible:
        g = y - ((u + v) >> 2)
        return [v + g, g, u + g, *planes[3:]]
    return [y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u, *planes[3:]]


def encode(
    planes: list[np.ndarray], bits: int = 8, signed: bool = False, levels: int = 3, tile: int | None = None, lossless: bool = True, step: float = 1 / 16, progression: str = "LRCP",
    layers: int = 1, precinct: int | None = None, markers: bool = False, sub: list[tuple[int, int]] | None = None, size: tuple[int, int] | None = None,
    style: int = 0, own_levels: dict[int, int] | None = None, changes: list[tuple[int, int, int, int, int, str]] | None = None, roi: int = 0,
) -> bytes:
    """A codestream; lossless, or with quantiser steps that are multiples of ``step``.

    ``precinct`` is the log2 of the precincts' sides.  Passes are dealt evenly to the
    ``layers``.  With ``sub`` (column and row steps of each component), ``size`` is the
    image's width and height on the reference grid.  ``own_levels`` gives components
    other decomposition levels, ``changes`` is a list of progression segments, and
    ``roi`` lifts every second coefficient of the first component by so many planes.
    """
    h, w = planes[0].shape if size is None else size[::-1]
    tile = tile or max(w, h)
    transform = len(planes) >= 3 and sub is None
    sub = sub or [(1, 1)] * len(planes)
    header = Header(w, h, 0, 0, tile, tile, 0, 0, [bits] * len(planes), [signed] * len(planes), sub, progression, layers, transform, levels, (64, 64), lossless, style, markers, markers)
    header.precincts = [(precinct, precinct)] * (levels + 1) if precinct else []
    header.steps = _steps(levels, bits, lossless, transform, step)
    header.quant = 0 if lossless else 2
    out = [struct.pack(">H", SOC)]
    seg = lambda marker, body: struct.pack(">HH", marker, len(body) + 2) + body
    out.append(seg(SIZ, struct.pack(">HIIIIIIIIH", 0, w, h, 0, 0, tile, tile, 0, 0, len(planes)) + b"".join(bytes([(bits - 1) | signed << 7, dx, dy]) for dx, dy in sub)))
    out.append(seg(COD, struct.pack(">BBHBBBBBB", int(precinct is not None) | 6 * markers, PROGRESSIONS.index(progression), layers, int(transform), levels, 4, 4, style, int(lossless)) + bytes([precinct << 4 | precinct] * (levels + 1) if precinct else [])))
    quant = bytes(e << 3 for e, _ in header.steps) if lossless else b"".join(struct.pack(">H", e << 11 | m) for e, m in header.steps)
    out.append(seg(QCD, bytes([header.quant | GUARD << 5]) + quant))
    for c, n in (own_levels or {}).items():
        steps = _steps(n, bits, lossless, transform, step)
        body = bytes([c, int(precinct is not None), n, 4, 4, style, int(lossless)]) + bytes([precinct << 4 | precinct] * (n + 1) if precinct else [])
        _style(header, COC, body, -1)
        out.append(seg(COC, body))
        body = bytes([c, header.quant | GUARD << 5]) + (bytes(e << 3 for e, _ in steps) if lossless else b"".join(struct.pack(">H", e << 11 | m) for e, m in steps))
        _style(header, QCC, body, -1)
        out.append(seg(QCC, body))
    if roi:
        _style(header, RGN, bytes([0, 0, roi]), -1)
        out.append(seg(RGN, bytes([0, 0, roi])))
    if changes:
        body = b"".join(struct.pack(">BBHBBB", r0, c0, n, r1, c1, PROGRESSIONS.index(o)) for r0, c0, n, r1, c1, o in changes)
        _style(header, POC, body, -1)
        out.append(seg(POC, body))
    for t in range(header.grid[0] * header.grid[1]):
        body = _encode_tile(header, t, planes)
        out.append(seg(SOT, struct.pack(">HIBB", t, len(body) + 14, 0, 1)) + struct.pack(">H", SOD) + body)
    out.append(struct.pack(">H", EOC))
    return b"".join(out)


def _encode_tile(header: Header, t: int, planes: list[np.ndarray]) -> bytes:
    rect = header.tile_rect(t)
    part = []
    for c, p in enumerate(planes):
        x0, y0, x1, y1 = component_rect(header, c, rect)
        part.append(p[y0:y1, x0:x1].astype(np.int64) - (0 if header.signed[c] else 1 << (header.bits[c] - 1)))
    if header.transform:
        part = component_transform(part, header.reversible)
    bands = {}
    for c, plane in enumerate(part):
        h = header.view(t, c)
        own = component_rect(header, c, rect)
        ll, fine = wavelet.forward(plane, h.levels, own[0], own[1], h.reversible)
        for index, (r, name, bx0, by0, *_) in enumerate(bands_of(own, h.levels)):
            coef = ll if name == "LL" else fine[h.levels - r][name]
            if not h.reversible:
                coef = (np.sign(coef) * np.floor(np.abs(coef) / _step_size(h, index, name, c))).astype(np.int64)
            if h.roi:
                if np.abs(coef).max(initial=0) >= 1 << h.roi:
                    raise ValueError("the region of interest is lifted by too little")
                coef = np.where(np.arange(coef.size).reshape(coef.shape) % 2 == 0, coef << h.roi, coef)
            bands[c, index] = (coef, bx0, by0)
    precincts = precincts_of(header, t)
    for p in precincts:
        for q in p.parts:
            coef, bx0, by0 = bands[p.comp, q.band]
            for b in q.blocks:
                x0, y0, x1, y1 = b.rect
                b.planes, b.passes, b.data = BlockEncoder(coef[y0 - by0 : y1 - by0, x0 - bx0 : x1 - bx0], q.name, header.view(t, p.comp).style).encode()
                if b.planes > q.limit:
                    raise ValueError("a coefficient needs more bit planes than its band has")
    out = []
    for i, (layer, p) in enumerate(packet_sequence(header, precincts)):
        if header.sop:
            out.append(struct.pack(">HHH", 0xFF91, 4, i & 0xFFFF))
        head, bodies = _packet(header, layer, p)
        out += [head, b"\xff\x92" if header.eph else b"", *bodies]
    return b"".join(out)


def _share(total: int, layer: int, layers: int) -> tuple[int, int]:
    """What of ``total`` things comes before a layer, and with it."""
    return total * layer // layers, total * (layer + 1) // layers


def _packet(header: Header, layer: int, p: Precinct) -> tuple[bytes, list[bytes]]:
    out, bodies = _BitWriter(), []
    out.put(1)
    for q in p.parts:
        if not q.blocks:
            continue
        if layer == 0:
            first = [next((n for n in range(header.layers) if _share(b.passes, n, header.layers)[1]), header.layers) for b in q.blocks]
            q.included = TagTree(*q.grid, first)
            q.missing = TagTree(*q.grid, [q.limit - b.planes for b in q.blocks])
        for b in q.blocks:
            before, after = _share(b.passes, layer, header.layers)
            if b.seen:
                out.put(int(after > before))
            else:
                q.included.write(out, b.column, b.row, layer + 1)
            if after == before:
                continue
            if not b.seen:
                b.seen = True
                for k in range(1, q.limit - b.planes + 2):
                    q.missing.write(out, b.column, b.row, k)
            n = after - before
            low, high = (len(b.data) * k // b.passes for k in (before, after))
            _put_passes(out, n)
            size = max((high - low).bit_length(), 1)
            while b.bits + n.bit_length() - 1 < size:
                out.put(1)
                b.bits += 1
            out.put(0)
            out.put(high - low, b.bits + n.bit_length() - 1)
            bodies.append(b.data[low:high])
    return out.finish(), bodies


# ---- decoder


def check(header: Header) -> None:
    """Refuse what is not decoded, by name."""
    styles = {header.style} | {d["style"] for ds in header.overrides.values() for d in ds if "style" in d}
    if odd := [s for s in styles if s & ~(RESET | CAUSAL | SEGMENT_MARKS)]:
        raise Unsupported(f"code-block style {max(odd):#x}")
    if max(header.bits) > 31:
        raise Unsupported("more than 31 bits a sample")


def decode_tile(header: Header, t: int, body: bytes, reduction: int = 0) -> tuple[list[np.ndarray], list[str]]:
    """Samples of a tile at a reduced resolution, and warnings; what is missing from a cut-off body is zero."""
    header, rect, warnings = header.view(t), header.tile_rect(t), []
    views = [header.view(t, c) for c in range(len(header.bits))]
    if reduction > min(v.levels for v in views):
        raise ValueError(f"reduction {reduction} in tile {t}")
    precincts = precincts_of(header, t)
    try:
        at = 0
        for layer, p in packet_sequence(header, precincts):
            at = _read_packet(header, body, at, layer, p)
    except (IndexError, EOFError) as e:
        warnings.append(f"tile {t}: {e or 'data ends early'}")
    coef = {}
    for p in precincts:
        h = views[p.comp]
        if p.res > h.levels - reduction:
            continue
        layout = bands_of(component_rect(header, p.comp, rect), h.levels)
        for q in p.parts:
            _, _, bx0, by0, bx1, by1 = layout[q.band]
            plane = coef.setdefault((p.comp, q.band), np.zeros((by1 - by0, bx1 - bx0), np.int64 if h.reversible else np.float64))
            for b in q.blocks:
                if b.passes:
                    x0, y0, x1, y1 = b.rect
                    try:
                        v = BlockDecoder(b.data, x1 - x0, y1 - y0, q.name, h.style).decode(b.planes, b.passes)
                    except EOFError as e:
                        warnings.append(f"tile {t}: {e}")
                        continue
                    if h.roi:
                        v = np.where(np.abs(v) >= 1 << h.roi, np.sign(v) * (np.abs(v) >> h.roi), v)
                    if not h.reversible:
                        v = (v + np.sign(v) * 0.5) * _step_size(h, q.band, q.name, p.comp)
                    plane[y0 - by0 : y1 - by0, x0 - bx0 : x1 - bx0] = v
    planes = []
    for c in range(len(header.bits)):
        own, h = component_rect(header, c, rect), views[c]
        fine: list[dict] = [{} for _ in range(h.levels)]
        ll = None
        for i, (r, name, x0, y0, x1, y1) in enumerate(bands_of(own, h.levels)):
            plane = coef.get((c, i), np.zeros((max(0, y1 - y0), max(0, x1 - x0)), np.int64 if h.reversible else np.float64))
            if r:
                fine[h.levels - r][name] = plane
            else:
                ll = plane
        planes.append(wavelet.inverse(ll, fine, own[0], own[1], h.reversible, reduction))
    if header.transform:
        planes = inverse_component_transform(planes, header.reversible)
    out = []
    for c, p in enumerate(planes):
        if p.dtype != np.int64:
            p = np.floor(p + 0.5).astype(np.int64)
        half = 1 << (header.bits[c] - 1)
        out.append(np.clip(p, -half, half - 1) if header.signed[c] else np.clip(p + half, 0, 2 * half - 1))
    return out, warnings


def _read_packet(header: Header, body: bytes, at: int, layer: int, p: Precinct) -> int:
    """Take a packet's header and its blocks' bytes; blocks that are cut off do not count."""
    if body[at : at + 2] == b"\xff\x91":
        at += 6
    if at >= len(body):
        raise EOFError("packets are missing")
    source, found = _BitReader(body, at), []
    if source.get():
        for q in p.parts:
            if not q.blocks:
                continue
            if q.included is None:
                q.included, q.missing = TagTree(*q.grid), TagTree(*q.grid)
            for b in q.blocks:
                if not (source.get() if b.seen else q.included.read(source, b.column, b.row, layer + 1)):
                    continue
                if not b.seen:
                    b.seen, zero = True, 1
                    while not q.missing.read(source, b.column, b.row, zero):
                        zero += 1
                        if zero > q.limit + 1:
                            raise EOFError("broken bit planes")
                    b.planes = q.limit - zero + 1
                n = _get_passes(source)
                while source.get():
                    b.bits += 1
                    if b.bits > 32:
                        raise EOFError("broken lengths")
                found.append((b, n, source.get(b.bits + n.bit_length() - 1)))
    at = source.finish()
    if body[at : at + 2] == b"\xff\x92":
        at += 2
    for b, n, size in found:
        if at + size > len(body):
            raise EOFError("a code block is cut off")
        if b.passes + n > max(0, 3 * b.planes - 2):
            raise EOFError("too many passes")
        b.data, b.passes = b.data + body[at : at + size], b.passes + n
        at += size
    return at


def tiles_for(header: Header, region: tuple[int, int, int, int] | None) -> list[int]:
    """Tiles that a region (x0, y0, x1, y1 on the reference grid) touches."""
    nx, ny = header.grid
    if region is None:
        return list(range(nx * ny))
    x0, y0, x1, y1 = region
    cols = range(max(0, (x0 - header.tile_x0) // header.tile_w), min(nx, -(-(x1 - header.tile_x0) // header.tile_w)))
    rows = range(max(0, (y0 - header.tile_y0) // header.tile_h), min(ny, -(-(y1 - header.tile_y0) // header.tile_h)))
    return [q * nx + p for q in rows for p in cols]


def decode(data: bytes, region: tuple[int, int, int, int] | None = None, reduction: int = 0, at: int = 0, end: int | None = None) -> tuple[list[np.ndarray], list[str]]:
    """Planes of a region at a reduced resolution; only its tiles are decoded.  (planes, warnings)."""
    header, parts, warnings = parse(data, at, end)
    check(header)
    least = min([header.levels, *(d["levels"] for ds in header.overrides.values() for d in ds if "levels" in d)])
    if not 0 <= reduction <= least:
        raise ValueError(f"reduction {reduction}; the stream has {least} levels")
    full = (header.x0, header.y0, header.width, header.height)
    region = full if region is None else (max(region[0], full[0]), max(region[1], full[1]), min(region[2], full[2]), min(region[3], full[3]))
    if region[0] >= region[2] or region[1] >= region[3]:
        raise ValueError("the region is outside the image")
    window = [tuple(_ceil(v, reduction) for v in component_rect(header, c, region)) for c in range(len(header.bits))]
    out = [np.zeros((ey - oy, ex - ox), np.int64) for ox, oy, ex, ey in window]
    bodies: dict[int, bytes] = {}
    for p in sorted(parts, key=lambda p: (p.tile, p.part)):
        bodies[p.tile] = bodies.get(p.tile, b"") + data[p.start : p.end]
    for t in tiles_for(header, region):
        if t not in bodies:
            warnings.append(f"tile {t} is missing")
            continue
        planes, more = decode_tile(header, t, bodies[t], reduction)
        warnings += more
        for c, (o, p) in enumerate(zip(out, planes, strict=True)):
            ox, oy, ex, ey = window[c]
            tx0, ty0, tx1, ty1 = (_ceil(v, reduction) for v in component_rect(header, c, header.tile_rect(t)))
            x0, y0, x1, y1 = max(tx0, ox), max(ty0, oy), min(tx1, ex), min(ty1, ey)
            if x0 < x1 and y0 < y1:
                o[y0 - oy : y1 - oy, x0 - ox : x1 - ox] = p[y0 - ty0 : y1 - ty0, x0 - tx0 : x1 - tx0]
    return out, warnings


def encode_to_target(planes: list[np.ndarray], target: float, bits: int = 8, rounds: int = 3, **options) -> tuple[bytes, float]:
    """(codestream, mean absolute error): the quantiser step is moved until the error is within 0.85 to 1.18 of ``target``, the nearest kept."""
    step, best = max(target, 1e-3), None
    for _ in range(rounds):
        data = encode(planes, bits, lossless=False, step=step, **options)
        error = float(np.mean([np.abs(a - b).mean() for a, b in zip(planes, decode(data)[0], strict=True)]))
        miss = abs(np.log(max(error, 1e-9) / target))
        if best is None or miss < best[0]:
            best = (miss, data, error)
        if 0.85 <= error / target <= 1.18:
            break
        step *= min(3.0, max(1 / 3, target / max(error, 1e-9)))
    return best[1], best[2]


# ---- JP2


def present(planes: list[np.ndarray], info: dict) -> list[np.ndarray]:
    """Channels of a JP2 file: palette columns looked up (indexes clamped), colours in their order, alpha and others last."""
    if info["palette"] and info["mapping"]:
        table = np.array(info["palette"])
        planes = [table[np.clip(planes[c], 0, len(table) - 1), column] if kind == 1 else planes[c] for c, kind, column in info["mapping"]]
    if info["channels"]:
        colour = sorted((assoc, c) for c, kind, assoc in info["channels"] if kind == 0 and 0 < assoc < 65535)
        rest = [c for c, kind, assoc in info["channels"] if not (kind == 0 and 0 < assoc < 65535)]
        planes = [planes[c] for c in [c for _, c in colour] + rest]
    return planes


def box(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I", len(payload) + 8) + kind + payload


def wrap_jp2(codestream: bytes, width: int, height: int, comps: int, bits: int = 8, colour: int | None = None, icc: bytes | None = None, alpha: int | None = None) -> bytes:
    """A JP2 file: signature, file type, image header, colour, channel definition, codestream."""
    ihdr = box(b"ihdr", struct.pack(">IIHBBBB", height, width, comps, bits - 1, 7, 0, 0))
    colr = box(b"colr", b"\x02\x00\x00" + icc if icc else struct.pack(">BBBI", 1, 0, 0, colour or (16 if comps >= 3 else 17)))
    cdef = b""
    if alpha is not None:
        cdef = box(b"cdef", struct.pack(">H", comps) + b"".join(struct.pack(">HHH", c, int(c == alpha), 0 if c == alpha else c + 1) for c in range(comps)))
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + box(b"jp2h", ihdr + colr + cdef) + box(b"jp2c", codestream)
