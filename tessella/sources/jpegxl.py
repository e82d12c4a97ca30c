"""JPEG XL headers: one description of each header that both reads and writes it.

A ``Bits`` object passes values through: reading, ``b.u(8, value)`` ignores the
value and returns what the stream holds; writing, it puts the value and returns
it.  Each header is a dict; keys that are missing take the format's defaults.
"""

from __future__ import annotations

import struct

import numpy as np

from tessella.functions.kernels import lehmer_apply, lehmer_of

# Names by code.
FRAME_TYPES = ("regular", "lf", "reference", "skip-progressive")
EXTRA_TYPES = {0: "alpha", 1: "depth", 2: "spot", 3: "selection", 4: "black", 5: "cfa", 6: "thermal", 15: "non-optional", 16: "optional"}
COLOUR_SPACES = ("rgb", "grey", "xyb", "unknown")
RATIOS = {1: (1, 1), 2: (6, 5), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}
FLAG_LF_FRAME = 32


class Bits:
    """Least significant bit first; a reader over ``data``, or a writer without."""

    def __init__(self, data: bytes | None = None):
        self.reading = data is not None
        self.data = data or b""
        self.at, self.acc, self.done = 0, 0, bytearray()

    def u(self, n: int, value: int = 0) -> int:
        if self.reading:
            first, last = self.at >> 3, (self.at + n + 7) >> 3
            if last > len(self.data):
                raise EOFError("the header is cut off")
            value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        else:
            value = int(value)
            if not 0 <= value < 1 << n:
                raise ValueError(f"{value} does not fit {n} bits")
            self.acc |= value << self.at - 8 * len(self.done)
            if self.at + n >= 8 * len(self.done) + 64:
                k = (self.at + n) // 8 - len(self.done)
                self.done += (self.acc & (1 << 8 * k) - 1).to_bytes(k, "little")
                self.acc >>= 8 * k
        self.at += n
        return value

    def flag(self, value: bool = False) -> bool:
        return bool(self.u(1, int(value)))

    def choice(self, ways, value: int = 0) -> int:
        """One of four (base, bits), told by two bits; the first that fits is written."""
        if self.reading:
            base, n = ways[self.u(2)]
            return base + self.u(n)
        for i, (base, n) in enumerate(ways):
            if 0 <= value - base < 1 << n:
                self.u(2, i)
                self.u(n, value - base)
                return value
        raise ValueError(f"{value} is out of range")

    def enum(self, value: int = 0) -> int:
        return self.choice(((0, 0), (1, 0), (2, 4), (18, 6)), value)

    def u64(self, value: int = 0) -> int:
        kind = self.u(2, 0 if value == 0 else 1 if value <= 16 else 2 if value <= 272 else 3)
        if kind == 0:
            return 0
        if kind < 3:
            base, n = ((1, 4), (17, 8))[kind - 1]
            return base + self.u(n, value - base)
        out, shift = self.u(12, value & 4095), 12
        while self.flag(value >> shift > 0):
            n = 4 if shift == 60 else 8
            out |= self.u(n, value >> shift & ((1 << n) - 1)) << shift
            shift += n
            if shift >= 64:
                break
        return out

    def f16(self, value: float = 0.0) -> float:
        raw = self.u(16, int(np.float16(value).view(np.uint16)))
        if raw >> 10 & 31 == 31:
            raise ValueError("a number that is not finite")
        return float(np.uint16(raw).view(np.float16))

    def align(self) -> None:
        self.u(-self.at % 8, 0)

    def bytes(self) -> bytes:
        return bytes(self.done) + self.acc.to_bytes((self.at + 7) // 8 - len(self.done), "little")


def _size_ratio(height: int, code: int) -> int:
    a, b = RATIOS[code]
    return height * a // b


def size(b: Bits, s: dict) -> dict:
    """width and height: in eights or free, the width by ratio where one fits."""
    ways = ((1, 9), (1, 13), (1, 18), (1, 30))
    w, h = s.get("width", 1), s.get("height", 1)
    eights = b.flag(not b.reading and h % 8 == 0 == w % 8 and h <= 256 and w <= 256)
    one = (lambda v: (b.u(5, v // 8 - 1) + 1) * 8) if eights else (lambda v: b.choice(ways, v))
    h = one(h)
    ratio = b.u(3, next((k for k in RATIOS if _size_ratio(h, k) == w), 0))
    w = _size_ratio(h, ratio) if ratio else one(w)
    if w * h > 1 << 40:
        raise ValueError("the image is too large")
    return {"width": w, "height": h}


def preview(b: Bits, s: dict) -> dict:
    w, h = s.get("width", 1), s.get("height", 1)
    eights = b.flag(not b.reading and h % 8 == 0 == w % 8)
    if eights:
        ways = ((16, 0), (32, 0), (1, 5), (33, 9))
        one = lambda v: b.choice(ways, v // 8) * 8
    else:
        one = lambda v: b.choice(((1, 6), (65, 8), (321, 10), (1345, 12)), v)
    h = one(h)
    ratio = b.u(3, next((k for k in RATIOS if _size_ratio(h, k) == w), 0))
    w = _size_ratio(h, ratio) if ratio else one(w)
    if w > 4096 or h > 4096:
        raise ValueError("the preview is too large")
    return {"width": w, "height": h}


def bit_depth(b: Bits, s: dict) -> dict:
    if b.flag(s.get("exponent", 0) > 0):
        bits = b.choice(((32, 0), (16, 0), (24, 0), (1, 6)), s.get("bits", 32))
        exponent = b.u(4, s.get("exponent", 1) - 1) + 1
        if not (2 <= exponent <= 8 and 2 <= bits - exponent - 1 <= 23):
            raise ValueError("a float layout that is not allowed")
        return {"bits": bits, "exponent": exponent}
    bits = b.choice(((8, 0), (10, 0), (12, 0), (1, 6)), s.get("bits", 8))
    if bits > 31:
        raise ValueError(f"{bits} bits a sample")
    return {"bits": bits, "exponent": 0}


def name(b: Bits, text: str = "") -> str:
    raw = text.encode()
    n = b.choice(((0, 0), (0, 4), (16, 5), (48, 10)), len(raw))
    raw = raw.ljust(n, b"\0")
    return bytes(b.u(8, raw[i]) for i in range(n)).decode("utf-8", "replace")


def extensions(b: Bits) -> None:
    mask = b.u64()
    lengths = [b.u64() for i in range(64) if mask >> i & 1]
    for n in lengths:
        b.at += n


def extra_channel(b: Bits, s: dict) -> dict:
    plain = {"type": "alpha", "depth": {"bits": 8, "exponent": 0}, "shift": 0, "name": "", "associated": False}
    if b.flag(not b.reading and {**plain, **s} == plain):
        return plain
    codes = {v: k for k, v in EXTRA_TYPES.items()}
    kind = EXTRA_TYPES.get(b.enum(codes[s.get("type", "alpha")] if not b.reading else 0))
    if kind is None:
        raise ValueError("an extra channel of an unknown type")
    out = {"type": kind, "depth": bit_depth(b, s.get("depth", {})), "shift": b.choice(((0, 0), (3, 0), (4, 0), (1, 3)), s.get("shift", 0)), "name": name(b, s.get("name", ""))}
    if kind == "alpha":
        out["associated"] = b.flag(s.get("associated", False))
    elif kind == "spot":
        given = s.get("spot", [0.0] * 4)
        out["spot"] = [b.f16(v) for v in given]
    elif kind == "cfa":
        out["cfa"] = b.choice(((1, 0), (0, 2), (3, 4), (19, 8)), s.get("cfa", 1))
    return out


def _xy(b: Bits, given) -> list[float]:
    ways = ((0, 19), (524288, 19), (1048576, 20), (2097152, 21))
    out = []
    for v in given:
        u = b.choice(ways, (lambda k: 2 * k if k >= 0 else -2 * k - 1)(round(v * 1e6)))
        out.append((u >> 1 ^ -(u & 1)) / 1e6)
    return out


def colour_encoding(b: Bits, s: dict) -> dict:
    plain = {"default": True, "icc": False, "space": "rgb", "white": 1, "primaries": 1, "transfer": 13, "gamma": 0, "intent": 1}
    if b.flag(not b.reading and {**plain, **s, "default": True} == plain):
        return plain
    out = {**plain, "default": False, "icc": b.flag(s.get("icc", False))}
    space = b.enum(COLOUR_SPACES.index(s.get("space", "rgb")))
    if space >= len(COLOUR_SPACES):
        raise ValueError("an unknown colour space")
    out["space"] = COLOUR_SPACES[space]
    if out["icc"]:
        return out
    if out["space"] != "xyb":
        out["white"] = b.enum(s.get("white", 1))
        if out["white"] == 2:
            out["white_xy"] = _xy(b, s.get("white_xy", [0.0] * 2))
        if out["space"] != "grey":
            out["primaries"] = b.enum(s.get("primaries", 1))
            if out["primaries"] == 2:
                out["primaries_xy"] = _xy(b, s.get("primaries_xy", [0.0] * 6))
    if b.flag(s.get("gamma", 0) > 0):
        out["gamma"], out["transfer"] = b.u(24, s.get("gamma", 0)), None
        if not 0 < out["gamma"] <= 10_000_000:
            raise ValueError("a gamma that is not allowed")
    else:
        out["transfer"] = b.enum(s.get("transfer") or 13)
    out["intent"] = b.enum(s.get("intent", 1))
    return out


def metadata(b: Bits, s: dict) -> dict:
    """Depth, orientation, preview, animation, extra channels, colour, tone mapping, opsin matrix, upsampling weights."""
    out = {"orientation": 1, "intrinsic": None, "preview": None, "animation": None, "depth": {"bits": 8, "exponent": 0}, "short": True, "extra": [], "xyb": True, "colour": colour_encoding(_default_colour(), {}), "tone": {"intensity": 255.0, "min": 0.0, "relative": False, "below": 0.0}, "opsin": None, "weights": {}}
    given = {**out, **s}
    if not b.flag(not b.reading and {**given, "opsin": None, "weights": {}} == out):
        fields = b.flag(any(given[k] != out[k] for k in ("orientation", "intrinsic", "preview", "animation", "tone")))
        if fields:
            out["orientation"] = b.u(3, given["orientation"] - 1) + 1
            if b.flag(given["intrinsic"] is not None):
                out["intrinsic"] = size(b, given["intrinsic"] or {})
            if b.flag(given["preview"] is not None):
                out["preview"] = preview(b, given["preview"] or {})
            if b.flag(given["animation"] is not None):
                a = given["animation"] or {}
                out["animation"] = {
                    "numerator": b.choice(((100, 0), (1000, 0), (1, 10), (1, 30)), a.get("numerator", 100)),
                    "denominator": b.choice(((1, 0), (1001, 0), (1, 8), (1, 10)), a.get("denominator", 1)),
                    "loops": b.choice(((0, 0), (0, 3), (0, 16), (0, 32)), a.get("loops", 0)),
                    "timecodes": b.flag(a.get("timecodes", False)),
                }
        out["depth"] = bit_depth(b, given["depth"])
        out["short"] = b.flag(given["short"])
        n = b.choice(((0, 0), (1, 0), (2, 4), (1, 12)), len(given["extra"]))
        out["extra"] = [extra_channel(b, given["extra"][i] if i < len(given["extra"]) else {}) for i in range(n)]
        out["xyb"] = b.flag(given["xyb"])
        out["colour"] = colour_encoding(b, given["colour"])
        if fields and not b.flag(not b.reading and given["tone"] == out["tone"]):
            t = given["tone"]
            out["tone"] = {"intensity": b.f16(t["intensity"]), "min": b.f16(t["min"]), "relative": b.flag(t["relative"]), "below": b.f16(t["below"])}
        extensions(b)
    if not b.flag(not b.reading and given["opsin"] is None and not given["weights"]):
        if out["xyb"] and not b.flag(not b.reading and given["opsin"] is None):
            values = given["opsin"] or [0.0] * 16
            out["opsin"] = [b.f16(v) for v in values]
        mask = b.u(3, sum(1 << i for i, k in enumerate((2, 4, 8)) if k in given["weights"]))
        for i, (k, n) in enumerate(((2, 15), (4, 55), (8, 210))):
            if mask >> i & 1:
                out["weights"][k] = [b.f16(v) for v in given["weights"].get(k, [0.0] * n)]
    return out


def _default_colour() -> Bits:
    return Bits(b"\x01")


def passes(b: Bits, s: dict) -> dict:
    n = b.choice(((1, 0), (2, 0), (3, 0), (4, 3)), s.get("n", 1))
    out = {"n": n, "shift": [0] * n, "down": [1], "last": [n - 1]}
    if n > 1:
        given = out if b.reading else {**out, **s}
        k = b.choice(((0, 0), (1, 0), (2, 0), (3, 1)), len(given["down"]) - 1)
        if k >= n:
            raise ValueError("more downsampling steps than passes")
        out["shift"] = [b.u(2, given["shift"][i]) for i in range(n - 1)] + [0]
        down = [1 << b.u(2, given["down"][i].bit_length() - 1 if i < len(given["down"]) else 0) for i in range(k)]
        last = [b.choice(((0, 0), (1, 0), (2, 0), (0, 3)), given["last"][i] if i < len(given["last"]) else 0) for i in range(k)]
        out["down"], out["last"] = [*down, 1], [*last, n - 1]
    return out


#: The restoration filter's defaults (fixed values).
FILTER = {"gab": True, "gab_weights": None, "epf": 2, "sharp": None, "scale": None, "sigma": None, "modular_sigma": 1.0}


def restoration_filter(b: Bits, s: dict, modular: bool) -> dict:
    given, out = {**FILTER, **s}, dict(FILTER)
    if b.flag(not b.reading and given == FILTER):
        return out
    out["gab"] = b.flag(given["gab"])
    if out["gab"] and b.flag(given["gab_weights"] is not None):
        out["gab_weights"] = [b.f16(v) for v in given["gab_weights"] or [0.0] * 6]
    out["epf"] = b.u(2, given["epf"])
    if out["epf"]:
        if not modular and b.flag(given["sharp"] is not None):
            out["sharp"] = [b.f16(v) for v in given["sharp"] or [0.0] * 8]
        if b.flag(given["scale"] is not None):
            out["scale"] = [b.f16(v) for v in given["scale"] or [0.0] * 3]
            b.u(32)
        if b.flag(given["sigma"] is not None):
            out["sigma"] = [b.f16(v) for v in given["sigma"] or [0.0] * (3 if modular else 4)]
        if modular:
            out["modular_sigma"] = b.f16(given["modular_sigma"])
    extensions(b)
    return out


MODES = ("replace", "add", "blend", "muladd", "mul")


def _blending(b: Bits, s: dict, extra: int, full: bool) -> dict:
    mode = b.choice(((0, 0), (1, 0), (2, 0), (3, 2)), MODES.index(s.get("mode", "replace")))
    if mode >= len(MODES):
        raise ValueError("an unknown blend mode")
    out = {"mode": MODES[mode], "alpha": 0, "clamp": False, "source": 0}
    if extra:
        if mode in (2, 3):
            out["alpha"] = b.choice(((0, 0), (1, 0), (2, 0), (3, 3)), s.get("alpha", 0))
        if mode > 1:
            out["clamp"] = b.flag(s.get("clamp", False))
    if not full or mode:
        out["source"] = b.u(2, s.get("source", 0))
    return out


def frame(b: Bits, s: dict, meta: dict, width: int, height: int) -> dict:
    """Type, coding, subsampling, passes, crop, blending, duration, references, filter of a frame."""
    b.align()
    extra = len(meta["extra"])
    out: dict = {"type": "regular", "modular": False, "flags": 0, "ycbcr": False, "sampling": [0, 0, 0], "upsampling": 1, "extra_upsampling": [1] * extra, "group_shift": 8, "xqm": 3, "bqm": 2, "passes": {"n": 1, "shift": [0], "down": [1], "last": [0]}, "lf_level": 0, "x0": 0, "y0": 0, "width": width, "height": height, "blending": {"mode": "replace", "alpha": 0, "clamp": False, "source": 0}, "extra_blending": [{"mode": "replace", "alpha": 0, "clamp": False, "source": 0}] * extra, "duration": 0, "timecode": 0, "last": True, "save": 0, "save_before": False, "name": "", "filter": dict(FILTER)}
    given = {**out, **s}
    if b.flag(not b.reading and given == out):
        return out
    out["type"] = FRAME_TYPES[b.u(2, FRAME_TYPES.index(given["type"]))]
    kind = out["type"]
    out["modular"] = b.flag(given["modular"])
    out["flags"] = b.u64(given["flags"])
    if not meta["xyb"]:
        out["ycbcr"] = b.flag(given["ycbcr"])
    if not out["flags"] & FLAG_LF_FRAME:
        if out["ycbcr"]:
            out["sampling"] = [b.u(2, v) for v in given["sampling"]]
        out["upsampling"] = 1 << b.u(2, given["upsampling"].bit_length() - 1)
        out["extra_upsampling"] = [(1 << b.u(2, (given["extra_upsampling"][i] >> e["shift"]).bit_length() - 1)) << e["shift"] for i, e in enumerate(meta["extra"])]
        if any(u > 8 or u < out["upsampling"] for u in out["extra_upsampling"]):
            raise ValueError("extra channel upsampling that is not allowed")
    if out["modular"]:
        out["group_shift"] = 7 + b.u(2, given["group_shift"] - 7)
    elif meta["xyb"]:
        out["xqm"], out["bqm"] = b.u(3, given["xqm"]), b.u(3, given["bqm"])
    if kind != "reference":
        out["passes"] = passes(b, given["passes"])
    full = True
    if kind == "lf":
        out["lf_level"] = b.u(2, given["lf_level"] - 1) + 1
    elif b.flag((given["x0"], given["y0"], given["width"], given["height"]) != (0, 0, width, height)):
        ways = ((0, 8), (256, 11), (2304, 14), (18688, 30))
        if kind != "reference":
            for k in ("x0", "y0"):
                v = given[k]
                u = b.choice(ways, 2 * v if v >= 0 else -2 * v - 1)
                out[k] = u >> 1 ^ -(u & 1)
        out["width"], out["height"] = b.choice(ways, given["width"]), b.choice(ways, given["height"])
        full = out["x0"] <= 0 and out["y0"] <= 0 and out["x0"] + out["width"] >= width and out["y0"] + out["height"] >= height
    shown = kind in ("regular", "skip-progressive")
    if shown:
        out["blending"] = _blending(b, given["blending"], extra, full)
        out["extra_blending"] = [_blending(b, given["extra_blending"][i], extra, full) for i in range(extra)]
        if meta["animation"]:
            out["duration"] = b.choice(((0, 0), (1, 0), (0, 8), (0, 32)), given["duration"])
            if meta["animation"]["timecodes"]:
                out["timecode"] = b.u(32, given["timecode"])
        out["last"] = b.flag(given["last"])
    else:
        out["last"] = False
    if kind != "lf" and not out["last"]:
        out["save"] = b.u(2, given["save"])
    if kind == "reference" or shown and full and out["blending"]["mode"] == "replace" and (not out["duration"] or out["save"]) and not out["last"]:
        out["save_before"] = b.flag(given["save_before"])
    else:
        out["save_before"] = kind == "lf"
    out["name"] = name(b, given["name"])
    out["filter"] = restoration_filter(b, given["filter"], out["modular"])
    extensions(b)
    return out


def geometry(f: dict) -> dict:
    """Coded size, groups and coarse groups of a frame, and its number of sections."""
    down = f["upsampling"] << 3 * f["lf_level"]
    up = lambda v, n: -(-v // n)
    w, h, g = up(up(f["width"], f["upsampling"]), down // f["upsampling"]), up(up(f["height"], f["upsampling"]), down // f["upsampling"]), 1 << f["group_shift"]
    groups, coarse = up(w, g) * up(h, g), up(w, 8 * g) * up(h, 8 * g)
    n = f["passes"]["n"]
    return {"width": w, "height": h, "group": g, "columns": up(w, g), "rows": up(h, g), "groups": groups, "coarse": coarse, "sections": 1 if n == 1 and groups == 1 else 2 + coarse + n * groups}


def permutation(b: Bits, n: int, order: list[int] | None = None) -> list[int]:
    """An order of 0..n-1, entropy-coded as a Lehmer code without its trailing zeros; read, or written from ``order``."""
    from tessella.sources.modular import Code, Symbols

    context = lambda v: min(7, v.bit_length())
    if order is not None:
        code = lehmer_of(order)
        symbols = [(context(n), len(code)), *((context(before), v) for before, v in zip([0, *code], code, strict=False))]
        Code.fit(b, 8, symbols).write(b, symbols)
        return order
    reader = Symbols(b, Code.read(b, 8))
    length = reader.get(context(n))
    if length > n:
        raise ValueError("a permutation that is longer than what it orders")
    code, last = [], 0
    for i in range(length):
        last = reader.get(context(last))
        if last >= n - i:
            raise ValueError("a permutation that leaves its range")
        code.append(last)
    reader.finish()
    return lehmer_apply(list(range(n)), code)


def contents(b: Bits, sizes: list[int], n: int, order: list[int] | None = None) -> list[tuple[int, int]]:
    """(offset, size) of each section, from the end of the table on.

    Sections may stand in another order: section i is then entry ``order[i]`` of the table.
    ``sizes`` are those of the entries.
    """
    permuted = b.flag(order is not None)
    if permuted:
        order = permutation(b, n, order)
    b.align()
    sizes = [b.choice(((0, 10), (1024, 14), (17408, 22), (4211712, 30)), sizes[i] if i < len(sizes) else 0) for i in range(n)]
    b.align()
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist() if n else []
    entries = list(zip(offsets, sizes, strict=True))
    return [entries[i] for i in order] if permuted else entries


def reorder(entries: list[tuple[int, int]], lehmer: list[int]) -> list[tuple[int, int]]:
    """A table of contents with its permutation applied."""
    return lehmer_apply(entries, lehmer)


def read_headers(codestream: bytes) -> dict:
    """Image size and metadata, and the first frame's header, geometry and sections, where no profile or preview precedes it."""
    if codestream[:2] != b"\xff\x0a":
        raise ValueError("no codestream signature")
    b = Bits(codestream)
    b.at = 16
    out = {**size(b, {}), "metadata": metadata(b, {})}
    if not out["metadata"]["colour"]["icc"] and out["metadata"]["preview"] is None:
        w, h = out["width"], out["height"]
        out["frame"] = frame(b, {}, out["metadata"], w, h)
        out["geometry"] = geometry(out["frame"])
        out["sections"] = contents(b, [], out["geometry"]["sections"])
        out["body"] = b.at // 8
    return out


def write_headers(width: int, height: int, meta: dict | None = None, first: dict | None = None, sizes: list[int] | None = None, order: list[int] | None = None) -> bytes:
    b = Bits()
    size(b, {"width": width, "height": height})
    m = metadata(b, meta or {})
    if first is not None:
        f = frame(b, first, m, width, height)
        contents(b, sizes or [], geometry(f)["sections"], order)
    return b"\xff\x0a" + b.bytes()  # whole bytes, so alignment is the same with or without them


def required_level(width: int, height: int, icc: int, extra: int, bits: int, black: bool) -> int | None:
    """The codestream level that these facts ask for; None beyond all levels."""
    for level, side, area, profile, channels, depth in ((5, 1 << 18, 1 << 28, 1 << 22, 4, 16), (10, 1 << 30, 1 << 40, 1 << 28, 256, 32)):
        if max(width, height) <= side and width * height <= area and icc <= profile and extra <= channels and bits <= depth and not (black and level == 5):
            return level
    return None


def gain_map(data: bytes) -> dict:
    """The parts of a gain map box: version, metadata, colour encoding, compressed profile, codestream."""
    version, n = struct.unpack_from(">BH", data)
    at = 3 + n
    colour = data[at]
    profile = struct.unpack_from(">I", data, at + 1 + colour)[0]
    start = at + 5 + colour
    return {"version": version, "metadata": data[3:at], "colour": data[at + 1 : at + 1 + colour], "profile": data[start : start + profile], "codestream": data[start + profile :]}
