"""Box containers: JP2 and JPEG XL files as rows of boxes, and the payloads that describe an image."""

from __future__ import annotations

import struct

# Fixed values.
JP2_SIGNATURE = b"\0\0\0\x0cjP  \r\n\x87\n"
JXL_SIGNATURE = b"\0\0\0\x0cJXL \r\n\x87\n"
SUPER = (b"jp2h", b"res ", b"asoc", b"uinf")
#: Header boxes are no larger.
HEADER_LIMIT = 1 << 26


def sniff(head: bytes) -> str | None:
    """jp2, j2k, jxl, jxl-container, tiff-big, tiff, or None; slides are told apart by their directories."""
    if head[:12] == JP2_SIGNATURE or head[4:8] == b"jP  ":
        return "jp2"
    if head[:4] == b"\xff\x4f\xff\x51":
        return "j2k"
    if head[:12] == JXL_SIGNATURE:
        return "jxl-container"
    if head[:2] == b"\xff\x0a":
        return "jxl"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if head[:4] in (b"II+\0", b"MM\0+"):
        return "tiff-big"
    return None


def walk(data: bytes, start: int = 0, end: int | None = None, depth: int = 0):
    """(seq-less) rows (depth, type, header offset, payload offset, payload length), nested boxes after their parent.

    Size 1 means a 64-bit size, size 0 means to the end; a box that reaches past the end raises ValueError.
    """
    end = len(data) if end is None else end
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box at {at}: its size is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}, {end - at} bytes are left")
        yield depth, kind.decode("latin-1"), at, at + head, size - head
        if kind in SUPER:
            if size > HEADER_LIMIT:
                raise ValueError(f"header box at {at} of {size} bytes")
            yield from walk(data, at + head, at + size, depth + 1)
        at += size


def find(data: bytes, kind: str) -> bytes | None:
    """All boxes of a type, concatenated; None without one."""
    parts = [data[p : p + n] for _, k, _, p, n in walk(data) if k == kind]
    return b"".join(parts) if parts else None


def jp2_info(data: bytes) -> dict:
    """Image header, colour, palette, channel mapping and definition, resolution, and where the codestream lies."""
    out: dict = {"width": None, "height": None, "components": None, "bits": [], "colour": None, "icc": None, "palette": None, "mapping": [], "channels": [], "resolution": {}, "codestream": None}
    for _, kind, _, at, n in walk(data):
        body = data[at : at + n]
        if kind == "ihdr":
            out["height"], out["width"], out["components"], depth = struct.unpack_from(">IIHB", body)
            out["bits"] = [] if depth == 255 else [(depth & 127) + 1] * out["components"]
        elif kind == "bpcc":
            out["bits"] = [(b & 127) + 1 for b in body]
        elif kind == "colr" and out["colour"] is None and out["icc"] is None:
            if body[0] == 1:
                out["colour"] = {16: "srgb", 17: "grey", 18: "sycc"}.get(struct.unpack_from(">I", body, 3)[0], "unknown")
            elif body[0] == 2:
                out["icc"] = body[3:]
        elif kind == "pclr":
            entries, columns = struct.unpack_from(">HB", body)
            sizes = [((b & 127) + 8) // 8 for b in body[3 : 3 + columns]]
            p, rows = 3 + columns, []
            for _ in range(entries):
                row = []
                for s in sizes:
                    row.append(int.from_bytes(body[p : p + s], "big"))
                    p += s
                rows.append(row)
            out["palette"] = rows
        elif kind == "cmap":
            out["mapping"] = list(struct.iter_unpack(">HBB", body))
        elif kind == "cdef":
            out["channels"] = list(struct.iter_unpack(">HHH", body[2:]))
        elif kind in ("resc", "resd"):
            vn, vd, hn, hd, ve, he = struct.unpack(">HHHHbb", body)
            out["resolution"][kind] = (hn / hd * 10.0**he if hd else 0.0, vn / vd * 10.0**ve if vd else 0.0)
        elif kind == "jp2c" and out["codestream"] is None:
            out["codestream"] = (at, n)
    return out


def palette_box(rows: list[list[int]], bits: int = 8) -> bytes:
    size = (bits + 7) // 8
    body = struct.pack(">HB", len(rows), len(rows[0])) + bytes([bits - 1] * len(rows[0])) + b"".join(v.to_bytes(size, "big") for r in rows for v in r)
    return struct.pack(">I", len(body) + 8) + b"pclr" + body


# ---- JPEG XL containers


def jxl_segments(data: bytes) -> list[tuple[int, int, int, int]]:
    """(seq, codestream offset, file offset, length) of the codestream's parts, in order; index bytes skipped."""
    if data[:2] == b"\xff\x0a":
        return [(0, 0, 0, len(data))]
    out, at, kinds = [], 0, [k for _, k, *_ in walk(data)]
    if len(kinds) < 2 or kinds[1] != "ftyp":
        raise ValueError("the file type box does not come first")
    expected = 0
    for _, kind, _, p, n in walk(data):
        if kind == "jxlp":
            index = struct.unpack_from(">I", data, p)[0]
            if index & 0x7FFFFFFF != expected:
                raise ValueError("codestream parts are out of order")
            expected += 1
            p, n = p + 4, n - 4
        elif kind != "jxlc":
            continue
        out.append((len(out), at, p, n))
        at += n
    if not out:
        raise ValueError("no codestream box")
    return out


def jxl_level(data: bytes) -> int | None:
    """The declared codestream level: 5 for a container that declares none, None for a bare stream."""
    if data[:2] == b"\xff\x0a":
        return None
    body = find(data, "jxll")
    return body[0] if body else 5


def exif_payload(data: bytes) -> bytes | None:
    """The TIFF structure of the Exif box, whose first four bytes say where it starts."""
    body = find(data, "Exif")
    return body[4 + struct.unpack_from(">I", body)[0] :] if body and len(body) >= 4 else None


def wrap_jxl(codestream: bytes, level: int = 5, exif: bytes | None = None, xmp: bytes | None = None, parts: int = 1) -> bytes:
    """A container: level only above 5, metadata, then the codestream in one box or ordered parts."""
    box = lambda kind, payload: struct.pack(">I", len(payload) + 8) + kind + payload
    out = [JXL_SIGNATURE, box(b"ftyp", b"jxl \0\0\0\0jxl ")]
    if level > 5:
        out.append(box(b"jxll", bytes([level])))
    if exif is not None:
        out.append(box(b"Exif", b"\0\0\0\0" + exif))
    if xmp is not None:
        out.append(box(b"xml ", xmp))
    if parts == 1:
        out.append(box(b"jxlc", codestream))
    else:
        size = -(-len(codestream) // parts)
        for i in range(parts):
            last = 0x80000000 if i == parts - 1 else 0
            out.append(box(b"jxlp", struct.pack(">I", i | last) + codestream[i * size : (i + 1) * size]))
    return b"".join(out)


class Bits:
    """Least-significant-bit-first reader of codestream headers."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data[:65536], "little"), 0, 8 * min(len(data), 65536)

    def u(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError("header is cut off")
        v = self.value >> self.at & ((1 << n) - 1)
        self.at += n
        return v

    def u32(self, *ways: tuple[int, int]) -> int:
        """One of four (base, bits) by a two-bit selector."""
        base, n = ways[self.u(2)]
        return base + self.u(n)


#: Aspect ratios by code (fixed values): width = height * a / b.
RATIOS = {1: (1, 1), 2: (12, 10), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}
_SIZES = ((1, 9), (1, 13), (1, 18), (1, 30))


def jxl_size(codestream: bytes) -> tuple[int, int]:
    """(width, height) from the size header of a codestream."""
    if codestream[:2] != b"\xff\x0a":
        raise ValueError("no codestream signature")
    b = Bits(codestream[2:])
    small = b.u(1)
    height = (b.u(5) + 1) * 8 if small else b.u32(*_SIZES)
    ratio = b.u(3)
    if ratio:
        a, c = RATIOS[ratio]
        return height * a // c, height
    return ((b.u(5) + 1) * 8 if small else b.u32(*_SIZES)), height


def write_jxl_size(width: int, height: int) -> bytes:
    """A codestream's signature and size header, without a ratio."""
    bits, n = 0, 0

    def put(v: int, k: int) -> None:
        nonlocal bits, n
        bits |= v << n
        n += k

    def size(v: int) -> None:
        for i, (base, k) in enumerate(_SIZES):
            if v - base < 1 << k:
                put(i, 2)
                put(v - base, k)
                return
        raise ValueError("too large")

    put(0, 1)
    size(height)
    put(0, 3)
    size(width)
    return b"\xff\x0a" + bits.to_bytes((n + 7) // 8, "little")
