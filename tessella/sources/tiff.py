"""Tiled-TIFF slides: classic, big and oversize directories as rows; levels, associated images, tiles."""

from __future__ import annotations

import struct

#: Bytes of a value by field type (fixed values).
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_FORMAT = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
# Tags.
WIDTH, HEIGHT, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, STRIP_COUNTS = 256, 257, 259, 262, 270, 273, 279
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
X_RESOLUTION, Y_RESOLUTION, RESOLUTION_UNIT = 282, 283, 296
LENS, FOCAL_PLANE, FORMAT_FLAG, PROPERTY_MAP, MCU_STARTS, MCU_HIGH = 65421, 65424, 65420, 65449, 65426, 65432
CODECS = {1: "raw", 7: "jpeg", 33003: "jpeg2000-ycbcr", 33005: "jpeg2000-rgb", 22610: "jpegxr"}
MOST_ENTRIES, MOST_DIRECTORIES, MOST_VALUES = 8192, 4096, 1 << 24


class Field:
    __slots__ = ("count", "data", "order", "tag", "type")

    def __init__(self, tag: int, kind: int, count: int, data: bytes, order: str):
        self.tag, self.type, self.count, self.data, self.order = tag, kind, count, data, order

    @property
    def values(self) -> list:
        """Numbers; rationals as doubles, 0 where the denominator is 0."""
        if self.type in (5, 10):
            pairs = struct.iter_unpack(self.order + ("II" if self.type == 5 else "ii"), self.data)
            return [a / b if b else 0.0 for a, b in pairs]
        if self.type == 2:
            return []
        return list(struct.unpack(f"{self.order}{self.count}{_FORMAT[self.type]}", self.data))

    @property
    def text(self) -> str:
        return self.data.decode("latin-1").rstrip("\0")


def is_oversize(data: bytes) -> bool:
    """Little-endian classic header whose first directory pointer is 8 bytes and whose directory carries the vendor flag."""
    if data[:4] != b"II*\0" or len(data) < 14:
        return False
    at = struct.unpack_from("<Q", data, 4)[0]
    if at < 12 or at + 2 > len(data):
        return False
    n = struct.unpack_from("<H", data, at)[0]
    return at + 2 + 12 * n <= len(data) and any(struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == FORMAT_FLAG for i in range(n))


def read(data: bytes, read_at=None) -> tuple[str, list[dict[int, Field]]]:
    """(layout, directories): layout is classic, big or oversize.

    ``read_at(offset, length)`` replaces slices of ``data`` for sources that seek.
    A chain that loops or is too long raises ValueError; so does a value past the end.
    """
    get = read_at or (lambda at, n: data[at : at + n])
    head = get(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("no TIFF byte order")
    magic = struct.unpack_from(order + "H", head, 2)[0]
    if magic == 43:
        layout, at = "big", struct.unpack_from(order + "Q", head, 8)[0]
    elif magic == 42 and read_at is None and is_oversize(data):
        layout, at = "oversize", struct.unpack_from("<Q", head, 4)[0]
    elif magic == 42:
        layout, at = "classic", struct.unpack_from(order + "I", head, 4)[0]
    else:
        raise ValueError(f"TIFF version {magic}")
    out, seen = [], set()
    while at:
        if at in seen or len(out) >= MOST_DIRECTORIES:
            raise ValueError("the directories form a loop")
        seen.add(at)
        directory, at = _directory(get, at, order, layout)
        out.append(directory)
    return layout, out


def _exact(get, at: int, n: int) -> bytes:
    got = get(at, n)
    if len(got) != n:
        raise ValueError(f"{n} bytes at {at} are past the end")
    return got


def _directory(get, at: int, order: str, layout: str) -> tuple[dict[int, Field], int]:
    big = layout == "big"
    head, entry, pointer = (8, 20, 8) if big else (2, 12, 8 if layout == "oversize" else 4)
    n = struct.unpack(order + ("Q" if big else "H"), _exact(get, at, head))[0]
    if n > MOST_ENTRIES:
        raise ValueError(f"{n} directory entries")
    raw = _exact(get, at + head, n * entry)
    after = at + head + n * entry
    follows = struct.unpack(order + ("Q" if pointer == 8 else "I"), _exact(get, after, pointer))[0]
    high = struct.unpack(f"<{n}I", _exact(get, after + 8, 4 * n)) if layout == "oversize" else (0,) * n
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, i * entry)
        if kind not in TYPE_SIZE:
            continue
        value = raw[i * entry + (12 if big else 8) : (i + 1) * entry]
        size = TYPE_SIZE[kind] * count
        if count > MOST_VALUES:
            raise ValueError(f"tag {tag} has {count} values")
        inline = size <= len(value) and not (layout == "oversize" and kind == 2)
        if inline and high[i]:
            if kind not in (4, 9):
                raise ValueError(f"tag {tag}: a high word for type {kind}")
            kind, body = {4: 16, 9: 17}[kind], value + struct.pack("<I", high[i])
        elif inline:
            body = value[:size]
        else:
            offset = struct.unpack(order + ("Q" if big else "I"), value)[0] + (high[i] << 32)
            body = _exact(get, offset, size)
        out[tag] = Field(tag, kind, count, body, order)
    return out, follows


def first(directory: dict[int, Field], tag: int, default=None):
    f = directory.get(tag)
    return f.values[0] if f and f.count and f.type != 2 else default


def structure(layout: str, directories: list[dict[int, Field]]) -> list[dict]:
    """One row a directory: ifd, kind (level, focus, associated), level, name, size, tiles, codec, downsample."""
    rows, levels, names = [], [], {}
    for ifd, d in enumerate(directories):
        w, h = first(d, WIDTH, 0), first(d, HEIGHT, 0)
        text = d[DESCRIPTION].text if DESCRIPTION in d else ""
        if layout == "oversize":
            lens, focal = first(d, LENS, 0) or 0, first(d, FOCAL_PLANE, 0)
            kind = ("level" if not focal else "focus") if lens > 0 else "associated"
        else:
            kind = "level" if ifd == 0 or TILE_W in d else "associated"
        name = None
        if kind == "associated":
            lines = text.replace("\r\n", "\n").split("\n")
            word = "".join(_leading_word(lines[1] if len(lines) > 1 else lines[0])) or ("macro" if layout == "oversize" else "thumbnail" if ifd == 1 else "associated")
            names[word] = names.get(word, 0) + 1
            name = word if names[word] == 1 else f"{word} {names[word]}"
        row = {"ifd": ifd, "kind": kind, "level": None, "name": name, "width": w, "height": h, "tile_w": first(d, TILE_W), "tile_h": first(d, TILE_H), "codec": CODECS.get(first(d, COMPRESSION, 1), "unreadable"), "downsample": None, "description": text}
        if kind == "level":
            levels.append(row)
        rows.append(row)
    if levels:
        base = levels[0]
        for i, r in enumerate(levels):
            r["level"] = i
            r["downsample"] = (base["width"] / r["width"] + base["height"] / r["height"]) / 2 if r["width"] and r["height"] else None
    return rows


def _leading_word(line: str):
    for i, c in enumerate(line):
        if c.isalpha() or i and c.isdigit():
            yield c.lower()
        else:
            return


def tile_index(directory: dict[int, Field]) -> list[tuple[int, int, int, int, int]]:
    """(tile, column, row, offset, bytes); tiles of no bytes are kept, they show the background."""
    if TILE_W not in directory:
        return []
    nx = -(-first(directory, WIDTH) // first(directory, TILE_W))
    pairs = zip(directory[TILE_OFFSETS].values, directory[TILE_COUNTS].values, strict=True)
    return [(t, t % nx, t // nx, o, n) for t, (o, n) in enumerate(pairs)]


# ---- builders, for writing small slides


def build(directories: list[list[tuple[int, int, list | bytes | str]]], blobs: list[list[bytes]] | None = None, layout: str = "classic", order: str = "<") -> bytes:
    """A file of directories of (tag, type, values); ``blobs[i]`` are tiles, whose offsets and sizes are added to directory i."""
    big, over = layout == "big", layout == "oversize"
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42))
    out += struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + ("Q" if over else "I"), 0)
    link = 8 if big else 4
    wide = "Q" if big or over else "I"
    for i, entries in enumerate(directories):
        entries = list(entries)
        if blobs and i < len(blobs) and blobs[i]:
            offsets = []
            for b in blobs[i]:
                offsets.append(len(out) if b else 0)
                out += b
            entries += [(TILE_OFFSETS, 16 if big else 4, offsets), (TILE_COUNTS, 16 if big else 4, [len(b) for b in blobs[i]])]
        packed = []
        for tag, kind, values in sorted(entries, key=lambda e: e[0]):
            if isinstance(values, str):
                values = values.encode("latin-1") + b"\0"
            if isinstance(values, bytes):
                body, count = values, len(values)
            elif kind in (5, 10):
                body, count = b"".join(struct.pack(order + "II", *v) for v in values), len(values)
            else:
                high = over and kind == 4 and len(values) == 1 and values[0] >> 32
                body, count = (struct.pack("<Q", values[0]) if high else struct.pack(f"{order}{len(values)}{_FORMAT[kind]}", *values)), len(values)
            room = 8 if big else 4
            if len(body) > room and not (over and kind == 4 and count == 1) or over and kind == 2:
                place = len(out)
                out += body
                packed.append((tag, kind, count, struct.pack(order + ("Q" if big else "I"), place), 0))
            else:
                packed.append((tag, kind, count, body[:room].ljust(room, b"\0"), struct.unpack("<I", body[4:8])[0] if len(body) == 8 and over else 0))
        at = len(out)
        struct.pack_into(order + wide, out, link, at)
        out += struct.pack(order + ("Q" if big else "H"), len(packed))
        for tag, kind, count, value, _ in packed:
            out += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, count) + value
        link = len(out)
        out += struct.pack(order + wide, 0)
        if over:
            out += b"".join(struct.pack("<I", h) for *_, h in packed)
    return bytes(out)
