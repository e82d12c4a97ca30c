"""Region reads of whole slides: levels, tiles by arithmetic, per-codec decoding, subsampling, background."""

from __future__ import annotations

import numpy as np

from tessella.sources import jpeg, jpeg2000, tiff

BACKGROUND = 255


def best_level(rows: list[dict], downsample: float) -> int:
    """The coarsest level that is not coarser than ``downsample``, the earlier of equals; 0 where none is."""
    fits = [(r["downsample"], -r["level"]) for r in rows if r["kind"] == "level" and r["downsample"] is not None and r["downsample"] <= downsample + 1e-6]
    return -max(fits)[1] if fits else 0


def _eight(p: np.ndarray, bits: int, signed: bool) -> np.ndarray:
    p = p + (1 << (bits - 1)) if signed else p
    p = p >> (bits - 8) if bits > 8 else p << (8 - bits)
    return np.clip(p, 0, 255)


def decode_tile(data: bytes, codec: str, w: int, h: int) -> np.ndarray:
    """h x w x 3, 8 bits."""
    if codec.startswith("jpeg2000"):
        header, _, _ = jpeg2000.parse(data)
        planes, _ = jpeg2000.decode(data)
        planes = [_eight(p, b, s) for p, b, s in zip(planes, header.bits, header.signed, strict=True)]
        if len(planes) < 3:
            planes = [planes[0]] * 3
        if codec.endswith("ycbcr"):
            y, u, v = planes[0], planes[1] - 128.0, planes[2] - 128.0
            planes = [np.clip(np.floor(p + 0.5), 0, 255) for p in (y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u)]
        return np.stack(planes[:3], axis=2).astype(np.uint8)
    if codec == "jpeg":
        out = jpeg.decode(data)
        return out if out.shape[2] == 3 else out.repeat(3, axis=2)
    if codec == "raw":
        out = np.frombuffer(data[: len(data) // (w * h) * w * h], np.uint8).reshape(h, w, -1)
        return out if out.shape[2] >= 3 else out[:, :, :1].repeat(3, axis=2)
    raise ValueError(f"pixels of codec {codec} cannot be read")


def read_region(data: bytes, level: int, x: int, y: int, w: int, h: int, step: int = 1) -> np.ndarray:
    """Every ``step``-th pixel of a region of a level, as RGB.

    Tiles follow from the corners by arithmetic; those without data, and what lies
    outside the level, show the background.  Tiles without a sampled pixel are skipped.
    """
    layout, dirs = tiff.read(data)
    rows = [r for r in tiff.structure(layout, dirs) if r["kind"] == "level"]
    if not 0 <= level < len(rows):
        raise ValueError(f"level {level}; the slide has {len(rows)}")
    r = rows[level]
    out = np.full((-(-h // step), -(-w // step), 3), BACKGROUND, np.uint8)
    tw, th = r["tile_w"], r["tile_h"]
    index = {(i, j): (o, n) for _, i, j, o, n in tiff.tile_index(dirs[r["ifd"]])}
    if not index:
        raise ValueError("the level is not tiled")
    for j in range(max(0, y // th), (min(y + h, r["height"]) - 1) // th + 1):
        for i in range(max(0, x // tw), (min(x + w, r["width"]) - 1) // tw + 1):
            # destination pixels whose source lies in this tile
            x0, x1 = max(0, -(-(i * tw - x) // step)), min(out.shape[1] - 1, (min((i + 1) * tw, r["width"]) - 1 - x) // step)
            y0, y1 = max(0, -(-(j * th - y) // step)), min(out.shape[0] - 1, (min((j + 1) * th, r["height"]) - 1 - y) // step)
            offset, size = index.get((i, j), (0, 0))
            if x0 > x1 or y0 > y1 or not size:
                continue
            tile = decode_tile(data[offset : offset + size], r["codec"], tw, th)
            out[y0 : y1 + 1, x0 : x1 + 1] = tile[y + y0 * step - j * th : y + y1 * step - j * th + 1 : step, x + x0 * step - i * tw : x + x1 * step - i * tw + 1 : step]
    return out


def read_strips(data: bytes, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A region of one large JPEG with restart intervals: only the intervals it touches are decoded."""
    head = jpeg.read_header(data)
    if not head.restart:
        return jpeg.decode(data)[y : y + h, x : x + w]
    starts = jpeg.restart_starts(data, head.scan_at)
    tw, th = head.restart * head.mcu[0], head.mcu[1]
    per_row = head.mcus[0] // head.restart
    out = None
    for j in range(y // th, (min(y + h, head.height) - 1) // th + 1):
        for i in range(x // tw, (min(x + w, head.width) - 1) // tw + 1):
            tile = jpeg.decode(jpeg.cut_tile(data, head, starts, j * per_row + i))
            if out is None:
                out = np.full((h, w, tile.shape[2]), BACKGROUND, np.uint8)
            a, b, c, d = max(x, i * tw), max(y, j * th), min(x + w, i * tw + tile.shape[1]), min(y + h, j * th + tile.shape[0])
            out[b - y : d - y, a - x : c - x] = tile[b - j * th : d - j * th, a - i * tw : c - i * tw]
    return out
