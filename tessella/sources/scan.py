"""Scans as DataFrames: sniffing, box and directory rows, tile indexes, pixels; and the data source.

A scan starts from (path, content) rows, as ``spark.read.format("binaryFile")``
gives them, or from any table with such columns.  A broken file gives a row with
its error instead of a failed job.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources import boxes, jpeg2000, jpegxl, modular, slides, tiff

BOXES = "path string, seq int, depth int, type string, header_offset long, payload_offset long, payload_length long, error string"
ENTRIES = "path string, layout string, ifd int, tag int, type int, count long, value double, text string, error string"
LEVELS = "path string, layout string, ifd int, kind string, level int, name string, width long, height long, tile_w long, tile_h long, codec string, downsample double, description string, error string"
TILES = "path string, format string, ifd int, tile int, tx int, ty int, file_offset long, byte_length long, error string"
INFO = "path string, format string, width long, height long, channels int, bits array<int>, levels int, tiles int, colour string, lossless boolean, warnings array<string>, error string"
PLANES = "path string, channel int, x0 int, y0 int, w int, h int, y int, row array<int>, warnings array<string>, error string"


def formats(files: DataFrame) -> DataFrame:
    """path, format by the first bytes, in built-in functions; slides before plain TIFF need their directories (levels)."""
    head = F.substring("content", 1, 12)
    starts = lambda h: F.substring("content", 1, len(h)) == F.lit(h)
    kind = F.when(F.substring("content", 5, 4) == F.lit(b"jP  "), "jp2").when(starts(b"\xff\x4f\xff\x51"), "j2k").when(head == F.lit(boxes.JXL_SIGNATURE), "jxl-container").when(starts(b"\xff\x0a"), "jxl")
    kind = kind.when(starts(b"II*\0") | starts(b"MM\0*"), "tiff").when(starts(b"II+\0") | starts(b"MM\0+"), "tiff-big")
    return files.select("path", kind.alias("format"))


READERS = "path string, format string, reader string, error string"
#: Which reader a format goes to; slides come before plain TIFF.
READER_OF = {"ndpi": "slides", "svs": "slides", "jxl-container": "jpegxl", "jxl": "jpegxl", "jp2": "jpeg2000", "j2k": "jpeg2000", "tiff": "tiff", "tiff-big": "tiff"}
#: A first directory with more entries is no slide's.
MOST_ENTRIES = 8_192


def slide_format(data: bytes) -> str | None:
    """ndpi or svs by the first directory of a TIFF file, or None."""
    try:
        layout, directories = tiff.read(data)
    except (ValueError, IndexError, KeyError, struct.error):
        return None
    if not directories or len(directories[0]) > MOST_ENTRIES:
        return None
    if layout == "oversize":
        return "ndpi"
    text = directories[0][tiff.DESCRIPTION].text if tiff.DESCRIPTION in directories[0] else ""
    return "svs" if (text or "").startswith("Aperio") else None


def _reader_rows(_, data):
    kind = boxes.sniff(data[:16])
    if kind and kind.startswith("tiff"):
        kind = slide_format(data) or kind
    yield {"format": kind, "reader": READER_OF.get(kind)}


def scan_readers(files: DataFrame) -> DataFrame:
    """Each file's format, slides told from plain TIFF by their directories, and the reader that takes it (null: none)."""
    return _scan(files, _reader_rows, READERS)


def _scan(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of(path, content)`` yields dicts; an exception becomes a row with its text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, out = path.as_py(), []
                try:
                    for r in rows_of(path, content.as_py() or b""):
                        out.append({n: r.get(n) for n in names} | {"path": path})
                except Exception as e:  # noqa: BLE001  any broken file is a row
                    out.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
                if out:
                    yield pa.RecordBatch.from_pylist(out, target)

    return files.select("path", "content").mapInArrow(run, schema)


def _box_rows(_, data):
    for seq, (depth, kind, at, p, n) in enumerate(boxes.walk(data)):
        yield {"seq": seq, "depth": depth, "type": kind, "header_offset": at, "payload_offset": p, "payload_length": n}


def scan_boxes(files: DataFrame) -> DataFrame:
    return _scan(files, _box_rows, BOXES)


def _entry_rows(_, data):
    layout, dirs = tiff.read(data)
    for ifd, d in enumerate(dirs):
        for f in d.values():
            v = f.values
            yield {"layout": layout, "ifd": ifd, "tag": f.tag, "type": f.type, "count": f.count, "value": float(v[0]) if v else None, "text": f.text if f.type == 2 else None}


def scan_entries(files: DataFrame) -> DataFrame:
    return _scan(files, _entry_rows, ENTRIES)


def _level_rows(_, data):
    layout, dirs = tiff.read(data)
    yield from ({"layout": layout, **r} for r in tiff.structure(layout, dirs))


def scan_levels(files: DataFrame) -> DataFrame:
    return _scan(files, _level_rows, LEVELS)


def _codestream(data: bytes) -> tuple[str, int, int]:
    kind = boxes.sniff(data)
    if kind == "jp2":
        at, n = boxes.jp2_info(data)["codestream"]
        return kind, at, at + n
    if kind == "j2k":
        return kind, 0, len(data)
    raise ValueError(f"no JPEG 2000 data but {kind}")


def _tile_rows(_, data):
    kind = boxes.sniff(data)
    if kind in ("tiff", "tiff-big"):
        layout, dirs = tiff.read(data)
        for ifd, d in enumerate(dirs):
            for t, x, y, at, n in tiff.tile_index(d):
                yield {"format": layout, "ifd": ifd, "tile": t, "tx": x, "ty": y, "file_offset": at, "byte_length": n}
        return
    kind, at, end = _codestream(data)
    header, parts, _ = jpeg2000.parse(data, at, end)
    nx = header.grid[0]
    for p in parts:
        yield {"format": kind, "ifd": 0, "tile": p.tile, "tx": p.tile % nx, "ty": p.tile // nx, "file_offset": p.start, "byte_length": p.end - p.start}


def scan_tiles(files: DataFrame) -> DataFrame:
    """Byte ranges of all tiles: the index that regions are joined to."""
    return _scan(files, _tile_rows, TILES)


def _info_rows(_, data):
    kind = boxes.sniff(data)
    if kind in ("jxl", "jxl-container"):
        stream = b"".join(data[p : p + n] for _, _, p, n in boxes.jxl_segments(data))
        try:
            head = jpegxl.read_headers(stream)
        except EOFError:
            w, h = boxes.jxl_size(stream)
            yield {"format": kind, "width": w, "height": h, "warnings": ["the headers are cut off"]}
            return
        m = head["metadata"]
        grey = m["colour"]["space"] == "grey"
        channels = (1 if grey else 3) + len(m["extra"])
        yield {"format": kind, "width": head["width"], "height": head["height"], "channels": channels, "bits": [m["depth"]["bits"]] * (1 if grey else 3) + [e["depth"]["bits"] for e in m["extra"]], "levels": 0, "tiles": head["geometry"]["groups"] if "geometry" in head else None, "colour": m["colour"]["space"], "lossless": head["frame"]["modular"] and not m["xyb"] if "frame" in head else None, "warnings": []}
        return
    if kind in ("tiff", "tiff-big"):
        layout, dirs = tiff.read(data)
        rows = tiff.structure(layout, dirs)
        yield {"format": layout, "width": rows[0]["width"], "height": rows[0]["height"], "levels": sum(r["kind"] == "level" for r in rows), "tiles": len(tiff.tile_index(dirs[0])), "warnings": []}
        return
    kind, at, end = _codestream(data)
    h, parts, warnings = jpeg2000.parse(data, at, end)
    colour = boxes.jp2_info(data)["colour"] if kind == "jp2" else None
    yield {"format": kind, "width": h.width - h.x0, "height": h.height - h.y0, "channels": len(h.bits), "bits": h.bits, "levels": h.levels, "tiles": h.grid[0] * h.grid[1], "colour": colour, "lossless": h.reversible, "warnings": warnings}


def scan_info(files: DataFrame) -> DataFrame:
    """Header facts; no pixel is decoded."""
    return _scan(files, _info_rows, INFO)


def _plane_rows(region: tuple[int, int, int, int] | None = None, reduction: int = 0, level: int = 0, step: int = 1):
    def rows(_, data):
        kind, warnings = boxes.sniff(data[:16]), []
        x0, y0 = ((v + (1 << reduction) - 1) >> reduction for v in (region or (0, 0))[:2])
        if kind in ("tiff", "tiff-big"):
            if reduction:
                raise ValueError("slides have levels, no reduced resolutions")
            planes = np.moveaxis(_slide_region(data, region, level, step), 2, 0)
        elif level or step != 1:
            raise ValueError("levels and steps are read from slides only")
        elif kind in ("jxl", "jxl-container"):
            if reduction:
                raise ValueError("no reduced resolutions in this format")
            stream = b"".join(data[p : p + n] for _, _, p, n in boxes.jxl_segments(data))
            planes = modular.decode(stream, region)
        else:
            _, at, end = _codestream(data)
            planes, warnings = jpeg2000.decode(data, region, reduction, at, end)
            if at:
                planes = jpeg2000.present(planes, boxes.jp2_info(data))
        for c, p in enumerate(planes):
            for y, row in enumerate(p.astype(np.int32)):
                yield {"channel": c, "x0": x0, "y0": y0, "w": p.shape[1], "h": p.shape[0], "y": y, "row": row.tolist(), "warnings": warnings}

    return rows


def _slide_region(data, region: tuple[int, int, int, int] | None, level: int, step: int) -> np.ndarray:
    if region is None:
        levels = [r for r in tiff.structure(*tiff.read(data)) if r["kind"] == "level"]
        if not 0 <= level < len(levels):
            raise ValueError(f"level {level}; the slide has {len(levels)}")
        region = 0, 0, levels[level]["width"], levels[level]["height"]
    x0, y0, x1, y1 = region
    return slides.read_region(data, level, x0, y0, x1 - x0, y1 - y0, step)


def scan_planes(files: DataFrame, region: tuple[int, int, int, int] | None = None, reduction: int = 0, level: int = 0, step: int = 1) -> DataFrame:
    """Decoded rows of every channel of a region (x0, y0, x1, y1); only the region's tiles are decoded.

    Codestreams may be read at a reduced resolution.  Of slides, the region is one of a
    ``level`` in its own pixels, every ``step``-th of which is read, as RGB.
    """
    return _scan(files, _plane_rows(region, reduction, level, step), PLANES)


@contextmanager
def _content(f):
    """The bytes of a file; of a slide a map of it, so that only the parts in use are read."""
    if (boxes.sniff(f.read(16)) or "").startswith("tiff"):
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data
    else:
        f.seek(0)
        yield f.read()


class _Range(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


SCANS = {"boxes": (_box_rows, BOXES), "entries": (_entry_rows, ENTRIES), "levels": (_level_rows, LEVELS), "tiles": (_tile_rows, TILES), "info": (_info_rows, INFO), "planes": (None, PLANES)}


class RasterSource(DataSource):
    """``spark.read.format("raster").option("mode", "info").load(glob)``: scans of local or mounted files.

    Mode "planes" reads pixels, with the options region ("x0,y0,x1,y1"), reduction, level
    and step of ``scan_planes``.  Of a slide only the directories and the tiles that are
    needed are read, so it may be larger than memory; other files are read whole.

    For files in a store that only Spark reads, use the scan functions on a binaryFile table.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCANS[self.options.get("mode", "info")][1]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema])


class _Reader(DataSourceReader):
    def __init__(self, options, names):
        self.mode, self.path, self.names = options.get("mode", "info"), options["path"], names
        region = options.get("region")
        numbers = [int(options.get(k, d)) for k, d in (("reduction", 0), ("level", 0), ("step", 1))]
        self.planes = tuple(map(int, region.split(","))) if region else None, *numbers

    def partitions(self):
        import glob

        return [_Range([p]) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        rows_of = SCANS[self.mode][0] or _plane_rows(*self.planes)
        for path in partition.paths:
            try:
                with open(path, "rb") as f, _content(f) as data:
                    found = list(rows_of(path, data))
            except Exception as e:  # noqa: BLE001
                found = [{"error": f"{type(e).__name__}: {e}"}]
            for r in found:
                yield tuple(path if n == "path" else r.get(n) for n in self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
