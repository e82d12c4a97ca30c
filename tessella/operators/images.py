"""Queries of whole-image kernels: wavelets, block transforms, codecs and containers, one image a group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import blocks, wavelet
from tessella.operators.stencils import _lift_sql
from tessella.plans import views as V
from tessella.registry import query
from tessella.sources import boxes, jpeg2000, scan, tiff


def plane_of(table: pa.Table) -> np.ndarray:
    """The rows of an image in order, as one array."""
    order = np.argsort(table.column("y").to_numpy())
    return np.array([table.column("row")[int(i)].as_py() for i in order], np.int64)


def per_image(planes: DataFrame, kernel, value: str = "int") -> DataFrame:
    """``kernel(plane) -> plane`` for each image; the result as image rows."""

    def run(table: pa.Table) -> pa.Table:
        out = kernel(plane_of(table))
        kind = pa.int32() if value == "int" else pa.float64()
        first = int(table.column("y").to_numpy().min())
        n = len(out)
        return pa.table([pa.array([table.column("image_id")[0].as_py()] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array([r.tolist() for r in out], pa.list_(kind))], names=["image_id", "y", "row"])

    return planes.groupBy("image_id").applyInArrow(run, f"image_id long, y int, row array<{value}>")


_ROWS = [_lift_sql("raster", "c1", 1, "v - (e >> 1)", "y", "image_id, x"), _lift_sql("c1", "c2", 0, "v + ((e + 2) >> 2)", "y", "image_id, x"), _lift_sql("c2", "s1", 1, "v - (e >> 1)"), _lift_sql("s1", "s2", 0, "v + ((e + 2) >> 2)")]


@query("dwt53_forward_2d", "WITH " + ", ".join(_ROWS) + " SELECT image_id, y, x, v::INT AS c FROM s2")
def dwt53_forward_2d(spark, sf_dir):
    def kernel(p):
        return wavelet.analyse53(wavelet.analyse53(p, 0).T, 0).T

    return V.pixels(per_image(V.planes(spark, sf_dir), kernel), name="c")


@query("dwt_round_trip", "SELECT image_id, y, x, v AS exact, v AS rounded FROM raster")
def dwt_round_trip(spark, sf_dir):
    """Three levels of either wavelet, there and back."""

    def kernel(reversible):
        def both(p):
            ll, b = wavelet.forward(p, 3, reversible=reversible)
            return np.floor(wavelet.inverse(ll, b, reversible=reversible) + (0 if reversible else 0.5)).astype(int)

        return both

    a = V.pixels(per_image(V.planes(spark, sf_dir), kernel(True)), name="exact")
    b = V.pixels(per_image(V.planes(spark, sf_dir), kernel(False)), name="rounded")
    return a.join(b, ["image_id", "y", "x"])


_COS = lambda k, x: f"CASE WHEN {k} = 0 THEN 1.0 ELSE sqrt(2.0::DOUBLE) * cos({math.pi!r}::DOUBLE * {k} * (2 * ({x} % 8) + 1) / 16) END"


@query("dct8_forward", f"WITH whole AS (SELECT * FROM raster WHERE image_id IN (SELECT image_id FROM raster GROUP BY 1 HAVING count(*) = 4096)), k AS (SELECT image_id, y // 8 AS bby, x // 8 AS bbx, u, t, sum(v * ({_COS('u', 'y')}) * ({_COS('t', 'x')})) / 64 AS c FROM whole, (SELECT unnest(range(8))::INT AS u), (SELECT unnest(range(8))::INT AS t) GROUP BY ALL) SELECT image_id, (bby * 8 + u)::INT AS y, (bbx * 8 + t)::INT AS x, round(c + 1e-7, 3) + 0.0 AS c FROM k")
def dct8_forward(spark, sf_dir):
    """8 x 8 cosine transform of the full images."""
    from pyspark.sql import Window

    d = V.planes(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("image_id"))).filter(f"n = {V.SIDE}").drop("n")
    rows = per_image(d, lambda p: blocks.untile(blocks.dct(blocks.tile(p, 8))), "double")
    return V.pixels(rows.withColumn("row", F.transform("row", lambda c: F.round(c + 1e-7, 3) + 0.0)), name="c")


@query("squeeze_round_trip", "SELECT image_id, y, x, v FROM raster")
def squeeze_round_trip(spark, sf_dir):
    return V.pixels(per_image(V.planes(spark, sf_dir), lambda p: blocks.unsqueeze(*blocks.squeeze(p))))


@query("weighted_predictor_residuals")
def weighted_predictor_residuals(spark, sf_dir):
    """Residuals of the self-correcting predictor, whose state runs through the whole image."""
    return V.pixels(per_image(V.planes(spark, sf_dir), lambda p: p - blocks.weighted_predictions(p)), name="r")


def files(planes: DataFrame, write) -> DataFrame:
    """(path, content) with one file an image, by ``write(plane)``."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([str(table.column("image_id")[0].as_py())]), pa.array([write(plane_of(table))], pa.binary())], names=["path", "content"])

    return planes.groupBy("image_id").applyInArrow(run, "path string, content binary")


def _jp2(p: np.ndarray) -> bytes:
    return jpeg2000.wrap_jp2(jpeg2000.encode([p], 8, levels=3, tile=32), p.shape[1], p.shape[0], 1)


@query("j2k_round_trip", "SELECT image_id, y, x, v FROM raster")
def j2k_round_trip(spark, sf_dir):
    """Lossless JP2 files of 32 x 32 tiles, written and decoded."""
    out = scan.scan_planes(files(V.planes(spark, sf_dir), _jp2))
    return V.pixels(out.select(F.col("path").cast("long").alias("image_id"), "y", "row"))


@query("j2k_region_read", "SELECT image_id, y - 5 AS y, x - 9 AS x, v FROM raster WHERE y >= 5 AND y < 40 AND x >= 9 AND x < 50")
def j2k_region_read(spark, sf_dir):
    """A region: only the tiles it touches are decoded."""
    out = scan.scan_planes(files(V.planes(spark, sf_dir), _jp2), (9, 5, 50, 40))
    return V.pixels(out.select(F.col("path").cast("long").alias("image_id"), "y", "row"))


_LL = [_lift_sql("raster", "c1", 1, "v - (e >> 1)", "y", "image_id, x"), _lift_sql("c1", "c2", 0, "v + ((e + 2) >> 2)", "y", "image_id, x"), _lift_sql("c2", "s1", 1, "v - (e >> 1)"), _lift_sql("s1", "s2", 0, "v + ((e + 2) >> 2)")]


@query("j2k_reduced_read", "WITH raster0 AS (SELECT image_id, y, x, v - 128 AS v FROM raster), " + ", ".join(s.replace("FROM raster ", "FROM raster0 ") for s in _LL) + " SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, least(greatest(v + 128, 0), 255)::INT AS v FROM s2 WHERE y % 2 = 0 AND x % 2 = 0")
def j2k_reduced_read(spark, sf_dir):
    """Half resolution of untiled files: the finest sub-bands are not decoded."""
    whole = files(V.planes(spark, sf_dir), lambda p: jpeg2000.encode([p], 8, levels=3))
    return V.pixels(scan.scan_planes(whole, None, 1).select(F.col("path").cast("long").alias("image_id"), "y", "row"))


@query("image_info", "SELECT image_id::VARCHAR AS path, 'jp2' AS format, 64::BIGINT AS width, count(DISTINCT y) AS height, 1 AS channels, 3 AS levels, (2 * ((count(DISTINCT y) + 31) // 32))::INT AS tiles, 'grey' AS colour, true AS lossless FROM raster GROUP BY image_id")
def image_info(spark, sf_dir):
    out = scan.scan_info(files(V.planes(spark, sf_dir), _jp2))
    return out.select("path", "format", "width", "height", "channels", "levels", "tiles", "colour", "lossless")


@query("jp2_box_scan", "SELECT path, seq::INT AS seq, depth::INT AS depth, type, at_::BIGINT AS header_offset, n::BIGINT AS payload_length FROM (SELECT DISTINCT image_id::VARCHAR AS path FROM raster), (VALUES (0, 0, 'jP  ', 0, 4), (1, 0, 'ftyp', 12, 12), (2, 0, 'jp2h', 32, 37), (3, 1, 'ihdr', 40, 14), (4, 1, 'colr', 62, 7)) t(seq, depth, type, at_, n)")
def jp2_box_scan(spark, sf_dir):
    out = scan.scan_boxes(files(V.planes(spark, sf_dir), _jp2))
    return out.filter("type <> 'jp2c'").select("path", "seq", "depth", "type", "header_offset", "payload_length")


@query("format_sniff", "SELECT image_id::VARCHAR AS path, ['jp2', 'j2k', 'jxl', 'jxl-container', 'tiff', 'tiff-big'][image_id % 6 + 1] AS format FROM raster GROUP BY image_id")
def format_sniff(spark, sf_dir):
    heads = [boxes.JP2_SIGNATURE, b"\xff\x4f\xff\x51\0\x29\0\0\0\0\0\0", b"\xff\x0a\0\0\0\0\0\0\0\0\0\0", boxes.JXL_SIGNATURE, b"II*\0\x08\0\0\0\0\0\0\0", b"MM\0+\0\x08\0\0\0\0\0\0"]
    ids = V.planes(spark, sf_dir).select("image_id").distinct()
    content = F.element_at(F.array(*(F.lit(h) for h in heads)), (F.col("image_id") % 6 + 1).cast("int"))
    return scan.formats(ids.select(F.col("image_id").cast("string").alias("path"), content.alias("content")))


@query(
    "reader_dispatch",
    "SELECT image_id::VARCHAR AS path, ['jp2', 'jxl', 'tiff', 'svs', 'ndpi', NULL, 'tiff'][image_id % 7 + 1] AS format, ['jpeg2000', 'jpegxl', 'tiff', 'slides', 'slides', NULL, 'tiff'][image_id % 7 + 1] AS reader, NULL::VARCHAR AS error FROM raster GROUP BY image_id",
)
def reader_dispatch(spark, sf_dir):
    """Slides go before plain TIFF: vendor and description are looked up in the first directory, broken ones stay TIFF."""
    size = [(tiff.WIDTH, 4, [5]), (tiff.HEIGHT, 4, [6])]
    svs = tiff.build([[*size, (tiff.DESCRIPTION, 2, "Aperio Image Library v1\r\n5x6")]])
    late = tiff.build([[*size, (tiff.DESCRIPTION, 2, "by Aperio")]])
    ndpi = tiff.build([[(tiff.FORMAT_FLAG, 4, [1]), *size]], layout="oversize")
    heads = [boxes.JP2_SIGNATURE, b"\xff\x0a\0\0", tiff.build([size]), svs, ndpi, b"junk", late]
    ids = V.planes(spark, sf_dir).select("image_id").distinct()
    content = F.element_at(F.array(*(F.lit(bytes(h)) for h in heads)), (F.col("image_id") % 7 + 1).cast("int"))
    return scan.scan_readers(ids.select(F.col("image_id").cast("string").alias("path"), content.alias("content")))


@query("jxl_segments", "SELECT doc_id::VARCHAR AS path, i::INT AS seq, (i * ((strlen(text) + 2) // 3))::BIGINT AS codestream_offset, (least((i + 1) * ((strlen(text) + 2) // 3), strlen(text)) - least(i * ((strlen(text) + 2) // 3), strlen(text)))::BIGINT AS length FROM documents, (SELECT unnest(range(3)) AS i) WHERE strlen(text) > 6")
def jxl_segments(spark, sf_dir):
    """Codestreams dealt to three boxes of a container, and their places in the stream."""
    docs = V.table(spark, sf_dir, "documents").filter(F.octet_length("text") > 6).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([boxes.wrap_jxl(c.as_py(), 10, parts=3) for c in b.column(1)], pa.binary())], ["path", "content"])

    wrapped = docs.mapInArrow(run, "path string, content binary")
    rows = lambda _, data: ({"seq": s, "codestream_offset": o, "file_offset": f, "length": n} for s, o, f, n in boxes.jxl_segments(data))
    out = scan._scan(wrapped, rows, "path string, seq int, codestream_offset long, file_offset long, length long, error string")
    return out.select("path", "seq", "codestream_offset", "length")


def _slide(sizes: list[tuple[int, int]], layout: str) -> bytes:
    dirs = []
    for i, (w, h) in enumerate(sizes):
        entries = [(tiff.WIDTH, 4, [w]), (tiff.HEIGHT, 4, [h]), (tiff.COMPRESSION, 3, [33005 if layout != "oversize" else 7]), (tiff.TILE_W, 3, [256]), (tiff.TILE_H, 3, [256])]
        if i == 0:
            entries.append((tiff.DESCRIPTION, 2, "Vendor v1\r\nlevel 0|MPP = 0.25"))
        if layout == "oversize":
            entries += [(tiff.FORMAT_FLAG, 4, [1]), (tiff.LENS, 11, [20.0 / 2**i])]
        dirs.append(entries)
    label = [(tiff.WIDTH, 4, [300]), (tiff.HEIGHT, 4, [200]), (tiff.COMPRESSION, 3, [1]), (tiff.DESCRIPTION, 2, "Vendor v1\r\nlabel 300x200")]
    if layout == "oversize":
        label += [(tiff.FORMAT_FLAG, 4, [1]), (tiff.LENS, 11, [-1.0])]
    return tiff.build([*dirs, label], layout=layout)


@query("slide_levels", "WITH ds AS (SELECT image_id, level, w, h, (first_value(w) OVER o / w + first_value(h) OVER o / h) / 2 AS downsample FROM levels WINDOW o AS (PARTITION BY image_id ORDER BY level)) SELECT image_id::VARCHAR AS path, ['classic', 'big', 'oversize'][image_id % 3 + 1] AS layout, level AS ifd, 'level' AS kind, NULL::VARCHAR AS name, w AS width, h AS height, round(downsample, 6) AS downsample FROM ds UNION ALL SELECT o_orderkey::VARCHAR, ['classic', 'big', 'oversize'][o_orderkey % 3 + 1], 5, 'associated', 'label', 300, 200, NULL FROM orders")
def slide_levels(spark, sf_dir):
    """A slide file for each pyramid, in three directory layouts, written and scanned."""
    d = V.levels(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("level", "w", "h"))).alias("p"))

    def run(batches):
        for b in batches:
            out = [_slide([(s["w"], s["h"]) for s in p], ("classic", "big", "oversize")[i % 3]) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in b.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    out = scan.scan_levels(d.mapInArrow(run, "path string, content binary"))
    return out.select("path", "layout", "ifd", "kind", "name", "width", "height", F.round("downsample", 6).alias("downsample"))


def _tiled_slide(p: np.ndarray, size: int = 32) -> bytes:
    """A one-level slide of lossless tiles; the last tile is left out where there are several rows of them."""
    h, w = p.shape
    wide = np.pad(p, ((0, -h % size), (0, -w % size)), mode="edge")
    tiles = [jpeg2000.encode([wide[j : j + size, i : i + size]], levels=2) for j in range(0, h, size) for i in range(0, w, size)]
    if len(tiles) > 2:
        tiles[-1] = b""
    return tiff.build([[(tiff.WIDTH, 4, [w]), (tiff.HEIGHT, 4, [h]), (tiff.COMPRESSION, 3, [33005]), (tiff.TILE_W, 3, [size]), (tiff.TILE_H, 3, [size])]], [tiles])


@query("slide_region_read", "SELECT image_id, ((y - 4) // 2)::INT AS y, ((x - 10) // 2)::INT AS x, CASE WHEN y >= 32 AND x >= 32 THEN 255 ELSE v END AS v FROM raster WHERE y >= 4 AND y < 50 AND (y - 4) % 2 = 0 AND x >= 10 AND x < 60 AND (x - 10) % 2 = 0")
def slide_region_read(spark, sf_dir):
    """Every second pixel of a region of a tiled slide; the missing tile shows the background."""
    from tessella.sources import slides

    def rows(_, data):
        layout, dirs = tiff.read(data)
        height = tiff.structure(layout, dirs)[0]["height"]
        for y, row in enumerate(slides.read_region(data, 0, 10, 4, 50, min(50, height) - 4, 2)[:, :, 0]):
            yield {"y": y, "row": row.tolist()}

    out = scan._scan(files(V.planes(spark, sf_dir), _tiled_slide), rows, "path string, y int, row array<int>, error string")
    return V.pixels(out.select(F.col("path").cast("long").alias("image_id"), "y", "row"))


@query("slide_tile_index", "SELECT image_id::VARCHAR AS path, t::INT AS tile, (t % 2)::INT AS tx, (t // 2)::INT AS ty, NOT (t = 3) AS present FROM (SELECT image_id, count(DISTINCT y) AS h FROM raster GROUP BY 1), (SELECT unnest(range(4)) AS t) WHERE t < 2 * ((h + 31) // 32)")
def slide_tile_index(spark, sf_dir):
    out = scan.scan_tiles(files(V.planes(spark, sf_dir), _tiled_slide))
    return out.select("path", "tile", "tx", "ty", (F.col("byte_length") > 0).alias("present"))


@query("jpeg_strip_read")
def jpeg_strip_read(spark, sf_dir):
    """A region of a JPEG with restart intervals, decoded from the intervals it touches."""
    from tessella.sources import jpeg, slides

    whole = files(V.planes(spark, sf_dir), lambda p: jpeg.encode(np.clip(p, 0, 255).astype(np.uint8), 95, restart=4))
    rows = lambda _, data: ({"y": y, "row": r.tolist()} for y, r in enumerate(slides.read_strips(data, 8, 8, 40, 40)[:, :, 0]))
    out = scan._scan(whole, rows, "path string, y int, row array<int>, error string")
    return V.pixels(out.select(F.col("path").cast("long").alias("image_id"), "y", "row"))


@query(
    "lf_smoothing",
    """WITH t AS (SELECT image_id, y, x, v, lag(v) OVER c AS u, lead(v) OVER c AS d FROM raster WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
s AS (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS r, lag(u) OVER o AS ul, lead(u) OVER o AS ur, lag(d) OVER o AS dl, lead(d) OVER o AS dr FROM t WINDOW o AS (PARTITION BY image_id, y ORDER BY x)),
m AS (SELECT *, 0.05226273532324128::DOUBLE * v + 0.20345139757231578::DOUBLE * (u + d + l + r) + 0.0334829185968739::DOUBLE * (ul + ur + dl + dr) AS mean FROM s)
SELECT image_id, y, x, round(CASE WHEN u IS NULL OR d IS NULL OR l IS NULL OR r IS NULL THEN v ELSE v + (mean - v) * greatest(0, 3 - 4 * greatest(0.5, abs(v - mean) / 40)) END, 5) AS v FROM m""",
)
def lf_smoothing(spark, sf_dir):
    from tessella.functions.kernels import smooth_low_frequency

    rows = per_image(V.planes(spark, sf_dir), lambda p: smooth_low_frequency([p.astype(float)], [40.0])[0], "double")
    return V.pixels(rows.withColumn("row", F.transform("row", lambda v: F.round(v, 5))))


@query("palette_implicit", "SELECT image_id, y, x, CASE WHEN v < 100 THEN v * 2 WHEN v < 164 THEN ((v - 100) % 4) * 255 // 4 + 32 ELSE ((v - 164) % 5) * 255 // 4 END AS c0, CASE WHEN v < 100 THEN v + 1 WHEN v < 164 THEN ((v - 100) // 4 % 4) * 255 // 4 + 32 ELSE ((v - 164) // 5 % 5) * 255 // 4 END AS c1 FROM raster")
def palette_implicit(spark, sf_dir):
    """Indexes past the explicit colours stand for two built-in colour cubes: column expressions."""
    over = F.col("v") - 100

    def channel(c, explicit):
        small = F.floor(over / 4**c).cast("int") % 4
        large = F.floor((over - 64) / 5**c).cast("int") % 5
        return F.when(F.col("v") < 100, explicit).when(F.col("v") < 164, F.floor(small * 255 / 4).cast("int") + 32).otherwise(F.floor(large * 255 / 4).cast("int"))

    return V.raster(spark, sf_dir).select("image_id", "y", "x", channel(0, F.col("v") * 2).alias("c0"), channel(1, F.col("v") + 1).alias("c1"))


_CORNERS = {1: ("a", "b", "c", "d"), 2: ("63 - c", "b", "63 - a", "d"), 3: ("63 - c", "63 - d", "63 - a", "63 - b"), 4: ("a", "63 - d", "c", "63 - b"), 5: ("b", "a", "d", "c"), 6: ("b", "63 - c", "d", "63 - a"), 7: ("63 - d", "63 - c", "63 - b", "63 - a"), 8: ("63 - d", "a", "63 - b", "c")}


@query("inverse_orient_rect", "WITH q AS (SELECT DISTINCT x0 % 30 AS a, y0 % 30 AS b, x0 % 30 + rw % 32 AS c, y0 % 30 + rh % 32 AS d FROM requests) " + " UNION ALL ".join(f"SELECT a, b, c, d, {k} AS orientation, {w[0]} AS sx0, {w[1]} AS sy0, {w[2]} AS sx1, {w[3]} AS sy1 FROM q" for k, w in _CORNERS.items()))
def inverse_orient_rect(spark, sf_dir):
    """The source rectangle (both corners inclusive) of an oriented one, for all orientations of a 64 x 64 image."""
    r = V.requests(spark, sf_dir)
    q = r.select((F.col("x0") % 30).alias("a"), (F.col("y0") % 30).alias("b"), (F.col("x0") % 30 + F.col("rw") % 32).alias("c"), (F.col("y0") % 30 + F.col("rh") % 32).alias("d")).distinct()
    from tessella.operators.geometry import orient

    options = []
    for k in range(1, 9):
        (x0, y0), (x1, y1) = orient(k, F.col("a"), F.col("b"), V.SIDE, V.SIDE), orient(k, F.col("c"), F.col("d"), V.SIDE, V.SIDE)
        options.append(F.struct(F.lit(k).alias("orientation"), F.least(x0, x1).alias("sx0"), F.least(y0, y1).alias("sy0"), F.greatest(x0, x1).alias("sx1"), F.greatest(y0, y1).alias("sy1")))
    return q.select("a", "b", "c", "d", F.inline(F.array(*options)))


@query("jxl_lossless_round_trip", "SELECT image_id, y, x, v FROM raster")
def jxl_lossless_round_trip(spark, sf_dir):
    """Lossless images in containers of two parts, written, found by their boxes and decoded."""
    from tessella.sources import modular

    wrapped = files(V.planes(spark, sf_dir), lambda p: boxes.wrap_jxl(modular.encode([p], 8), parts=2))
    return V.pixels(scan.scan_planes(wrapped).select(F.col("path").cast("long").alias("image_id"), "y", "row"))


@query("jxl_info", "SELECT image_id::VARCHAR AS path, 'jxl' AS format, 64::BIGINT AS width, count(DISTINCT y) AS height, 1 AS channels, 1 AS tiles, 'grey' AS colour, true AS lossless FROM raster GROUP BY image_id")
def jxl_info(spark, sf_dir):
    from tessella.sources import modular

    out = scan.scan_info(files(V.planes(spark, sf_dir), lambda p: modular.encode([p], 8)))
    return out.select("path", "format", "width", "height", "channels", "tiles", "colour", "lossless")


@query("slide_scan_region", "SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, CASE WHEN y >= 32 AND x >= 32 THEN 255 ELSE v END AS v FROM raster WHERE y % 2 = 0 AND x % 2 = 0")
def slide_scan_region(spark, sf_dir):
    """Every second pixel of whole slides as image rows; the missing tile shows the background."""
    out = scan.scan_planes(files(V.planes(spark, sf_dir), _tiled_slide), step=2).filter("channel = 0")
    return V.pixels(out.select(F.col("path").cast("long").alias("image_id"), "y", "row"))
