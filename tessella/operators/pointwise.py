"""Queries of the pointwise sample and colour operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.functions import colour as C
from tessella.functions import samples as S
from tessella.plans import views as V
from tessella.registry import query


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _planes(cols, *names):
    return [c.alias(n) for c, n in zip(cols, names, strict=True)]


KEY = ("image_id", "y", "x")


@query("rct_forward", "SELECT image_id, y, x, (r + 2 * g + b) >> 2 AS c0, b - g AS c1, r - g AS c2 FROM rgb")
def rct_forward(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    return d.select(*KEY, *_planes(C.forward_rct(F.col("r"), F.col("g"), F.col("b")), "c0", "c1", "c2"))


@query("rct_inverse", "SELECT image_id, y, x, b + (r - ((g + b) >> 2)) AS red, r - ((g + b) >> 2) AS green, g + (r - ((g + b) >> 2)) AS blue FROM rgb")
def rct_inverse(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    return d.select(*KEY, *_planes(C.inverse_rct(F.col("r"), F.col("g"), F.col("b")), "red", "green", "blue"))


@query("ict_forward", "SELECT image_id, y, x, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luma, round(-0.168736::DOUBLE * r + -0.331264::DOUBLE * g + 0.5::DOUBLE * b, 6) AS cb, round(0.5::DOUBLE * r + -0.418688::DOUBLE * g + -0.081312::DOUBLE * b, 6) AS cr FROM rgb")
def ict_forward(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    return d.select(*KEY, *_planes(map(_r, C.forward_ict(F.col("r"), F.col("g"), F.col("b"))), "luma", "cb", "cr"))


@query("ict_inverse", "SELECT image_id, y, x, round(r + 1.402::DOUBLE * (b - 128), 6) AS red, round(r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128), 6) AS green, round(r + 1.772::DOUBLE * (g - 128), 6) AS blue FROM rgb")
def ict_inverse(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    return d.select(*KEY, *_planes(map(_r, C.inverse_ict(F.col("r"), F.col("g") - 128, F.col("b") - 128)), "red", "green", "blue"))


@query("dc_shift_clamp", "SELECT image_id, y, x, least(greatest(v * 2 - 256 + 128, 0), 255) AS unsigned_8, least(greatest(v * 2 - 256, -128), 127) AS signed_8 FROM raster")
def dc_shift_clamp(spark, sf_dir):
    d, v = V.raster(spark, sf_dir), F.col("v") * 2 - 256
    return d.select(*KEY, S.level_shift(v, 8).alias("unsigned_8"), S.level_shift(v, 8, True).alias("signed_8"))


@query("to_eight_bit", "SELECT image_id, y, x, least(greatest((v * 16) >> 4, 0), 255) AS from_12, least(greatest((v >> 4) << 4, 0), 255) AS from_4, least(greatest((v * 16 - 2048 + 2048) >> 4, 0), 255) AS from_signed_12 FROM raster")
def to_eight_bit(spark, sf_dir):
    d, v = V.raster(spark, sf_dir), F.col("v")
    return d.select(*KEY, S.to_eight_bit(v * 16, 12).alias("from_12"), S.to_eight_bit(F.shiftright(v, 4), 4).alias("from_4"), S.to_eight_bit(v * 16 - 2048, 12, True).alias("from_signed_12"))


@query("scale_and_align", "SELECT image_id, y, x, floor(v * 16 * 255.0::DOUBLE / 4095 + 0.5)::INT AS scaled, v << 4 AS aligned_12, (v >> 4) << 4 AS aligned_4 FROM raster")
def scale_and_align(spark, sf_dir):
    d, v = V.raster(spark, sf_dir), F.col("v")
    return d.select(*KEY, S.scale_to_eight(v * 16, 12).alias("scaled"), S.left_align(v, 12).alias("aligned_12"), S.left_align(F.shiftright(v, 4), 4).alias("aligned_4"))


@query("ycbcr_to_rgb", "SELECT image_id, y, x, least(greatest(floor(r + 1.402::DOUBLE * (b - 128) + 0.5), 0), 255)::INT AS red, least(greatest(floor(r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128) + 0.5), 0), 255)::INT AS green, least(greatest(floor(r + 1.772::DOUBLE * (g - 128) + 0.5), 0), 255)::INT AS blue FROM rgb")
def ycbcr_to_rgb(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    return d.select(*KEY, *_planes(C.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b")), "red", "green", "blue"))


@query("sample_ycbcr_to_rgb", "SELECT image_id, y, x, round(g / 255.0::DOUBLE - 0.5 + 128.0::DOUBLE / 255.0 + 1.402::DOUBLE * (b / 255.0::DOUBLE - 0.5), 6) AS red, round(g / 255.0::DOUBLE - 0.5 + 128.0::DOUBLE / 255.0 - 0.344136286201022::DOUBLE * (r / 255.0::DOUBLE - 0.5) - 0.714136286201022::DOUBLE * (b / 255.0::DOUBLE - 0.5), 6) AS green, round(g / 255.0::DOUBLE - 0.5 + 128.0::DOUBLE / 255.0 + 1.772::DOUBLE * (r / 255.0::DOUBLE - 0.5), 6) AS blue FROM rgb")
def sample_ycbcr_to_rgb(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    cb, y, cr = (S.normalise(F.col(c), 8) - 0.5 for c in "rgb")
    # blue uses Cb, which is the first plane
    return d.select(*KEY, *_planes(map(_r, C.sample_ycbcr_to_rgb(cb, y, cr)), "red", "green", "blue"))


_ROOT = repr(math.cbrt(C.OPSIN_BIAS))
_XYB = f"""
WITH n AS (SELECT image_id, y, x, (r / 255.0::DOUBLE - 0.5) / 30 AS cx, g / 255.0::DOUBLE AS cy, b / 255.0::DOUBLE AS cb FROM rgb),
m AS (SELECT image_id, y, x, pow(cy + cx - ({_ROOT})::DOUBLE, 3) + ({C.OPSIN_BIAS!r})::DOUBLE AS l, pow(cy - cx - ({_ROOT})::DOUBLE, 3) + ({C.OPSIN_BIAS!r})::DOUBLE AS m, pow(cb - ({_ROOT})::DOUBLE, 3) + ({C.OPSIN_BIAS!r})::DOUBLE AS s FROM n)
SELECT image_id, y, x, {", ".join(f"round(({k[0]!r})::DOUBLE * l + ({k[1]!r})::DOUBLE * m + ({k[2]!r})::DOUBLE * s, 6) AS {n}" for k, n in zip(C.OPSIN_INVERSE, ("red", "green", "blue")))} FROM m
"""


@query("xyb_to_linear", _XYB)
def xyb_to_linear(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    out = C.xyb_to_linear((F.col("r") / 255.0 - 0.5) / 30, F.col("g") / 255.0, F.col("b") / 255.0)
    return d.select(*KEY, *_planes(map(_r, out), "red", "green", "blue"))


_TO_XYB = f"""
WITH n AS (SELECT image_id, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM rgb),
m AS (SELECT image_id, y, x, {", ".join(f"cbrt(({k[0]!r})::DOUBLE * r + ({k[1]!r})::DOUBLE * g + ({k[2]!r})::DOUBLE * b - ({C.OPSIN_BIAS!r})::DOUBLE) + ({_ROOT})::DOUBLE AS {n}" for k, n in zip(C.OPSIN, "lms"))} FROM n)
SELECT image_id, y, x, round((l - m) / 2, 6) AS xyb_x, round((l + m) / 2, 6) AS xyb_y, round(s, 6) AS xyb_b FROM m
"""


@query("linear_to_xyb", _TO_XYB)
def linear_to_xyb(spark, sf_dir):
    d = V.rgb(spark, sf_dir)
    return d.select(*KEY, *_planes(map(_r, C.linear_to_xyb(*(F.col(c) / 255.0 for c in "rgb"))), "xyb_x", "xyb_y", "xyb_b"))


_A = 0.17883277
_HLG_B, _HLG_C = 1 - 4 * _A, 0.5 - _A * math.log(4 * _A)
_T = "(v / 255.0::DOUBLE * 1.2 - 0.1)"
TRANSFER_SQL = {
    "linear": _T,
    "srgb": f"sign({_T}) * CASE WHEN abs({_T}) <= 0.0031308 THEN 12.92::DOUBLE * abs({_T}) ELSE 1.055::DOUBLE * pow(abs({_T}), 1 / 2.4::DOUBLE) - 0.055 END",
    "bt709": f"CASE WHEN {_T} < 0.018 THEN 4.5::DOUBLE * {_T} ELSE 1.099::DOUBLE * pow(greatest({_T}, 0), 0.45::DOUBLE) - 0.099 END",
    "dci": f"pow(greatest({_T}, 0), 1 / 2.6::DOUBLE)",
    "pq": f"pow((0.8359375::DOUBLE + 18.8515625 * pow(greatest({_T}, 0), 0.1593017578125::DOUBLE)) / (1 + 18.6875::DOUBLE * pow(greatest({_T}, 0), 0.1593017578125::DOUBLE)), 78.84375::DOUBLE)",
    "hlg": f"CASE WHEN greatest({_T}, 0) <= 1 / 12.0::DOUBLE THEN sqrt(3 * greatest({_T}, 0)) ELSE {_A}::DOUBLE * ln(greatest(12 * greatest({_T}, 0) - {_HLG_B!r}::DOUBLE, 1e-9)) + {_HLG_C!r}::DOUBLE END",
}
for _name in C.TRANSFERS:

    def _transfer(spark, sf_dir, name=_name):
        v = F.col("v") / 255.0 * 1.2 - 0.1
        return V.raster(spark, sf_dir).select(*KEY, _r(C.from_linear(v, name)).alias("encoded"))

    query(f"transfer_{_name}", f"SELECT image_id, y, x, round({TRANSFER_SQL[_name]}, 6) AS encoded FROM raster")(_transfer)


@query("transfer_srgb_inverse", f"SELECT image_id, y, x, round(sign({_T}) * CASE WHEN abs({_T}) <= 0.04045 THEN abs({_T}) / 12.92 ELSE pow((abs({_T}) + 0.055::DOUBLE) / 1.055, 2.4::DOUBLE) END, 6) AS linear, round(CASE WHEN {_T} <= 0 THEN 0 WHEN {_T} >= 1 THEN 1 WHEN {_T} <= 0.0031308 THEN 12.92::DOUBLE * {_T} ELSE 1.055::DOUBLE * pow(greatest({_T}, 0), 1 / 2.4::DOUBLE) - 0.055 END, 6) AS clamped FROM raster")
def transfer_srgb_inverse(spark, sf_dir):
    v = F.col("v") / 255.0 * 1.2 - 0.1
    return V.raster(spark, sf_dir).select(*KEY, _r(C.linear_from_srgb(v)).alias("linear"), _r(C.srgb_clamped(v)).alias("clamped"))


@query("transfer_gamma", f"SELECT image_id, y, x, round(pow(greatest({_T}, 0), 0.45455::DOUBLE), 6) AS encoded FROM raster")
def transfer_gamma(spark, sf_dir):
    return V.raster(spark, sf_dir).select(*KEY, _r(C.gamma_from_linear(F.col("v") / 255.0 * 1.2 - 0.1, 0.45455)).alias("encoded"))


#: D50 connection space to linear sRGB (fixed values of the standard).
D50_TO_SRGB = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
_ICC = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} >= 1 THEN 1 WHEN {0} <= 0.0031308 THEN 12.92::DOUBLE * {0} ELSE 1.055::DOUBLE * pow({0}, 1 / 2.4::DOUBLE) - 0.055 END"


@query(
    "icc_matrix_to_srgb",
    "WITH m AS (SELECT image_id, y, x, pow(r / 255.0::DOUBLE, 2.2::DOUBLE) AS a, pow(g / 255.0::DOUBLE, 2.2::DOUBLE) AS b, pow(b / 255.0::DOUBLE, 2.2::DOUBLE) AS c FROM rgb), l AS (SELECT image_id, y, x, "
    + ", ".join(f"({k[0]})::DOUBLE * a + ({k[1]})::DOUBLE * b + ({k[2]})::DOUBLE * c AS l{i}" for i, k in enumerate(D50_TO_SRGB))
    + " FROM m) SELECT image_id, y, x, "
    + ", ".join(f"floor(({_ICC.format(f'l{i}')}) * 255 + 0.5)::INT AS {n}" for i, n in enumerate(("red", "green", "blue")))
    + " FROM l",
)
def icc_matrix_to_srgb(spark, sf_dir):
    """Tone curve, profile matrix, sRGB curve, rounded to 8 bits."""
    linear = C.matrix_apply(D50_TO_SRGB, *(F.pow(F.col(c) / 255.0, F.lit(2.2)) for c in "rgb"))
    return V.rgb(spark, sf_dir).select(*KEY, *_planes((C.half_up(C.srgb_clamped(c) * 255) for c in linear), "red", "green", "blue"))


@query("cmyk_composite", "SELECT image_id, y, x, floor(r * (b / 255::DOUBLE) + 0.5)::INT AS cyan, floor(g * (b / 255::DOUBLE) + 0.5)::INT AS magenta FROM rgb")
def cmyk_composite(spark, sf_dir):
    return V.rgb(spark, sf_dir).select(*KEY, C.cmyk_composite(F.col("r"), F.col("b")).alias("cyan"), C.cmyk_composite(F.col("g"), F.col("b")).alias("magenta"))


@query("spot_mix", "SELECT image_id, y, x, round(0.75::DOUBLE * (b / 255::DOUBLE) * 0.2 + (1 - 0.75::DOUBLE * (b / 255::DOUBLE)) * (r / 255::DOUBLE), 6) AS mixed FROM rgb")
def spot_mix(spark, sf_dir):
    return V.rgb(spark, sf_dir).select(*KEY, _r(C.spot_mix(F.col("r") / 255.0, F.col("b") / 255.0, 0.2, 0.75)).alias("mixed"))


@query("int_float_normalise", "SELECT image_id, y, x, round(v / 255::DOUBLE, 6) AS unit, least(greatest(floor((v / 255::DOUBLE * 1.1 - 0.05) * 1023 + 0.5), 0), 1023)::INT AS deep FROM raster")
def int_float_normalise(spark, sf_dir):
    v = F.col("v")
    return V.raster(spark, sf_dir).select(*KEY, _r(S.normalise(v, 8)).alias("unit"), S.denormalise(v / 255.0 * 1.1 - 0.05, 10).alias("deep"))


@query("white_is_zero", "SELECT image_id, y, x, 255 - v AS inverted FROM raster")
def white_is_zero(spark, sf_dir):
    return V.raster(spark, sf_dir).select(*KEY, (255 - F.col("v")).alias("inverted"))


@query("zigzag_pack", "SELECT image_id, y, x, CASE WHEN v >= 128 THEN 2 * (v - 128) ELSE -2 * (v - 128) - 1 END AS packed, v - 128 AS unpacked FROM raster")
def zigzag_pack(spark, sf_dir):
    d = V.raster(spark, sf_dir).withColumn("packed", S.zigzag_pack(F.col("v") - 128))
    return d.select(*KEY, "packed", S.zigzag_unpack(F.col("packed")).alias("unpacked"))


@query("bit_lengths", "SELECT image_id, y, x, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END::INT AS bits, CASE WHEN v <= 1 THEN 0 ELSE length(bin(v - 1)) END::INT AS ceil_log2, ((v + 6) // 7)::BIGINT AS ceil_div_7 FROM raster")
def bit_lengths(spark, sf_dir):
    v = F.col("v")
    return V.raster(spark, sf_dir).select(*KEY, S.bit_length(v).alias("bits"), S.ceil_log2(v).alias("ceil_log2"), S.ceil_div(v, 7).alias("ceil_div_7"))


_HYB = "WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey AS v, length(bin(l_partkey)) - 1 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v < 16 THEN v ELSE 16 + ((n - 4) << 2) + ((v - (1 << n)) >> (n - 2)) END::BIGINT AS token, CASE WHEN v < 16 THEN 0 ELSE n - 2 END::INT AS raw_bits, CASE WHEN v < 16 THEN 0 ELSE (v - (1 << n)) % (1 << greatest(n - 2, 0)) END::BIGINT AS raw FROM n"


@query("hybrid_uint_split", _HYB)
def hybrid_uint_split(spark, sf_dir):
    d = V.table(spark, sf_dir, "lineitem")
    token, n, raw = S.hybrid_token(F.col("l_partkey"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", token.cast("long").alias("token"), n.cast("int").alias("raw_bits"), raw.cast("long").alias("raw"))


@query("custom_float_decode", "SELECT image_id, y, x, 0.0 + round(CASE WHEN (v >> 7) % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN (v >> 3) % 16 = 0 THEN (v % 8) * pow(2.0::DOUBLE, -9) ELSE (1 + (v % 8) / 8.0::DOUBLE) * pow(2.0::DOUBLE, (v >> 3) % 16 - 7) END, 6) AS value FROM raster WHERE (v >> 3) % 16 < 15")
def custom_float_decode(spark, sf_dir):
    d = V.raster(spark, sf_dir).filter(F.shiftright("v", 3) % 16 < 15)
    return d.select(*KEY, (_r(S.custom_float(F.col("v"), 4, 3)) + 0.0).alias("value"))


@query(
    "custom_float_classes",
    "SELECT image_id, y, x, CASE WHEN (v >> 3) % 16 < 15 THEN 'finite' WHEN v % 8 > 0 THEN 'nan' WHEN (v >> 7) % 2 = 1 THEN '-inf' ELSE 'inf' END AS class, CASE WHEN (v >> 3) % 16 < 15 THEN 0.0 + round(CASE WHEN (v >> 7) % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN (v >> 3) % 16 = 0 THEN (v % 8) * pow(2.0::DOUBLE, -9) ELSE (1 + (v % 8) / 8.0::DOUBLE) * pow(2.0::DOUBLE, (v >> 3) % 16 - 7) END, 6) END AS value FROM raster",
)
def custom_float_classes(spark, sf_dir):
    """Every sample as a float; infinities and NaN have a class and no value."""
    d = V.raster(spark, sf_dir).withColumn("f", S.custom_float(F.col("v"), 4, 3))
    kind = F.when(F.isnan("f"), "nan").when(F.col("f") == float("inf"), "inf").when(F.col("f") == float("-inf"), "-inf").otherwise("finite")
    return d.select(*KEY, kind.alias("class"), F.when(kind == "finite", _r(F.col("f")) + 0.0).alias("value"))


@query("quantise_deadzone", "SELECT image_id, y, x, (sign(v - 128) * least(40, floor(abs(v - 128) / 2.5::DOUBLE)))::INT AS q, round((sign(v - 128) * least(40, floor(abs(v - 128) / 2.5::DOUBLE)))::INT * 2.5::DOUBLE * 0.5, 6) AS back FROM raster")
def quantise_deadzone(spark, sf_dir):
    d = V.raster(spark, sf_dir).withColumn("q", S.quantise(F.col("v") - 128, 2.5, 40))
    return d.select(*KEY, "q", _r(S.dequantise(F.col("q"), 2.5)).alias("back"))


@query("bin_centre", "SELECT image_id, y, x, CASE WHEN v % 2 = 1 THEN -1 ELSE 1 END * (CASE WHEN v > 7 THEN v >> 3 ELSE v END + CASE WHEN (CASE WHEN v > 7 THEN v >> 3 ELSE v END) <> 0 AND x % 4 >= 1 THEN 1 << ((x % 4) - 1) ELSE 0 END) AS reversible, CASE WHEN v = 0 THEN 0 ELSE CASE WHEN v % 2 = 1 THEN -1 ELSE 1 END * ((v << 1) + (1 << (x % 4))) END AS irreversible FROM raster")
def bin_centre(spark, sf_dir):
    v, odd, missing = F.col("v"), F.col("v") % 2 == 1, F.col("x") % 4
    return V.raster(spark, sf_dir).select(*KEY, S.bin_centre(v, odd, missing, roi=3).alias("reversible"), S.bin_centre(v, odd, missing, reversible=False).alias("irreversible"))


@query("xyb_modular_dequant", "SELECT image_id, y, x, round((1.0 / 32768)::DOUBLE * (r - 128), 9) AS cx, round((1.0 / 2048)::DOUBLE * g, 9) AS cy, round((1.0 / 1024)::DOUBLE * (g + b), 9) AS cb FROM rgb")
def xyb_modular_dequant(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return V.rgb(spark, sf_dir).select(*KEY, _r((r - 128) * (1 / 32768), 9).alias("cx"), _r(g * (1 / 2048), 9).alias("cy"), _r((g + b) * (1 / 1024), 9).alias("cb"))


@query("mpp_units", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 0 THEN round(CASE l_linenumber % 4 WHEN 2 THEN 25400.0 WHEN 3 THEN 10000.0 END::DOUBLE / l_quantity, 6) END AS mpp FROM lineitem")
def mpp_units(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(S.microns_per_pixel(F.col("l_quantity"), F.col("l_linenumber") % 4)).alias("mpp"))


@query("epf_inverse_sigma", "SELECT image_id, (y // 8)::BIGINT AS by_, (x // 8)::BIGINT AS bx, round(1.0::DOUBLE / ((65536.0 / 3000)::DOUBLE * (0.46::DOUBLE * (max(v) % 8) / 7 + 0.01) / (1 + min(v) % 16)), 6) AS inverse_sigma FROM raster GROUP BY ALL")
def epf_inverse_sigma(spark, sf_dir):
    """Per 8 x 8 cell: sharpness and multiplier of the cell give the filter's strength."""
    d = V.raster(spark, sf_dir).groupBy("image_id", F.expr("y div 8").cast("long").alias("by_"), F.expr("x div 8").cast("long").alias("bx")).agg((F.max("v") % 8).alias("sharp"), (1 + F.min("v") % 16).alias("mul"))
    return d.select("image_id", "by_", "bx", _r(1.0 / ((65536.0 / 3000) * (0.46 * F.col("sharp") / 7 + 0.01) / F.col("mul"))).alias("inverse_sigma"))


@query("subsampled_replicate", "SELECT a.image_id, a.y, a.x, b.v FROM raster a JOIN raster b ON b.image_id = a.image_id AND b.y = floor((a.y + 3) / 2.0)::INT - 1 AND b.x = least(floor((a.x - 3) / 3.0)::INT + 2, 63)")
def subsampled_replicate(spark, sf_dir):
    """A channel of half the rows and a third of the columns, with its own origin, read at full size."""
    rows = V.planes(spark, sf_dir)
    full = rows.select("image_id", "y", (S.floor_div(F.col("y") + 3, 2) - 1).alias("sy"))
    half = rows.select(F.col("image_id").alias("i"), F.col("y").cast("long").alias("sy"), "row")
    out = full.join(half, (full["image_id"] == half["i"]) & (full["sy"] == half["sy"]))
    take = F.transform(F.sequence(F.lit(0), F.lit(V.SIDE - 1)), lambda x: F.get("row", F.least(F.floor((x - 3) / 3.0).cast("int") + 2, F.lit(V.SIDE - 1))))
    return out.select("image_id", "y", F.posexplode(take).alias("x", "v"))


@query(
    "output_types",
    "WITH p AS (SELECT *, v % 33 AS bits, x % 5 + 1 AS channels, v > 32 AND v % 33 = 32 AS floating, y % 2 = 1 AND x % 5 > 0 AS alpha FROM raster), "
    "q AS (SELECT *, CASE channels - alpha::INT WHEN 1 THEN 'grey' WHEN 3 THEN 'rgb' ELSE 'bands' END AS plain FROM p) "
    "SELECT image_id, y, x, CASE WHEN floating THEN 'float' WHEN bits <= 8 THEN 'byte' WHEN bits <= 16 THEN 'ushort' ELSE 'int' END AS sample_type, CASE WHEN alpha AND plain <> 'bands' THEN plain || 'a' ELSE plain END AS layout FROM q",
)
def output_types(spark, sf_dir):
    """The raster type that each of many sample formats is delivered as."""
    bits, channels = F.col("v") % 33, F.col("x") % 5 + 1
    kind = S.output_type(bits, channels, (F.col("v") > 32) & (bits == 32), (F.col("y") % 2 == 1) & (channels > 1))
    return V.raster(spark, sf_dir).withColumn("t", kind).select(*KEY, "t.sample_type", "t.layout")
