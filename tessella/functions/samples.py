"""Sample arithmetic as column expressions: depth, sign, packing, quantisation, custom floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.arrays import shl, shr
from tessella.functions.colour import clamp, half_up


def div(a: Column, b) -> Column:
    """Integer division that truncates towards zero."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.when((a < 0) != (b < 0), -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b))).cast("long")


def floor_div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("long")


def level_shift(v: Column, bits: int, signed: bool = False) -> Column:
    """Unsigned samples are moved up by half their range; both kinds are clamped to it."""
    if signed:
        return clamp(v, -(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    return clamp(v + (1 << (bits - 1)), 0, (1 << bits) - 1)


def to_eight_bit(v: Column, bits: int, signed: bool = False) -> Column:
    v = v + (1 << (bits - 1)) if signed else v
    v = F.shiftright(v, bits - 8) if bits > 8 else F.shiftleft(v, 8 - bits) if bits < 8 else v
    return clamp(v, 0, 255)


def scale_to_eight(v: Column, bits: int) -> Column:
    """Rescaled by the ratio of the largest values, rounded half up."""
    return half_up(v * 255.0 / ((1 << bits) - 1))


def left_align(v: Column, bits: int) -> Column:
    return F.shiftleft(v, (8 if bits <= 8 else 16) - bits)


def normalise(v: Column, bits: int) -> Column:
    return v / float((1 << bits) - 1)


def denormalise(v: Column, bits: int) -> Column:
    top = (1 << bits) - 1
    return clamp(half_up(v * float(top)), 0, top)


def zigzag_pack(v: Column) -> Column:
    """0, -1, 1, -2 ... -> 0, 1, 2, 3 ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def zigzag_unpack(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u, 1) - 1)


def bit_length(v: Column) -> Column:
    """Bits of a value of 0 or more; 0 for 0."""
    return F.when(v <= 0, 0).otherwise(F.length(F.bin(v)))


def floor_log2(v: Column) -> Column:
    return bit_length(v) - 1


def ceil_log2(v: Column) -> Column:
    return bit_length(v - 1)


def hybrid_token(v: Column, split_exp: int = 4, msb: int = 2, lsb: int = 0) -> tuple[Column, Column, Column]:
    """(token, number of raw bits, raw bits) of a value under a hybrid integer code."""
    one = F.lit(1).cast("long")
    n = floor_log2(v)
    low = v - shl(one, n)
    token = (1 << split_exp) + shl(n - split_exp, msb + lsb) + shl(shr(low, F.greatest(n - msb, F.lit(0))), lsb) + low % (1 << lsb)
    raw = n - msb - lsb
    bits = shr(low, lsb) % shl(one, F.greatest(raw, F.lit(0)))
    small = v < (1 << split_exp)
    return F.when(small, v).otherwise(token), F.when(small, 0).otherwise(raw), F.when(small, 0).otherwise(bits)


def custom_float(bits: Column, exponent_bits: int, mantissa_bits: int) -> Column:
    """The value of a sign, exponent, mantissa pattern; infinities and NaN for the top exponent."""
    bias = (1 << (exponent_bits - 1)) - 1
    sign = F.when(F.shiftright(bits, exponent_bits + mantissa_bits) % 2 == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, mantissa_bits) % (1 << exponent_bits)
    mantissa = bits % (1 << mantissa_bits)
    value = F.when(exponent == 0, mantissa * 2.0 ** (1 - bias - mantissa_bits)).otherwise((1 + mantissa / float(1 << mantissa_bits)) * F.pow(F.lit(2.0), exponent - bias))
    top = F.when(mantissa == 0, float("inf")).otherwise(float("nan"))
    return sign * F.when(exponent == (1 << exponent_bits) - 1, top).otherwise(value)


def quantise(c: Column, step: float, limit: int) -> Column:
    """Dead-zone quantiser: truncates towards zero."""
    return F.signum(c).cast("int") * F.least(F.lit(limit), F.floor(F.abs(c) / step).cast("int"))


def dequantise(q: Column, step: float) -> Column:
    """From half-unit fixed point."""
    return q * step * 0.5


def bin_centre(magnitude: Column, negative: Column, missing: Column, roi: int = 0, reversible: bool = True) -> Column:
    """Middle of the interval that a magnitude with ``missing`` undecoded planes stands for, region of interest undone."""
    m = F.when(magnitude >= (1 << roi), F.shiftright(magnitude, roi)).otherwise(magnitude) if roi else magnitude
    one = F.lit(1)
    if reversible:
        m = F.when((m != 0) & (missing >= 1), m + shl(one, F.greatest(missing - 1, F.lit(0)))).otherwise(m)
    else:
        m = F.when(m != 0, F.shiftleft(m, 1) + shl(one, missing)).otherwise(0)
    return F.when(negative, -m).otherwise(m)


def microns_per_pixel(resolution: Column, unit: Column) -> Column:
    """TIFF resolution in units of 2 inch or 3 centimetre; null for other units or no resolution."""
    size = F.when(unit == 2, 25_400.0).when(unit == 3, 10_000.0)
    return F.when(resolution > 0, size / resolution)


def clamped_gradient(n: Column, w: Column, nw: Column) -> Column:
    low, high = F.least(n, w), F.greatest(n, w)
    return F.when(nw < low, high).when(nw > high, low).otherwise(n + w - nw)


def predict(kind: int, w: Column, n: Column, nw: Column, ne: Column, nn: Column, nee: Column, ww: Column) -> Column:
    """Prediction 0..13 except 6, which keeps a state of its own (kernels.weighted_predictions)."""
    match kind:
        case 0:
            return F.lit(0)
        case 1:
            return w
        case 2:
            return n
        case 3:
            return div(w + n, 2)
        case 4:
            return F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n)
        case 5:
            return clamped_gradient(n, w, nw)
        case 7:
            return ne
        case 8:
            return nw
        case 9:
            return ww
        case 10:
            return div(w + nw, 2)
        case 11:
            return div(n + nw, 2)
        case 12:
            return div(n + ne, 2)
        case 13:
            return div(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8, 16)
    raise ValueError(f"no stateless predictor {kind}")


def output_type(bits: Column, channels: Column, floating: Column, alpha: Column) -> Column:
    """Element type and colour layout of a delivered raster: struct of sample_type and layout.

    Samples of up to 8 bits are bytes, of up to 16 unsigned shorts, larger ones ints;
    floating ones floats.  One and three colours are grey and rgb, with or without
    alpha; any other number is delivered as bands.
    """
    kind = F.when(floating, "float").when(bits <= 8, "byte").when(bits <= 16, "ushort").otherwise("int")
    colours = channels - alpha.cast("int")
    layout = F.when(colours == 1, "grey").when(colours == 3, "rgb").otherwise("bands")
    return F.struct(kind.alias("sample_type"), F.when(alpha & (layout != "bands"), F.concat(layout, F.lit("a"))).otherwise(layout).alias("layout"))
