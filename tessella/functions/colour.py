"""Colour transforms as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
#: Linear RGB from mixed cone responses, row by row, and the bias of each.
OPSIN_INVERSE = (
    (11.031566901960783, -9.866943921568629, -0.16462299647058826),
    (-3.254147380392157, 4.418770392156863, -0.16462299647058826),
    (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863),
)
OPSIN_BIAS = -0.0037930732552754493
#: Irreversible luma and chroma weights.
ICT = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
#: Channel orders of the 42 reversible transforms: type = 7 * order + kind.
RCT_ORDERS = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))


def _half(c: Column | np.ndarray) -> Column | np.ndarray:
    """Arithmetic shift by one: floor(c / 2)."""
    return c >> 1 if isinstance(c, np.ndarray) else F.shiftright(c, 1)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_up(c: Column) -> Column:
    """floor(c + 0.5), as an integer."""
    return F.floor(c + 0.5).cast("int")


def forward_rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def inverse_rct(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(u + v, 2)
    return v + g, g, u + g


def forward_ict(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple(k[0] * r + k[1] * g + k[2] * b for k in ICT)


def inverse_ict(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb


def forward_rct42(kind: int, planes: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Type 0..41 of the reversible family: a permutation, then one of seven differences; of columns or of NumPy arrays."""
    a, b, c = (planes[i] for i in RCT_ORDERS[kind // 7])
    match kind % 7:
        case 1:
            return a, b, c - a
        case 2:
            return a, b - a, c
        case 3:
            return a, b - a, c - a
        case 4:
            return a, b - _half(a + c), c
        case 5:
            d = c - a
            return a, b - a - _half(d), d
        case 6:
            co = a - c
            t = c + _half(co)
            cg = b - t
            return t + _half(cg), co, cg
    return a, b, c


def inverse_rct42(kind: int, coded: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    a, b, c = coded
    match kind % 7:
        case 1:
            out = a, b, c + a
        case 2:
            out = a, b + a, c
        case 3:
            out = a, b + a, c + a
        case 4:
            out = a, b + _half(a + c), c
        case 5:
            out = a, b + a + _half(c), c + a
        case 6:
            t = a - _half(c)
            blue = t - _half(b)
            out = b + blue, c + t, blue
        case _:
            out = a, b, c
    back: list[Column] = list(out)
    for i, at in enumerate(RCT_ORDERS[kind // 7]):
        back[at] = out[i]
    return tuple(back)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """8-bit, centred at 128, rounded half up, clamped."""
    u, v = cb - 128, cr - 128
    return tuple(clamp(half_up(c), 0, 255) for c in inverse_ict(y, u, v))


def sample_ycbcr_to_rgb(cb: Column, y: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Unit-range planes in the order Cb, Y, Cr; Y is stored without its middle."""
    luma = y + 128.0 / 255.0
    return luma + 1.402 * cr, luma - 0.344136286201022 * cb - 0.714136286201022 * cr, luma + 1.772 * cb


def xyb_to_linear(x: Column, y: Column, b: Column, intensity: float = 255.0) -> tuple[Column, ...]:
    root = math.cbrt(OPSIN_BIAS)
    mixed = [g * g * g + OPSIN_BIAS for g in (y + x - root, y - x - root, b - root)]
    return tuple((row[0] * mixed[0] + row[1] * mixed[1] + row[2] * mixed[2]) * (255.0 / intensity) for row in OPSIN_INVERSE)


def _invert(m) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


OPSIN = _invert(OPSIN_INVERSE)


def linear_to_xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    root = math.cbrt(OPSIN_BIAS)
    cone = [F.cbrt(k[0] * r + k[1] * g + k[2] * b - OPSIN_BIAS) + root for k in OPSIN]
    return (cone[0] - cone[1]) / 2, (cone[0] + cone[1]) / 2, cone[2]


def srgb_from_linear(v: Column) -> Column:
    """The sRGB curve, mirrored for negative values."""
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 0.0031308, 12.92 * a).otherwise(1.055 * F.pow(a, F.lit(1 / 2.4)) - 0.055)


def srgb_clamped(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).otherwise(srgb_from_linear(v))


def linear_from_srgb(v: Column) -> Column:
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))


def bt709_from_linear(v: Column) -> Column:
    return F.when(v < 0.018, 4.5 * v).otherwise(1.099 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(0.45)) - 0.099)


def gamma_from_linear(v: Column, gamma: float) -> Column:
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(gamma))


def dci_from_linear(v: Column) -> Column:
    return gamma_from_linear(v, 1 / 2.6)


def pq_from_linear(v: Column) -> Column:
    x = F.pow(F.greatest(v, F.lit(0.0)), F.lit(0.1593017578125))
    return F.pow((0.8359375 + 18.8515625 * x) / (1 + 18.6875 * x), F.lit(78.84375))


def hlg_from_linear(v: Column) -> Column:
    a = 0.17883277
    b, c = 1 - 4 * a, 0.5 - a * math.log(4 * a)
    x = F.greatest(v, F.lit(0.0))
    return F.when(x <= 1 / 12, F.sqrt(3 * x)).otherwise(a * F.log(F.greatest(12 * x - b, F.lit(1e-9))) + c)


TRANSFERS = {"linear": lambda v: v, "srgb": srgb_from_linear, "bt709": bt709_from_linear, "dci": dci_from_linear, "pq": pq_from_linear, "hlg": hlg_from_linear}


def from_linear(v: Column, transfer: str) -> Column:
    """Unknown transfers count as sRGB."""
    return TRANSFERS.get(transfer, srgb_from_linear)(v)


def matrix_apply(m, r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """A 3 x 3 profile matrix applied to linear channels."""
    return tuple(k[0] * r + k[1] * g + k[2] * b for k in m)


def cmyk_composite(c: Column, black: Column, black_max: int = 255) -> Column:
    """A colour channel darkened by the black channel."""
    return half_up(c * (black / black_max))


def spot_mix(p: Column, spot: Column, colour: float, strength: float) -> Column:
    mix = strength * spot
    return mix * colour + (1 - mix) * p
