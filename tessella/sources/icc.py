"""ICC profiles of matrix and tone-curve type: parsing, building, and conversion to 8-bit sRGB."""

from __future__ import annotations

import struct

import numpy as np

#: From the profile connection space (D50) to linear sRGB (fixed values).
D50_TO_SRGB = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])


def tags(profile: bytes) -> dict[str, bytes]:
    if len(profile) < 132 or profile[36:40] != b"acsp":
        raise ValueError("no profile")
    out = {}
    for i in range(struct.unpack_from(">I", profile, 128)[0]):
        name, at, n = struct.unpack_from(">4sII", profile, 132 + 12 * i)
        if at + n > len(profile):
            raise ValueError("a tag past the end")
        out[name.decode("latin-1")] = profile[at : at + n]
    return out


def curve(data: bytes):
    """A tone curve as a function of 0..1: identity, gamma, table or parametric."""
    kind = data[:4]
    if kind == b"curv":
        n = struct.unpack_from(">I", data, 8)[0]
        if n == 0:
            return lambda x: x
        table = np.frombuffer(data, ">u2", n, 12).astype(float)
        if n == 1:
            return lambda x: np.power(x, table[0] / 256)
        return lambda x: np.interp(x, np.linspace(0, 1, n), table / 65535)
    if kind == b"para":
        shape = struct.unpack_from(">H", data, 8)[0]
        count = (1, 3, 4, 5, 7)[shape]
        g, a, b, c, d, e, f = ([v / 65536 for v in struct.unpack_from(f">{count}i", data, 12)] + [0.0] * 7)[:7]
        if shape == 0:
            return lambda x: np.power(x, g)
        if shape == 1:
            return lambda x: np.where(x >= -b / a, np.power(np.maximum(a * x + b, 0), g), 0)
        if shape == 2:
            return lambda x: np.where(x >= -b / a, np.power(np.maximum(a * x + b, 0), g) + c, c)
        return lambda x: np.where(x >= d, np.power(np.maximum(a * x + b, 0), g) + e, c * x + f)
    raise ValueError(f"a curve of type {kind!r}")


def matrix_profile(profile: bytes):
    """(matrix, curves) of an RGB matrix profile; None for grey, CMYK and lookup-table profiles."""
    found = tags(profile)
    if profile[16:20] != b"RGB " or "A2B0" in found or not {"rXYZ", "gXYZ", "bXYZ", "rTRC", "gTRC", "bTRC"} <= set(found):
        return None
    columns = [[v / 65536 for v in struct.unpack_from(">3i", found[f"{c}XYZ"], 8)] for c in "rgb"]
    return np.array(columns).T, [curve(found[f"{c}TRC"]) for c in "rgb"]


def to_srgb(rgb: np.ndarray, profile: bytes, bits: int = 8) -> np.ndarray:
    """Samples (... x 3) to 8-bit sRGB; unchanged where the profile is no matrix profile."""
    parsed = matrix_profile(profile)
    if parsed is None:
        return rgb
    matrix, curves = parsed
    unit = rgb.astype(float) / ((1 << bits) - 1)
    linear = np.stack([f(unit[..., i]) for i, f in enumerate(curves)], axis=-1) @ (D50_TO_SRGB @ matrix).T
    linear = np.clip(linear, 0, 1)
    encoded = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.power(linear, 1 / 2.4) - 0.055)
    return np.floor(encoded * 255 + 0.5).astype(np.uint8)


def build(matrix: np.ndarray, gamma: float) -> bytes:
    """A matrix profile with one gamma."""
    xyz = lambda v: b"XYZ " + bytes(4) + struct.pack(">3i", *(round(x * 65536) for x in v))
    body = {f"{c}XYZ": xyz(matrix[:, i]) for i, c in enumerate("rgb")} | {f"{c}TRC": b"curv" + bytes(4) + struct.pack(">IH", 1, round(gamma * 256)) + bytes(2) for c in "rgb"}
    at, index, data = 132 + 12 * len(body), b"", b""
    for name, value in body.items():
        index += struct.pack(">4sII", name.encode(), at + len(data), len(value))
        data += value
    head = bytearray(128)
    head[16:24], head[36:40] = b"RGB XYZ ", b"acsp"
    head[:4] = struct.pack(">I", at + len(data))
    return bytes(head) + struct.pack(">I", len(body)) + index + data
