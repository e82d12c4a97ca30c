"""Two-dimensional lifting wavelets on NumPy planes, for any origin parity."""

from __future__ import annotations

import numpy as np

from tessella.operators.stencils import LIFT97, SCALE97


def _lift(x: np.ndarray, origin: int, parity: int, step) -> np.ndarray:
    """One lifting step along axis 0: rows of absolute ``parity`` get step(own, sum of mirrored neighbours)."""
    wide = np.pad(x, [(1, 1)] + [(0, 0)] * (x.ndim - 1), mode="reflect")
    at = np.arange((parity - origin) % 2, len(x), 2)
    out = x.copy()
    out[at] = step(x[at], wide[at] + wide[at + 2])
    return out


def analyse53(x: np.ndarray, origin: int) -> np.ndarray:
    if len(x) == 1:
        return x * 2 if origin % 2 else x
    x = _lift(x, origin, 1, lambda v, s: v - (s >> 1))
    return _lift(x, origin, 0, lambda v, s: v + ((s + 2) >> 2))


def synthesise53(x: np.ndarray, origin: int) -> np.ndarray:
    if len(x) == 1:
        return x >> 1 if origin % 2 else x
    x = _lift(x, origin, 0, lambda v, s: v - ((s + 2) >> 2))
    return _lift(x, origin, 1, lambda v, s: v + (s >> 1))


def analyse97(x: np.ndarray, origin: int) -> np.ndarray:
    if len(x) == 1:
        return x * 2 if origin % 2 else x
    for i, k in enumerate(LIFT97):
        x = _lift(x, origin, 1 - i % 2, lambda v, s, k=k: v + k * s)
    low = (np.arange(len(x)) + origin) % 2 == 0
    x = x.copy()
    x[low] /= SCALE97
    x[~low] *= SCALE97
    return x


def synthesise97(x: np.ndarray, origin: int) -> np.ndarray:
    if len(x) == 1:
        return x / 2 if origin % 2 else x
    low = (np.arange(len(x)) + origin) % 2 == 0
    x = x.copy()
    x[low] *= SCALE97
    x[~low] /= SCALE97
    for i, k in reversed(list(enumerate(LIFT97))):
        x = _lift(x, origin, 1 - i % 2, lambda v, s, k=k: v - k * s)
    return x


def _places(x0: int, y0: int) -> dict[str, tuple[slice, slice]]:
    """Where each band lies in the interleaved plane: even absolute positions are low-pass."""
    x, y = (slice(x0 % 2, None, 2), slice(1 - x0 % 2, None, 2)), (slice(y0 % 2, None, 2), slice(1 - y0 % 2, None, 2))
    return {"LL": (y[0], x[0]), "HL": (y[0], x[1]), "LH": (y[1], x[0]), "HH": (y[1], x[1])}


def forward(plane: np.ndarray, levels: int, x0: int = 0, y0: int = 0, reversible: bool = True) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
    """(LL, [{HL, LH, HH} from the finest level on]); columns are analysed before rows."""
    analyse = analyse53 if reversible else analyse97
    x = plane.astype(np.int64 if reversible else np.float64)
    out = []
    for _ in range(levels):
        if x.size:
            x = analyse(analyse(x, y0).T, x0).T
        bands = {b: x[at] for b, at in _places(x0, y0).items()}
        x = bands.pop("LL")
        out.append(bands)
        x0, y0 = (x0 + 1) >> 1, (y0 + 1) >> 1
    return x, out


def inverse(ll: np.ndarray, bands: list[dict[str, np.ndarray]], x0: int = 0, y0: int = 0, reversible: bool = True, skip: int = 0) -> np.ndarray:
    """Undo ``forward``; ``skip`` finest levels are left out, which gives a reduced image.  (x0, y0) is the full image's origin."""
    synthesise = synthesise53 if reversible else synthesise97
    x = ll.astype(np.int64 if reversible else np.float64)
    for level in range(len(bands) - 1, skip - 1, -1):
        b = bands[level] | {"LL": x}
        ox, oy = -(-x0 // (1 << level)), -(-y0 // (1 << level))
        x = np.empty((x.shape[0] + b["LH"].shape[0], x.shape[1] + b["HL"].shape[1]), x.dtype)
        for name, at in _places(ox, oy).items():
            x[at] = b[name]
        if x.size:
            x = synthesise(synthesise(x.T, ox).T, oy)
    return x
