"""Block transforms and filters on NumPy planes."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def dct_basis(n: int) -> np.ndarray:
    """Rows: frequencies; the first is the mean, the others cosines scaled by sqrt(2)."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.sqrt(2.0) * np.cos(np.pi * k * (2 * x + 1) / (2 * n))
    basis[0] = 1.0
    return basis


def dct(block: np.ndarray) -> np.ndarray:
    """Forward transform of the last two axes; coefficient (0, 0) is the mean."""
    h, w = block.shape[-2:]
    return dct_basis(h) / h @ block @ (dct_basis(w) / w).T


def idct(coef: np.ndarray) -> np.ndarray:
    h, w = coef.shape[-2:]
    return dct_basis(h).T @ coef @ dct_basis(w)


def tile(plane: np.ndarray, n: int) -> np.ndarray:
    """(rows of blocks, columns of blocks, n, n); the sides must be multiples of n."""
    h, w = plane.shape
    return plane.reshape(h // n, n, w // n, n).swapaxes(1, 2)


def untile(blocks: np.ndarray) -> np.ndarray:
    a, b, n, m = blocks.shape
    return blocks.swapaxes(1, 2).reshape(a * n, b * m)


def gaussian(plane: np.ndarray, sigma: float = 1.6) -> np.ndarray:
    """Separable blur, edges repeated."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(plane, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        plane = sum(w * np.take(wide, np.arange(i, i + plane.shape[axis]), axis) for i, w in enumerate(k))
    return plane


def perceptual_distance(a: list[np.ndarray], b: list[np.ndarray], gains=(120.0, 1.0, 0.30)) -> float:
    """Cubic mean over X, Y, B planes of low-frequency error and of high-frequency error masked by the original's contrast."""
    low = [gaussian(p) for p in a]
    mask = 1 + 14 * gaussian(np.abs(a[1] - low[1]))
    total = np.zeros_like(mask)
    for x, y, l, g in zip(a, b, low, gains, strict=True):
        m = gaussian(y)
        total += g * ((l - m) ** 2 + (((x - l) - (y - m)) / mask) ** 2)
    return float(30 * np.mean(np.sqrt(total) ** 3) ** (1 / 3))


def mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Half-sample mirroring: -1 is 0, n is n - 1."""
    i = np.mod(i, 2 * n)
    return np.where(i >= n, 2 * n - 1 - i, i)


def edge_preserving(planes: list[np.ndarray], inverse_sigma: np.ndarray, scale=(40.0, 5.0, 3.5)) -> list[np.ndarray]:
    """One pass of a five-tap filter whose weights fall with the difference of plus-shaped neighbourhoods over all planes."""
    h, w = planes[0].shape
    y, x = np.mgrid[:h, :w]
    at = lambda p, dy, dx: p[mirror(y + dy, h), mirror(x + dx, w)]
    plus = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
    total = np.ones((h, w))
    sums = [p.astype(float) for p in planes]
    for dy, dx in plus[1:]:
        sad = sum(s * sum(np.abs(at(p, dy + a, dx + b) - at(p, a, b)) for a, b in plus) for p, s in zip(planes, scale, strict=False))
        weight = np.maximum(0, 1 - sad * inverse_sigma)
        total = total + weight
        sums = [s + weight * at(p, dy, dx) for s, p in zip(sums, planes, strict=True)]
    return [s / total for s in sums]


def unsqueeze(average: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undo a horizontal squeeze: rows of averages and residuals -> rows twice as wide."""
    h, n = residual.shape
    out = np.zeros((h, average.shape[1] + n), np.int64)
    left = average[:, 0].astype(np.int64)
    for i in range(n):
        a = average[:, i].astype(np.int64)
        after = average[:, i + 1].astype(np.int64) if i + 1 < average.shape[1] else a
        b = left if i else a
        diff = residual[:, i] + tendency(b, a, after)
        first = a + _div(diff, 2)
        out[:, 2 * i], out[:, 2 * i + 1] = first, first - diff
        left = out[:, 2 * i + 1]
    if average.shape[1] > n:
        out[:, -1] = average[:, -1]
    return out


def squeeze(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(averages, residuals) of pairs along each row; an odd last sample stays an average."""
    rows = rows.astype(np.int64)
    n = rows.shape[1] // 2
    a, b = rows[:, 0 : 2 * n : 2], rows[:, 1 : 2 * n : 2]
    average = (a + b + (a > b)) >> 1
    if rows.shape[1] % 2:
        average = np.concatenate([average, rows[:, -1:]], axis=1)
    mid = average[:, :n]
    after = np.concatenate([average[:, 1:], average[:, -1:]], axis=1)[:, :n]
    left = np.concatenate([mid[:, :1], b[:, :-1]], axis=1) if n else mid
    return average, a - b - tendency(left, mid, after)


def _div(a: np.ndarray, n: int) -> np.ndarray:
    """Towards zero."""
    return np.where(a < 0, -(-a // n), a // n)


def tendency(b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Difference that a smooth, monotone signal would have; 0 elsewhere."""
    down = _div(4 * b - 3 * n - a + 6, 12)
    down = np.where(down - (down & 1) > 2 * (b - a), 2 * (b - a) + 1, down)
    down = np.where(down + (down & 1) > 2 * (a - n), 2 * (a - n), down)
    up = _div(4 * b - 3 * n - a - 6, 12)
    up = np.where(up + (up & 1) < 2 * (b - a), 2 * (b - a) - 1, up)
    up = np.where(up - (up & 1) < 2 * (a - n), 2 * (a - n), up)
    return np.where((b >= a) & (a >= n), down, np.where((b <= a) & (a <= n), up, 0))


# Fixed values of the self-correcting predictor: parameters and weights.
WP_P1, WP_P2, WP_P3, WP_W = 16, 10, (7, 7, 7, 0, 0), (13, 12, 12, 12)


_DIV24 = [(1 << 24) // (i + 1) for i in range(64)]


class WeightedPredictor:
    """The self-correcting predictor of one channel: four guesses, weighted by their recent errors nearby."""

    def __init__(self, width: int):
        self.w = width
        self.errors = [[[0] * 4 for _ in range(width)] for _ in range(2)]
        self.misses = [[0] * width for _ in range(2)]

    def predict(self, x: int, y: int, vw: int, vn: int, vnw: int, vne: int, vnn: int) -> int:
        """The prediction; ``largest`` is then the largest miss nearby."""
        last = x + 1 >= self.w
        now, above = self.misses[y & 1], self.misses[y & 1 ^ 1]
        tw, tn = now[x - 1] if x else 0, above[x] if y else 0
        tnw, tne = above[x - 1] if x and y else tn, above[x + 1] if y and not last else tn
        self.largest = max((tw, tn, tnw, tne), key=abs)
        self.guess = (8 * (vw + vne - vn), 8 * vn - ((tw + tn + tne) * WP_P1 >> 5), 8 * vw - ((tw + tn + tnw) * WP_P2 >> 5), 8 * vn - ((tnw * WP_P3[0] + tn * WP_P3[1] + tne * WP_P3[2] + 8 * (vnn - vn) * WP_P3[3] + 8 * (vnw - vw) * WP_P3[4]) >> 5))
        none = (0, 0, 0, 0)
        row, up = self.errors[y & 1], self.errors[y & 1 ^ 1]
        n, w = up[x] if y else none, row[x - 1] if x else none
        nw, ww, ne = up[x - 1] if x and y else n, row[x - 2] if x > 1 else none, up[x + 1] if y and not last else n
        weights = []
        for i in range(4):
            total = (n[i] + w[i] + nw[i] + ww[i] + ne[i] + (w[i] if last else 0)) & 0xFFFFFFFF
            shift = max((total + 1).bit_length() - 6, 0)
            weights.append(4 + (WP_W[i] * _DIV24[total >> shift] >> shift))
        drop = max(sum(weights).bit_length() - 5, 0)
        weights = [k >> drop for k in weights]
        total = sum(weights)
        p = (sum(g * k for g, k in zip(self.guess, weights, strict=True)) + (total >> 1) - 1) * _DIV24[total - 1] >> 24
        if ((tn ^ tw) | (tn ^ tnw)) <= 0:
            p = min(max(p, 8 * min(vw, vn, vne)), 8 * max(vw, vn, vne))
        self.at, self.fine = (x, y), p
        return (p + 3) >> 3

    def learn(self, v: int) -> None:
        x, y = self.at
        self.errors[y & 1][x] = [(abs(g - 8 * v) + 3) >> 3 for g in self.guess]
        self.misses[y & 1][x] = self.fine - 8 * v


def weighted_predictions(plane: np.ndarray) -> np.ndarray:
    """Predictions of the self-correcting predictor for every sample of a plane."""
    h, w = plane.shape
    px = plane.astype(int).tolist()
    wp, out = WeightedPredictor(w), np.zeros((h, w), np.int64)
    for y in range(h):
        row, up = px[y], px[y - 1] if y else None
        for x in range(w):
            vw = row[x - 1] if x else up[x] if y else 0
            vn = up[x] if y else vw
            vnw = up[x - 1] if x and y else vw
            out[y, x] = wp.predict(x, y, vw, vn, vnw, up[x + 1] if y and x + 1 < w else vn, px[y - 2][x] if y > 1 else vn)
            wp.learn(row[x])
    return out
