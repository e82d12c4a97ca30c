"""Sequential and format-specific kernels: permutations, palettes, upsampling, noise, clustering, compositing."""

from __future__ import annotations

import numpy as np

from tessella.functions.blocks import mirror


def lehmer_apply(items: list, code: list[int]) -> list:
    """Items in the order that a Lehmer code gives: each entry picks from what is left, the rest follow."""
    left = list(items)
    return [left.pop(c) for c in code] + left


def lehmer_of(order: list[int]) -> list[int]:
    """The Lehmer code of a permutation of 0..n-1, without trailing zeros."""
    left, code = list(range(len(order))), []
    for v in order:
        code.append(left.index(v))
        left.pop(code[-1])
    while code and not code[-1]:
        code.pop()
    return code


def move_to_front(values: list[int], size: int = 256) -> list[int]:
    recent, out = list(range(size)), []
    for v in values:
        out.append(at := recent.index(v))
        recent.insert(0, recent.pop(at))
    return out


def undo_move_to_front(places: list[int], size: int = 256) -> list[int]:
    recent, out = list(range(size)), []
    for at in places:
        recent.insert(0, recent.pop(at))
        out.append(recent[0])
    return out


def palette_colours(index: np.ndarray, explicit: np.ndarray, bits: int) -> np.ndarray:
    """Channels x index shape: explicit colours, then a 4 x 4 x 4 cube of middles, then a 5 x 5 x 5 cube; channels past the third are 0 there."""
    channels, n = explicit.shape
    top = (1 << bits) - 1
    over = index - n
    out = []
    for c in range(channels):
        small = (over >> 2 * c) % 4 * top // 4 + (1 << max(0, bits - 3))
        large = (over - 64) // 5**c % 5 * top // 4
        implicit = np.where(over < 64, small, large) if c < 3 else np.zeros_like(over)
        out.append(np.where(index < n, explicit[c][np.clip(index, 0, n - 1)], implicit))
    return np.stack(out)


def upsample(plane: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
    """k-fold by 5 x 5 kernels, one for each place in the k x k cell, from a symmetric half-kernel of packed weights.

    Results stay within the support's smallest and largest samples; edges mirror.
    """
    h, w = plane.shape
    side = 5 * k // 2
    full = np.zeros((side, side))
    full[np.triu_indices(side)] = weights
    full = full + np.triu(full, 1).T
    y, x = np.mgrid[:h, :w]
    near = np.stack([plane[mirror(y + i - 2, h), mirror(x + j - 2, w)] for i in range(5) for j in range(5)])
    low, high = near.min(axis=0), near.max(axis=0)
    out = np.zeros((h * k, w * k))

    def axis(at: int) -> list[int]:
        return [5 * at + i if at < k // 2 else 5 * (k - 1 - at) + 4 - i for i in range(5)]

    for ky in range(k):
        for kx in range(k):
            kernel = full[np.ix_(axis(ky), axis(kx))].ravel()
            out[ky::k, kx::k] = np.clip(np.tensordot(kernel, near, 1), low, high)
    return out


_MASK = (1 << 64) - 1


def _split_mix(z: int) -> int:
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return z ^ z >> 31


class XorShift128:
    """Eight lanes of a xorshift128+ generator, seeded by split-mix steps."""

    def __init__(self, seed0: int, seed1: int):
        a, b = [_split_mix(seed0 + 0x9E3779B97F4A7C15 & _MASK)], [_split_mix(seed1 + 0x9E3779B97F4A7C15 & _MASK)]
        for _ in range(7):
            a.append(_split_mix(a[-1]))
            b.append(_split_mix(b[-1]))
        self.a, self.b = np.array(a, np.uint64), np.array(b, np.uint64)

    def fill(self) -> np.ndarray:
        """Sixteen 32-bit words: low and high halves of each lane's sum."""
        total = self.a + self.b
        x, self.a = self.a, self.b
        x = x ^ (x << np.uint64(23))
        self.b = x ^ self.a ^ (x >> np.uint64(18)) ^ (self.a >> np.uint64(5))
        return total.view(np.uint32)


def noise_field(seed: int, width: int, height: int, x0: int = 0, y0: int = 0) -> np.ndarray:
    """Three planes of high-pass noise of one group."""
    rng = XorShift128(seed, x0 << 32 | y0)
    across = -(-width // 16)
    words = np.stack([np.stack([np.concatenate([rng.fill() for _ in range(across)])[:width] for _ in range(height)]) for _ in range(3)])
    raw = ((words >> np.uint32(9)) | np.uint32(0x3F800000)).view(np.float32).astype(float)
    y, x = np.mgrid[:height, :width]
    total = sum(raw[:, mirror(y + i, height), mirror(x + j, width)] for i in range(-2, 3) for j in range(-2, 3))
    return 0.16 * total - 4.0 * raw


def add_noise(planes: list[np.ndarray], noise: np.ndarray, strengths: np.ndarray, base_x: float = 0.0, base_b: float = 1.0) -> list[np.ndarray]:
    """Noise on X, Y, B planes; its strength is looked up (eight entries, linear between) by the brightness of two channels."""
    x, y, b = planes
    at = np.arange(8.0)
    red, green = (np.clip(np.interp(3 * np.maximum(v, 0), at, strengths), 0, 1) for v in (y + x, y - x))
    own, shared = 0.00171875, 0.21828125
    r, g = red * (own * noise[0] + shared * noise[2]), green * (own * noise[1] + shared * noise[2])
    return [x + base_x * (r + g) + r - g, y + r + g, b + base_b * (r + g)]


def smooth_low_frequency(planes: list[np.ndarray], steps: list[float]) -> list[np.ndarray]:
    """Low-frequency planes blended towards their weighted 3 x 3 mean where that changes them by little, edges untouched."""
    if min(planes[0].shape) <= 2:
        return planes
    side, corner, own = 0.20345139757231578, 0.0334829185968739, 0.05226273532324128
    inner, means = [], []
    for p in planes:
        c = p[1:-1, 1:-1]
        inner.append(c)
        means.append(own * c + side * (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) + corner * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]))
    gap = np.maximum(0.5, np.max([np.abs(c - m) / s for c, m, s in zip(inner, means, steps, strict=True)], axis=0))
    share = np.maximum(0, 3 - 4 * gap)
    out = []
    for p, c, m in zip(planes, inner, means, strict=True):
        q = p.astype(float).copy()
        q[1:-1, 1:-1] = c + (m - c) * share
        out.append(q)
    return out


def sharpen_inverse(plane: np.ndarray, kernel, rounds: int = 8, relax: float = 1.3863) -> np.ndarray:
    """The plane that ``kernel`` smooths to ``plane``, by relaxed fixed-point steps."""
    x = plane.astype(float)
    for _ in range(rounds):
        x = x + relax * (plane - kernel(x))
    return x


def gaborish(plane: np.ndarray, w1: float = 0.115169525, w2: float = 0.061248592) -> np.ndarray:
    """3 x 3 smoothing, edges repeated."""
    p = np.pad(plane, 1, mode="edge")
    side = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    corner = p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]
    return (p[1:-1, 1:-1] + w1 * side + w2 * corner) / (1 + 4 * (w1 + w2))


def entropy_bits(counts: np.ndarray) -> float:
    total = counts.sum()
    c = counts[counts > 0]
    return float((c * np.log2(total / c)).sum()) if total else 0.0


def cluster_histograms(histograms: np.ndarray, most: int = 64, overhead: float = 20.0) -> list[int]:
    """A cluster for each histogram: the pair whose union costs least is merged while that saves bits or there are too many."""
    groups = [[i] for i in range(len(histograms))]
    sums = [h.astype(float) for h in histograms]
    cost = [entropy_bits(h) + overhead for h in sums]
    while len(groups) > 1:
        best = min(((entropy_bits(sums[i] + sums[j]) + overhead - cost[i] - cost[j], i, j) for i in range(len(groups)) for j in range(i)), default=None)
        if best is None or best[0] >= 0 and len(groups) <= most:
            break
        _, i, j = best
        sums[j] += sums[i]
        groups[j] += groups[i]
        cost[j] = entropy_bits(sums[j]) + overhead
        for x in (sums, groups, cost):
            x.pop(i)
    out = [0] * len(histograms)
    for c, members in enumerate(sorted(groups, key=min)):
        for m in members:
            out[m] = c
    return out


def composite(frames: list[dict], width: int, height: int) -> list[np.ndarray]:
    """Canvases after each shown frame.

    A frame has plane, x0, y0, mode (replace, add, mul, blend, muladd), alpha (plane or None),
    source (reference slot), save (slot or 0), duration and last.  A frame is shown if
    it has a duration or is the last; it is saved if it names a slot or has no duration.
    """
    slots: dict[int, np.ndarray] = {}
    shown = []
    for f in frames:
        old = slots.get(f.get("source", 0), np.zeros((height, width)))
        canvas = old.copy()
        y0, x0 = f.get("y0", 0), f.get("x0", 0)
        h, w = f["plane"].shape
        a, b, c, d = max(0, y0), max(0, x0), min(height, y0 + h), min(width, x0 + w)
        if a < c and b < d:
            new = f["plane"][a - y0 : c - y0, b - x0 : d - x0]
            back = old[a:c, b:d]
            alpha = 1.0 if f.get("alpha") is None else f["alpha"][a - y0 : c - y0, b - x0 : d - x0]
            match f.get("mode", "replace"):
                case "add":
                    new = back + new
                case "mul":
                    new = back * np.clip(new, 0, 1)
                case "blend":
                    new = new * alpha + back * (1 - alpha)
                case "muladd":
                    new = back + alpha * new
            canvas[a:c, b:d] = new
        if (f.get("save", 0) or not f.get("duration", 0)) and not f.get("last"):
            slots[f.get("save", 0)] = canvas
        if f.get("duration", 0) or f.get("last"):
            shown.append(canvas)
    return shown


def demosaic(plane: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Three planes of a Bayer mosaic; each missing colour is the mean of the nearest sites of it inside the image."""
    h, w = plane.shape
    colour = np.array(["RGB".index(c) for c in pattern]).reshape(2, 2)
    site = colour[np.arange(h)[:, None] % 2, np.arange(w)[None, :] % 2]
    out = np.empty((3, h, w))
    for c in range(3):
        values, known = np.pad(np.where(site == c, plane, 0).astype(float), 1), np.pad((site == c).astype(float), 1)
        cut = lambda a, dy, dx: a[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        plus, cross = ((-1, 0), (1, 0), (0, -1), (0, 1)), ((-1, -1), (-1, 1), (1, -1), (1, 1))
        n4, n8 = (sum(cut(known, *d) for d in s) for s in (plus, cross))
        v4, v8 = (sum(cut(values, *d) for d in s) for s in (plus, cross))
        out[c] = np.where(site == c, plane, np.where(n4 > 0, v4 / np.maximum(n4, 1), v8 / np.maximum(n8, 1)))
    return out


def half_float(x: np.ndarray) -> np.ndarray:
    """Snapped to binary16."""
    return x.astype(np.float16).astype(np.float32)


def find_copies(values: list[int], least: int = 3, window: int = 1 << 20, chain: int = 48) -> list[tuple]:
    """Literals ("lit", value) and copies ("copy", length, distance), greedily, by chains of earlier triples."""
    seen: dict[tuple, list[int]] = {}
    out, i, n = [], 0, len(values)

    def remember(at: int) -> None:
        if at + least <= n:
            seen.setdefault(tuple(values[at : at + least]), []).append(at)

    while i < n:
        best, where = 0, 0
        for j in reversed(seen.get(tuple(values[i : i + least]), [])[-chain:]):
            if i - j > window:
                break
            k = least
            while i + k < n and values[j + k] == values[i + k]:
                k += 1
            if k > best:
                best, where = k, j
        if best >= least:
            out.append(("copy", best, i - where))
            for at in range(i, i + best):
                remember(at)
            i += best
        else:
            out.append(("lit", values[i]))
            remember(i)
            i += 1
    return out


def undo_copies(items: list[tuple]) -> list[int]:
    out: list[int] = []
    for kind, a, *rest in items:
        if kind == "lit":
            out.append(a)
        else:
            for _ in range(a):
                out.append(out[-rest[0]])
    return out
