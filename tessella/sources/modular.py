"""Lossless JPEG XL images: groups, trees, adaptive distributions, predictors and transforms.

Written: 8 to 16 bits, one or three channels, with a colour transform, a palette or
(in one group) squeezes, and one predictor.  Read: such streams with any tree,
predictor and transforms, and range-coded distributions.  Prefix codes, copies,
palette deltas, several passes and squeezes over several groups are refused by name.
"""

from __future__ import annotations

import numpy as np

from tessella.functions.blocks import WeightedPredictor
from tessella.functions.colour import RCT_ORDERS
from tessella.sources import jpegxl
from tessella.sources.jpegxl import Bits

# The coder's precision and first state, the code of the counts' logarithms as (bits, length), the integer code written.
PRECISION, START = 12, 0x130000
LOG_CODES = ((17, 5), (11, 4), (15, 4), (3, 4), (9, 4), (7, 4), (4, 3), (2, 3), (5, 3), (6, 3), (0, 3), (33, 6), (1, 7), (65, 7))
_LOG_OF = {(n, v): s for s, (v, n) in enumerate(LOG_CODES)}
SPLIT = (4, 2, 0)
ALPHABET = 8


class Unsupported(ValueError):
    """A feature that is recognised but not decoded."""


def _short(b: Bits, value: int = 0) -> int:
    """0..255: a flag for 0, else the size in three bits and the rest."""
    if not b.flag(value > 0):
        return 0
    n = b.u(3, max(value, 1).bit_length() - 1)
    return (1 << n) + b.u(n, value - (1 << n) if not b.reading else 0)


def _at_most(b: Bits, top: int, value: int = 0) -> int:
    v = b.u(top.bit_length(), value) if top else 0
    if v > top:
        raise ValueError("a value past its limit")
    return v


def integer_code(b: Bits, log_size: int, value: tuple[int, int, int] = SPLIT) -> tuple[int, int, int]:
    split = _at_most(b, log_size, value[0])
    if split == log_size:
        return split, 0, 0
    msb = _at_most(b, split, value[1])
    return split, msb, _at_most(b, split - msb, value[2])


def to_token(v: int, code: tuple[int, int, int]) -> tuple[int, int, int]:
    """(token, number of raw bits, raw bits)."""
    split, msb, lsb = code
    if v < 1 << split:
        return v, 0, 0
    n = v.bit_length() - 1 - msb - lsb
    top = v >> (n + lsb) & ((1 << msb) - 1)
    token = (1 << split) + ((n - split + msb + lsb << msb | top) << lsb | v & ((1 << lsb) - 1))
    return token, n, v >> lsb & ((1 << n) - 1)


def from_token(b: Bits, token: int, code: tuple[int, int, int]) -> int:
    split, msb, lsb = code
    if token < 1 << split:
        return token
    over = token - (1 << split)
    n = split - msb - lsb + (over >> msb + lsb)
    if n > 32:
        raise ValueError("an integer that is too wide")
    top = (1 << msb) | over >> lsb & ((1 << msb) - 1)
    return (top << n | b.u(n)) << lsb | token & ((1 << lsb) - 1)


class Slots:
    """Where each of the 4096 states leads: buckets of equal size, each shared by at most two symbols."""

    def __init__(self, counts: list[int], log_size: int):
        self.counts, self.shift = counts, PRECISION - log_size
        size = 1 << self.shift
        alone = [i for i, c in enumerate(counts) if c]
        if len(alone) == 1:
            self.cut, self.other, self.offset = [0] * len(counts), [alone[0]] * len(counts), [i << self.shift for i in range(len(counts))]
            return
        self.cut, self.other, self.offset = list(counts), list(range(len(counts))), [0] * len(counts)
        full = [i for i, c in enumerate(counts) if c > size]
        open_ = [i for i, c in enumerate(counts) if c < size]
        while full:
            if not open_:
                raise ValueError("counts that do not sum up")
            big, small = full[-1], open_.pop()
            self.cut[big] -= size - self.cut[small]
            self.other[small], self.offset[small] = big, self.cut[big] - self.cut[small]
            if self.cut[big] <= size:
                full.pop()
                if self.cut[big] < size:
                    open_.append(big)

    def at(self, place: int) -> tuple[int, int]:
        """(symbol, rank among its states)."""
        i, k = place >> self.shift, place & ((1 << self.shift) - 1)
        return (i, k) if k < self.cut[i] else (self.other[i], self.offset[i] + k)

    def places(self) -> list[list[int]]:
        """For each symbol, the state of each rank."""
        out = [[0] * c for c in self.counts]
        for place in range(1 << PRECISION):
            s, k = self.at(place)
            out[s][k] = place
        return out


def normalise(histogram: list[int], size: int) -> list[int]:
    """Counts that sum to 4096, none of a used symbol 0."""
    total = sum(histogram)
    if not total:
        return [1 << PRECISION] + [0] * (size - 1)
    counts = [max(1, round(n * (1 << PRECISION) / total)) if n else 0 for n in histogram] + [0] * (size - len(histogram))
    while (over := sum(counts) - (1 << PRECISION)) != 0:
        i = max(range(size), key=lambda k: counts[k])
        counts[i] -= over if counts[i] > over else counts[i] - 1
    return counts


def distribution(b: Bits, size: int, counts: list[int] | None = None) -> list[int]:
    """Counts of a distribution: one symbol, two, even, or a list of logarithms with extra bits."""
    used = [i for i, c in enumerate(counts or []) if c]
    kind = b.u(2, {1: 1, 2: 3}.get(len(used), 0))
    out = [0] * size
    if kind == 1:
        out[_short(b, used[0] if used else 0)] = 1 << PRECISION
        return out
    if kind == 3:
        x, y = _short(b, used[0] if used else 0), _short(b, used[1] if used else 0)
        out[x] = b.u(PRECISION, counts[x] if counts else 0)
        out[y] = (1 << PRECISION) - out[x]
        return out
    if kind == 2:
        n = _short(b) + 1
        return [(1 << PRECISION) // n + (i < (1 << PRECISION) % n) if i < n else 0 for i in range(size)]
    length = 0
    while length < 3 and b.flag(True):
        length += 1
    shift = b.u(length, 13 + 1 - (1 << length) if not b.reading else 0) + (1 << length) - 1
    n = _short(b, max(0, (used[-1] + 1 if used else 3) - 3)) + 3
    logs: list[int] = []
    repeats: dict[int, int] = {}
    while len(logs) < n:
        if not b.reading:
            c = counts[len(logs)]
            code = c.bit_length() if c else 0
            b.u(LOG_CODES[code][1], LOG_CODES[code][0])
        else:
            v, bits = 0, 0
            while (bits, v) not in _LOG_OF:
                v |= b.u(1) << bits
                bits += 1
                if bits > 7:
                    raise ValueError("a broken count")
            code = _LOG_OF[bits, v]
        if code == 13:
            k = _short(b) + 4
            repeats[len(logs)] = k
            logs += [-1] * k
        else:
            logs.append(code)
    biggest = max(logs)
    left_out = logs.index(biggest)
    i = 0
    while i < min(len(logs), size):
        if i in repeats:
            if i and i - 1 == left_out:
                raise ValueError("a repeat of the count that is left out")
            for k in range(i, min(i + repeats[i], size)):
                out[k] = out[i - 1] if i else 0
            i += repeats[i]
            continue
        code = logs[i]
        if i != left_out:
            if code < 2:
                out[i] = code
            else:
                c = code - 1
                bits = min(max(0, shift - (PRECISION - c >> 1)), c)
                given = (counts[i] - (1 << c)) >> (c - bits) if counts else 0
                out[i] = (1 << c) + (b.u(bits, given) << (c - bits))
        i += 1
    out[left_out] = (1 << PRECISION) - sum(out)
    if out[left_out] < 0:
        raise ValueError("counts that sum to too much")
    return out


class Code:
    """The entropy code of a stream: contexts, clusters, integer codes and distributions."""

    def __init__(self, clusters: list[int], integers: list[tuple[int, int, int]], counts: list[list[int]], log_size: int):
        self.clusters, self.integers = clusters, integers
        self.slots = [Slots(c, log_size) for c in counts]

    @classmethod
    def read(cls, b: Bits, contexts: int) -> Code:
        if b.flag():
            raise Unsupported("copies of earlier symbols")
        clusters = cls._clusters(b, contexts)
        n = max(clusters) + 1
        if b.flag():
            raise Unsupported("prefix codes")
        log_size = 5 + b.u(2)
        integers = [integer_code(b, log_size) for _ in range(n)]
        return cls(clusters, integers, [distribution(b, 1 << log_size) for _ in range(n)], log_size)

    @classmethod
    def _clusters(cls, b: Bits, contexts: int) -> list[int]:
        if contexts == 1:
            return [0]
        if b.flag():
            n = b.u(2)
            return [b.u(n) for _ in range(contexts)]
        front = b.flag()
        reader = Symbols(b, cls.read(b, 1))
        out = [reader.get(0) for _ in range(contexts)]
        reader.finish()
        if front:
            from tessella.functions.kernels import undo_move_to_front

            out = undo_move_to_front(out)
        return out

    @classmethod
    def fit(cls, b: Bits, contexts: int, symbols: list[tuple[int, int]]) -> Code:
        """Fit a code to (context, value) symbols, one cluster a context, and write it."""
        if contexts > 8:
            raise ValueError("more contexts than are written")
        size = 1 << ALPHABET
        histograms = [[0] * size for _ in range(contexts)]
        for ctx, v in symbols:
            histograms[ctx][to_token(v, SPLIT)[0]] += 1
        counts = [normalise(h, size) for h in histograms]
        b.flag(False)
        if contexts > 1:
            b.flag(True)
            b.u(2, 3)
            for i in range(contexts):
                b.u(3, i)
        b.flag(False)
        b.u(2, ALPHABET - 5)
        for _ in range(contexts):
            integer_code(b, ALPHABET)
        counts = [distribution(b, size, c) for c in counts]
        return cls(list(range(contexts)), [SPLIT] * contexts, counts, ALPHABET)

    def write(self, b: Bits, symbols: list[tuple[int, int]]) -> None:
        """The symbols, coded from the last to the first and put in reading order."""
        places = [s.places() for s in self.slots]
        state, parts = START, []
        for ctx, v in reversed(symbols):
            k = self.clusters[ctx]
            token, n, raw = to_token(v, self.integers[k])
            f = self.slots[k].counts[token]
            parts.append((n, raw))
            if state >= f << 20:
                parts.append((16, state & 0xFFFF))
                state >>= 16
            state = (state // f << PRECISION) + places[k][token][state % f]
        b.u(32, state)
        for n, v in reversed(parts):
            b.u(n, v)


class Symbols:
    """A reader of one stream's symbols."""

    def __init__(self, b: Bits, code: Code):
        self.b, self.code, self.state = b, code, None

    def get(self, ctx: int) -> int:
        b, k = self.b, self.code.clusters[ctx]
        if self.state is None:
            self.state = b.u(32)
        s = self.state
        slots = self.code.slots[k]
        token, rank = slots.at(s & 0xFFF)
        s = slots.counts[token] * (s >> PRECISION) + rank
        self.state = s << 16 | b.u(16) if s < 1 << 16 else s
        return from_token(b, token, self.code.integers[k])

    def finish(self) -> None:
        if (self.b.u(32) if self.state is None else self.state) != START:
            raise ValueError("the stream does not end in the coder's first state")


def pack(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def unpack(u: int) -> int:
    return u >> 1 ^ -(u & 1)


def read_tree(b: Bits, most: int) -> tuple[list[tuple], int]:
    """Nodes in breadth-first order: (property, split, left, right) or (None, context, predictor, offset, multiplier)."""
    reader = Symbols(b, Code.read(b, 6))
    nodes, waiting, leaves = [], 1, 0
    while waiting:
        waiting -= 1
        if len(nodes) >= most:
            raise ValueError("too many tree nodes")
        p = reader.get(1)
        if p:
            at = len(nodes)
            nodes.append((p - 1, unpack(reader.get(0)), at + waiting + 1, at + waiting + 2))
            waiting += 2
        else:
            predictor, offset = reader.get(2), unpack(reader.get(3))
            shift = reader.get(4)
            nodes.append((None, leaves, predictor, offset, reader.get(5) + 1 << shift))
            leaves += 1
    reader.finish()
    return nodes, leaves


def channel_tree(channels: int, predictor: int = 5) -> list[tuple[int, int]]:
    """Symbols (context, value) of a tree that has one leaf a channel, the last channel's first."""
    out = []
    leaf = [(1, 0), (2, predictor), (3, 0), (4, 0), (5, 0)]
    for c in range(channels - 1, 0, -1):
        out += [(1, 1), (0, pack(c - 1)), *leaf]  # property 0 is the channel: above c - 1 to the left
    return out + leaf


def _neighbours(px, x: int, y: int, w: int):
    """W, N, NW, NE, NN, NEE, WW with the edge rules."""
    row, up = px[y], px[y - 1] if y else None
    west = row[x - 1] if x else up[x] if y else 0
    north = up[x] if y else west
    nw = up[x - 1] if x and y else west
    ne = up[x + 1] if y and x + 1 < w else north
    return west, north, nw, ne, px[y - 2][x] if y > 1 else north, up[x + 2] if y and x + 2 < w else ne, row[x - 2] if x > 1 else west


def _cut(a: int, n: int) -> int:
    return -(-a // n) if a < 0 else a // n


def _predict(k: int, west: int, north: int, nw: int, ne: int, nn: int, nee: int, ww: int) -> int:
    match k:
        case 0:
            return 0
        case 1:
            return west
        case 2:
            return north
        case 3:
            return _cut(west + north, 2)
        case 4:
            return west if abs(north - nw) < abs(west - nw) else north
        case 5:
            low, high = min(west, north), max(west, north)
            return high if nw < low else low if nw > high else west + north - nw
        case 7:
            return ne
        case 8:
            return nw
        case 9:
            return ww
        case 10:
            return _cut(west + nw, 2)
        case 11:
            return _cut(north + nw, 2)
        case 12:
            return _cut(north + ne, 2)
        case 13:
            return _cut(6 * north - 2 * nn + 7 * west + ww + nee + 3 * ne + 8, 16)
    raise Unsupported(f"predictor {k}")


def _property(p: int, channel: int, stream: int, x: int, y: int, px, near, earlier, wp) -> int:
    west, north, nw, ne, nn, _, ww = near
    if p < 4:
        return (channel, stream, y, x)[p]
    if p < 8:
        return (abs(north), abs(west), north, west)[p - 4]
    if p == 8:
        if not x:
            return west
        a, b, c, *_ = _neighbours(px, x - 1, y, len(px[0]))
        return west - (a + b - c)
    if p < 15:
        return (west + north - nw, west - nw, nw - north, north - ne, north - nn, west - ww)[p - 9]
    if p == 15:
        return wp.largest
    k = (p - 16) >> 2
    if k >= len(earlier):
        return 0
    other = earlier[k]
    v = other[y][x]
    if p & 2:
        # edges of the other channel count as 0 here, and neighbours fall back on the west
        left = other[y][x - 1] if x else 0
        up = other[y - 1][x] if y else left
        corner = other[y - 1][x - 1] if x and y else left
        v -= _predict(5, left, up, corner, 0, 0, 0, 0)
    return v if p & 1 else abs(v)


def _forward_rct(kind: int, planes: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c = (planes[i] for i in RCT_ORDERS[kind // 7])
    if kind % 7 != 6:
        raise ValueError("only type 6 of each order is written")
    co = a - c
    t = c + (co >> 1)
    cg = b - t
    return [t + (cg >> 1), co, cg]


def _inverse_rct(kind: int, coded: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c = coded
    k = kind % 7
    if k == 6:
        t = a - (c >> 1)
        blue = t - (b >> 1)
        out = [b + blue, c + t, blue]
    else:
        third = c + a if k in (1, 3, 5) else c
        second = {2: b + a, 3: b + a, 4: b + ((a + third) >> 1), 5: b + a + (c >> 1)}.get(k, b)
        out = [a, second, third]
    back = list(out)
    for plane, at in zip(out, RCT_ORDERS[kind // 7], strict=True):
        back[at] = plane
    return back


_CHANNEL = ((0, 3), (8, 6), (72, 10), (1096, 13))


def default_squeezes(shapes: list[tuple[int, int]], meta: int) -> list[tuple[bool, bool, int, int]]:
    """(horizontal, in place, first channel, channels): chroma once each way, then alternately until nothing is above eight."""
    n, (w, h) = len(shapes) - meta, shapes[meta]
    out = []
    if n > 2 and shapes[meta + 1] == (w, h):
        out += [(True, False, meta + 1, 2), (False, False, meta + 1, 2)]
    tall = w <= h
    while w > 8 or h > 8:
        if w > 8 and not tall:
            out.append((True, True, meta, n))
            w = (w + 1) // 2
        tall = False
        if h > 8:
            out.append((False, True, meta, n))
            h = (h + 1) // 2
    return out


class Layout:
    """Channel shapes as transforms change them, how to undo these, and, writing, the channels themselves."""

    def __init__(self, shapes: list[tuple[int, int]], bits: int, planes: list[np.ndarray] | None = None):
        self.shapes, self.bits, self.planes, self.meta = list(shapes), bits, planes, 0
        self.undo: list = []

    def rct(self, begin: int, kind: int) -> None:
        if self.planes is not None:
            self.planes[begin : begin + 3] = _forward_rct(kind, self.planes[begin : begin + 3])

        def back(planes):
            planes[begin : begin + 3] = _inverse_rct(kind, planes[begin : begin + 3])

        self.undo.append(back)

    def palette(self, begin: int, n: int, colours: int) -> None:
        from tessella.functions.kernels import palette_colours

        self.shapes = [(colours, n), *self.shapes[: begin + 1], *self.shapes[begin + n :]]
        self.meta = self.meta + 1 if begin >= self.meta else self.meta + 2 - n

        def back(planes):
            explicit, index = planes.pop(0), planes[begin]
            if (index < 0).any():
                raise Unsupported("palette deltas")
            index = np.minimum(index, colours - 1) if n == 1 else index
            planes[begin : begin + 1] = list(palette_colours(index, explicit, self.bits))

        self.undo.append(back)

    def squeeze(self, horizontal: bool, in_place: bool, begin: int, n: int) -> None:
        from tessella.functions.blocks import squeeze, unsqueeze

        turn = (lambda p: p) if horizontal else np.transpose
        at = begin + n if in_place else len(self.shapes)
        rest = []
        for k in range(begin, begin + n):
            w, h = self.shapes[k]
            self.shapes[k] = ((w + 1) // 2, h) if horizontal else (w, (h + 1) // 2)
            rest.append((w // 2, h) if horizontal else (w, h // 2))
        self.shapes[at:at] = rest
        if begin < self.meta:
            self.meta += n
        if self.planes is not None:
            both = [squeeze(turn(p)) for p in self.planes[begin : begin + n]]
            self.planes[begin : begin + n] = [turn(a) for a, _ in both]
            self.planes[at:at] = [turn(r) for _, r in both]

        def back(planes):
            rest = planes[at : at + n]
            del planes[at : at + n]
            for k in range(n):
                planes[begin + k] = turn(unsqueeze(turn(planes[begin + k]), turn(rest[k])))

        self.undo.append(back)

    def restore(self, planes: list[np.ndarray]) -> list[np.ndarray]:
        for back in reversed(self.undo):
            back(planes)
        return planes


def transforms(b: Bits, layout: Layout, wanted: list[tuple] = ()) -> None:
    """The list of transforms: ("rct", begin, type), ("palette", begin, channels, colours) or ("squeeze",), read or written."""
    for i in range(b.choice(((0, 0), (1, 0), (2, 4), (18, 8)), len(wanted))):
        name, *args = wanted[i] if wanted else (None,)
        kind = b.u(2, ("rct", "palette", "squeeze").index(name) if name else 0)
        if kind == 0:
            layout.rct(b.choice(_CHANNEL, args[0] if args else 0), b.choice(((6, 0), (0, 2), (2, 4), (10, 6)), args[1] if args else 0))
        elif kind == 1:
            begin, n = b.choice(_CHANNEL, args[0] if args else 0), b.choice(((1, 0), (3, 0), (4, 0), (1, 13)), args[1] if args else 1)
            colours = b.choice(((0, 8), (256, 10), (1280, 12), (5376, 16)), args[2] if args else 0)
            if b.choice(((0, 0), (1, 8), (257, 10), (1281, 16))):
                raise Unsupported("palette deltas")
            b.u(4)
            layout.palette(begin, n, colours)
        elif kind == 2:
            steps = b.choice(((0, 0), (1, 4), (9, 6), (41, 8)))
            plan = [(b.flag(), b.flag(), b.choice(_CHANNEL), b.choice(((1, 0), (2, 0), (3, 0), (4, 4)))) for _ in range(steps)]
            for step in plan or default_squeezes(layout.shapes, layout.meta):
                layout.squeeze(*step)
        else:
            raise ValueError("an unknown transform")


def find_palette(planes: list[np.ndarray], most: int = 1024) -> tuple[np.ndarray, np.ndarray] | None:
    """(colours as channels x count, index plane) sorted by brightness; None for too many or too few colours."""
    flat = np.stack([p.ravel() for p in planes])
    colours, index = np.unique(flat, axis=1, return_inverse=True)
    n = colours.shape[1]
    if not 2 <= n <= most or 4 * n >= flat.shape[1]:
        return None
    weight = np.array([3, 6, 1][: len(planes)] if len(planes) > 1 else [1])
    order = np.argsort(weight @ colours[: len(weight)], kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return colours[:, order], place[index].reshape(planes[0].shape)


#: Streams of other kinds that come before the groups' in the numbering of streams.
_TABLES = 17


def _symbols(plane: np.ndarray, ctx: int, predictor: int) -> list[tuple[int, int]]:
    px, (h, w) = plane.tolist(), plane.shape
    wp, out = WeightedPredictor(w) if predictor == 6 else None, []
    for y in range(h):
        for x in range(w):
            near = _neighbours(px, x, y, w)
            guess = wp.predict(x, y, *near[:5]) if wp else _predict(predictor, *near)
            out.append((ctx, pack(px[y][x] - guess)))
            if wp:
                wp.learn(px[y][x])
    return out


def _global_channels(layout: Layout, dim: int) -> int:
    """How many channels the frame's own stream holds: those of transforms, then the first that fit a group."""
    n = 0
    for i, (w, h) in enumerate(layout.shapes):
        if i >= layout.meta and max(w, h) > dim:
            break
        n += 1
    return n


def _groups(w: int, h: int, dim: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(0, h, dim) for x in range(0, w, dim)]


def encode(planes: list[np.ndarray], bits: int = 8, predictor: int = 5, use_palette: bool = True, squeeze: bool = False, group_shift: int = 10) -> bytes:
    """A lossless codestream of one or three planes; a palette is used where one is found."""
    h, w = planes[0].shape
    if len(planes) not in (1, 3):
        raise ValueError("one or three planes are written")
    n, wanted, dim = len(planes), [], 1 << group_shift
    several = max(w, h) > dim
    if several and squeeze:
        raise ValueError("squeezes are written in one group")
    layout = Layout([(w, h)] * n, bits, [p.astype(np.int64) for p in planes])
    found = find_palette(planes) if use_palette and not squeeze else None
    if found:
        wanted = [("palette", 0, n, found[0].shape[1])]
    else:
        wanted = [("rct", 0, 6)] * (n == 3) + [("squeeze",)] * squeeze
    tail = Bits()  # what follows the code: flags and transforms
    tail.flag(True)  # the global tree is used
    tail.flag(True)  # default predictor parameters
    transforms(tail, layout, wanted)
    coded = [np.atleast_2d(found[0]), found[1]] if found else layout.planes
    own = _global_channels(layout, dim) if several else len(coded)
    leaves = len(coded) if len(coded) <= 8 else 1
    ctx = lambda c: leaves - 1 - c if leaves > 1 else 0  # noqa: E731  leaves are numbered as they come: the last channel first
    streams = [[s for c, p in enumerate(coded[:own]) for s in _symbols(p, ctx(c), predictor)]]
    if several:
        streams += [[s for c, p in enumerate(coded[own:]) for s in _symbols(p[y : y + dim, x : x + dim], ctx(c), predictor)] for x, y in _groups(w, h, dim)]
    b = Bits()
    b.flag(True)  # default low-frequency steps
    b.flag(True)  # a tree follows
    tree = channel_tree(leaves, predictor)
    Code.fit(b, 6, tree).write(b, tree)
    code = Code.fit(b, leaves, [s for stream in streams for s in stream])
    for i in range(tail.at):
        b.u(1, tail.bytes()[i >> 3] >> (i & 7) & 1)
    code.write(b, streams[0])
    b.align()
    sections = [b.bytes()]
    if several:
        sections += [b""] * (1 + -(-w // (8 * dim)) * -(-h // (8 * dim)))  # nothing in the coarse groups and between
        for stream in streams[1:]:
            b = Bits()
            b.flag(True)
            b.flag(True)
            transforms(b, Layout([], bits))
            code.write(b, stream)
            b.align()
            sections.append(b.bytes())
    meta = {"depth": {"bits": bits, "exponent": 0}, "xyb": False, "colour": {} if n == 3 else {"space": "grey"}}
    return jpegxl.write_headers(w, h, meta, {"modular": True, "group_shift": group_shift, "filter": {"gab": False, "epf": 0}}, [len(s) for s in sections]) + b"".join(sections)


def _channels(b: Bits, tree: list[tuple], code: Code, shapes: list[tuple[int, int]], stream: int) -> list[np.ndarray]:
    """The channels of one stream."""
    corrects = any(n[0] == 15 or n[0] is None and n[2] == 6 for n in tree)
    reader, out = Symbols(b, code), []
    for c, (w, h) in enumerate(shapes):
        px = [[0] * w for _ in range(h)]
        earlier = [p for p in reversed(out) if len(p) == h and h and len(p[0]) == w]
        wp = WeightedPredictor(w) if corrects else None
        for y in range(h):
            for x in range(w):
                near = _neighbours(px, x, y, w)
                guess = wp.predict(x, y, *near[:5]) if wp else 0
                node = tree[0]
                while node[0] is not None:
                    node = tree[node[2] if _property(node[0], c, stream, x, y, px, near, earlier, wp) > node[1] else node[3]]
                _, ctx, predictor, offset, times = node
                px[y][x] = unpack(reader.get(ctx)) * times + offset + (guess if predictor == 6 else _predict(predictor, *near))
                if wp:
                    wp.learn(px[y][x])
        out.append(px)
    reader.finish()
    return [np.array(p, np.int64).reshape(h, w) for p, (w, h) in zip(out, shapes, strict=True)]


def _stream(b: Bits, layout: Layout, tree, code, most: int):
    """The header of a stream: its tree and code, with its transforms taken into ``layout``."""
    own = not b.flag()
    if not b.flag():
        raise Unsupported("other parameters of the self-correcting predictor")
    transforms(b, layout)
    if own:
        tree, leaves = read_tree(b, most)
        code = Code.read(b, leaves)
    if tree is None:
        raise ValueError("no tree")
    return tree, code


def decode(data: bytes, region: tuple[int, int, int, int] | None = None) -> list[np.ndarray]:
    """Planes of a lossless image; of several groups, only those that ``region`` (x0, y0, x1, y1) touches are decoded."""
    head = jpegxl.read_headers(data)
    if "frame" not in head:
        raise Unsupported("a profile or a preview before the frame")
    f, g, meta = head["frame"], head["geometry"], head["metadata"]
    if not f["modular"] or meta["xyb"] or f["flags"] or f["passes"]["n"] != 1 or f["upsampling"] != 1 or meta["depth"]["exponent"] or any(e["shift"] for e in meta["extra"]):
        raise Unsupported("lossy, composed, float, subsampled or progressive images")
    w, h, dim = f["width"], f["height"], g["group"]
    x0, y0, x1, y1 = region or (0, 0, w, h)
    channels = (1 if meta["colour"]["space"] == "grey" else 3) + len(meta["extra"])
    sections = [(head["body"] + at, n) for at, n in head["sections"]]
    b = Bits(data)
    b.at = 8 * sections[0][0]
    if not b.flag():
        for _ in range(3):
            b.f16()
    most = min(1 << 22, 1024 + w * h * channels // 16)
    tree = code = None
    if b.flag():
        tree, leaves = read_tree(b, most)
        code = Code.read(b, leaves)
    layout = Layout([(w, h)] * channels, meta["depth"]["bits"])
    own_tree, own_code = _stream(b, layout, tree, code, most)
    several = g["sections"] > 1
    own = _global_channels(layout, dim) if several else len(layout.shapes)
    planes = _channels(b, own_tree, own_code, layout.shapes[:own], 0)
    rest = layout.shapes[own:]
    if any(s != (w, h) for s in rest):
        raise Unsupported("squeezes over several groups")
    planes += [np.zeros((h, w), np.int64) for _ in rest]
    for i, (gx, gy) in enumerate(_groups(w, h, dim) if rest else []):
        if gx >= x1 or gy >= y1 or gx + dim <= x0 or gy + dim <= y0:
            continue
        at, _ = sections[2 + g["coarse"] + i]
        b = Bits(data)
        b.at = 8 * at
        size = (min(dim, w - gx), min(dim, h - gy))
        local = Layout([size] * len(rest), meta["depth"]["bits"])
        its_tree, its_code = _stream(b, local, tree, code, most)
        got = local.restore(_channels(b, its_tree, its_code, local.shapes, 1 + 3 * g["coarse"] + _TABLES + i))
        for p, part in zip(planes[own:], got, strict=True):
            p[gy : gy + size[1], gx : gx + size[0]] = part
    planes = layout.restore(planes)
    return planes if region is None else [p[y0:y1, x0:x1] for p in planes]
