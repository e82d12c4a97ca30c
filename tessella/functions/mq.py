"""The adaptive binary arithmetic coder of JPEG 2000 and its code-block passes."""

from __future__ import annotations

# Fixed values of ISO/IEC 15444-1, table C.2: (Qe, next if more probable, next if less probable, switch).
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0),
    (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0),
    (0x2401, 23, 20, 0), (0x2201, 24, 21, 0), (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0),
    (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
SIGN, REFINE, RUN, UNIFORM = 9, 14, 17, 18


# Code-block styles.
RESET, CAUSAL, SEGMENT_MARKS = 0x02, 0x08, 0x20


class _Contexts:
    def __init__(self):
        self.restart()

    def restart(self) -> None:
        self.state = [0] * 19
        self.state[0], self.state[RUN], self.state[UNIFORM] = 4, 3, 46
        self.mps = [0] * 19


class Encoder(_Contexts):
    def __init__(self):
        super().__init__()
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray(1)

    def put(self, cx: int, bit: int) -> None:
        qe, more, less, switch = STATES[self.state[cx]]
        self.a -= qe
        if bit == self.mps[cx]:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            self.state[cx] = more
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            self.mps[cx] ^= switch
            self.state[cx] = less
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()
            if self.a & 0x8000:
                break

    def _byte(self) -> None:
        out = self.out
        if out[-1] != 0xFF and self.c >= 0x8000000:
            out[-1] += 1
            self.c &= 0x7FFFFFF
        if out[-1] == 0xFF:
            out.append(self.c >> 20 & 0xFF)
            self.c &= 0xFFFFF
            self.ct = 7
        else:
            out.append(self.c >> 19 & 0xFF)
            self.c &= 0x7FFFF
            self.ct = 8

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        return bytes(self.out[1:-1] if self.out[-1] == 0xFF else self.out[1:])


class Decoder(_Contexts):
    def __init__(self, data: bytes):
        super().__init__()
        self.data, self.at = data, 0
        self.c = (data[0] if data else 0xFF) << 16
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        data, at = self.data, self.at
        now = data[at] if at < len(data) else 0xFF
        after = data[at + 1] if at + 1 < len(data) else 0xFF
        if now == 0xFF:
            if after > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += after << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += after << 8
            self.ct = 8

    def get(self, cx: int) -> int:
        qe, more, less, switch = STATES[self.state[cx]]
        self.a -= qe
        bit = self.mps[cx]
        if self.c >> 16 < qe:
            likely = self.a < qe
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return bit
            likely = self.a >= qe
        if likely:
            self.state[cx] = more
        else:
            bit ^= 1
            self.mps[cx] ^= switch
            self.state[cx] = less
        while True:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return bit


def _zero_context(band: str):
    """Context of a coefficient's significance, by its horizontal, vertical and diagonal neighbours."""

    def plain(h, v, d):
        if h == 2:
            return 8
        if h == 1:
            return 7 if v else 6 if d else 5
        return 4 if v == 2 else 3 if v == 1 else min(d, 2)

    def diagonal(h, v, d):
        n = h + v
        if d >= 3:
            return 8
        if d == 2:
            return 7 if n else 6
        return 3 + min(n, 2) if d else min(n, 2)

    rule = diagonal if band == "HH" else (lambda h, v, d: plain(v, h, d)) if band == "HL" else plain
    return [[[rule(h, v, d) for d in range(5)] for v in range(3)] for h in range(3)]


ZERO = {b: _zero_context(b) for b in ("LL", "LH", "HL", "HH")}
#: (context, flip) by the clamped sums of horizontal and vertical signs.
SIGNS = {(1, 1): (13, 0), (1, 0): (12, 0), (1, -1): (11, 0), (0, 1): (10, 0), (0, 0): (9, 0), (0, -1): (10, 1), (-1, 1): (11, 1), (-1, 0): (12, 1), (-1, -1): (13, 1)}


class _Passes:
    """The three passes over a code block; ``bit(cx, p)`` codes or decodes one decision for position p."""

    def __init__(self, w: int, h: int, band: str, style: int = 0):
        self.w, self.h, self.s, self.style = w, h, w + 2, style
        n = self.s * (h + 2)
        self.sig, self.sign, self.seen, self.done = [0] * n, [0] * n, [0] * n, [0] * n
        self.zero = ZERO[band]

    def _around(self, p: int) -> tuple[int, int, int]:
        s, g = self.s, self.sig
        if self.style & CAUSAL and (p // s - 1) % 4 == 3:  # the next stripe is not looked at
            return g[p - 1] + g[p + 1], g[p - s], g[p - s - 1] + g[p - s + 1]
        return g[p - 1] + g[p + 1], g[p - s] + g[p + s], g[p - s - 1] + g[p - s + 1] + g[p + s - 1] + g[p + s + 1]

    def _signs(self, p: int) -> tuple[int, int]:
        s, g, m = self.s, self.sig, self.sign
        one = lambda q: g[q] * (1 - 2 * m[q])
        below = 0 if self.style & CAUSAL and (p // s - 1) % 4 == 3 else one(p + s)
        h, v = one(p - 1) + one(p + 1), one(p - s) + below
        return SIGNS[max(-1, min(1, h)), max(-1, min(1, v))]

    def stripes(self):
        for y in range(0, self.h, 4):
            for x in range(self.w):
                yield [(y + k + 1) * self.s + x + 1 for k in range(min(4, self.h - y))]

    def significance(self, plane: int) -> None:
        for column in self.stripes():
            for p in column:
                if not self.sig[p]:
                    h, v, d = self._around(p)
                    if h + v + d:
                        self.seen[p] = 1
                        if self.bit(self.zero[h][v][d], p, plane):
                            self.new(p, plane)

    def refinement(self, plane: int) -> None:
        for column in self.stripes():
            for p in column:
                if self.sig[p] and not self.seen[p]:
                    cx = 16 if self.done[p] else 15 if sum(self._around(p)) else 14
                    self.done[p] = 1
                    self.refine(cx, p, plane)

    def cleanup(self, plane: int) -> None:
        for column in self.stripes():
            at = 0
            if len(column) == 4 and not any(self.sig[p] or self.seen[p] or sum(self._around(p)) for p in column):
                at = self.run(column, plane)
                if at == 4:
                    continue
                self.new(column[at], plane)
                at += 1
            for p in column[at:]:
                if not self.sig[p] and not self.seen[p]:
                    h, v, d = self._around(p)
                    if self.bit(self.zero[h][v][d], p, plane):
                        self.new(p, plane)
        self.seen = [0] * len(self.seen)

    def all(self, planes: int, passes: int) -> None:
        for i in range(passes):
            plane = planes - 1 - (i + 2) // 3
            (self.cleanup, self.significance, self.refinement)[i % 3](plane)
            if self.style & SEGMENT_MARKS and i % 3 == 0:
                self.mark()
            if self.style & RESET:
                self.mq.restart()


class BlockEncoder(_Passes):
    def __init__(self, values, band: str, style: int = 0):
        h, w = values.shape
        super().__init__(w, h, band, style)
        self.mq, self.mag = Encoder(), [0] * len(self.sig)
        for y, row in enumerate(values.tolist()):
            for x, v in enumerate(row):
                p = (y + 1) * self.s + x + 1
                self.mag[p] = abs(v)
                self.sign[p] = int(v < 0)
        self.planes = max(self.mag).bit_length()

    def bit(self, cx, p, plane):
        b = self.mag[p] >> plane & 1
        self.mq.put(cx, b)
        return b

    def refine(self, cx, p, plane):
        self.mq.put(cx, self.mag[p] >> plane & 1)

    def new(self, p, plane):
        cx, flip = self._signs(p)
        self.mq.put(cx, self.sign[p] ^ flip)
        self.sig[p] = 1

    def run(self, column, plane):
        at = next((i for i, p in enumerate(column) if self.mag[p] >> plane & 1), 4)
        self.mq.put(RUN, int(at < 4))
        if at < 4:
            self.mq.put(UNIFORM, at >> 1)
            self.mq.put(UNIFORM, at & 1)
        return at

    def mark(self):
        for b in (1, 0, 1, 0):
            self.mq.put(UNIFORM, b)

    def encode(self) -> tuple[int, int, bytes]:
        """(bit planes, passes, bytes)."""
        if not self.planes:
            return 0, 0, b""
        passes = 3 * self.planes - 2
        self.all(self.planes, passes)
        return self.planes, passes, self.mq.finish()


class BlockDecoder(_Passes):
    def __init__(self, data: bytes, w: int, h: int, band: str, style: int = 0):
        super().__init__(w, h, band, style)
        self.mq, self.mag = Decoder(data), [0] * len(self.sig)

    def bit(self, cx, p, plane):
        return self.mq.get(cx)

    def refine(self, cx, p, plane):
        self.mag[p] |= self.mq.get(cx) << plane

    def new(self, p, plane):
        cx, flip = self._signs(p)
        self.sign[p] = self.mq.get(cx) ^ flip
        self.sig[p] = 1
        self.mag[p] |= 1 << plane

    def run(self, column, plane):
        if not self.mq.get(RUN):
            return 4
        return self.mq.get(UNIFORM) << 1 | self.mq.get(UNIFORM)

    def mark(self):
        if [self.mq.get(UNIFORM) for _ in range(4)] != [1, 0, 1, 0]:
            raise EOFError("a segmentation mark is broken")

    def decode(self, planes: int, passes: int):
        import numpy as np

        self.all(planes, passes)
        out = np.array([-m if n else m for m, n in zip(self.mag, self.sign, strict=True)], np.int64)
        return out.reshape(self.h + 2, self.s)[1:-1, 1:-1]
