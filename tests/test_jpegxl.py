import numpy as np
import pytest

from tessella.sources import jpegxl as X


def both(write, *args):
    """Write with a description, read the result with the same one."""
    b = X.Bits()
    wrote = write(b, *args)
    b.align()
    return wrote, write(X.Bits(b.bytes() + b"\0"), *[{} if isinstance(a, dict) and i == 0 else a for i, a in enumerate(args)])


@pytest.mark.parametrize("w,h", [(1, 1), (8, 8), (256, 128), (257, 3), (1920, 1080), (513, 8191), (262144, 5)])
def test_sizes(w, h):
    assert both(X.size, {"width": w, "height": h})[1] == {"width": w, "height": h}
    if max(w, h) <= 4096:
        assert both(X.preview, {"width": w, "height": h})[1] == {"width": w, "height": h}


def test_numbers():
    for v in (0, 1, 16, 17, 272, 273, 4095, 4096, 1 << 40, (1 << 64) - 1):
        b = X.Bits()
        b.u64(v)
        assert X.Bits(b.bytes()).u64() == v
    for v in (0.0, 1.0, -2.5, 65504.0, 6e-8):
        b = X.Bits()
        b.f16(v)
        assert X.Bits(b.bytes()).f16() == float(np.float16(v))
    with pytest.raises(EOFError):
        X.Bits(b"").u(1)


METAS = [
    {},
    {"depth": {"bits": 16, "exponent": 0}, "xyb": False, "orientation": 6},
    {"depth": {"bits": 32, "exponent": 8}, "xyb": False, "colour": {"space": "grey", "transfer": 8}},
    {"animation": {"numerator": 10, "denominator": 1, "loops": 3, "timecodes": True}, "extra": [{"type": "alpha"}, {"type": "spot", "spot": [1.0, 0.5, 0.25, 1.0], "name": "gold"}, {"type": "cfa", "cfa": 7, "shift": 3}]},
    {"preview": {"width": 64, "height": 40}, "intrinsic": {"width": 100, "height": 50}, "tone": {"intensity": 1000.0, "min": 0.5, "relative": True, "below": 0.25}},
    {"opsin": [float(i) for i in range(16)], "weights": {2: [0.5] * 15}},
    {"colour": {"white": 2, "white_xy": [0.3, 0.31], "primaries": 2, "primaries_xy": [0.6, 0.3, 0.2, 0.7, 0.1, -0.05], "gamma": 4_545_455}, "xyb": False},
]


@pytest.mark.parametrize("meta", METAS)
def test_metadata(meta):
    wrote, read = both(X.metadata, meta)
    assert wrote == read
    for k, v in meta.items():
        if not isinstance(v, (dict, list)):
            assert read[k] == v
    assert len(read["extra"]) == len(meta.get("extra", []))


@pytest.mark.parametrize(
    "f",
    [
        {},
        {"modular": True, "group_shift": 9, "filter": {"gab": False, "epf": 0}},
        {"x0": -5, "y0": 300, "width": 40, "height": 2000, "blending": {"mode": "blend", "alpha": 0, "clamp": True, "source": 2}, "last": False, "save": 3, "duration": 700, "name": "façade"},
        {"type": "reference", "width": 20, "height": 30, "last": False, "save": 1, "save_before": True},
        {"type": "lf", "lf_level": 2, "last": False},
        {"passes": {"n": 3, "shift": [2, 1, 0], "down": [4, 1], "last": [0, 2]}, "filter": {"epf": 3, "sharp": [i / 8 for i in range(8)], "gab_weights": [0.1] * 6, "sigma": [0.5, 1.0, 6.5, 0.625]}},
    ],
)
@pytest.mark.parametrize("meta", [METAS[0], METAS[3]])
def test_frames(f, meta):
    m = X.metadata(X.Bits(), meta)
    if f.get("duration") and not m["animation"]:
        f = {**f, "duration": 0}
    f = {**f, "extra_upsampling": [1 << e["shift"] for e in m["extra"]]} if f else f
    b = X.Bits()
    wrote = X.frame(b, f, m, 500, 400)
    assert X.frame(X.Bits(b.bytes() + b"\0"), {}, m, 500, 400) == wrote
    assert all(wrote[k] == v for k, v in f.items() if not isinstance(v, (dict, list)))


def test_whole_header():
    g = X.geometry({"upsampling": 2, "lf_level": 0, "width": 5000, "height": 1000, "group_shift": 8, "passes": {"n": 2}})
    assert (g["width"], g["height"], g["groups"], g["coarse"], g["sections"]) == (2500, 500, 20, 2, 44)
    sizes = [10, 2000, 30_000, 5_000_000, 7, 8]
    data = X.write_headers(600, 300, {"xyb": False}, {"modular": True}, sizes + [1] * 20)
    out = X.read_headers(data)
    assert (out["width"], out["height"]) == (600, 300) and out["geometry"]["groups"] == 6 and [n for _, n in out["sections"][:6]] == sizes
    assert out["sections"][3][0] == 32010 and out["body"] == len(data)
    assert X.reorder([(0, 1), (1, 2), (3, 4)], [2]) == [(3, 4), (0, 1), (1, 2)]
    with pytest.raises(ValueError):
        X.read_headers(b"nope")


def test_levels():
    assert X.required_level(1000, 1000, 0, 1, 8, False) == 5 and X.required_level(1000, 1000, 0, 1, 8, True) == 10
    assert X.required_level(1 << 19, 100, 0, 0, 8, False) == 10 and X.required_level(1 << 31, 1, 0, 0, 8, False) is None


def test_distributions():
    from tessella.sources import modular as M

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 200):
        counts = M.normalise((rng.random(n) ** 4 * 1000).astype(int).tolist() if n > 2 else [5] * n, 256)
        assert sum(counts) == 4096
        b = X.Bits()
        assert M.distribution(b, 256, counts) == counts
        assert M.distribution(X.Bits(b.bytes() + bytes(8)), 256) == counts
        places = M.Slots(counts, 8).places()
        assert sorted(p for s in places for p in s) == list(range(4096))


def test_symbols_round_trip():
    from tessella.sources import modular as M

    rng = np.random.default_rng(3)
    symbols = [(int(c), int(v)) for c, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 70000, 3000) >> rng.integers(0, 17, 3000), strict=True)]
    b = X.Bits()
    M.Code.fit(b, 3, symbols).write(b, symbols)
    b.align()
    r = X.Bits(b.bytes())
    reader = M.Symbols(r, M.Code.read(r, 3))
    assert [(c, reader.get(c)) for c, _ in symbols] == symbols
    reader.finish()


@pytest.mark.parametrize("h,w,n,bits", [(1, 1, 1, 8), (20, 31, 1, 8), (24, 17, 3, 8), (9, 40, 3, 12), (16, 16, 1, 16)])
def test_lossless_images(h, w, n, bits):
    from tessella.sources import modular as M

    rng = np.random.default_rng(4)
    y, x = np.mgrid[:h, :w]
    planes = [(x * 5 + y * 3 * c + rng.integers(0, 9, (h, w))) % (1 << bits) for c in range(n)]
    data = M.encode(planes, bits)
    assert all((a == b).all() for a, b in zip(planes, M.decode(data), strict=True))
    head = X.read_headers(data)
    assert (head["width"], head["height"], head["metadata"]["depth"]["bits"], head["body"] + head["sections"][0][1]) == (w, h, bits, len(data))
    with pytest.raises((ValueError, EOFError)):
        M.decode(data[:-6])
    for options in ({"predictor": 6}, {"predictor": 13}, {"squeeze": True}, {"use_palette": False}):
        assert all((a == b).all() for a, b in zip(planes, M.decode(M.encode(planes, bits, **options)), strict=True)), options


def test_lossless_palettes():
    from tessella.sources import modular as M

    rng = np.random.default_rng(6)
    index = rng.integers(0, 7, (20, 30))
    for n in (1, 3):
        planes = [rng.integers(0, 256, 7)[index] for _ in range(n)]
        colours, found = M.find_palette(planes)
        assert colours.shape[0] == n and (colours[:, found] == np.stack(planes)).all()
        small, large = M.encode(planes), M.encode(planes, use_palette=False)
        assert len(small) < len(large) and all((a == b).all() for a, b in zip(planes, M.decode(small), strict=True))


def test_lossless_groups(monkeypatch):
    from tessella.sources import modular as M

    rng = np.random.default_rng(9)
    h, w = 140, 300
    y, x = np.mgrid[:h, :w]
    for planes in ([(x + y * c + rng.integers(0, 5, (h, w))) % 256 for c in range(3)], [rng.integers(0, 5, (h, w)) * 40]):
        data = M.encode(planes, group_shift=7)
        head = X.read_headers(data)
        assert head["geometry"]["groups"] == 6 and len(head["sections"]) == 9
        assert all((a == b).all() for a, b in zip(planes, M.decode(data), strict=True))
        calls, real = [], M._channels
        monkeypatch.setattr(M, "_channels", lambda *a: calls.append(a[-1]) or real(*a))
        part = M.decode(data, (130, 20, 250, 100))
        monkeypatch.undo()
        assert all((a[20:100, 130:250] == b).all() for a, b in zip(planes, part, strict=True)) and len(calls) == 2
    with pytest.raises(ValueError):
        M.encode([planes[0]], squeeze=True, group_shift=7)


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 0, 1, 3, 4], [1, 0, 4, 2, 3]])
def test_permuted_contents(order):
    b = X.Bits()
    sizes = [5, 0, 1500, 20_000, 7]
    X.contents(b, sizes, 5, order)
    starts = [sum(sizes[:i]) for i in range(5)]
    assert X.contents(X.Bits(b.bytes()), [], 5) == [(starts[i], sizes[i]) for i in order]


def test_sections_in_another_order():
    from tessella.sources import modular as M

    plane = (np.arange(300 * 270).reshape(300, 270) * 7 % 251).astype(np.int64)
    data = M.encode([plane], group_shift=7)
    h = X.read_headers(data)
    n = len(h["sections"])
    assert n > 4
    order = [n - 1 - i for i in range(n)]
    body = {order[i]: data[h["body"] + at : h["body"] + at + size] for i, (at, size) in enumerate(h["sections"])}
    parts = [body[i] for i in range(n)]
    again = X.write_headers(h["width"], h["height"], h["metadata"], h["frame"], [len(p) for p in parts], order) + b"".join(parts)
    assert X.read_headers(again)["sections"] != h["sections"]
    want, got = M.decode(data), M.decode(again)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    with pytest.raises(EOFError):
        X.read_headers(again[: h["body"] - 8])
