"""Containers, slides and codestreams, written and read back; broken files give rows with errors."""

import numpy as np
import pytest

from tessella.functions import blocks, mq, wavelet
from tessella.sources import boxes, jpeg2000, scan, tiff


def picture(h, w, n, bits=8, seed=0):
    """Gradient, flat and noise thirds for each channel."""
    y, x = np.mgrid[:h, :w]
    top, rng = (1 << bits) - 1, np.random.default_rng(seed)
    return [np.where(y < h // 3, (x * top // max(w - 1, 1) + 17 * c) & top, np.where(y < 2 * h // 3, (31 * c + 77) & top, rng.integers(0, top + 1, (h, w)))) for c in range(n)]


@pytest.mark.parametrize("h,w,n,bits,levels,tile", [(64, 64, 1, 8, 3, None), (100, 130, 3, 8, 4, 64), (33, 17, 3, 12, 2, 20), (1, 1, 1, 8, 1, None), (7, 90, 2, 16, 5, None), (40, 40, 1, 8, 0, 33)])
@pytest.mark.parametrize("order", jpeg2000.PROGRESSIONS)
def test_codestream_round_trip(h, w, n, bits, levels, tile, order):
    p = picture(h, w, n, bits)
    data = jpeg2000.encode(p, bits, levels=levels, tile=tile, progression=order)
    out, warnings = jpeg2000.decode(data)
    assert not warnings and all((a == b).all() for a, b in zip(p, out, strict=True))
    if h > 20:
        out, _ = jpeg2000.decode(data, (5, 6, w - 3, h - 2))
        assert all((a[6 : h - 2, 5 : w - 3] == b).all() for a, b in zip(p, out, strict=True))


def test_lossy_and_reduced():
    p = picture(96, 80, 3)
    fine, coarse = (jpeg2000.encode(p, lossless=False, step=s) for s in (1 / 16, 4))
    assert len(coarse) < len(fine)
    assert max(abs(a - b).max() for a, b in zip(p, jpeg2000.decode(fine)[0], strict=True)) <= 1
    small, _ = jpeg2000.decode(jpeg2000.encode(p), None, 2)
    assert small[0].shape == (24, 20)
    with pytest.raises(ValueError, match="reduction"):
        jpeg2000.decode(fine, None, 9)
    with pytest.raises(ValueError, match="outside"):
        jpeg2000.decode(fine, (200, 200, 300, 300))


@pytest.mark.parametrize("order", jpeg2000.PROGRESSIONS)
@pytest.mark.parametrize("layers,precinct,markers", [(3, None, True), (1, 5, False), (4, 6, True)])
def test_layers_and_precincts(order, layers, precinct, markers):
    p = picture(90, 120, 3)
    data = jpeg2000.encode(p, tile=70, levels=3, progression=order, layers=layers, precinct=precinct, markers=markers)
    out, warnings = jpeg2000.decode(data)
    assert not warnings and all((a == b).all() for a, b in zip(p, out, strict=True))
    small, _ = jpeg2000.decode(data, (10, 20, 100, 80), 1)
    assert (small[0] == jpeg2000.decode(data, None, 1)[0][0][10:40, 5:50]).all()


@pytest.mark.parametrize("order", jpeg2000.PROGRESSIONS)
def test_subsampled_components(order):
    luma = picture(61, 75, 1)[0]
    chroma = [luma[::2, ::2], luma[::2, ::2] ^ 1]
    data = jpeg2000.encode([luma, *chroma], tile=40, progression=order, sub=[(1, 1), (2, 2), (2, 2)], size=(75, 61), precinct=5)
    out, warnings = jpeg2000.decode(data)
    assert not warnings and all((a == b).all() for a, b in zip([luma, *chroma], out, strict=True))


@pytest.mark.parametrize("style", [0x02, 0x08, 0x20, 0x2A])
def test_block_styles(style):
    p = picture(40, 70, 1)
    data = jpeg2000.encode(p, style=style)
    out, warnings = jpeg2000.decode(data)
    assert not warnings and (out[0] == p[0]).all() and data != jpeg2000.encode(p)
    with pytest.raises(jpeg2000.Unsupported):
        jpeg2000.decode(jpeg2000.encode(p, style=0x40))


def test_overrides_changes_and_regions_of_interest():
    p = picture(70, 90, 2)
    segments = [(0, 0, 2, 2, 2, "RLCP"), (0, 0, 3, 6, 1, "CPRL"), (0, 0, 3, 6, 2, "LRCP")]
    for options in ({"own_levels": {1: 1}}, {"changes": segments, "layers": 3}, {"roi": 11}, {"own_levels": {0: 5}, "precinct": 6, "tile": 50, "changes": segments, "layers": 3, "roi": 12}):
        data = jpeg2000.encode(p, **options)
        out, warnings = jpeg2000.decode(data)
        assert not warnings and all((a == b).all() for a, b in zip(p, out, strict=True)), options
    main, own = jpeg2000.parse(jpeg2000.encode(p, own_levels={1: 1}))[0], {1: 1}
    assert main.view(0, 0).levels == 3 and main.view(0, 1).levels == 1 and len(main.view(0, 1).steps) == 4 and own
    with pytest.raises(ValueError, match="1 levels"):
        jpeg2000.decode(jpeg2000.encode(p, own_levels=own), None, 2)
    main.overrides[0, -1] = [{"levels": 4}]
    assert (main.view(0, 1).levels, main.view(1, 1).levels, main.view(0).levels) == (4, 1, 4)


def test_cut_off_streams_keep_what_came():
    p = picture(100, 100, 1)
    data = jpeg2000.encode(p, tile=50)
    out, warnings = jpeg2000.decode(data[: len(data) * 2 // 3])
    assert warnings and (out[0][:50, :50] == p[0][:50, :50]).all()
    header, parts, _ = jpeg2000.parse(data)
    assert len(parts) == 4 and header.grid == (2, 2) and all(data[q.start - 2 : q.start] == b"\xff\x93" for q in parts)


def test_random_damage_never_hangs():
    data, rng = jpeg2000.encode(picture(32, 32, 1)), np.random.default_rng(1)
    for _ in range(150):
        broken = bytearray(data)
        for at in rng.integers(2, len(data), 3):
            broken[at] = rng.integers(256)
        try:
            jpeg2000.decode(bytes(broken[: rng.integers(len(data) // 2, len(data) + 1)]), None, 0) if jpeg2000.parse(bytes(broken))[0].width < 4096 and jpeg2000.parse(bytes(broken))[0].height < 4096 else None
        except Exception as e:  # noqa: BLE001
            assert not isinstance(e, (MemoryError, RecursionError))


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (8, 1), (33, 50)])
@pytest.mark.parametrize("origin", [(0, 0), (1, 0), (3, 5)])
def test_wavelets(shape, origin):
    p = np.random.default_rng(2).integers(0, 255, shape)
    for levels in (0, 1, 3):
        for reversible in (True, False):
            ll, b = wavelet.forward(p, levels, *origin, reversible)
            assert np.allclose(wavelet.inverse(ll, b, *origin, reversible), p)


@pytest.mark.parametrize("band", ["LL", "HL", "LH", "HH"])
def test_block_coder(band):
    for scale in (0, 1, 50, 9000):
        v = (np.random.default_rng(3).standard_normal((13, 21)) * scale).astype(int)
        planes, passes, data = mq.BlockEncoder(v, band).encode()
        assert not planes and not v.any() or (mq.BlockDecoder(data, 21, 13, band).decode(planes, passes) == v).all()


def test_block_transforms():
    rng = np.random.default_rng(4)
    for n in (2, 8, 32):
        x = rng.standard_normal((n, n))
        assert np.allclose(blocks.idct(blocks.dct(x)), x) and np.isclose(blocks.dct(x)[0, 0], x.mean())
    for w in (1, 2, 7, 16):
        x = rng.integers(-500, 500, (5, w))
        assert (blocks.unsqueeze(*blocks.squeeze(x)) == x).all()
    flat = np.full((9, 9), 50)
    assert (blocks.weighted_predictions(flat)[1:, 1:] == 50).all()
    a = [rng.random((16, 16)) for _ in range(3)]
    assert blocks.perceptual_distance(a, a) == 0 < blocks.perceptual_distance(a, [p + 0.1 * rng.random((16, 16)) for p in a])
    assert np.allclose(blocks.gaussian(np.ones((8, 8))), 1) and np.allclose(blocks.edge_preserving([np.ones((8, 8))] * 3, np.ones((8, 8)))[0], 1)


def test_jp2_boxes():
    stream = jpeg2000.encode(picture(8, 8, 4))
    data = jpeg2000.wrap_jp2(stream, 8, 8, 4, alpha=3)
    info = boxes.jp2_info(data)
    assert (info["width"], info["height"], info["components"], info["colour"]) == (8, 8, 4, "srgb")
    assert info["channels"][3] == (3, 1, 0) and data[info["codestream"][0] :] == stream
    open_end = data[:-8 - len(stream)] + b"\0\0\0\0jp2c" + stream
    assert boxes.jp2_info(open_end)["codestream"][1] == len(stream)
    long = data[: -8 - len(stream)] + b"\0\0\0\1jp2c" + (16 + len(stream)).to_bytes(8, "big") + stream
    assert boxes.jp2_info(long)["codestream"] == (len(long) - len(stream), len(stream))
    assert list(boxes.walk(boxes.palette_box([[1, 2, 3], [4, 5, 6]])))[0][1] == "pclr"
    with pytest.raises(ValueError):
        list(boxes.walk(data[:-5]))


def test_jxl_containers():
    stream = boxes.write_jxl_size(1234, 77) + bytes(50)
    assert boxes.jxl_size(stream) == (1234, 77) and boxes.jxl_level(stream) is None
    data = boxes.wrap_jxl(stream, 10, exif=b"II*\0", xmp=b"<x/>", parts=3)
    parts = boxes.jxl_segments(data)
    assert b"".join(data[p : p + n] for _, _, p, n in parts) == stream and [o for _, o, _, _ in parts] == [0, 19, 38]
    assert boxes.jxl_level(data) == 10 and boxes.exif_payload(data) == b"II*\0" and boxes.find(data, "xml ") == b"<x/>"
    assert boxes.jxl_level(boxes.wrap_jxl(stream)) == 5


@pytest.mark.parametrize("layout,order", [("classic", "<"), ("classic", ">"), ("big", "<"), ("big", ">"), ("oversize", "<")])
def test_tiff_layouts(layout, order):
    entries = [(tiff.WIDTH, 4, [600]), (tiff.HEIGHT, 4, [300]), (tiff.TILE_W, 3, [256]), (tiff.TILE_H, 3, [256]), (tiff.X_RESOLUTION, 5, [(40000, 1)]), (tiff.Y_RESOLUTION, 5, [(1, 0)]), (tiff.DESCRIPTION, 2, "Hi"), (tiff.FORMAT_FLAG, 4, [1]), (tiff.LENS, 11, [20.0])]
    tiles = [bytes([i]) * (i + 1) for i in range(5)] + [b""]
    data = tiff.build([entries, entries[:2]], [tiles], layout, order)
    got, dirs = tiff.read(data)
    assert got == layout and len(dirs) == 2 and dirs[0][tiff.DESCRIPTION].text == "Hi"
    assert dirs[0][tiff.X_RESOLUTION].values == [40000.0] and dirs[0][tiff.Y_RESOLUTION].values == [0.0]
    index = tiff.tile_index(dirs[0])
    assert [(x, y) for _, x, y, _, _ in index] == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1)]
    assert [data[o : o + n] for *_, o, n in index] == tiles


def test_oversize_values_past_four_gigabytes():
    data = tiff.build([[(tiff.FORMAT_FLAG, 4, [1]), (tiff.WIDTH, 4, [(5 << 32) + 7])]], layout="oversize")
    f = tiff.read(data)[1][0][tiff.WIDTH]
    assert f.values == [(5 << 32) + 7] and f.type == 16


def test_directory_loops_and_damage():
    data = bytearray(tiff.build([[(tiff.WIDTH, 4, [5])]]))
    at = int.from_bytes(data[4:8], "little")
    data[at + 14 : at + 18] = at.to_bytes(4, "little")
    with pytest.raises(ValueError, match="loop"):
        tiff.read(bytes(data))
    with pytest.raises(ValueError):
        tiff.read(b"II*\0\xff\0\0\0")


def test_slide_structure():
    sizes = [(1000, 800), (250, 200)]
    dirs = [[(tiff.WIDTH, 4, [w]), (tiff.HEIGHT, 4, [h]), (tiff.TILE_W, 3, [256]), (tiff.TILE_H, 3, [256])] for w, h in sizes]
    names = [[(tiff.WIDTH, 4, [9]), (tiff.HEIGHT, 4, [9]), (tiff.DESCRIPTION, 2, f"x\r\n{n}")] for n in ("label 1x1", "Label again", "macro")]
    rows = tiff.structure(*tiff.read(tiff.build(dirs + names)))
    assert [r["downsample"] for r in rows[:2]] == [1.0, 4.0] and [r["name"] for r in rows[2:]] == ["label", "label 2", "macro"]


def test_scans(spark, tmp_path):
    p = picture(40, 50, 1)
    good = jpeg2000.wrap_jp2(jpeg2000.encode(p, tile=32), 50, 40, 1)
    files = {"a.jp2": good, "b.jp2": good[:30], "c.tif": tiff.build([[(tiff.WIDTH, 4, [5]), (tiff.HEIGHT, 4, [6])]]), "d.jxl": boxes.write_jxl_size(10, 20), "e.bin": b"junk"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    df = spark.read.format("binaryFile").load(str(tmp_path))
    info = {r.path.rsplit("/")[-1]: r for r in scan.scan_info(df).collect()}
    assert (info["a.jp2"].width, info["a.jp2"].tiles, info["c.tif"].height, info["d.jxl"].width) == (50, 4, 6, 10)
    assert info["b.jp2"].error and info["e.bin"].error
    kinds = {r.path.rsplit("/")[-1]: r.format for r in scan.formats(df).collect()}
    assert kinds == {"a.jp2": "jp2", "b.jp2": "jp2", "c.tif": "tiff", "d.jxl": "jxl", "e.bin": None}
    readers = {r.path.rsplit("/")[-1]: (r.format, r.reader) for r in scan.scan_readers(df).collect()}
    assert readers == {"a.jp2": ("jp2", "jpeg2000"), "b.jp2": ("jp2", "jpeg2000"), "c.tif": ("tiff", "tiff"), "d.jxl": ("jxl", "jpegxl"), "e.bin": (None, None)}
    assert scan.slide_format(b"II*\0\xff") is None
    rows = {r.y: r.row for r in scan.scan_planes(df.filter("path like '%a.jp2'"), (4, 3, 30, 20)).collect()}
    assert (np.array([rows[y] for y in sorted(rows)]) == p[0][3:20, 4:30]).all()
    assert scan.scan_tiles(df).filter("path like '%a.jp2'").count() == 4 and scan.scan_entries(df).filter("tag = 256").first().value == 5
    scan.register(spark)
    again = spark.read.format("raster").option("mode", "info").load(f"{tmp_path}/*")
    assert {(r.path.rsplit("/")[-1], r.width) for r in again.collect() if r.width} == {("a.jp2", 50), ("c.tif", 5), ("d.jxl", 10)}


def test_prefix_codes():
    from tessella.functions.huffman import canonical, code_lengths

    counts = {i: 2**i for i in range(20)}
    for limit in (5, 8, 16):
        lengths = code_lengths(counts, limit)
        assert max(lengths.values()) <= limit and sum(2.0**-n for n in lengths.values()) == 1
        codes = canonical(lengths)
        assert len({f"{c:0{n}b}" for c, n in codes.values()}) == 20
    assert code_lengths({7: 3}) == {7: 1} and code_lengths({}) == {}


@pytest.mark.parametrize("shape", [(16, 16), (33, 50), (64, 48, 3)])
def test_jpeg_round_trip(shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    image = ((x * 3 + y * 2) % 256).astype(np.uint8) if len(shape) == 2 else np.stack([x * 4 % 256, y * 3 % 256, (x + y) % 256], axis=2).astype(np.uint8)
    from tessella.sources import jpeg

    for restart in (0, 1, 2):
        out = jpeg.decode(jpeg.encode(image, 100, restart))
        assert np.abs(out.reshape(image.shape).astype(int) - image).mean() < 3
    for quality in (40, 100):
        plain, later = (jpeg.coefficients(jpeg.encode(image, quality, progressive=p)) for p in (False, True))
        assert later[0].sof == 0xC2 and all((a == b).all() for a, b in zip(plain[1], later[1], strict=True))
    h, planes = jpeg.coefficients(jpeg.encode(image, 95))
    assert (h.width, h.height) == (shape[1], shape[0]) and len(planes) == (3 if len(shape) == 3 else 1)
    with pytest.raises(ValueError):
        jpeg.decode(b"\xff\xd8\xff\xd9")


def test_restart_intervals_as_tiles():
    from tessella.sources import jpeg, slides

    image = np.random.default_rng(3).integers(0, 256, (40, 64)).astype(np.uint8)
    data = jpeg.encode(image, 100, restart=4)
    head = jpeg.read_header(data)
    starts = jpeg.restart_starts(data, head.scan_at)
    assert len(starts) == 10 and jpeg.check_starts(data, starts) and not jpeg.check_starts(data, [starts[0], starts[1] + 1])
    whole = jpeg.decode(data)
    assert (slides.read_strips(data, 10, 5, 40, 20) == whole[5:25, 10:50]).all()


@pytest.mark.parametrize("layout,code", [("classic", 33005), ("big", 33003), ("oversize", 7), ("classic", 1)])
def test_slide_regions(layout, code):
    from tessella.sources import jpeg, slides

    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (70, 90, 3)).astype(np.uint8)
    tiles = []
    for j in range(3):
        for i in range(3):
            t = np.zeros((32, 32, 3), np.uint8)
            part = image[j * 32 : j * 32 + 32, i * 32 : i * 32 + 32]
            t[: part.shape[0], : part.shape[1]] = part
            channels = [t[:, :, c].astype(int) for c in range(3)]
            tiles.append(jpeg2000.encode(channels, levels=2) if code > 9 else jpeg.encode(t, 100) if code == 7 else t.tobytes())
    tiles[4] = b""
    entries = [(tiff.WIDTH, 4, [90]), (tiff.HEIGHT, 4, [70]), (tiff.TILE_W, 3, [32]), (tiff.TILE_H, 3, [32]), (tiff.COMPRESSION, 3, [code]), (tiff.FORMAT_FLAG, 4, [1]), (tiff.LENS, 11, [20.0])]
    data = tiff.build([entries], [tiles], layout)
    image[32:64, 32:64] = 255
    for x, y, w, h, step in ((0, 0, 90, 70, 1), (10, 20, 60, 45, 1), (5, 3, 80, 60, 3), (60, 40, 60, 60, 2)):
        want = np.full((h, w, 3), 255, np.uint8)
        part = image[y : y + h, x : x + w]
        want[: part.shape[0], : part.shape[1]] = part
        got = slides.read_region(data, 0, x, y, w, h, step)
        if code in (33005, 1):
            assert (got == want[::step, ::step]).all()
        else:
            assert got.shape == want[::step, ::step].shape
    rows = [{"kind": "level", "level": i, "downsample": d} for i, d in enumerate((1.0, 4.0, 4.0, 16.0))]
    assert [slides.best_level(rows, d) for d in (0.5, 1, 3.9, 4, 15.99, 99)] == [0, 0, 0, 1, 1, 3]


def test_profiles():
    from tessella.sources import icc

    srgb = np.linalg.inv(icc.D50_TO_SRGB)
    data = icc.build(srgb, 2.2)
    ramp = np.repeat(np.arange(0, 256, 15)[:, None], 3, axis=1).astype(np.uint8)
    out = icc.to_srgb(ramp, data)
    # a grey ramp with gamma 2.2: only the curves differ from sRGB's
    linear = (ramp / 255.0) ** (round(2.2 * 256) / 256)
    want = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055) * 255
    assert np.abs(out - want).max() < 0.6 and (out[0] == 0).all() and (out[-1] == 255).all()
    assert icc.matrix_profile(data[:16] + b"CMYK" + data[20:]) is None
    table = b"curv" + bytes(4) + (3).to_bytes(4, "big") + np.array([0, 10000, 65535], ">u2").tobytes()
    assert np.isclose(icc.curve(table)(0.5), 10000 / 65535)
    para = b"para" + bytes(4) + b"\0\3\0\0" + np.array([2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045], dtype=float).__mul__(65536).round().astype(">i4").tobytes()
    assert np.isclose(icc.curve(para)(0.5), 0.2140, atol=1e-3) and np.isclose(icc.curve(para)(0.01), 0.01 / 12.92, atol=1e-5)
    with pytest.raises(ValueError):
        icc.tags(b"x" * 200)


def test_rate_control_and_presentation():
    p = picture(64, 64, 1)
    data, error = jpeg2000.encode_to_target(p, 2.0)
    assert 1.0 < error < 4.0 and len(data) < len(jpeg2000.encode(p))
    info = {"palette": [[1, 2, 3], [4, 5, 6]], "mapping": [(0, 1, 0), (0, 1, 1), (0, 1, 2)], "channels": [(0, 0, 3), (1, 1, 0), (2, 0, 1)]}
    out = jpeg2000.present([np.array([[0, 1, 9]])], info)
    assert [o.tolist() for o in out] == [[[3, 6, 6]], [[1, 4, 4]], [[2, 5, 5]]]


def test_copies():
    from tessella.functions import kernels

    rng = np.random.default_rng(8)
    for values in ([], [1], [5] * 50, rng.integers(0, 3, 300).tolist(), [1, 2, 3, 4] * 20):
        assert kernels.undo_copies(kernels.find_copies(values)) == values
    assert len(kernels.find_copies([1, 2, 3, 4] * 20)) == 5
