"""Pixels of slides as rows, from bytes and through the data source, which reads only what a region needs."""

import numpy as np
import pytest

from tessella.sources import jpeg2000, scan, slides, tiff


@pytest.fixture(scope="module")
def slide():
    """(plane, file) of two levels: 8 x 8 noisy tiles of 32 pixels, and a coarse one of one tile."""
    plane = np.random.default_rng(5).integers(0, 256, (256, 256))
    cut = lambda p: [jpeg2000.encode([p[j : j + 32, i : i + 32]], levels=1) for j in range(0, p.shape[0], 32) for i in range(0, p.shape[1], 32)]
    entries = lambda n: [(tiff.WIDTH, 4, [n]), (tiff.HEIGHT, 4, [n]), (tiff.COMPRESSION, 3, [33005]), (tiff.TILE_W, 3, [32]), (tiff.TILE_H, 3, [32])]
    return plane, tiff.build([entries(256), entries(32)], [cut(plane), cut(plane[::8, ::8])], layout="big")


def rows_of(df):
    out = {(r.channel, r.y): r.row for r in df.collect()}
    return np.array([out[0, y] for y in range(1 + max(y for _, y in out))]), {c for c, _ in out}


def test_planes_of_slides(spark, tmp_path, slide):
    plane, data = slide
    (tmp_path / "a.tif").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.tif"))
    got, channels = rows_of(scan.scan_planes(files, (30, 40, 70, 60)))
    assert channels == {0, 1, 2} and (got == plane[40:60, 30:70]).all()
    assert (rows_of(scan.scan_planes(files, (0, 0, 100, 9), step=3))[0] == plane[:9:3, :100:3]).all()
    assert (rows_of(scan.scan_planes(files, level=1))[0] == plane[::8, ::8]).all()
    assert "reduced" in scan.scan_planes(files, reduction=1).first().error
    assert "level 2" in scan.scan_planes(files, level=2).first().error

    scan.register(spark)
    read = lambda **o: spark.read.format("raster").options(**o).load(str(tmp_path / "*"))
    assert (rows_of(read(mode="planes", region="30,40,70,60"))[0] == plane[40:60, 30:70]).all()
    assert (rows_of(read(mode="planes", level=1, step=2))[0] == plane[::16, ::16]).all()
    assert read(mode="levels").filter("error is null").count() == 2
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "short.tif").write_bytes(data[:40])
    assert read(mode="planes", level=1).filter("error is not null").count() == 2


def test_a_window_reads_its_own_tiles(slide):
    plane, data = slide

    class Counted:
        read = 0

        def __getitem__(self, at):
            self.read += len(data[at])
            return data[at]

    source = Counted()
    out = slides.read_region(source, 0, 64, 64, 32, 32)
    assert (out[:, :, 0] == plane[64:96, 64:96]).all()
    assert source.read < 0.25 * len(data)
