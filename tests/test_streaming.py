"""The row-band encoder: any batching gives the same codestream."""

import numpy as np
import pytest

from tessella.sources import jpeg2000
from tessella.streaming import bands

W, H = 24, 40


def images():
    rng = np.random.default_rng(7)
    return {i: rng.integers(0, 256, (H, W)) for i in range(3)}


@pytest.mark.parametrize("batches", [1, 4])
def test_stream(spark, tmp_path, batches):
    source, out = tmp_path / "in", str(tmp_path / "out")
    pics = images()
    schema = "image_id long, y int, row array<int>"
    cuts = np.linspace(0, H, batches + 1).astype(int)
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = bands.encode_rows(stream, W, H, 16).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(out)
    try:
        for a, b in zip(cuts, cuts[1:], strict=False):
            data = [(i, y, p[y].tolist()) for i, p in pics.items() for y in range(a, b)]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    got = {r.image_id: bytes(r.content) for r in bands.assemble(spark.read.parquet(out)).collect()}
    whole = {}
    for i, p in pics.items():
        e = bands.BandEncoder(W, H, 16)
        whole[i] = b"".join(b for y in range(H) for _, b in e.add(y, p[y].tolist()))
        planes, warnings = jpeg2000.decode(got[i])
        assert not warnings and (planes[0] == p).all()
    assert got == whole


def test_rows_out_of_order():
    e = bands.BandEncoder(4, 4, 2)
    list(e.add(0, [1, 2, 3, 4]))
    with pytest.raises(ValueError, match="row 2 came where row 1 was due"):
        list(e.add(2, [1, 2, 3, 4]))
    with pytest.raises(ValueError, match="samples"):
        list(e.add(1, [1]))
