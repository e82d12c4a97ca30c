"""Queries that use all of their tables: nothing is left out, whatever its place or value."""

from pyspark.sql import functions as F

from tessella.plans import views as V
from tessella.queries import QUERIES


def test_regions_read_every_plane(spark, sf_dir):
    import __spark_entry__ as entry

    out = entry.entry(spark).collect()
    planes = V.planes(spark, sf_dir)
    assert {r.plane for r in out} == {r.image_id for r in planes.select("image_id").distinct().collect()}
    # one request of a single image alone: all of the plane that lies in it, at its own step
    one = {(r.image_id, r.level): r for r in out}
    alone = V.requests(spark, sf_dir).withColumn("k", F.count("*").over(V.Window.partitionBy("image_id"))).filter("k = 1").collect()
    rows = {(r.image_id, r.y): r.row for r in planes.collect()}
    sides = max(k for k, _ in rows) + 1
    checked = 0
    for a in alone:
        (r,) = [r for (i, _), r in one.items() if i == a.image_id]
        plane = a.image_id % sides
        height = 1 + max(y for i, y in rows if i == plane)
        step = 2**r.level * max(1, int(a.d / 2**r.level))
        ys = range(a.y0 % height, min(a.y0 % height + a.rh, height), step)
        xs = range(a.x0 % 64, min(a.x0 % 64 + a.rw, 64), step)
        v = [rows[plane, y][x] for y in ys for x in xs]
        assert (r.plane, r.pixels, r.peak) == (plane, len(v), max(v)) and abs(r.mean - sum(v) / len(v)) < 1e-6
        checked += 1
    assert checked


def test_floats_of_every_sample(spark, sf_dir):
    out = QUERIES["custom_float_classes"](spark, sf_dir)
    assert out.count() == V.raster(spark, sf_dir).count()
    kinds = {r["class"]: r["count"] for r in out.groupBy("class").count().collect()}
    assert kinds["finite"] == QUERIES["custom_float_decode"](spark, sf_dir).count() and kinds["nan"] and kinds["inf"]
    print(kinds)
    assert out.filter("(value is null) = (class = 'finite')").count() == 0


def test_levels_are_all_used(spark, sf_dir):
    for name, part in (("background_fill_levels", "background_fill"), ("geometry_bands_levels", "geometry_bands")):
        rows = {r["level"]: r["count"] for r in QUERIES[name](spark, sf_dir).groupBy("level").count().collect()}
        assert set(rows) == set(range(5))
        assert rows[{"background_fill": 3, "geometry_bands": 1}[part]] == QUERIES[part](spark, sf_dir).count()
        print(name, sum(rows.values()), rows)
