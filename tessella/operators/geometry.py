"""Queries of selection and geometry: regions, tiles, levels, joins on them, packet orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.samples import ceil_div, floor_div
from tessella.plans import views as V
from tessella.registry import query

TILE = 256


def with_downsample(levels: DataFrame) -> DataFrame:
    """Mean of the two size ratios to level 0 of the same image."""
    w = Window.partitionBy("image_id").orderBy("level")
    return levels.withColumn("downsample", (F.first("w").over(w) / F.col("w") + F.first("h").over(w) / F.col("h")) / 2)


_DS = "SELECT image_id, level, w, h, (first_value(w) OVER o / w + first_value(h) OVER o / h) / 2 AS downsample FROM levels WINDOW o AS (PARTITION BY image_id ORDER BY level)"


@query("level_downsample", f"SELECT image_id, level, round(downsample, 6) AS downsample FROM ({_DS})")
def level_downsample(spark, sf_dir):
    return with_downsample(V.levels(spark, sf_dir)).select("image_id", "level", F.round("downsample", 6).alias("downsample"))


def best_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """For each request (image_id, d) the coarsest level that is not coarser than d; level 0 where none is.

    The levels of an image travel as one array, so each request meets one row.
    """
    pyramids = with_downsample(levels).groupBy("image_id").agg(F.collect_list(F.struct("downsample", (-F.col("level")).alias("neg"))).alias("pyramid"))
    joined = requests.join(pyramids, "image_id")
    fits = F.filter("pyramid", lambda p: p["downsample"] <= F.col("d") + 1e-6)
    return joined.withColumn("level", F.coalesce(-F.array_max(fits)["neg"], F.lit(0))).drop("pyramid")


_BEST = f"""
WITH ds AS ({_DS}),
best AS (SELECT r.image_id, x0, y0, rw, rh, d, n, level, row_number() OVER (PARTITION BY r.image_id, x0, y0, rw, rh, d ORDER BY downsample DESC, level) AS k
  FROM requests r JOIN ds ON ds.image_id = r.image_id AND (downsample <= d + 1e-6 OR level = 0))
SELECT image_id, x0, y0, rw, rh, d, n, level FROM best WHERE k = 1
"""


@query("best_level", _BEST)
def best_level_query(spark, sf_dir):
    return best_level(V.requests(spark, sf_dir), V.levels(spark, sf_dir)).select("image_id", "x0", "y0", "rw", "rh", "d", "n", "level")


def tiles(levels: DataFrame, size: int = TILE) -> DataFrame:
    """Every tile of every level, clipped at the edges."""
    grid = levels.withColumn("nx", ceil_div(F.col("w"), size)).withColumn("ny", ceil_div(F.col("h"), size))
    rows = grid.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") * F.col("ny") - 1)))
    rows = rows.withColumn("tx", F.col("tile") % F.col("nx")).withColumn("ty", floor_div(F.col("tile"), F.col("nx")))
    edge = lambda t, limit: F.least((F.col(t) + 1) * size, F.col(limit))
    return rows.select("image_id", "level", "tile", "tx", "ty", (F.col("tx") * size).alias("x0"), (F.col("ty") * size).alias("y0"), edge("tx", "w").alias("x1"), edge("ty", "h").alias("y1"))


_TILES = "SELECT image_id, level, ty * nx + tx AS tile, tx, ty, tx * 256 AS x0, ty * 256 AS y0, least((tx + 1) * 256, w) AS x1, least((ty + 1) * 256, h) AS y1 FROM (SELECT *, unnest(range(ny)) AS ty FROM (SELECT *, unnest(range(nx)) AS tx FROM (SELECT *, (w + 255) // 256 AS nx, (h + 255) // 256 AS ny FROM levels)))"


@query("tile_grid", f"SELECT image_id, level, count(*) AS tiles, sum((x1 - x0) * (y1 - y0))::BIGINT AS area, max(x1) AS w, max(y1) AS h FROM ({_TILES}) GROUP BY ALL")
def tile_grid(spark, sf_dir):
    t = tiles(V.levels(spark, sf_dir))
    return t.groupBy("image_id", "level").agg(F.count("*").alias("tiles"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.max("x1").alias("w"), F.max("y1").alias("h"))


@query("tiles_for_region", f"SELECT image_id, level, tile, tx, ty FROM ({_TILES}) WHERE level = 0 AND x0 < 900 AND x1 > 300 AND y0 < 700 AND y1 > 200")
def tiles_for_region(spark, sf_dir):
    """One region: the tile numbers follow from its corners, so only those are made."""
    d = V.levels(spark, sf_dir).filter("level = 0")
    last = lambda hi, limit: F.least(F.lit((hi - 1) // TILE), floor_div(F.col(limit) - 1, TILE))
    d = d.withColumn("tx", F.explode(F.sequence(F.lit(300 // TILE).cast("long"), last(900, "w")))).withColumn("ty", F.explode(F.sequence(F.lit(200 // TILE).cast("long"), last(700, "h"))))
    return d.select("image_id", "level", (F.col("ty") * ceil_div(F.col("w"), TILE) + F.col("tx")).alias("tile"), "tx", "ty")


def request_tiles(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Many regions: each is expanded to the tile numbers it covers, which is a join on equal keys, not on ranges."""
    d = requests.join(levels.filter("level = 0"), "image_id")
    d = d.withColumn("x1", F.least(F.col("x0") + F.col("rw"), F.col("w"))).withColumn("y1", F.least(F.col("y0") + F.col("rh"), F.col("h"))).filter("x1 > x0 and y1 > y0")
    span = lambda a, b: F.sequence(floor_div(F.col(a), TILE), floor_div(F.col(b) - 1, TILE))
    return d.withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))


@query("tiles_for_regions_binned_join", f"SELECT r.image_id, r.x0, r.y0, rw, rh, d, n, count(*) AS tiles, min(tile) AS first_tile, max(tile) AS last_tile FROM requests r JOIN ({_TILES}) t ON t.image_id = r.image_id AND t.level = 0 AND t.x0 < r.x0 + rw AND t.x1 > r.x0 AND t.y0 < r.y0 + rh AND t.y1 > r.y0 GROUP BY ALL")
def tiles_for_regions_binned_join(spark, sf_dir):
    d = request_tiles(V.requests(spark, sf_dir), V.levels(spark, sf_dir)).withColumn("tile", F.col("ty") * ceil_div(F.col("w"), TILE) + F.col("tx"))
    return d.groupBy("image_id", "x0", "y0", "rw", "rh", "d", "n").agg(F.count("*").alias("tiles"), F.min("tile").alias("first_tile"), F.max("tile").alias("last_tile"))


@query("group_selection_margin16", "SELECT image_id, x0, y0, rw, rh, d, n, greatest(0, x0 // 2 - 16) // 256 AS gx0, greatest(0, y0 // 2 - 16) // 256 AS gy0, (least(1200, (x0 + rw + 1) // 2 + 16) + 255) // 256 AS gx1, (least(1200, (y0 + rh + 1) // 2 + 16) + 255) // 256 AS gy1, greatest(0, x0 // 2 - 16) // 2048 AS lx0, (least(1200, (x0 + rw + 1) // 2 + 16) + 2047) // 2048 AS lx1 FROM requests")
def group_selection_margin16(spark, sf_dir):
    """Groups (256) and coarse groups (2048) of a frame upsampled twofold, with a margin of 16 samples."""
    low = lambda c: F.greatest(F.lit(0).cast("long"), floor_div(F.col(c), 2) - 16)
    high = lambda c, n: F.least(F.lit(1200).cast("long"), floor_div(F.col(c) + F.col(n) + 1, 2) + 16)
    return V.requests(spark, sf_dir).select(
        "image_id", "x0", "y0", "rw", "rh", "d", "n",
        floor_div(low("x0"), 256).alias("gx0"), floor_div(low("y0"), 256).alias("gy0"), ceil_div(high("x0", "rw"), 256).alias("gx1"), ceil_div(high("y0", "rh"), 256).alias("gy1"),
        floor_div(low("x0"), 2048).alias("lx0"), ceil_div(high("x0", "rw"), 2048).alias("lx1"),
    )


@query("region_crop", "SELECT image_id, y - 10 AS y, x - 20 AS x, v FROM raster WHERE y >= 10 AND y < 42 AND x >= 20 AND x < 52")
def region_crop(spark, sf_dir):
    rows = V.planes(spark, sf_dir).filter("y >= 10 and y < 42")
    return V.pixels(rows.withColumn("y", F.col("y") - 10).withColumn("row", F.slice("row", 21, 32)))


@query("subsample_read", "SELECT image_id, (y - 5) // 3 AS y, (x - 7) // 4 AS x, v FROM raster WHERE y >= 5 AND (y - 5) % 3 = 0 AND x >= 7 AND (x - 7) % 4 = 0")
def subsample_read(spark, sf_dir):
    rows = V.planes(spark, sf_dir).filter("y >= 5 and (y - 5) % 3 = 0")
    take = F.transform(F.sequence(F.lit(7), F.lit(V.SIDE - 1), F.lit(4)), lambda i: F.get("row", i))
    return V.pixels(rows.withColumn("y", F.expr("cast((y - 5) div 3 as int)")).withColumn("row", take))


@query("band_select_reorder", "SELECT image_id, y, x, b AS band0, r AS band1 FROM rgb")
def band_select_reorder(spark, sf_dir):
    return V.rgb(spark, sf_dir).select("image_id", "y", "x", F.col("b").alias("band0"), F.col("r").alias("band1"))


@query("reduced_size_ceil_div", "SELECT image_id, k AS reduction, ((w + (1 << k) - 1) >> k) - ((17 + (1 << k) - 1) >> k) AS w, ((h + (1 << k) - 1) >> k) - ((9 + (1 << k) - 1) >> k) AS h FROM levels, (SELECT unnest(range(6))::INT AS k) WHERE level = 0")
def reduced_size_ceil_div(spark, sf_dir):
    """Size at each resolution reduction of an image whose origin is (17, 9)."""
    d = V.levels(spark, sf_dir).filter("level = 0").withColumn("reduction", F.explode(F.sequence(F.lit(0), F.lit(5))))
    up = lambda c: F.call_function("shiftright", c + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("reduction")) - 1, F.col("reduction"))
    return d.select("image_id", "reduction", (up(F.col("w")) - up(F.lit(17))).alias("w"), (up(F.col("h")) - up(F.lit(9))).alias("h"))


@query("component_windows", "SELECT image_id, x0, y0, rw, rh, d, n, x0 // 2 AS cx0, (x0 + rw - 1) // 2 + 1 AS cx1, y0 // 3 AS cy0, (y0 + rh - 1) // 3 + 1 AS cy1 FROM requests")
def component_windows(spark, sf_dir):
    """Region on the reference grid -> window of a component of half the columns and a third of the rows."""
    end = lambda a, n, s: floor_div(F.col(a) + F.col(n) - 1, s) + 1
    return V.requests(spark, sf_dir).select("image_id", "x0", "y0", "rw", "rh", "d", "n", floor_div(F.col("x0"), 2).alias("cx0"), end("x0", "rw", 2).alias("cx1"), floor_div(F.col("y0"), 3).alias("cy0"), end("y0", "rh", 3).alias("cy1"))


@query("destination_window", "SELECT image_id, x0, y0, rw, rh, d, n, greatest(0, ceil((256 - x0) / 3.0))::BIGINT AS from_x, least(rw // 3 - 1, floor((256 + 255 - x0) / 3.0))::BIGINT AS to_x FROM requests")
def destination_window(spark, sf_dir):
    """Destination columns that the tile at 256..511 fills when every third pixel is read."""
    first, last = F.ceil((256 - F.col("x0")) / 3.0), F.floor((511 - F.col("x0")) / 3.0)
    return V.requests(spark, sf_dir).select("image_id", "x0", "y0", "rw", "rh", "d", "n", F.greatest(F.lit(0), first).cast("long").alias("from_x"), F.least(floor_div(F.col("rw"), 3) - 1, last).cast("long").alias("to_x"))


# Output pixel (x, y) reads this source column and row, for a W x H source (1..8).
def orient(k: int, x: Column, y: Column, w: int, h: int) -> tuple[Column, Column]:
    """Source coordinates of an output pixel under orientation k; 5 to 8 swap the sides."""
    flip_x, flip_y = lambda c: w - 1 - c, lambda c: h - 1 - c
    return {1: (x, y), 2: (flip_x(x), y), 3: (flip_x(x), flip_y(y)), 4: (x, flip_y(y)), 5: (y, x), 6: (y, flip_y(x)), 7: (flip_x(y), flip_y(x)), 8: (flip_x(y), x)}[k]


_ORIENT = {1: "x, y", 2: "63 - x, y", 3: "63 - x, 63 - y", 4: "x, 63 - y", 5: "y, x", 6: "63 - y, x", 7: "63 - y, 63 - x", 8: "y, 63 - x"}


@query("orientation_1_to_8", " UNION ALL ".join(f"SELECT image_id, {k} AS orientation, nx::INT AS x, ny::INT AS y, v FROM (SELECT image_id, v, {' AS nx, '.join(_ORIENT[k].split(', '))} AS ny FROM raster WHERE image_id IN (SELECT image_id FROM raster GROUP BY 1 HAVING count(*) = 4096))" for k in range(1, 9)))
def orientation_1_to_8(spark, sf_dir):
    """All orientations of the full images: each source pixel is sent to its place, without a join."""
    d = V.planes(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("image_id"))).filter(f"n = {V.SIDE}")
    d = V.pixels(d)
    n = V.SIDE - 1
    place = {1: ("x", "y"), 2: (n - F.col("x"), "y"), 3: (n - F.col("x"), n - F.col("y")), 4: ("x", n - F.col("y")), 5: ("y", "x"), 6: (n - F.col("y"), "x"), 7: (n - F.col("y"), n - F.col("x")), 8: ("y", n - F.col("x"))}
    col = lambda c: F.col(c) if isinstance(c, str) else c
    options = F.array(*(F.struct(F.lit(k).alias("orientation"), col(x).alias("nx"), col(y).alias("ny")) for k, (x, y) in place.items()))
    return d.select("image_id", "v", F.inline(options)).select("image_id", "orientation", F.col("nx").alias("x"), F.col("ny").alias("y"), "v")


@query("missing_tiles_anti", f"SELECT image_id, count(*) AS missing, min(tile) AS first_missing FROM ({_TILES}) t WHERE level = 0 AND NOT EXISTS (SELECT 1 FROM requests r WHERE r.image_id = t.image_id AND t.x0 < r.x0 + rw AND t.x1 > r.x0 AND t.y0 < r.y0 + rh AND t.y1 > r.y0) GROUP BY image_id")
def missing_tiles_anti(spark, sf_dir):
    """Tiles that no request touched: how many of each image, and the first.

    Only touched tiles are made, and merged to one set an image before they are
    shuffled; a set has no more members than its image has tiles.  The first gap of
    the sorted set is the first place at which another number stands.
    """
    levels = V.levels(spark, sf_dir).filter("level = 0")
    number = F.col("ty") * ceil_div(F.col("w"), TILE) + F.col("tx")
    seen = request_tiles(V.requests(spark, sf_dir), levels).groupBy("image_id").agg(F.sort_array(F.collect_set(number)).alias("seen"))
    d = levels.withColumn("tiles", ceil_div(F.col("w"), TILE) * ceil_div(F.col("h"), TILE)).join(seen, "image_id", "left")
    touched = F.when(F.col("seen").isNull(), 0).otherwise(F.size("seen")).cast("long")
    gap = F.array_min(F.transform("seen", lambda v, i: F.when(v != i, i.cast("long"))))
    d = d.select("image_id", (F.col("tiles") - touched).alias("missing"), F.coalesce(gap, touched).alias("first_missing"))
    return d.filter("missing > 0")


@query("background_fill", f"SELECT t.image_id, tile, coalesce(v, 255) AS v FROM ({_TILES}) t LEFT JOIN (SELECT o_orderkey AS image_id, max(l_partkey % 255)::INT AS v, 0::BIGINT AS tx FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) s ON s.image_id = t.image_id AND s.tx = t.tx WHERE level = 3")
def background_fill(spark, sf_dir):
    """Tiles without data are painted with the background value."""
    data = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.max(F.col("l_partkey") % 255).cast("int").alias("v")).withColumn("tx", F.lit(0).cast("long"))
    return tiles(V.levels(spark, sf_dir).filter("level = 3")).join(data, ["image_id", "tx"], "left").select("image_id", "tile", F.coalesce("v", F.lit(255)).alias("v"))


@query("background_fill_levels", f"SELECT t.image_id, level, tile, coalesce(v, 255) AS v FROM ({_TILES}) t LEFT JOIN (SELECT o_orderkey AS image_id, max(l_partkey % 255)::INT AS v, 0::BIGINT AS tx FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) s ON s.image_id = t.image_id AND s.tx = t.tx")
def background_fill_levels(spark, sf_dir):
    """Tiles without data are painted with the background value, on all levels."""
    data = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.max(F.col("l_partkey") % 255).cast("int").alias("v")).withColumn("tx", F.lit(0).cast("long"))
    return tiles(V.levels(spark, sf_dir)).join(data, ["image_id", "tx"], "left").select("image_id", "level", "tile", F.coalesce("v", F.lit(255)).alias("v"))


@query("style_precedence_coalesce", "SELECT o.o_orderkey, c.c_custkey, coalesce(t.l_quantity, CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice END, CASE WHEN c.c_custkey % 2 = 0 THEN c.c_acctbal END, n.n_nationkey::DOUBLE) AS style FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) t ON t.l_orderkey = o.o_orderkey")
def style_precedence_coalesce(spark, sf_dir):
    """Four sources in order of precedence: tile component, tile, main component, main."""
    own = V.table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("own"))
    c = V.table(spark, sf_dir, "customer")
    d = V.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(own, "o_orderkey", "left")
    style = F.coalesce("own", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")), F.col("n_nationkey").cast("double"))
    return d.select("o_orderkey", "c_custkey", style.alias("style"))


@query("level_enforce", "SELECT image_id, level, CASE WHEN w <= 262144 AND h <= 262144 AND w * h * 16 <= 268435456 AND image_id % 7 <= 4 AND 8 + image_id % 13 <= 16 THEN 5 WHEN w <= 1073741824 AND h <= 1073741824 AND w * h * 16 <= 1099511627776 AND image_id % 7 <= 256 AND 8 + image_id % 13 <= 32 THEN 10 ELSE -1 END AS required FROM levels")
def level_enforce(spark, sf_dir):
    """Codestream level that size, extra channels and depth ask for."""
    d = V.levels(spark, sf_dir)
    side, area, extra, bits = F.greatest("w", "h"), F.col("w") * F.col("h") * 16, F.col("image_id") % 7, 8 + F.col("image_id") % 13
    within = lambda s, a, e, b: (side <= s) & (area <= a) & (extra <= e) & (bits <= b)
    return d.select("image_id", "level", F.when(within(1 << 18, 1 << 28, 4, 16), 5).when(within(1 << 30, 1 << 40, 256, 32), 10).otherwise(-1).alias("required"))


@query("memory_budget_reject", "SELECT image_id, level, w * h * 3 * 4 AS bytes FROM levels WHERE w * h * 3 * 4 > 104857600")
def memory_budget_reject(spark, sf_dir):
    size = F.col("w") * F.col("h") * 3 * 4
    return V.levels(spark, sf_dir).filter(size > 100 << 20).select("image_id", "level", size.alias("bytes"))


@query("structural_caps", "SELECT image_id, level, CASE WHEN w > 4096 THEN 'width' WHEN h > 4096 THEN 'height' WHEN ((w + 255) // 256) * ((h + 255) // 256) > 200 THEN 'tiles' END AS reason FROM levels WHERE w > 4096 OR h > 4096 OR ((w + 255) // 256) * ((h + 255) // 256) > 200")
def structural_caps(spark, sf_dir):
    n = ceil_div(F.col("w"), TILE) * ceil_div(F.col("h"), TILE)
    reason = F.when(F.col("w") > 4096, "width").when(F.col("h") > 4096, "height").when(n > 200, "tiles")
    return V.levels(spark, sf_dir).select("image_id", "level", reason.alias("reason")).filter("reason is not null")


@query("level_kind", "SELECT event_id, CASE WHEN value > 20 AND user_id % 5 = 0 THEN 'level' WHEN value > 20 THEN 'focus' ELSE 'associated' END AS kind, CASE user_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'raw' WHEN 2 THEN 'jpeg2000' ELSE 'unreadable' END AS codec FROM events")
def level_kind(spark, sf_dir):
    """Directories by lens and focal plane, and codecs by code; unknown codes stay describable."""
    d = V.table(spark, sf_dir, "events")
    codecs = F.create_map(*(F.lit(x) for kv in ((0, "jpeg"), (1, "raw"), (2, "jpeg2000")) for x in kv))
    lens = F.col("value") > 20
    return d.select("event_id", F.when(lens & (F.col("user_id") % 5 == 0), "level").when(lens, "focus").otherwise("associated").alias("kind"), F.coalesce(F.try_element_at(codecs, (F.col("user_id") % 4).cast("int")), F.lit("unreadable")).alias("codec"))


PACKETS = {"lrcp": ("layer", "res", "comp", "prec"), "rlcp": ("res", "layer", "comp", "prec"), "rpcl": ("res", "py", "px", "comp", "layer"), "pcrl": ("py", "px", "comp", "res", "layer"), "cprl": ("comp", "py", "px", "res", "layer")}


def packets(customers: DataFrame) -> DataFrame:
    """Packets of a tile for each customer: 2 layers, 3 resolutions, 3 components, and a precinct grid that grows with resolution."""
    d = customers.select(F.col("c_custkey").alias("image_id"))
    for name, n in (("layer", 2), ("res", 3), ("comp", 3)):
        d = d.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = F.call_function("shiftleft", F.lit(1), F.col("res"))
    d = d.withColumn("prec", F.explode(F.sequence(F.lit(0), side * side - 1)))
    step = F.call_function("shiftright", F.lit(256), F.col("res"))
    return d.withColumn("px", F.col("prec") % side * step).withColumn("py", F.floor(F.col("prec") / side).cast("int") * step)


_PACKETS = "SELECT *, (prec % (1 << res)) * (256 >> res) AS px, (prec // (1 << res)) * (256 >> res) AS py FROM (SELECT image_id, layer, res, comp, unnest(range((1 << res) * (1 << res)))::INT AS prec FROM (SELECT c_custkey AS image_id FROM customer), (SELECT unnest(range(2))::INT AS layer), (SELECT unnest(range(3))::INT AS res), (SELECT unnest(range(3))::INT AS comp))"
for _name, _order in PACKETS.items():

    def _ordered(spark, sf_dir, order=_order):
        w = Window.partitionBy("image_id").orderBy(*order)
        return packets(V.table(spark, sf_dir, "customer")).select("image_id", "layer", "res", "comp", "prec", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))

    query(f"packet_order_{_name}", f"SELECT image_id, layer, res, comp, prec, row_number() OVER (PARTITION BY image_id ORDER BY {', '.join(_order)}) - 1 AS ordinal FROM ({_PACKETS})")(_ordered)


@query("packet_once_dedup", f"WITH p AS ({_PACKETS}), s AS (SELECT *, 0 AS segment FROM p WHERE res < 2 UNION ALL SELECT *, 1 FROM p WHERE comp < 2), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, layer, res, comp, prec ORDER BY segment) AS seen FROM s) SELECT image_id, layer, res, comp, prec, segment, row_number() OVER (PARTITION BY image_id ORDER BY segment, layer, res, comp, prec) - 1 AS ordinal FROM k WHERE seen = 1")
def packet_once_dedup(spark, sf_dir):
    """Two progression segments that overlap; a packet is emitted by the first."""
    p = packets(V.table(spark, sf_dir, "customer"))
    both = p.filter("res < 2").withColumn("segment", F.lit(0)).unionByName(p.filter("comp < 2").withColumn("segment", F.lit(1)))
    first = both.groupBy("image_id", "layer", "res", "comp", "prec").agg(F.min("segment").alias("segment"))
    w = Window.partitionBy("image_id").orderBy("segment", "layer", "res", "comp", "prec")
    return first.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


@query("geometry_bands", "WITH b AS (SELECT image_id, w, h, nb, o[1]::INT AS xo, o[2]::INT AS yo FROM levels, (SELECT unnest(range(1, 4))::INT AS nb), (SELECT unnest([[1, 0], [0, 1], [1, 1]]) AS o) WHERE level = 1), g AS (SELECT image_id, nb, xo, yo, ((17 - xo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb)::BIGINT AS x0, ((9 - yo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb)::BIGINT AS y0, (w - xo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb AS x1, (h - yo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb AS y1 FROM b) SELECT image_id, nb, xo, yo, x0, y0, x1, y1, ((x1 + 63) >> 6) - (x0 >> 6) AS blocks_x, ((y1 + 63) >> 6) - (y0 >> 6) AS blocks_y, xo + yo AS gain FROM g")
def geometry_bands(spark, sf_dir):
    """Sub-band rectangles of three decomposition levels, and their 64 x 64 code-block grids."""
    d = V.levels(spark, sf_dir).filter("level = 1").withColumn("nb", F.explode(F.sequence(F.lit(1), F.lit(3))))
    d = d.select("image_id", "w", "h", "nb", F.inline(F.array(*(F.struct(F.lit(x).alias("xo"), F.lit(y).alias("yo")) for x, y in ((1, 0), (0, 1), (1, 1))))))
    one = F.lit(1).cast("long")
    shl, shr = lambda a, n: F.call_function("shiftleft", a, n), lambda a, n: F.call_function("shiftright", a, n)
    edge = lambda c, o: shr(c - F.col(o) * shl(one, F.col("nb") - 1) + shl(one, F.col("nb")) - 1, F.col("nb"))
    d = d.select("image_id", "nb", "xo", "yo", edge(F.lit(17).cast("long"), "xo").alias("x0"), edge(F.lit(9).cast("long"), "yo").alias("y0"), edge(F.col("w"), "xo").alias("x1"), edge(F.col("h"), "yo").alias("y1"))
    blocks = lambda a, b: F.shiftright(F.col(b) + 63, 6) - F.shiftright(F.col(a), 6)
    return d.select("*", blocks("x0", "x1").alias("blocks_x"), blocks("y0", "y1").alias("blocks_y"), (F.col("xo") + F.col("yo")).alias("gain"))


@query("geometry_bands_levels", "WITH b AS (SELECT image_id, level, w, h, nb, o[1]::INT AS xo, o[2]::INT AS yo FROM levels, (SELECT unnest(range(1, 4))::INT AS nb), (SELECT unnest([[1, 0], [0, 1], [1, 1]]) AS o)), g AS (SELECT image_id, level, nb, xo, yo, ((17 - xo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb)::BIGINT AS x0, ((9 - yo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb)::BIGINT AS y0, (w - xo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb AS x1, (h - yo * (1 << (nb - 1)) + (1 << nb) - 1) >> nb AS y1 FROM b) SELECT image_id, level, nb, xo, yo, x0, y0, x1, y1, ((x1 + 63) >> 6) - (x0 >> 6) AS blocks_x, ((y1 + 63) >> 6) - (y0 >> 6) AS blocks_y, xo + yo AS gain FROM g")
def geometry_bands_levels(spark, sf_dir):
    """Sub-band rectangles of three decomposition levels of every level of the pyramid, and their 64 x 64 code-block grids."""
    d = V.levels(spark, sf_dir).withColumn("nb", F.explode(F.sequence(F.lit(1), F.lit(3))))
    d = d.select("image_id", "level", "w", "h", "nb", F.inline(F.array(*(F.struct(F.lit(x).alias("xo"), F.lit(y).alias("yo")) for x, y in ((1, 0), (0, 1), (1, 1))))))
    one = F.lit(1).cast("long")
    shl, shr = lambda a, n: F.call_function("shiftleft", a, n), lambda a, n: F.call_function("shiftright", a, n)
    edge = lambda c, o: shr(c - F.col(o) * shl(one, F.col("nb") - 1) + shl(one, F.col("nb")) - 1, F.col("nb"))
    d = d.select("image_id", "level", "nb", "xo", "yo", edge(F.lit(17).cast("long"), "xo").alias("x0"), edge(F.lit(9).cast("long"), "yo").alias("y0"), edge(F.col("w"), "xo").alias("x1"), edge(F.col("h"), "yo").alias("y1"))
    blocks = lambda a, b: F.shiftright(F.col(b) + 63, 6) - F.shiftright(F.col(a), 6)
    return d.select("*", blocks("x0", "x1").alias("blocks_x"), blocks("y0", "y1").alias("blocks_y"), (F.col("xo") + F.col("yo")).alias("gain"))


@query(
    "render_region",
    _BEST.strip().replace("SELECT image_id, x0, y0, rw, rh, d, n, level FROM best WHERE k = 1", "SELECT b.image_id, r.image_id AS plane, level, count(*) AS pixels, round(avg(v)::DOUBLE, 6) AS mean, max(v) AS peak FROM best b JOIN raster r ON r.image_id = b.image_id % 7 AND r.y >= b.y0 % 48 AND r.y < b.y0 % 48 + 16 AND r.x >= b.x0 % 48 AND r.x < b.x0 % 48 + 16 AND (r.y - b.y0 % 48) % 2 = 0 AND (r.x - b.x0 % 48) % 2 = 0 WHERE k = 1 GROUP BY ALL"),
)
def render_region(spark, sf_dir):
    """The minimum slice: best level, region, every second sample, and statistics of what is read."""
    asked = best_level(V.requests(spark, sf_dir), V.levels(spark, sf_dir)).select("image_id", (F.col("image_id") % 7).alias("plane"), "level", (F.col("x0") % 48).cast("int").alias("rx"), (F.col("y0") % 48).cast("int").alias("ry"))
    asked = asked.withColumn("y", F.explode(F.sequence(F.col("ry"), F.col("ry") + 14, F.lit(2))))
    rows = V.planes(spark, sf_dir).select(F.col("image_id").alias("plane"), "y", "row")
    read = asked.join(rows, ["plane", "y"])
    values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("row", F.col("rx") + 2 * i))
    v = read.select("image_id", "plane", "level", F.explode(values).alias("v"))
    return v.groupBy("image_id", "plane", "level").agg(F.count("*").alias("pixels"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("peak"))


@query(
    "render_region_whole",
    _BEST.strip().replace(
        "SELECT image_id, x0, y0, rw, rh, d, n, level FROM best WHERE k = 1",
        """, sides AS (SELECT image_id AS plane, max(x) + 1 AS pw, max(y) + 1 AS ph FROM raster GROUP BY ALL),
asked AS (SELECT image_id, level, plane, x0 % pw AS rx, y0 % ph AS ry, rw, rh, ((1 << level) * greatest(1, floor(d / (1 << level))))::INT AS step FROM best JOIN sides ON plane = image_id % (SELECT max(plane) + 1 FROM sides) WHERE k = 1)
SELECT a.image_id, plane, level, count(*) AS pixels, round(avg(v)::DOUBLE, 6) AS mean, max(v) AS peak FROM asked a JOIN raster r ON r.image_id = plane AND r.y >= ry AND r.y < ry + rh AND r.x >= rx AND r.x < rx + rw AND (r.y - ry) % step = 0 AND (r.x - rx) % step = 0 GROUP BY ALL""",
    ),
)
def render_region_whole(spark, sf_dir):
    """The minimum slice on all planes: best level, the region in its own size clipped to the plane, and statistics of what is read.

    The step is the level's scale times the whole part of what is left of the downsample.
    """
    rows = V.planes(spark, sf_dir).select(F.col("image_id").alias("plane"), "y", "row")
    sides = rows.groupBy("plane").agg(F.max(F.size("row")).alias("pw"), (F.max("y") + 1).alias("ph"))
    asked = best_level(V.requests(spark, sf_dir), V.levels(spark, sf_dir)).crossJoin(F.broadcast(sides.agg((F.max("plane") + 1).alias("planes"))))
    asked = asked.withColumn("plane", F.col("image_id") % F.col("planes")).join(sides, "plane")
    scale = F.call_function("shiftleft", F.lit(1), F.col("level"))
    asked = asked.select("image_id", "plane", "level", "rw", "rh", "pw", "ph", (F.col("x0") % F.col("pw")).alias("rx"), (F.col("y0") % F.col("ph")).alias("ry"), (scale * F.greatest(F.lit(1), F.floor(F.col("d") / scale))).cast("int").alias("step"))
    inside = lambda at, size, side: F.sequence(F.col(at).cast("int"), (F.least(F.col(at) + F.col(size), F.col(side)) - 1).cast("int"), F.col("step"))
    asked = asked.select("image_id", "plane", "level", inside("rx", "rw", "pw").alias("xs"), F.explode(inside("ry", "rh", "ph")).alias("y"))
    read = asked.join(rows, ["plane", "y"]).withColumn("vs", F.transform("xs", lambda x: F.get("row", x)))
    of_row = read.select("image_id", "plane", "level", F.size("vs").alias("n"), F.aggregate("vs", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("vs").alias("peak"))
    out = of_row.groupBy("image_id", "plane", "level").agg(F.sum("n").alias("pixels"), F.sum("total").alias("total"), F.max("peak").alias("peak"))
    return out.select("image_id", "plane", "level", "pixels", F.round(F.col("total") / F.col("pixels"), 6).alias("mean"), "peak")
