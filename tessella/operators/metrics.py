"""Queries of quality metrics and encoder-side statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import colour as C
from tessella.functions import samples as S
from tessella.functions.arrays import let
from tessella.plans import views as V
from tessella.registry import query

#: A degraded copy of the raster: the two low bits are dropped.
_REF = "(v - v % 4)"


def reference(v):
    return v - v % 4


@query("rmse_peak", f"SELECT image_id, max(abs(v - {_REF})) AS peak, round(sqrt(avg(((v - {_REF}) * (v - {_REF}))::DOUBLE)), 6) AS rmse FROM raster GROUP BY image_id")
def rmse_peak(spark, sf_dir):
    d = F.col("v") - reference(F.col("v"))
    return V.raster(spark, sf_dir).groupBy("image_id").agg(F.max(F.abs(d)).alias("peak"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


@query("conformance_limits", f"WITH m AS (SELECT image_id, max(abs(v - {_REF})) AS peak, avg(((v - {_REF}) * (v - {_REF}))::DOUBLE) AS mse FROM raster GROUP BY image_id) SELECT image_id, peak, round(mse, 6) AS mse, peak <= 2 + image_id % 2 AND mse <= 3.4 + image_id % 3 * 0.1 AS pass FROM m")
def conformance_limits(spark, sf_dir):
    """Peak and mean squared error against limits of each component."""
    d = F.col("v") - reference(F.col("v"))
    m = V.raster(spark, sf_dir).groupBy("image_id").agg(F.max(F.abs(d)).alias("peak"), F.avg(d * d).alias("mse"))
    return m.select("image_id", "peak", F.round("mse", 6).alias("mse"), ((F.col("peak") <= 2 + F.col("image_id") % 2) & (F.col("mse") <= 3.4 + F.col("image_id") % 3 * 0.1)).alias("pass"))


@query("weighted_mae", "SELECT image_id, round(sum(abs(r - (r - r % 4)) + 2 * abs(g - (g - g % 8)) + abs(b - (b - b % 4)))::DOUBLE / (4 * count(*)) * 255 / 255, 6) AS mae FROM rgb GROUP BY image_id")
def weighted_mae(spark, sf_dir):
    e = F.col("r") % 4 + 2 * (F.col("g") % 8) + F.col("b") % 4
    return V.rgb(spark, sf_dir).groupBy("image_id").agg(F.round(F.sum(e) / (4 * F.count("*")), 6).alias("mae"))


@query("pnorm_pool", "SELECT image_id, round(pow(avg(pow((v % 4) / 255.0::DOUBLE / (1 + 14 * abs(v - 128) / 255.0::DOUBLE), 3)), 1 / 3.0::DOUBLE) * 30, 6) AS distance FROM raster GROUP BY image_id")
def pnorm_pool(spark, sf_dir):
    """Cubic mean of errors masked by contrast, times 30."""
    e = F.col("v") % 4 / 255.0 / (1 + 14 * F.abs(F.col("v") - 128) / 255.0)
    return V.raster(spark, sf_dir).groupBy("image_id").agg(F.round(F.pow(F.avg(F.pow(e, F.lit(3))), F.lit(1 / 3)) * 30, 6).alias("distance"))


@query("channel_mean_depth", "SELECT image_id, sum(v)::BIGINT // count(*) AS mean, max(length(bin(v)))::INT AS depth FROM raster GROUP BY image_id")
def channel_mean_depth(spark, sf_dir):
    return V.raster(spark, sf_dir).groupBy("image_id").agg(S.floor_div(F.sum("v"), F.count("*")).alias("mean"), F.max(S.bit_length(F.col("v"))).alias("depth"))


_TILES16 = "SELECT image_id, y // 2 AS ty, x // 2 AS tx, string_agg((v // 24)::VARCHAR, ',' ORDER BY y, x) AS content FROM raster GROUP BY ALL"


@query("duplicate_tiles", f"SELECT content, count(*) AS n, min(image_id * 10000 + ty * 100 + tx) AS first_tile FROM ({_TILES16}) GROUP BY content HAVING count(*) >= 3")
def duplicate_tiles(spark, sf_dir):
    """2 x 2 tiles of coarse samples that occur at least three times, keyed by content."""
    rows = V.planes(spark, sf_dir).withColumn("ty", F.expr("y div 2"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(V.SIDE // 2 - 1)), lambda t: F.struct(t.alias("tx"), F.transform(F.slice("row", t * 2 + 1, 2), lambda v: F.floor(v / 24)).alias("part")))
    parts = rows.select("image_id", "ty", "y", F.inline(cut))
    tiles = parts.groupBy("image_id", "ty", "tx").agg(F.array_join(F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("y", "part"))), lambda s: s["part"])), lambda v: v.cast("string")), ",").alias("content"))
    return tiles.groupBy("content").agg(F.count("*").alias("n"), F.min(F.col("image_id") * 10000 + F.col("ty") * 100 + F.col("tx")).alias("first_tile")).filter("n >= 3")


_COLOUR = "(r // 32)::BIGINT + (g // 32)::BIGINT * 65536 + (b // 32)::BIGINT * 4294967296"


@query("palette_detect", f"WITH c AS (SELECT image_id, {_COLOUR} AS colour, 3 * (r // 32) + 6 * (g // 32) + (b // 32) AS luma FROM rgb), k AS (SELECT image_id, count(DISTINCT colour) AS colours, count(*) AS n FROM c GROUP BY 1) SELECT c.image_id, colour, count(*) AS pixels, (dense_rank() OVER (PARTITION BY c.image_id ORDER BY luma, colour) - 1)::INT AS place FROM c JOIN k USING (image_id) WHERE colours BETWEEN 2 AND 1024 AND colours < n / 4 GROUP BY c.image_id, colour, luma")
def palette_detect(spark, sf_dir):
    """Distinct colours of images that have 2 to 1024 and fewer than a quarter of their pixels, in order of brightness."""
    q = lambda c: F.floor(F.col(c) / 32).cast("long")
    d = V.rgb(spark, sf_dir).select("image_id", (q("r") + q("g") * 65536 + q("b") * (1 << 32)).alias("colour"), (3 * q("r") + 6 * q("g") + q("b")).alias("luma"))
    counts = d.groupBy("image_id", "colour", "luma").agg(F.count("*").alias("pixels"))
    w = Window.partitionBy("image_id")
    counts = counts.withColumn("colours", F.count("*").over(w)).withColumn("n", F.sum("pixels").over(w)).filter("colours between 2 and 1024 and colours < n / 4")
    return counts.select("image_id", "colour", "pixels", (F.dense_rank().over(w.orderBy("luma", "colour")) - 1).alias("place"))


@query("palette_lookup_join", "SELECT image_id, y, x, p_size AS v FROM raster JOIN (SELECT p_partkey, p_size FROM part WHERE p_partkey <= 180) ON p_partkey = least(greatest(v, 1), 180)")
def palette_lookup_join(spark, sf_dir):
    """Sample -> palette entry, index clamped; the palette is at most 180 rows and broadcast."""
    palette = V.table(spark, sf_dir, "part").filter("p_partkey <= 180").select("p_partkey", "p_size")
    d = V.raster(spark, sf_dir).withColumn("at", F.least(F.greatest("v", F.lit(1)), F.lit(180)))
    return d.join(F.broadcast(palette), F.col("at") == F.col("p_partkey")).select("image_id", "y", "x", F.col("p_size").alias("v"))


_PACK = "CASE WHEN {0} >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END"
_GRAD = "CASE WHEN nw < least(n, w) THEN greatest(n, w) WHEN nw > greatest(n, w) THEN least(n, w) ELSE n + w - nw END"


def tokens(spark, sf_dir):
    """Bit length of each packed gradient residual, with the row's context."""
    d = V.around(spark, sf_dir)
    r = F.col("v") - S.clamped_gradient(F.col("n"), F.col("w"), F.col("nw"))
    return d.select("image_id", F.expr("cast(y div 16 as int)").alias("ctx"), S.bit_length(S.zigzag_pack(r)).alias("token"))


_TOKENS = f"SELECT image_id, (y // 16)::INT AS ctx, CASE WHEN p = 0 THEN 0 ELSE length(bin(p)) END::INT AS token FROM (SELECT image_id, y, {_PACK.format(f'(v - ({_GRAD}))')} AS p FROM around)"


@query("symbol_histogram", f"SELECT image_id, ctx, token, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL")
def symbol_histogram(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("image_id", "ctx", "token").agg(F.count("*").alias("n"))


@query("histogram_entropy_bits", f"WITH h AS (SELECT image_id, ctx, token, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY image_id, ctx)::DOUBLE AS total FROM h) SELECT image_id, ctx, round(sum(n * log2(total / n)), 5) AS bits FROM t GROUP BY ALL")
def histogram_entropy_bits(spark, sf_dir):
    h = tokens(spark, sf_dir).groupBy("image_id", "ctx", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id", "ctx")
    h = h.withColumn("total", F.sum("n").over(w))
    return h.groupBy("image_id", "ctx").agg(F.round(F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))), 5).alias("bits"))


def _cost_sql(c: str) -> str:
    """Bits of packed horizontal differences of a channel expression."""
    return f"sum(length(bin(CASE WHEN {c} - coalesce({c}_w, 0) >= 0 THEN 2 * ({c} - coalesce({c}_w, 0)) ELSE -2 * ({c} - coalesce({c}_w, 0)) - 1 END + 1)))"


def _rct_sql(kind: int) -> tuple[str, str, str]:
    a, b, c = ("rgb"[i] for i in C.RCT_ORDERS[kind // 7])
    return {
        0: (a, b, c),
        1: (a, b, f"{c} - {a}"),
        2: (a, f"{b} - {a}", c),
        3: (a, f"{b} - {a}", f"{c} - {a}"),
        4: (a, f"{b} - (({a} + {c}) >> 1)", c),
        5: (a, f"{b} - {a} - (({c} - {a}) >> 1)", f"{c} - {a}"),
        6: (f"{c} + (({a} - {c}) >> 1) + (({b} - ({c} + (({a} - {c}) >> 1))) >> 1)", f"{a} - {c}", f"{b} - ({c} + (({a} - {c}) >> 1))"),
    }[kind % 7]


_RCT = (
    "WITH k AS ("
    + " UNION ALL ".join("SELECT image_id, y, x, {k} AS kind, {0} AS c0, {1} AS c1, {2} AS c2 FROM rgb".format(*_rct_sql(k), k=k) for k in range(42))
    + f"), d AS (SELECT *, {', '.join(f'lag({c}) OVER o AS {c}_w' for c in ('c0', 'c1', 'c2'))} FROM k WINDOW o AS (PARTITION BY image_id, kind, y ORDER BY x)), s AS (SELECT image_id, kind, ({' + '.join(map(_cost_sql, ('c0', 'c1', 'c2')))})::BIGINT AS cost FROM d GROUP BY ALL) SELECT image_id, kind::INT AS kind, cost, (row_number() OVER (PARTITION BY image_id ORDER BY cost, kind) = 1) AS best FROM s"
)


@query("rct42_cost_argmin", _RCT)
def rct42_cost_argmin(spark, sf_dir):
    """Cost of every reversible transform of an image, and the cheapest; all 42 in one pass over image rows."""
    d = V.rgb_rows(spark, sf_dir).select("image_id", "r", "g", "b")
    s = d.mapInArrow(_rct_costs, "image_id long, kind int, cost long").groupBy("image_id", "kind").agg(F.sum("cost").alias("cost"))
    w = Window.partitionBy("image_id").orderBy("cost", "kind")
    return s.select("image_id", "kind", "cost", (F.row_number().over(w) == 1).alias("best"))


def _rct_costs(batches):
    """(image_id, kind, cost) of the rows of each batch: bits of the packed differences from the left neighbour."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, image = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        lengths = pc.list_value_length(batch.column(1)).to_numpy()
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        planes = tuple(batch.column(c).flatten().to_numpy().astype(np.int64) for c in (1, 2, 3))
        image = np.repeat(image, lengths)

        def cost(z):
            step = np.diff(z, prepend=0)
            step[starts] = z[starts]
            packed = np.where(step >= 0, 2 * step, -2 * step - 1)
            # the exponent is the number of bits
            return np.bincount(image, np.frexp((packed + 1).astype(np.float64))[1], len(ids)).astype(np.int64)

        costs = np.stack([sum(cost(z) for z in C.forward_rct42(kind, planes)) for kind in range(42)], axis=1)
        kinds = np.tile(np.arange(42, dtype=np.int32), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 42)), pa.array(kinds), pa.array(costs.ravel())], ["image_id", "kind", "cost"])


@query("rct42_round_trip", "SELECT image_id, count(*) * 42 AS samples, 0::BIGINT AS wrong FROM rgb GROUP BY image_id")
def rct42_round_trip(spark, sf_dir):
    """Every type applied and undone: no sample may differ."""
    d = V.rgb(spark, sf_dir)
    rgb = tuple(F.col(c) for c in "rgb")
    bad = F.lit(0)
    for kind in range(42):
        back = C.inverse_rct42(kind, C.forward_rct42(kind, rgb))
        bad = bad + F.when((back[0] == rgb[0]) & (back[1] == rgb[1]) & (back[2] == rgb[2]), 0).otherwise(1)
    return d.groupBy("image_id").agg((F.count("*") * 42).alias("samples"), F.sum(bad).alias("wrong"))


@query("activity_cells", """WITH t AS (SELECT image_id, y, x, v, coalesce(lag(v) OVER c, v) AS u, coalesce(lead(v) OVER c, v) AS d FROM raster WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
s AS (SELECT *, coalesce(lag(v) OVER o, v) AS l, coalesce(lead(v) OVER o, v) AS r FROM t WINDOW o AS (PARTITION BY image_id, y ORDER BY x))
SELECT image_id, (y // 8)::INT AS cy, (x // 8)::INT AS cx, round(avg(abs(4 * v - u - d - l - r)), 6) AS activity FROM s GROUP BY ALL""")
def activity_cells(spark, sf_dir):
    """Mean absolute Laplacian of each 8 x 8 cell, edges repeated."""
    from tessella.operators.stencils import _edge, rows_around

    rows = rows_around(spark, sf_dir)
    lap = F.transform("row", lambda v, x: F.abs(4 * v - F.get("up", x) - F.get("down", x) - _edge("row", x - 1) - _edge("row", x + 1)))
    cells = V.pixels(rows.withColumn("row", lap), name="a")
    return cells.groupBy("image_id", F.expr("cast(y div 8 as int)").alias("cy"), F.expr("cast(x div 8 as int)").alias("cx")).agg(F.round(F.avg("a"), 6).alias("activity"))


@query("cfl_regression", "WITH t AS (SELECT image_id, count(*) AS n, sum(g)::DOUBLE AS sy, sum(r - g)::DOUBLE AS sc, sum(g * g)::DOUBLE AS syy, sum(g * (r - g))::DOUBLE AS syc FROM rgb GROUP BY image_id) SELECT image_id, CASE WHEN syy - sy * sy / n <= 1e-9 THEN 0 ELSE least(greatest(floor(84 * (syc - sy * sc / n) / (syy - sy * sy / n) + 0.5), -128), 127) END::INT AS factor FROM t")
def cfl_regression(spark, sf_dir):
    """Least-squares factor of a chroma channel on luma for each 64 x 64 tile."""
    y, c = F.col("g"), F.col("r") - F.col("g")
    t = V.rgb(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("sy"), F.sum(c).cast("double").alias("sc"), F.sum(y * y).cast("double").alias("syy"), F.sum(y * c).cast("double").alias("syc"))
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    slope = 84 * (F.col("syc") - F.col("sy") * F.col("sc") / F.col("n")) / spread
    return t.select("image_id", F.when(spread <= 1e-9, 0).otherwise(C.clamp(C.half_up(slope), -128, 127)).alias("factor"))


@query("quadtree_min_tagtree", " UNION ALL ".join(f"SELECT image_id, {k} AS level, (y >> {k})::INT AS y, (x >> {k})::INT AS x, min(v) AS v FROM raster GROUP BY ALL" for k in range(1, 7)))
def quadtree_min_tagtree(spark, sf_dir):
    """Minimum of each quad at six levels, in one aggregation."""
    d = V.raster(spark, sf_dir)
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("y", k).alias("qy"), F.shiftright("x", k).alias("qx")) for k in range(1, 7)))
    return d.select("image_id", "v", F.inline(levels)).groupBy("image_id", "level", F.col("qy").alias("y"), F.col("qx").alias("x")).agg(F.min("v").alias("v"))


@query("blanked_background", f"WITH t AS ({_TILES16}), k AS (SELECT content FROM t GROUP BY content HAVING count(*) >= 3), m AS (SELECT image_id, sum(v)::BIGINT // count(*) AS mean FROM raster GROUP BY 1) SELECT r.image_id, r.y, r.x, CASE WHEN k.content IS NULL THEN r.v ELSE mean END::BIGINT AS v FROM raster r JOIN t ON t.image_id = r.image_id AND t.ty = r.y // 2 AND t.tx = r.x // 2 JOIN m ON m.image_id = r.image_id LEFT JOIN k ON k.content = t.content")
def blanked_background(spark, sf_dir):
    """The image without its repeated tiles, which take the channel's mean."""
    rows = V.planes(spark, sf_dir).withColumn("ty", F.expr("y div 2"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(V.SIDE // 2 - 1)), lambda t: F.struct(t.alias("tx"), F.slice("row", t * 2 + 1, 2).alias("part")))
    tiles = rows.select("image_id", "ty", "y", F.inline(cut)).groupBy("image_id", "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("y", "part"))).alias("rows"))
    coarse = F.array_join(F.transform(F.flatten(F.transform("rows", lambda s: s["part"])), lambda v: F.floor(v / 24).cast("string")), ",")
    tiles = tiles.withColumn("key", F.md5(coarse)).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    mean = V.raster(spark, sf_dir).groupBy("image_id").agg(S.floor_div(F.sum("v"), F.count("*")).alias("mean"))
    out = tiles.join(mean, "image_id").select("image_id", "tx", "n", "mean", F.inline("rows"))
    return out.select("image_id", "y", F.posexplode("part").alias("dx", "s"), "tx", "n", "mean").select("image_id", "y", (F.col("tx") * 2 + F.col("dx")).alias("x"), F.when(F.col("n") >= 3, F.col("mean")).otherwise(F.col("s")).cast("long").alias("v"))
