"""Queries of block transforms: the table of types, coefficient orders, non-zero contexts, choice of a predictor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.operators.images import plane_of
from tessella.plans import views as V
from tessella.registry import query

# Fixed values of the format: type, parameter set, coefficient order, method, height, width.
TYPES = (
    (0, 0, 0, "dct", 8, 8),
    (1, 1, 1, "hornuss", 8, 8),
    (2, 2, 1, "dct2", 8, 8),
    (3, 3, 1, "dct4", 8, 8),
    (4, 4, 2, "dct", 16, 16),
    (5, 5, 3, "dct", 32, 32),
    (6, 6, 4, "dct", 16, 8),
    (7, 6, 4, "dct", 8, 16),
    (8, 7, 5, "dct", 32, 8),
    (9, 7, 5, "dct", 8, 32),
    (10, 8, 6, "dct", 32, 16),
    (11, 8, 6, "dct", 16, 32),
    (12, 9, 1, "dct4x8", 8, 8),
    (13, 9, 1, "dct8x4", 8, 8),
    (14, 10, 1, "afv", 8, 8),
    (15, 10, 1, "afv", 8, 8),
    (16, 10, 1, "afv", 8, 8),
    (17, 10, 1, "afv", 8, 8),
    (18, 11, 7, "dct", 64, 64),
    (19, 12, 8, "dct", 64, 32),
    (20, 12, 8, "dct", 32, 64),
    (21, 13, 9, "dct", 128, 128),
    (22, 14, 10, "dct", 128, 64),
    (23, 14, 10, "dct", 64, 128),
    (24, 15, 11, "dct", 256, 256),
    (25, 16, 12, "dct", 256, 128),
    (26, 16, 12, "dct", 128, 256),
)

_VALUES = ", ".join(str(t) for t in TYPES)
_COLUMNS = "type, parameters, order_id, method, h, w"
#: What stands for an order or a parameter set: the first type that is not upright.
_TABLE = f"""SELECT *, h // 8 * (w // 8) AS cells, h > w OR (method = 'dct' AND h = w) AS flip,
min(CASE WHEN h <= w THEN type END) OVER (PARTITION BY order_id) AS order_type,
min(CASE WHEN h <= w THEN type END) OVER (PARTITION BY parameters) AS parameter_type FROM (VALUES {_VALUES}) AS t({_COLUMNS})"""


def block_types(spark: SparkSession) -> DataFrame:
    """The 27 types of block transforms with all that follows from a type."""
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t({_COLUMNS})").select(
        "*",
        F.expr("cast((h div 8) * (w div 8) as int)").alias("cells"),
        F.expr("h > w OR (method = 'dct' AND h = w)").alias("flip"),
        *(F.min(F.when(F.col("h") <= F.col("w"), F.col("type"))).over(Window.partitionBy(k)).alias(n) for k, n in (("order_id", "order_type"), ("parameters", "parameter_type"))),
    )


@query("block_type_lookup", f"WITH t AS ({_TABLE}) SELECT l_orderkey, l_linenumber, t.* FROM lineitem JOIN t ON t.type = l_partkey % 27")
def block_type_lookup(spark, sf_dir):
    """Size, parameter set and coefficient order of each block by its type; the table has 27 rows."""
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 27).cast("int").alias("type"))
    return rows.join(F.broadcast(block_types(spark)), "type")


_ORDER = f"""WITH o AS (SELECT order_id, h, w, h // 8 AS bh, w // 8 AS bw FROM ({_TABLE}) WHERE type = order_type),
p AS (SELECT *, k // w AS y, k % w AS x FROM (SELECT *, unnest(range(h * w)) AS k FROM o)),
s AS (SELECT *, y < bh AND x < bw AS low, y * greatest(bh, bw) // bh AS sy, x * greatest(bh, bw) // bw AS sx FROM p)
SELECT order_id, y, x, low, row_number() OVER (PARTITION BY order_id ORDER BY low DESC, CASE WHEN low THEN y ELSE sy + sx END, CASE WHEN low THEN x WHEN (sy + sx) % 2 = 1 THEN sy - sx ELSE sx - sy END) - 1 AS place FROM s"""


@query("coefficient_order", _ORDER)
def coefficient_order(spark, sf_dir):
    """Place of each coefficient of the 13 orders: the low ones row by row, then diagonals that change direction."""
    o = block_types(spark).filter("type = order_type")
    p = o.withColumn("k", F.explode(F.expr("sequence(0L, cast(h * w - 1 as bigint))"))).selectExpr("order_id", "h div 8 AS bh", "w div 8 AS bw", "k div w AS y", "k % w AS x")
    s = p.selectExpr("order_id", "y", "x", "y < bh AND x < bw AS low", "y * greatest(bh, bw) div bh AS sy", "x * greatest(bh, bw) div bw AS sx")
    along = F.expr("CASE WHEN low THEN x WHEN (sy + sx) % 2 = 1 THEN sy - sx ELSE sx - sy END")
    order = Window.partitionBy("order_id").orderBy(F.col("low").desc(), F.expr("CASE WHEN low THEN y ELSE sy + sx END"), along)
    return s.select("order_id", "y", "x", "low", (F.row_number().over(order) - 1).cast("long").alias("place"))


#: Clusters of block contexts, and the prediction of a cell without neighbours.
CLUSTERS, ALONE = 15, 32

_NONZERO = f"""WITH c AS (SELECT image_id, y // 8 AS cy, x // 8 AS cx, count(*) FILTER (v % 3 = 0) AS n FROM raster GROUP BY ALL),
t AS (SELECT *, lag(n) OVER (PARTITION BY image_id, cx ORDER BY cy) AS up, lag(n) OVER (PARTITION BY image_id, cy ORDER BY cx) AS side FROM c),
p AS (SELECT *, CASE WHEN up IS NULL THEN coalesce(side, {ALONE}) WHEN side IS NULL THEN up ELSE (up + side + 1) // 2 END AS predicted FROM t)
SELECT image_id, cy::INT AS cy, cx::INT AS cx, n, predicted, image_id % {CLUSTERS} + {CLUSTERS} * CASE WHEN predicted < 8 THEN predicted ELSE 4 + least(predicted, 64) // 2 END AS context FROM p"""


@query("nonzero_context", _NONZERO)
def nonzero_context(spark, sf_dir):
    """Coefficients other than zero of each 8 x 8 cell, predicted from the cells above and to the left, and the context."""
    count = lambda k: F.size(F.filter(F.slice("row", 8 * k + 1, 8), lambda v: v % 3 == 0))
    rows = V.planes(spark, sf_dir).groupBy("image_id", F.expr("cast(y div 8 as int)").alias("cy")).agg(F.array(*(F.sum(count(k)) for k in range(V.SIDE // 8))).alias("row"))
    rows = rows.withColumn("above", F.lag("row").over(Window.partitionBy("image_id").orderBy("cy")))
    cells = rows.select("image_id", "cy", "row", "above", F.posexplode("row").alias("cx", "n"))
    up, side = F.get("above", F.col("cx")), F.when(F.col("cx") > 0, F.get("row", F.col("cx") - 1))
    cells = cells.select("image_id", "cy", "cx", "n", up.alias("up"), side.alias("side"))
    p = cells.withColumn("predicted", F.expr(f"CASE WHEN up IS NULL THEN coalesce(side, {ALONE}) WHEN side IS NULL THEN up ELSE (up + side + 1) div 2 END"))
    context = F.expr(f"image_id % {CLUSTERS} + {CLUSTERS} * CASE WHEN predicted < 8 THEN predicted ELSE 4 + least(predicted, 64) div 2 END")
    return p.select("image_id", "cy", "cx", "n", "predicted", context.alias("context"))


def code_bits(residuals: np.ndarray) -> int:
    """Bits of the packed residuals, each counted up to its highest set bit."""
    packed = np.where(residuals >= 0, 2 * residuals, -2 * residuals - 1)
    return int(np.frexp((packed + 1).astype(np.float64))[1].sum())


def gradient_predictions(p: np.ndarray) -> np.ndarray:
    """The clamped gradient of every sample of a plane from its left, upper and upper left neighbours."""
    left, up = np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], up[1:] = p[:, :-1], p[:-1]
    left[1:, 0] = p[:-1, 0]
    up[0] = left[0]
    corner = left.copy()
    corner[1:, 1:] = p[:-1, :-1]
    return np.clip(left + up - corner, np.minimum(left, up), np.maximum(left, up))


@query("predictor_choice")
def predictor_choice(spark, sf_dir):
    """Bits of the gradient and of the self-correcting predictor (6), which is taken where it saves over 5 %."""

    def run(table: pa.Table) -> pa.Table:
        p = plane_of(table).astype(np.int64)
        plain, own = code_bits(p - gradient_predictions(p)), code_bits(p - blocks.weighted_predictions(p))
        values = (table.column("image_id")[0].as_py(), plain, own, 6 if 20 * own < 19 * plain else 5)
        return pa.table([pa.array([v], pa.int64()) for v in values], names=["image_id", "gradient_bits", "weighted_bits", "predictor"])

    return V.planes(spark, sf_dir).groupBy("image_id").applyInArrow(run, "image_id long, gradient_bits long, weighted_bits long, predictor long")
