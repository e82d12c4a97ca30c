"""Queries of the neighbourhood operators: predictors, lifting, squeeze, filters on image rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessella.functions import samples as S
from tessella.functions.arrays import let
from tessella.functions.colour import clamp
from tessella.plans import views as V
from tessella.registry import query

KEY = ("image_id", "y", "x")

PREDICT_SQL = {
    0: "0",
    1: "w",
    2: "n",
    3: "(w + n) // 2",
    4: "CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END",
    5: "CASE WHEN nw < least(n, w) THEN greatest(n, w) WHEN nw > greatest(n, w) THEN least(n, w) ELSE n + w - nw END",
    7: "ne",
    8: "nw",
    9: "ww",
    10: "(w + nw) // 2",
    11: "(n + nw) // 2",
    12: "(n + ne) // 2",
    13: "(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) // 16",
}


@query("neighbour_context", "SELECT image_id, y, x, v, w, n, nw, ne, nn, nee, ww FROM around")
def neighbour_context(spark, sf_dir):
    return V.around(spark, sf_dir)


@query("predictor_residuals", "SELECT image_id, y, x, " + ", ".join(f"(v - ({sql}))::BIGINT AS r{k}" for k, sql in PREDICT_SQL.items()) + " FROM around")
def predictor_residuals(spark, sf_dir):
    d = V.around(spark, sf_dir)
    near = [F.col(c) for c in ("w", "n", "nw", "ne", "nn", "nee", "ww")]
    return d.select(*KEY, *((F.col("v") - S.predict(k, *near)).cast("long").alias(f"r{k}") for k in PREDICT_SQL))


def mirror(row: Column, i: Column, n: int) -> Column:
    """Sample i with whole-sample mirroring at both ends."""
    j = F.abs(i)
    return F.get(row, F.when(j >= n, 2 * (n - 1) - j).otherwise(j).cast("int"))


def lift(row: Column, n: int, parity: int, step) -> Column:
    """One lifting step on a row: samples of ``parity`` get ``step(own, left + right)``."""
    return let(row, lambda r: F.transform(r, lambda v, i: F.when(i % 2 == parity, step(v, mirror(r, i - 1, n) + mirror(r, i + 1, n))).otherwise(v)))


def forward53(row: Column, n: int) -> Column:
    """Reversible 5/3 analysis of a row at an even origin, interleaved."""
    row = lift(row, n, 1, lambda v, s: v - F.shiftright(s, 1))
    return lift(row, n, 0, lambda v, s: v + F.shiftright(s + 2, 2))


def inverse53(row: Column, n: int) -> Column:
    row = lift(row, n, 0, lambda v, s: v - F.shiftright(s + 2, 2))
    return lift(row, n, 1, lambda v, s: v + F.shiftright(s, 1))


# Fixed values of the irreversible wavelet: the four lifting weights and the scale.
LIFT97 = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971)
SCALE97 = 1.230174104914001


def forward97(row: Column, n: int) -> Column:
    row = F.transform(row, lambda v: v.cast("double"))
    for i, k in enumerate(LIFT97):
        row = lift(row, n, 1 - i % 2, lambda v, s, k=k: v + k * s)
    return F.transform(row, lambda v, i: F.when(i % 2 == 0, v / SCALE97).otherwise(v * SCALE97))


def _lift_sql(source: str, target: str, parity: int, expression: str, order: str = "x", part: str = "image_id, y") -> str:
    """A lifting step as SQL over long rows; e is the sum of the mirrored neighbours."""
    return f"{target} AS (SELECT image_id, y, x, CASE WHEN {order} % 2 = {parity} THEN {expression} ELSE v END AS v FROM (SELECT *, coalesce(lag(v) OVER o, lead(v) OVER o) + coalesce(lead(v) OVER o, lag(v) OVER o) AS e FROM {source} WINDOW o AS (PARTITION BY {part} ORDER BY {order})))"


@query("dwt53_forward_1d", "WITH " + ", ".join([_lift_sql("raster", "s1", 1, "v - (e >> 1)"), _lift_sql("s1", "s2", 0, "v + ((e + 2) >> 2)")]) + " SELECT image_id, y, x, v::INT AS c FROM s2")
def dwt53_forward_1d(spark, sf_dir):
    return V.pixels(V.planes(spark, sf_dir).withColumn("row", forward53(F.col("row"), V.SIDE)), name="c")


@query("dwt53_inverse_1d", "WITH " + ", ".join([_lift_sql("raster", "s1", 0, "v - ((e + 2) >> 2)"), _lift_sql("s1", "s2", 1, "v + (e >> 1)")]) + " SELECT image_id, y, x, v::INT AS c FROM s2")
def dwt53_inverse_1d(spark, sf_dir):
    return V.pixels(V.planes(spark, sf_dir).withColumn("row", inverse53(F.col("row"), V.SIDE)), name="c")


_97 = [_lift_sql("raster" if i == 0 else f"s{i}", f"s{i + 1}", 1 - i % 2, f"v::DOUBLE + ({k!r})::DOUBLE * e") for i, k in enumerate(LIFT97)]


@query("dwt97_lift_1d", "WITH " + ", ".join(_97) + f" SELECT image_id, y, x, round(CASE WHEN x % 2 = 0 THEN v / {SCALE97}::DOUBLE ELSE v * {SCALE97}::DOUBLE END, 6) AS c FROM s4")
def dwt97_lift_1d(spark, sf_dir):
    rows = V.planes(spark, sf_dir).withColumn("row", F.transform(forward97(F.col("row"), V.SIDE), lambda v: F.round(v, 6)))
    return V.pixels(rows, name="c")


def tendency(b: Column, a: Column, n: Column) -> Column:
    """What a smooth signal between the left sample, the average and the next average would differ by."""
    down = S.div(4 * b - 3 * n - a + 6, 12)
    down = F.when(down - F.call_function("mod", down, F.lit(2)) > 2 * (b - a), 2 * (b - a) + 1).otherwise(down)
    down = F.when(down + F.call_function("mod", down, F.lit(2)) > 2 * (a - n), 2 * (a - n)).otherwise(down)
    up = S.div(4 * b - 3 * n - a - 6, 12)
    odd = F.abs(F.call_function("mod", up, F.lit(2)))
    up = F.when(up + odd < 2 * (b - a), 2 * (b - a) - 1).otherwise(up)
    odd = F.abs(F.call_function("mod", up, F.lit(2)))
    up = F.when(up - odd < 2 * (a - n), 2 * (a - n)).otherwise(up)
    return F.when((b >= a) & (a >= n), down).when((b <= a) & (a <= n), up).otherwise(0)


_TEND = """CASE WHEN b >= a AND a >= n THEN d3 WHEN b <= a AND a <= n THEN u3 ELSE 0 END"""
_SQUEEZE = f"""
WITH p AS (SELECT image_id, y, x // 2 AS i, max(v) FILTER (x % 2 = 0) AS l, max(v) FILTER (x % 2 = 1) AS r FROM raster GROUP BY ALL),
q AS (SELECT *, (l + r + (l > r)::INT) >> 1 AS a FROM p),
s AS (SELECT *, coalesce(lag(r) OVER o, a) AS b, coalesce(lead(a) OVER o, a) AS n FROM q WINDOW o AS (PARTITION BY image_id, y ORDER BY i)),
t1 AS (SELECT *, (4 * b - 3 * n - a + 6) // 12 AS d1, (4 * b - 3 * n - a - 6) // 12 AS u1 FROM s),
t2 AS (SELECT *, CASE WHEN d1 - d1 % 2 > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE d1 END AS d2, CASE WHEN u1 + abs(u1 % 2) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE u1 END AS u2 FROM t1),
t3 AS (SELECT *, CASE WHEN d2 + d2 % 2 > 2 * (a - n) THEN 2 * (a - n) ELSE d2 END AS d3, CASE WHEN u2 - abs(u2 % 2) < 2 * (a - n) THEN 2 * (a - n) ELSE u2 END AS u3 FROM t2)
SELECT image_id, y, i::INT AS i, a AS average, (l - r - {_TEND})::BIGINT AS residual FROM t3
"""


@query("squeeze_forward", _SQUEEZE)
def squeeze_forward(spark, sf_dir):
    """Pairs of a row as average and residual against the smooth tendency."""
    half = V.SIDE // 2
    mean = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.shiftright(F.get("row", 2 * i) + F.get("row", 2 * i + 1) + (F.get("row", 2 * i) > F.get("row", 2 * i + 1)).cast("int"), 1))
    rows = V.planes(spark, sf_dir)

    def one(avg: Column, a: Column, i: Column) -> Column:
        left = F.when(i > 0, F.get("row", 2 * i - 1)).otherwise(a)
        after = F.coalesce(F.get(avg, i + 1), a)
        return F.struct(i.alias("i"), a.alias("average"), left.alias("b"), after.alias("n"), (F.get("row", 2 * i) - F.get("row", 2 * i + 1)).alias("d"))

    pairs = rows.select("image_id", "y", F.inline(let(mean, lambda avg: F.transform(avg, lambda a, i: one(avg, a, i)))))
    return pairs.select("image_id", "y", "i", "average", (F.col("d") - tendency(F.col("b"), F.col("average"), F.col("n"))).cast("long").alias("residual"))


def _edge(row, i: Column) -> Column:
    return F.get(row, clamp(i, 0, V.SIDE - 1))


@query("chroma_triangle_upsample", "SELECT image_id, y, 2 * x + k AS x, round(0.75::DOUBLE * v + 0.25::DOUBLE * CASE k WHEN 0 THEN coalesce(lag(v) OVER o, v) ELSE coalesce(lead(v) OVER o, v) END, 6) AS v FROM raster, (SELECT unnest([0, 1])::INT AS k) WINDOW o AS (PARTITION BY image_id, y, k ORDER BY x)")
def chroma_triangle_upsample(spark, sf_dir):
    rows = V.planes(spark, sf_dir)
    wide = F.flatten(F.transform("row", lambda v, x: F.array(*(F.round(0.75 * v + 0.25 * _edge("row", x + d), 6) for d in (-1, 1)))))
    return V.pixels(rows.withColumn("row", wide))


# Default weights of the side and corner taps.
GABORISH = (0.115169525, 0.061248592)
_G = 1 / (1 + 4 * (GABORISH[0] + GABORISH[1]))


def rows_around(spark, sf_dir):
    """Image rows with the row above and below; edges repeat."""
    w = Window.partitionBy("image_id").orderBy("y")
    d = V.planes(spark, sf_dir)
    return d.withColumn("up", F.coalesce(F.lag("row").over(w), F.col("row"))).withColumn("down", F.coalesce(F.lead("row").over(w), F.col("row")))


_STENCIL = """WITH t AS (SELECT image_id, y, x, v, coalesce(lag(v) OVER c, v) AS u, coalesce(lead(v) OVER c, v) AS d FROM raster WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
s AS (SELECT *, coalesce(lag(v) OVER o, v) AS l, coalesce(lead(v) OVER o, v) AS r, coalesce(lag(u) OVER o, u) AS ul, coalesce(lead(u) OVER o, u) AS ur, coalesce(lag(d) OVER o, d) AS dl, coalesce(lead(d) OVER o, d) AS dr FROM t WINDOW o AS (PARTITION BY image_id, y ORDER BY x))"""


@query("gaborish_3x3", f"{_STENCIL} SELECT image_id, y, x, round(({_G!r})::DOUBLE * (v + {GABORISH[0]}::DOUBLE * (u + d + l + r) + {GABORISH[1]}::DOUBLE * (ul + ur + dl + dr)), 5) AS v FROM s")
def gaborish_3x3(spark, sf_dir):
    side = lambda x: F.get("up", x) + F.get("down", x) + _edge("row", x - 1) + _edge("row", x + 1)
    corner = lambda x: _edge("up", x - 1) + _edge("up", x + 1) + _edge("down", x - 1) + _edge("down", x + 1)
    rows = rows_around(spark, sf_dir)
    return V.pixels(rows.withColumn("row", F.transform("row", lambda v, x: F.round(_G * (v + GABORISH[0] * side(x) + GABORISH[1] * corner(x)), 5))))


@query(
    "demosaic_rggb",
    """WITH t AS (SELECT image_id, y, x, v, lag(v) OVER c AS u, lead(v) OVER c AS d FROM raster WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
s AS (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS r, lag(u) OVER o AS ul, lead(u) OVER o AS ur, lag(d) OVER o AS dl, lead(d) OVER o AS dr FROM t WINDOW o AS (PARTITION BY image_id, y ORDER BY x)),
m AS (SELECT *, list_avg([l, r]) AS h, list_avg([u, d]) AS k, list_avg([l, r, u, d]) AS p, list_avg([ul, ur, dl, dr]) AS q FROM s)
SELECT image_id, y, x, round(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v WHEN y % 2 = 0 THEN h WHEN x % 2 = 0 THEN k ELSE q END, 6) AS red,
 round(CASE WHEN (x + y) % 2 = 1 THEN v ELSE p END, 6) AS green,
 round(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v WHEN y % 2 = 1 THEN h WHEN x % 2 = 1 THEN k ELSE q END, 6) AS blue FROM m""",
)
def demosaic_rggb(spark, sf_dir):
    """Bilinear colours of a red-green / green-blue mosaic; only neighbours inside the image count."""
    w = Window.partitionBy("image_id").orderBy("y")
    rows = V.planes(spark, sf_dir).withColumn("up", F.lag("row").over(w)).withColumn("down", F.lead("row").over(w))
    at = lambda row, i: F.when(i >= 0, F.get(row, i))

    def mean(*cs: Column) -> Column:
        total, n = F.lit(0), F.lit(0)
        for c in cs:
            total, n = total + F.coalesce(c, F.lit(0)), n + c.isNotNull().cast("int")
        return F.when(n > 0, total / n)

    def one(v: Column, x: Column) -> Column:
        left, right, up, down = at("row", x - 1), at("row", x + 1), at("up", x), at("down", x)
        across, along, plus, corners = mean(left, right), mean(up, down), mean(left, right, up, down), mean(at("up", x - 1), at("up", x + 1), at("down", x - 1), at("down", x + 1))
        even_y, even_x = F.col("y") % 2 == 0, x % 2 == 0
        red = F.when(even_y & even_x, v).when(even_y, across).when(even_x, along).otherwise(corners)
        blue = F.when(~even_y & ~even_x, v).when(~even_y, across).when(~even_x, along).otherwise(corners)
        green = F.when((x + F.col("y")) % 2 == 1, v).otherwise(plus)
        return F.struct(x.alias("x"), F.round(red, 6).alias("red"), F.round(green, 6).alias("green"), F.round(blue, 6).alias("blue"))

    return rows.select("image_id", "y", F.inline(F.transform("row", one)))


@query("support_min_max", f"{_STENCIL} SELECT image_id, y, x, least(v, u, d, l, r, ul, ur, dl, dr) AS low, greatest(v, u, d, l, r, ul, ur, dl, dr) AS high FROM s")
def support_min_max(spark, sf_dir):
    """Smallest and largest sample of the 3 x 3 support, which a sharpening result is clamped to."""
    near = lambda x: [F.get("row", x), F.get("up", x), F.get("down", x), *(_edge(r, x + k) for r in ("row", "up", "down") for k in (-1, 1))]
    rows = rows_around(spark, sf_dir)
    return rows.select("image_id", "y", F.inline(F.transform("row", lambda v, x: F.struct(x.alias("x"), F.least(*near(x)).alias("low"), F.greatest(*near(x)).alias("high")))))


@query(
    "support_min_max_5x5",
    "WITH t AS (SELECT image_id, y, x, min(v) OVER c AS a, max(v) OVER c AS b FROM raster WINDOW c AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) "
    "SELECT image_id, y, x, min(a) OVER o AS low, max(b) OVER o AS high FROM t WINDOW o AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
)
def support_min_max_5x5(spark, sf_dir):
    """Smallest and largest sample of the 5 x 5 support, which an upsampled result is clamped to; edges repeat, so they add nothing."""
    w = Window.partitionBy("image_id").orderBy("y")
    rows = V.planes(spark, sf_dir)
    for k in (1, 2):
        rows = rows.withColumn(f"up{k}", F.lag("row", k).over(w)).withColumn(f"down{k}", F.lead("row", k).over(w))
    near = lambda x: [F.get(r, x + k) for r in ("row", "up1", "up2", "down1", "down2") for k in range(-2, 3)]
    return rows.select("image_id", "y", F.inline(F.transform("row", lambda v, x: F.struct(x.alias("x"), F.least(*near(x)).alias("low"), F.greatest(*near(x)).alias("high")))))
