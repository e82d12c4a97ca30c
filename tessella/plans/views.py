"""Rasters, pyramids and frames derived from the relational tables, in Spark and as SQL.

Image rows stay arrays (one record for each image row) until a query needs single
pixels: a shuffle then moves rows, not pixels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each image row: image_id, y, row (array of 8-bit samples)."""
    level = lambda e: F.floor((e.cast("double") + 1.0) * 127.5).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {SIDE}").alias("image_id"), F.expr(f"cast(vec_id % {SIDE} as int)").alias("y"), F.transform("embedding", level).alias("row"))


def pixels(rows: DataFrame, *columns: str, value: str = "row", name: str = "v") -> DataFrame:
    """image_id, y, x and one sample a record."""
    return rows.select("image_id", "y", *columns, F.posexplode(value).alias("x", name))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(planes(spark, sf_dir))


def rgb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three planes as one image: image_id, y and the arrays r, g, b; incomplete ones are left out."""
    rows = planes(spark, sf_dir).withColumn("c", F.col("image_id") % 3).withColumn("image_id", F.expr("image_id div 3"))
    pick = lambda c: F.max(F.when(F.col("c") == c, F.col("row")))
    out = rows.groupBy("image_id", "y").agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
    return out.filter("r is not null and g is not null and b is not null")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rgb_rows(spark, sf_dir)
    zipped = F.transform(F.arrays_zip("r", "g", "b"), lambda p, x: F.struct(x.alias("x"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b")))
    return rows.select("image_id", "y", F.inline(zipped))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-level pyramid for each order: image_id, level, w, h, by halving and rounding up."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (1024 + F.col("o_orderkey") % 4096).alias("w0"), (1024 + F.col("o_custkey") % 4096).alias("h0"))
    rows = orders.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4))))
    half = lambda c: F.call_function("shiftright", F.col(c) + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1, F.col("level"))
    return rows.select("image_id", "level", half("w0").alias("w"), half("h0").alias("h"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region requests from line items: image_id, x0, y0, rw, rh, d (wanted downsample), n (how often asked)."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 1500).alias("x0"),
        (F.col("l_suppkey") * 7 % 1500).alias("y0"),
        (64 + F.col("l_partkey") % 512).alias("rw"),
        (64 + F.col("l_linenumber").cast("long") * 64).alias("rh"),
        (1 + F.col("l_quantity") / 4).alias("d"),
    )
    return rows.groupBy("image_id", "x0", "y0", "rw", "rh", "d").agg(F.count("*").alias("n"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animation frames from events: user_id, frame, duration (ticks), kind."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("frame"), F.floor("value").cast("long").alias("duration"), F.col("event_type").alias("kind"), "event_id")


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide descriptions made of events: event_id, text."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("Vendor Image Library v1\r\nlabel 4x3 [0,0 2x2]|AppMag = "), (F.col("event_id") % 3 * 20).cast("string"), F.lit("|MPP = 0."), (F.col("event_id") % 9).cast("string"), F.lit("|Title = Case A="), F.col("event_type"), F.lit("|Flag|Note ="), F.col("props"))
    return e.select("event_id", text.alias("text"))


#: The same as SQL; a view may use those above it.
VIEWS = {
    "raster": "SELECT vec_id // 64 AS image_id, (vec_id % 64)::INT AS y, (i - 1)::INT AS x, floor((e::DOUBLE + 1.0) * 127.5)::INT AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)",
    "rgb": "SELECT a.image_id // 3 AS image_id, a.y, a.x, a.v AS r, b.v AS g, c.v AS b FROM raster a JOIN raster b ON b.image_id = a.image_id + 1 AND b.y = a.y AND b.x = a.x JOIN raster c ON c.image_id = a.image_id + 2 AND c.y = a.y AND c.x = a.x WHERE a.image_id % 3 = 0",
    "levels": "SELECT o_orderkey AS image_id, l::INT AS level, ((1024 + o_orderkey % 4096) + (1 << l) - 1) >> l AS w, ((1024 + o_custkey % 4096) + (1 << l) - 1) >> l AS h FROM orders, (SELECT unnest(range(5)) AS l)",
    "requests": "SELECT l_orderkey AS image_id, l_partkey % 1500 AS x0, l_suppkey * 7 % 1500 AS y0, 64 + l_partkey % 512 AS rw, 64 + l_linenumber::BIGINT * 64 AS rh, 1 + l_quantity / 4 AS d, count(*) AS n FROM lineitem GROUP BY ALL",
    "frames": "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, floor(value)::BIGINT AS duration, event_type AS kind, event_id FROM events",
    "properties": "SELECT event_id, 'Vendor Image Library v1' || chr(13) || chr(10) || 'label 4x3 [0,0 2x2]|AppMag = ' || (event_id % 3 * 20) || '|MPP = 0.' || (event_id % 9) || '|Title = Case A=' || event_type || '|Flag|Note =' || props AS text FROM events",
    # the neighbours of a pixel with the edge rules of C8
    "around": """SELECT image_id, y, x, v, coalesce(w0, n0, 0) AS w, coalesce(n0, w0, 0) AS n, coalesce(nw0, w0, n0, 0) AS nw, coalesce(ne0, n0, w0, 0) AS ne, coalesce(nn0, n0, w0, 0) AS nn, coalesce(nee0, ne0, n0, w0, 0) AS nee, coalesce(ww0, w0, n0, 0) AS ww FROM (
      SELECT p.*, lag(v, 1) OVER r AS w0, lag(v, 2) OVER r AS ww0, n0, nn0, lag(n0, 1) OVER r AS nw0, lead(n0, 1) OVER r AS ne0, lead(n0, 2) OVER r AS nee0
      FROM (SELECT *, lag(v, 1) OVER c AS n0, lag(v, 2) OVER c AS nn0 FROM raster WINDOW c AS (PARTITION BY image_id, x ORDER BY y)) p WINDOW r AS (PARTITION BY image_id, y ORDER BY x))""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it needs before it; its own WITH list may follow."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(body)

    need(sql)
    head = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    sql = sql.strip()
    if not head:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}{',' + sql[4:] if sql[:5].upper() == 'WITH ' else chr(10) + sql}"


def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel with its causal neighbours w, n, nw, ne, nn, nee, ww, by the edge rules of lossless prediction.

    Whole rows are lagged, so one window over image rows serves all seven neighbours.
    """
    above = Window.partitionBy("image_id").orderBy("y")
    rows = planes(spark, sf_dir).withColumn("r1", F.lag("row", 1).over(above)).withColumn("r2", F.lag("row", 2).over(above))

    def one(v: Column, x: Column) -> Column:
        at = lambda row, i: F.when(i >= 0, F.get(row, i))
        w0, n0 = at("row", x - 1), at("r1", x)
        w, n = F.coalesce(w0, n0, F.lit(0)), F.coalesce(n0, w0, F.lit(0))
        ne = F.coalesce(at("r1", x + 1), n)
        return F.struct(x.alias("x"), v.alias("v"), w.alias("w"), n.alias("n"), F.coalesce(at("r1", x - 1), w).alias("nw"), ne.alias("ne"), F.coalesce(at("r2", x), n).alias("nn"), F.coalesce(at("r1", x + 2), ne).alias("nee"), F.coalesce(at("row", x - 2), w).alias("ww"))

    return rows.select("image_id", "y", F.inline(F.transform("row", one)))
