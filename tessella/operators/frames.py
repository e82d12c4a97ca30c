"""Queries of animation, ordering, compositing and slide texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.arrays import let
from tessella.plans import views as V
from tessella.registry import query


@query("animation_timeline", "SELECT user_id, frame, duration, coalesce(sum(duration) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM frames")
def animation_timeline(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return V.frames(spark, sf_dir).select("user_id", "frame", "duration", F.coalesce(F.sum("duration").over(w), F.lit(0)).alias("start"))


@query("visible_frames", "SELECT user_id, frame FROM (SELECT *, max(frame) OVER (PARTITION BY user_id) AS last FROM frames) WHERE kind <> 'error' AND (duration <> 0 OR frame = last)")
def visible_frames(spark, sf_dir):
    d = V.frames(spark, sf_dir).withColumn("last", F.max("frame").over(Window.partitionBy("user_id")))
    return d.filter("kind <> 'error' and (duration <> 0 or frame = last)").select("user_id", "frame")


@query("reference_slot_asof", "SELECT user_id, frame, last_value(CASE WHEN kind = 'click' THEN frame END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reference FROM frames")
def reference_slot_asof(spark, sf_dir):
    """The latest frame saved to the slot before each frame."""
    w = Window.partitionBy("user_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return V.frames(spark, sf_dir).select("user_id", "frame", F.last(F.when(F.col("kind") == "click", F.col("frame")), ignorenulls=True).over(w).alias("reference"))


def fold_frames(frames, start: float = 0.0):
    """Composite the samples of a user's frames in order: replace, add, multiply, or blend by the frame's alpha."""
    ordered = frames.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("frame", "mode", "v", "alpha"))).alias("fs"))

    def step(acc, f):
        v, a = f["v"], f["alpha"]
        return F.when(f["mode"] == 0, v).when(f["mode"] == 1, acc + v).when(f["mode"] == 2, acc * F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(v * a + acc * (1 - a))

    return ordered.select("user_id", F.aggregate("fs", F.lit(start), step).alias("canvas"))


@query(
    "frame_blend_fold",
    """WITH RECURSIVE f AS (SELECT user_id, frame, frame % 4 AS mode, (duration % 16) / 16.0::DOUBLE AS v, (event_id % 8) / 8.0::DOUBLE AS alpha FROM frames),
fold AS (SELECT user_id, -1 AS frame, 0.0::DOUBLE AS canvas FROM f GROUP BY 1 UNION ALL
  SELECT f.user_id, f.frame, CASE f.mode WHEN 0 THEN v WHEN 1 THEN canvas + v WHEN 2 THEN canvas * least(greatest(v, 0), 1) ELSE v * alpha + canvas * (1 - alpha) END
  FROM fold JOIN f ON f.user_id = fold.user_id AND f.frame = fold.frame + 1)
SELECT user_id, round(arg_max(canvas, frame), 6) AS canvas FROM fold GROUP BY user_id""",
)
def frame_blend_fold(spark, sf_dir):
    d = V.frames(spark, sf_dir).select("user_id", "frame", (F.col("frame") % 4).alias("mode"), (F.col("duration") % 16 / 16.0).alias("v"), (F.col("event_id") % 8 / 8.0).alias("alpha"))
    return fold_frames(d).select("user_id", F.round("canvas", 6).alias("canvas"))


@query(
    "frame_blend_alpha",
    "WITH p AS (SELECT image_id, y, x, r / 255.0::DOUBLE AS old, g / 255.0::DOUBLE AS new, b / 255.0::DOUBLE AS na, 0.5::DOUBLE AS oa FROM rgb), q AS (SELECT *, na + oa * (1 - na) AS outa FROM p) SELECT image_id, y, x, round(old + new, 6) AS added, round(old * least(greatest(new, 0), 1), 6) AS multiplied, round(CASE WHEN outa <= 0 THEN new ELSE (new * na + old * oa * (1 - na)) / outa END, 6) AS blended, round(new + old * (1 - na), 6) AS premultiplied, round(old + na * new, 6) AS muladd, round(outa, 6) AS alpha FROM q",
)
def frame_blend_alpha(spark, sf_dir):
    """All blend modes of a new sample over an old one."""
    old, new, na, oa = F.col("r") / 255.0, F.col("g") / 255.0, F.col("b") / 255.0, F.lit(0.5)
    out = na + oa * (1 - na)
    r = lambda c: F.round(c, 6)
    return V.rgb(spark, sf_dir).select(
        "image_id", "y", "x", r(old + new).alias("added"), r(old * F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0))).alias("multiplied"),
        r(F.when(out <= 0, new).otherwise((new * na + old * oa * (1 - na)) / out)).alias("blended"), r(new + old * (1 - na)).alias("premultiplied"), r(old + na * new).alias("muladd"), r(out).alias("alpha"),
    )


@query("patch_stamp", "SELECT r.image_id, r.y, r.x, r.v + coalesce(p.v, 0) AS v FROM raster r LEFT JOIN raster p ON p.image_id = r.image_id AND r.y BETWEEN 32 AND 39 AND r.x BETWEEN 40 AND 47 AND p.y = r.y - 32 AND p.x = r.x - 40")
def patch_stamp(spark, sf_dir):
    """The 8 x 8 patch of an image's corner, added at (40, 32): whole rows are joined."""
    rows = V.planes(spark, sf_dir)
    patch = rows.filter("y < 8").select("image_id", (F.col("y") + 32).alias("y"), F.slice("row", 1, 8).alias("patch"))
    joined = rows.join(patch, ["image_id", "y"], "left")
    stamped = F.transform("row", lambda v, x: v + F.coalesce(F.when((x >= 40) & (x < 48), F.get("patch", x - 40)), F.lit(0)))
    return V.pixels(joined.withColumn("row", stamped))


@query("toc_offsets_running_sum", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents) SELECT doc_id, seq::INT AS seq, length(line)::INT AS size, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM s")
def toc_offsets_running_sum(spark, sf_dir):
    """Section sizes of a table of contents -> offsets."""
    s = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("doc_id", "seq", F.length("line").alias("size"), F.coalesce(F.sum(F.length("line")).over(w), F.lit(0)).alias("offset_"))


@query("prefix_arrived_sections", "WITH s AS (SELECT user_id, frame, duration + 1 AS size, sum(duration + 1) OVER (PARTITION BY user_id ORDER BY frame)::BIGINT AS stop FROM frames) SELECT user_id, frame, stop <= 400 AS arrived, (min((stop <= 400 AND frame % 50 <> 49)::INT) OVER (PARTITION BY user_id ORDER BY frame) = 1) AS usable FROM s")
def prefix_arrived_sections(spark, sf_dir):
    """Sections within the first 400 bytes, and those before the first gap."""
    w = Window.partitionBy("user_id").orderBy("frame")
    d = V.frames(spark, sf_dir).withColumn("arrived", F.sum(F.col("duration") + 1).over(w) <= 400)
    return d.select("user_id", "frame", "arrived", (F.min((F.col("arrived") & (F.col("frame") % 50 != 49)).cast("int")).over(w) == 1).alias("usable"))


@query("channel_order_cdef", "SELECT o_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_suppkey % 4, l_linenumber, l_partkey) AS channels FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def channel_order_cdef(spark, sf_dir):
    """Channels of an image sorted by their association."""
    d = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct((F.col("l_suppkey") % 4).alias("a"), "l_linenumber", "l_partkey"))).alias("c"))
    return d.select("o_orderkey", F.array_join(F.transform("c", lambda s: s["l_linenumber"].cast("string")), ",").alias("channels"))


@query("name_disambiguation", "SELECT event_id, CASE WHEN k = 1 THEN event_type ELSE event_type || ' ' || k END AS name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)")
def name_disambiguation(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    d = V.table(spark, sf_dir, "events").withColumn("k", k)
    return d.select("event_id", F.when(F.col("k") == 1, F.col("event_type")).otherwise(F.concat_ws(" ", "event_type", "k")).alias("name"))


_FIELD = "trim(regexp_extract(text, '\\|{0}\\s*=([^|]*)', 1))"


@query("aperio_properties", f"SELECT event_id, 'Vendor Image Library v1' AS header, {_FIELD.format('AppMag')}::DOUBLE AS magnification, {_FIELD.format('MPP')}::DOUBLE AS mpp, {_FIELD.format('Title')} AS title, '' AS flag, {_FIELD.format('Note')} AS note, 5::INT AS fields FROM properties")
def aperio_properties(spark, sf_dir):
    def fields(m):
        get = lambda k: F.try_element_at(m, F.lit(k))
        return F.struct(T.number(get("AppMag")).alias("magnification"), T.number(get("MPP")).alias("mpp"), get("Title").alias("title"), get("Flag").alias("flag"), get("Note").alias("note"), F.size(m).alias("fields"))

    d = V.properties(spark, sf_dir).select("event_id", T.description_header(F.col("text")).alias("header"), let(T.description_properties(F.col("text")), fields).alias("f"))
    return d.select("event_id", "header", "f.*")


@query("ndpi_properties", "SELECT event_id, event_type AS kind, (event_id % 9)::VARCHAR AS lens, 2::INT AS fields FROM events")
def ndpi_properties(spark, sf_dir):
    text = F.concat(F.lit("Kind="), F.col("event_type"), F.lit("\r\nLens = "), (F.col("event_id") % 9).cast("string"), F.lit("\nEmpty=\n=None\nplain"))
    fields = lambda m: F.struct(F.try_element_at(m, F.lit("Kind")).alias("kind"), F.try_element_at(m, F.lit("Lens")).alias("lens"), F.size(m).alias("fields"))
    return V.table(spark, sf_dir, "events").select("event_id", let(T.line_properties(text), fields).alias("f")).select("event_id", "f.*")


@query("associated_name", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'macro2' ELSE '' END AS name FROM events")
def associated_name(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, "Label 387x463").when(F.col("event_id") % 3 == 1, "macro2 1280x431").otherwise("387 thumbnail")
    return V.table(spark, sf_dir, "events").select("event_id", T.associated_name(line).alias("name"))


@query("tiff_widen_64bit", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_linenumber::BIGINT * 4294967296 AS offset_, CASE WHEN l_linenumber = 0 THEN 4 ELSE 16 END AS type FROM lineitem")
def tiff_widen_64bit(spark, sf_dir):
    """Low and high words of an oversize directory entry; a high word widens the type."""
    high = F.call_function("shiftleft", F.col("l_linenumber").cast("long"), F.lit(32))
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").bitwiseOR(high).alias("offset_"), F.when(F.col("l_linenumber") == 0, 4).otherwise(16).alias("type"))


@query("modular_channel_inclusion", "SELECT event_id, least(user_id % 4, event_id % 5) AS shift, least(user_id % 4, event_id % 5) BETWEEN 1 AND 2 AND user_id % 7 > 0 AS included FROM events")
def modular_channel_inclusion(spark, sf_dir):
    shift = F.least(F.col("user_id") % 4, F.col("event_id") % 5)
    return V.table(spark, sf_dir, "events").select("event_id", shift.alias("shift"), (shift.between(1, 2) & (F.col("user_id") % 7 > 0)).alias("included"))


@query("progressive_split", "SELECT image_id, y, x, v >> 4 AS pass0, (v >> 2) - (v >> 4) * 4 AS pass1, v - (v >> 2) * 4 AS pass2 FROM (SELECT image_id, y, x, v - 128 AS v FROM raster)")
def progressive_split(spark, sf_dir):
    """A coefficient coded in three passes, coarse bits first."""
    v = F.col("v") - 128
    sr, sl = F.shiftright, F.shiftleft
    return V.raster(spark, sf_dir).select("image_id", "y", "x", sr(v, 4).alias("pass0"), (sr(v, 2) - sl(sr(v, 4), 2)).alias("pass1"), (v - sl(sr(v, 2), 2)).alias("pass2"))
