"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Within a source, documents are ordered by a hash of their id and dealt into
equal ranges of it.  Range totals give each range its offset, a window within
the range gives each document its own, and the source is cut where its budget
ends.  A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, lookup_join, materialize

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often.
MOST_EPOCHS = 3
#: Documents of a hash range, on average; ranges of one source at most.
RANGE_ROWS, RANGES = 1_000, 1 << 16


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: int = MOST_EPOCHS) -> list[float]:
    """Share the sum of ``sizes`` by weight, none above ``most`` times its size, the excess reshared."""
    total, out = sum(sizes), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    full, left = 0, sum(weights)
    for at, i in enumerate(order):
        level = (total - full) / left
        if level <= most * sizes[i] / weights[i]:
            for j in order[at:]:
                out[j] = level * weights[j]
            break
        out[i] = float(most * sizes[i])
        full, left = full + most * sizes[i], left - weights[i]
    return out


def _ordered(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], seed: str) -> DataFrame:
    """Each document's size, its source's plan, and the words of its source before it in hash order."""
    spark = docs.sparkSession
    slim = docs.select(docs[key].alias("key"), docs[source].alias("source"), words(docs[text]).alias("size"))
    slim = materialize(slim.withColumn("draw", draw(F.col("key"), seed)), "mix-sizes")
    known = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    known.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # UTF-8 strings sort by code point
    shares = [float(weights[i % len(weights)]) for i in range(len(known))]
    goal = targets([r["size"] for r in known], shares)
    plan = spark.createDataFrame(
        [(r["source"], r["size"], t, int(t) // r["size"] if r["size"] else 0, int(t) % r["size"] if r["size"] else 0, max(1, min(RANGES, r["n"] // RANGE_ROWS)), r["n"]) for r, t in zip(known, goal, strict=True)],
        "_source string, source_size long, target double, epochs long, rest long, ranges long, n long",
    )
    # null is a source of its own, so it gets a key
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    plan = plan.withColumn("_key", named("_source")).drop("_source")
    rows = lookup_join(slim.withColumn("_key", named("source")), plan, "_key", "n", sum(r["n"] for r in known)).drop("_key")
    # the first 16 bits of the hash, cut into the source's ranges
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("draw", 1, 4), 16, 10).cast("long") * F.col("ranges") / 65536))
    sums = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-ranges")
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("_source"), F.col("range").alias("_range"), "offset")
    within = Window.partitionBy("source", "range").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(offsets, rows["source"].eqNullSafe(offsets["_source"]) & (rows["range"] == offsets["_range"]))
    return rows.withColumn("before", F.col("before") + F.col("offset"))


def draw(key: Column, seed: str) -> Column:
    """The hash that a document is ordered by within its source; null keys hash as an empty text."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """What the mix takes of each document: key, source, size, source_size, target, epochs, taken.

    ``taken`` counts words, repeats included.  The document at which a source's
    budget ends gives the words that are still wanted; ``epochs`` is the number of
    whole copies.  Order: md5 of seed and key, then key, then size.
    Null is a source of its own.  An empty table gives an empty result.  The
    driver collects one row for each source.
    """
    rows = _ordered(docs, key, text, source, weights, seed)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        (F.col("epochs") + F.when(extra > 0, (extra == F.col("size")).cast("int")).otherwise(0)).alias("epochs"),
        (F.col("epochs") * F.col("size") + extra).cast("bigint").alias("taken"),
    )


def mix_whole(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mixed documents, whole, as rows of ``docs``: one row for each copy.

    A source's cut is a place in its hash order: the document there is taken if at
    least half of it fits.  Only the cuts (one row a source) go back to the
    documents, so their texts are not shuffled.  Rows that share the cut's key are
    taken together.
    """
    spark = docs.sparkSession
    rows = _ordered(docs, key, text, source, weights, seed)
    taken = (F.col("before") < F.col("rest")) & ((F.col("rest") - F.col("before")) * 2 >= F.col("size"))
    kind = docs.schema[key].dataType.simpleString()
    cuts = rows.groupBy("source", "epochs").agg(F.max(F.when(taken, F.struct("draw", "key"))).alias("cut")).collect()
    many = len(cuts)
    cuts = spark.createDataFrame([(r["source"], r["epochs"], r["cut"]) for r in cuts], f"_source string, _epochs long, _cut struct<draw:string,key:{kind}>")
    few = F.broadcast(cuts) if many <= BROADCAST_ROWS else cuts
    found = docs.join(few, docs[source].eqNullSafe(cuts["_source"]))
    more = F.coalesce(F.struct(draw(docs[key], seed).alias("draw"), docs[key].alias("key")) <= F.col("_cut"), F.lit(False))
    copies = F.col("_epochs") + more.cast("int")
    return found.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*(docs[c] for c in docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size / w AS ratio, row_number() OVER (ORDER BY 3 * source_size / w, encode(source) NULLS LAST) AS i FROM s
), c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_,
         sum(source_size) OVER ()::BIGINT AS total
  FROM o
), l AS (
  SELECT min_by((total - full_) / left_, i) AS level, min(i) AS at_ FROM c WHERE (total - full_) / left_ <= ratio
), t AS (
  SELECT source, source_size, CASE WHEN i >= at_ THEN level * w ELSE (3 * source_size)::DOUBLE END AS target FROM c, l
), b AS (
  SELECT *, floor(target)::BIGINT AS budget FROM t
), r AS (
  SELECT doc_id, d.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_epochs,
         CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target, (full_epochs + CASE WHEN greatest(0, least(size, rest - before_)) > 0 AND rest - before_ >= size THEN 1 ELSE 0 END)::BIGINT AS epochs,
       (full_epochs * size + greatest(0, least(size, rest - before_)))::BIGINT AS taken
FROM r
"""
