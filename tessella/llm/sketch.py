"""Document fingerprints: bottom-k sketches of word-shingle hashes, in Spark expressions only.

A sketch is the ascending array of the k smallest distinct 64-bit shingle hashes.
Sketches of parts merge to the sketch of the whole, and two of them estimate
resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
#: Ranges of keys that documents are dealt by, at most; larger ranges are sorted on disk.
RANGES = 1 << 16


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct hashes of the runs of ``words`` words of ``text`` (case is ignored).

    Words are runs of characters other than ASCII white space.  With fewer words
    the whole sequence is the one shingle; a null text, or one without words, has
    the empty sketch.
    """
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(F.size(h) >= words, runs).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(parts, lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch for each ``key``: its rows' k smallest hashes; ranks are cut before the shuffle.

    A group whose sketches are all empty or null gets the empty sketch.
    """
    hashes = df.select(key, F.explode(column).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).filter(F.col("_r") <= k)
    merged = ranked.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list("_h")).alias("_s"))
    keys = df.select(key).distinct()
    return keys.join(merged, keys[key].eqNullSafe(merged["_key"]), "left").select(key, F.coalesce("_s", F.array().cast("array<bigint>")).alias(column))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def to_string(a: Column) -> Column:
    """16 hexadecimal digits for each hash, ascending."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def from_string(s: Column) -> Column:
    """The sketch that ``to_string`` wrote; the empty string is the empty sketch."""
    hashes = F.transform(F.sequence(F.lit(0), (F.length(s) / 16).cast("int") - 1), lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    return F.when(F.length(s) > 0, hashes).when(F.length(s) == 0, F.array().cast("array<bigint>"))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below ``key``: found in blocks first, then in the block."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine, coarse = F.lit(bounds), F.lit(bounds[step - 1 :: step])
    blocks = F.size(F.filter(coarse, lambda b: b < key)) * step
    return let(blocks, lambda n: n + F.size(F.filter(F.slice(fine, n + 1, F.lit(step)), lambda b: b < key)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = 128) -> DataFrame:
    """Each document beside the next one in descending key order; after the last comes the first.

    Returns key, text, next_text, sketch, next_sketch.  Ties of the key are ordered
    by text, null keys come last, null texts are empty.  Documents are dealt by key
    ranges taken from approximate quantiles, in one shuffle; only the first
    document of each range (one row a range) is passed to its neighbour.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(RANGES, n // rows_per_range))
    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("key", F.lit(cuts), 10 * ranges)).first()[0] if cuts else []
    rows = rows.withColumn("range", F.coalesce(_range_of(F.col("key"), sorted(set(found or []))), F.lit(0)))

    # the first document of each range: its key, then its text (RANGES rows at most)
    first = F.broadcast(rows.groupBy("range").agg(F.max("key").alias("_max")).withColumnRenamed("range", "_range"))
    heads = rows.join(first, (rows["range"] == first["_range"]) & rows["key"].eqNullSafe(first["_max"])).groupBy("range").agg(F.max("text").alias("head"))
    filled = sorted(r["range"] for r in rows.select("range").distinct().collect())
    # the head of a range comes after the range above it, the topmost one after the lowest
    pairs = F.arrays_zip(F.lit(filled).cast("array<int>").alias("range"), F.lit(filled[1:] + filled[:1]).cast("array<int>").alias("for_range"))
    after = spark.range(1).select(F.inline(pairs)) if filled else spark.range(0).select(F.lit(0).alias("range"), F.lit(0).alias("for_range"))
    heads = heads.join(F.broadcast(after), "range").select("for_range", "head", sketch(F.col("head")).alias("head_sketch"))

    order = Window.partitionBy("range").orderBy(F.col("key").desc_nulls_last(), F.col("text").desc())
    seen = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("sketch", sketch(F.col("text")))
    seen = seen.withColumn("next_sketch", F.lead("sketch").over(order))
    last = F.col("next_text").isNull()
    out = seen.join(heads, (F.col("range") == F.col("for_range")) & last, "left")
    return out.select(F.col("key").alias(key), "text", F.when(last, F.col("head")).otherwise(F.col("next_text")).alias("next_text"), "sketch", F.when(last, F.col("head_sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"))


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare them and the next document's.

    The edited text has its last floor(n/2) characters replaced by the first as many
    (or all) of the next document's.  Likeness is the estimated resemblance.
    """
    rows = with_next(docs, key, text)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        to_string(F.col("sketch")).alias("fingerprint"),
        to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )
