"""Block transforms: orders are permutations, and a predictor is chosen by the bits of the residual queries."""

from pyspark.sql import functions as F

from tessella.operators.blocktypes import block_types
from tessella.queries import QUERIES


def test_block_types(spark):
    rows = {r.type: r for r in block_types(spark).collect()}
    assert sorted(rows) == list(range(27))
    assert (rows[6].order_type, rows[6].parameter_type, rows[6].flip, rows[6].cells) == (7, 7, True, 2)
    assert (rows[13].order_type, rows[13].parameter_type, rows[13].flip) == (1, 12, False)
    assert rows[24].cells == 1024 and rows[24].flip and not rows[26].flip


def test_orders_are_permutations(spark, sf_dir):
    out = QUERIES["coefficient_order"](spark, sf_dir)
    sizes = {r.order_id: r for r in out.groupBy("order_id").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("top")).collect()}
    assert sorted(sizes) == list(range(13)) and all(r.n == r.places == r.top + 1 for r in sizes.values())
    first = [(r.y, r.x) for r in out.filter("order_id = 0 and place < 10").orderBy("place").collect()]
    assert first == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)]


def test_predictor_choice(spark, sf_dir):
    got = {r.image_id: r for r in QUERIES["predictor_choice"](spark, sf_dir).collect()}

    def bits(name, column):
        r = F.col(column).cast("long")
        packed = F.when(r >= 0, 2 * r).otherwise(-2 * r - 1) + 1
        return {x.image_id: x.n for x in QUERIES[name](spark, sf_dir).groupBy("image_id").agg(F.sum(F.length(F.bin(packed))).alias("n")).collect()}

    plain, own = bits("predictor_residuals", "r5"), bits("weighted_predictor_residuals", "r")
    assert got and {k: (r.gradient_bits, r.weighted_bits) for k, r in got.items()} == {k: (plain[k], own[k]) for k in plain}
    assert all(r.predictor == (6 if r.weighted_bits * 20 < r.gradient_bits * 19 else 5) for r in got.values())
