"""Numbering by range partitions."""

from pyspark.sql import functions as F

from tissuemill.operators import masks
from tissuemill.operators.order import numbered


def test_numbers_are_whole_beyond_the_range_sample(spark):
    """More rows than a range partitioning samples: two jobs over it have different bounds."""
    ids = spark.range(0, 400_000, 1, 4).select(F.xxhash64("id").alias("instance"))
    got = masks._numbered(ids, 7).agg(F.count("*"), F.count_distinct("new"), F.min("new"), F.max("new")).first()
    assert tuple(got) == (400_000, 400_000, 8, 400_007)


def test_numbered_follows_the_order_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(2, "a"), (1, "b"), (None, "c"), (2, "A")], "k int, t string")
    assert {r.t: r.n for r in numbered(rows, ["k", "t"], "n").collect()} == {"c": 1, "b": 2, "A": 3, "a": 4}
    assert numbered(rows.limit(0), ["k"], "n").count() == 0
