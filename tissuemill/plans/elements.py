"""The driver's tables read as spatial elements, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels per row of the image: a vector is a pixel, its components are the channels.
WIDTH = 25
#: Components of a vector.
CHANNELS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.expr(f"vec_id div {WIDTH}").alias("y"), (F.col("vec_id") % WIDTH).alias("x"), F.posexplode("embedding").alias("c", "v"))
    return rows.select("c", "y", "x", F.col("v").cast("double").alias("value"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {WIDTH}").alias("y"), (F.col("vec_id") % WIDTH).alias("x"), F.col("label").cast("long").alias("instance"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).withColumn("instance", F.expr("(y div 5) * 5 + (x div 5) + 1"))


def cluster_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of the first four channels, from 1, the first of equals."""
    four = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {WIDTH}").alias("y"), (F.col("vec_id") % WIDTH).alias("x"), F.array_position(four, F.array_max(four)).alias("instance"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select((F.col("l_quantity") / 2).alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.col("p_brand").alias("gene"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return li.join(part, li.l_partkey == part.p_partkey).join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("instance"), F.col("p_brand").alias("gene")).agg(F.count("*").cast("double").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers with counts: instance, region, size."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance"), F.col("c_nationkey").alias("region"), (1 + F.col("c_custkey") % 97).alias("size"))
    with_orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("instance")).distinct()
    return c.join(with_orders, "instance", "left_semi")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as markers of types t0 to t4, by the number in their name."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.concat(F.lit("t"), (number % 5).cast("string")).alias("type")).distinct().withColumn("weight", F.lit(1.0))


TYPES = ("t0", "t1", "t2", "t3", "t4")

# The same elements in SQL, as the start of a WITH clause.
SQL = f"""
img AS (SELECT vec_id // {WIDTH} AS y, vec_id % {WIDTH} AS x, (i - 1)::INTEGER AS c, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i)),
lab AS (SELECT vec_id // {WIDTH} AS y, vec_id % {WIDTH} AS x, label::BIGINT AS instance FROM embeddings),
grd AS (SELECT y, x, (y // 5) * 5 + (x // 5) + 1 AS instance FROM lab),
clu AS (SELECT y, x, arg_max(c, (value, -c)) + 1 AS instance FROM img WHERE c < 4 GROUP BY y, x),
pts AS (SELECT l_quantity / 2 AS x, (l_suppkey % 50)::DOUBLE AS y, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey),
cnt AS (SELECT o_custkey AS instance, p_brand AS gene, count(*)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cel AS (SELECT c_custkey AS instance, c_nationkey AS region, 1 + c_custkey % 97 AS size FROM customer WHERE c_custkey IN (SELECT instance FROM cnt)),
mrk AS (SELECT DISTINCT p_brand AS gene, 't' || (regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER % 5)::VARCHAR AS type FROM part)
"""


def sql(rest: str) -> str:
    """``rest`` is a SELECT, or further WITH members that start with a comma and a SELECT."""
    return f"WITH {SQL}{rest}"
