"""Queries of rasters, masks and points over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import qc
from ..operators import composites, graph, masks, patches, points, raster, tiles
from ..sources import instruments
from ..sources.transcripts import transform_points
from . import elements as el
from . import register

N = 6
sql = el.sql


def rnd(*names):
    return [F.round(F.col(n) + 0.0, N).alias(n) for n in names]


def rsql(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"round({e} + 0.0, {N}) AS {n}" for e, n in pairs)


@register("raster_mean", sql(f"SELECT instance, c, {rsql(('avg(value)', 'mean'))} FROM img JOIN lab USING (y, x) GROUP BY ALL"))
def raster_mean(spark, d):
    return raster.aggregate_stats(el.image(spark, d), el.labels(spark, d), ["mean"]).select("instance", "c", *rnd("mean"))


@register("raster_stats", sql(f""", m AS (SELECT instance, c, value, avg(value) OVER (PARTITION BY instance, c) AS mu FROM img JOIN lab USING (y, x)),
s AS (SELECT instance, c, count(*) AS count, sum(value) AS sum, avg(value) AS mean, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4, min(value) AS min, max(value) AS max FROM m GROUP BY ALL)
SELECT instance, c, count, {rsql(('sum', 'sum'), ('mean', 'mean'), ('m2', 'var'), ('coalesce(m3 / pow(nullif(m2, 0), 1.5), 0)', 'skew'), ('coalesce(m4 / pow(nullif(m2, 0), 2) - 3, 0)', 'kurtosis'), ('min', 'min'), ('max', 'max'))} FROM s"""))  # fmt: skip
def raster_stats(spark, d):
    out = raster.aggregate_stats(el.image(spark, d), el.labels(spark, d), ["count", "sum", "mean", "var", "skew", "kurtosis", "min", "max"])
    return out.select("instance", "c", "count", *rnd("sum", "mean", "var", "skew", "kurtosis", "min", "max"))


@register("raster_index", sql(f""", w AS (SELECT i.instance, c FROM (VALUES (1::BIGINT), (3), (77)) i(instance), (SELECT DISTINCT c FROM img)),
a AS (SELECT instance, c, sum(value) AS s, count(*) AS n FROM img JOIN lab USING (y, x) GROUP BY ALL)
SELECT instance, c, round(coalesce(s, 0) + 0.0, {N}) AS sum, coalesce(n, 0) AS count FROM w LEFT JOIN a USING (instance, c)"""))  # fmt: skip
def raster_index(spark, d):
    return raster.aggregate_stats(el.image(spark, d), el.labels(spark, d), ["sum", "count"], index=[1, 3, 77]).select("instance", "c", *rnd("sum"), "count")


@register("instance_size", sql("SELECT instance, count(*) AS size FROM lab GROUP BY 1"))
def instance_size(spark, d):
    return raster.instance_size(el.labels(spark, d))


@register("center_of_mass", sql(f"SELECT instance, {rsql(('avg(y)', 'y'), ('avg(x)', 'x'))} FROM lab GROUP BY 1"))
def center_of_mass(spark, d):
    return raster.center_of_mass(el.labels(spark, d)).select("instance", *rnd("y", "x"))


@register("raster_quantiles", sql(f""", q AS (SELECT instance, c, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS q, unnest(quantile_cont(value, [0.1, 0.5, 0.9])) AS value FROM img JOIN lab USING (y, x) WHERE instance <> 0 GROUP BY instance, c)
SELECT instance, c, q, {rsql(('value', 'value'))} FROM q"""))  # fmt: skip
def raster_quantiles(spark, d):
    return raster.quantiles(el.image(spark, d), el.labels(spark, d), (0.1, 0.5, 0.9)).select("instance", "c", "q", *rnd("value"))


@register("feature_matrix", sql("SELECT instance, " + rsql(*[(f"{f}(value) FILTER (c = {c})", f"{n}__{c}") for n, f in (("mean", "avg"), ("max", "max")) for c in (0, 5)]) + " FROM img JOIN lab USING (y, x) WHERE instance <> 0 GROUP BY 1"))
def feature_matrix(spark, d):
    return raster.feature_matrix(el.image(spark, d), el.labels(spark, d), ["mean", "max"], [0, 5]).select("instance", *rnd("mean__0", "mean__5", "max__0", "max__5"))


@register("allocate_intensity", sql(f"SELECT instance, count(*) AS size, {rsql(('avg(x) + 3', 'x'), ('avg(y) + 2', 'y'))} FROM lab WHERE instance <> 0 GROUP BY 1"))
def allocate_intensity(spark, d):
    return raster.allocate_intensity(el.image(spark, d), el.labels(spark, d), "mean", offset=(2.0, 3.0))["obs"].select("instance", "size", *rnd("x", "y"))


@register("combine_channels", sql(f"SELECT CASE WHEN c < 3 THEN 0 ELSE 1 END::INTEGER AS c, y, x, {rsql(('sum(value)', 'value'))} FROM img WHERE c < 5 GROUP BY 1, y, x"))
def combine_channels(spark, d):
    return raster.combine_channels(el.image(spark, d), [[0, 1, 2], [3, 4]]).select("c", "y", "x", *rnd("value"))


@register("normalize", sql(f""", b AS (SELECT c, quantile_cont(value, 0.03) AS lo, quantile_cont(value, 0.998) AS hi FROM img WHERE value <> 0 GROUP BY c)
SELECT c, y, x, {rsql(('greatest(0.0, least(1.0, (value - lo) / (hi - lo + 1e-20)))', 'value'))} FROM img JOIN b USING (c)"""))  # fmt: skip
def normalize(spark, d):
    return raster.normalize(el.image(spark, d)).select("c", "y", "x", *rnd("value"))


@register("image_histogram", sql("SELECT c, least(floor((value + 1) / 0.1), 19)::INTEGER AS bin, count(*) AS n FROM img WHERE value BETWEEN -1 AND 1 AND value <> 0 GROUP BY ALL"))
def image_histogram(spark, d):
    return raster.histogram(el.image(spark, d), 20, -1.0, 1.0, exclude_zeros=True)


@register("image_ecdf", sql(f"SELECT c, {rsql(('value', 'value'), ('share', 'share'))} FROM (SELECT DISTINCT c, value, cume_dist() OVER (PARTITION BY c ORDER BY value) AS share FROM img)"))
def image_ecdf(spark, d):
    return raster.ecdf(el.image(spark, d)).select("c", *rnd("value", "share"))


@register("mean_normalized", sql(f""", b AS (SELECT c, quantile_cont(value, 0.03) AS lo, quantile_cont(value, 0.998) AS hi FROM img WHERE value <> 0 GROUP BY c)
SELECT c, {rsql(('asinh(avg(greatest(0.0, least(1.0, (value - lo) / (hi - lo + 1e-20)))))', 'value'))} FROM img JOIN b USING (c) GROUP BY c"""))  # fmt: skip
def mean_normalized(spark, d):
    return raster.mean_normalized(el.image(spark, d)).select("c", *rnd("value"))


#: Otsu's threshold of each group in {keys} of ``sig`` by prefix sums over the occupied ones of 65,536 bins, and the ratio of the means around it.
OTSU = """, rng AS (SELECT {keys}, min(value) AS lo, max(value) AS hi FROM sig GROUP BY ALL),
bns AS (SELECT {keys}, lo, hi, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 65536), 65535) ELSE 0 END AS bin, count(*) AS n FROM sig JOIN rng USING ({keys}) GROUP BY ALL),
cen AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 65536 AS center FROM bns),
cum AS (SELECT {keys}, lo, hi, center, bin, sum(n) OVER w AS nl, sum(n * center) OVER w AS sl, sum(n) OVER (PARTITION BY {keys}) AS na, sum(n * center) OVER (PARTITION BY {keys}) AS sa FROM cen WINDOW w AS (PARTITION BY {keys} ORDER BY bin)),
cut AS (SELECT {keys}, CASE WHEN any_value(hi) > any_value(lo) THEN arg_max(center, nl * (na - nl) * pow(sl / nl - (sa - sl) / (na - nl), 2)) FILTER (nl < na) ELSE any_value(lo) END AS threshold FROM cum GROUP BY ALL),
snr AS (SELECT {keys}, threshold, avg(value) FILTER (value > threshold) / avg(value) FILTER (value <= threshold) AS snr FROM sig JOIN cut USING ({keys}) GROUP BY ALL)"""


@register("signal_to_noise", sql(f", sig AS (SELECT c, abs(value) AS value FROM img){OTSU.format(keys='c')} SELECT c, {rsql(('threshold', 'threshold'), ('snr', 'snr'))} FROM snr"))
def signal_to_noise(spark, d):
    return raster.signal_to_noise(el.image(spark, d).withColumn("value", F.abs("value"))).select("c", *rnd("threshold", "snr"))


@register("pixel_preprocess", sql(f""", q AS (SELECT c, quantile_cont(abs(value), 0.99) AS q FROM img WHERE value <> 0 GROUP BY c),
s AS (SELECT c, y, x, coalesce(abs(value) / nullif(q, 0), 0) AS value FROM img JOIN q USING (c)), p AS (SELECT y, x, sum(value) AS s FROM s GROUP BY ALL),
k AS (SELECT c, y, x, value / s AS value FROM s JOIN p USING (y, x) WHERE s > 0 AND s >= (SELECT quantile_cont(s, 0.05) FROM p)), t AS (SELECT c, quantile_cont(value, 0.999) AS t FROM k WHERE value <> 0 GROUP BY c)
SELECT 'a' AS image, c, y, x, {rsql(('least(coalesce(value / nullif(t, 0), 0), 1)', 'value'))} FROM k LEFT JOIN t USING (c)"""))  # fmt: skip
def pixel_preprocess(spark, d):
    rows = el.image(spark, d).withColumn("value", F.abs("value")).withColumn("image", F.lit("a"))
    return raster.pixel_preprocess(rows).select("image", "c", "y", "x", *rnd("value"))


@register("shape_moments", sql(f""", m AS (SELECT instance, count(*) AS area, var_pop(y) + 1.0 / 12 AS vy, var_pop(x) + 1.0 / 12 AS vx, covar_pop(y, x) AS vyx FROM lab WHERE instance <> 0 GROUP BY 1),
l AS (SELECT *, (vy + vx + sqrt(pow(vy - vx, 2) + 4 * pow(vyx, 2))) / 2 AS l1, (vy + vx - sqrt(pow(vy - vx, 2) + 4 * pow(vyx, 2))) / 2 AS l2 FROM m)
SELECT instance, area, {rsql(('4 * sqrt(l1)', 'axis_major_length'), ('4 * sqrt(greatest(l2, 0))', 'axis_minor_length'), ('sqrt(1 - l2 / l1)', 'eccentricity'), ('sqrt(4 * area / pi())', 'equivalent_diameter_area'))} FROM l"""))  # fmt: skip
def shape_moments(spark, d):
    return raster.shape_moments(el.labels(spark, d)).select("instance", "area", *rnd("axis_major_length", "axis_minor_length", "eccentricity", "equivalent_diameter_area"))


@register("shape_outlines", sql(", n AS (SELECT a.instance, (SELECT count(*) FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM grd b WHERE b.y = a.y + dy AND b.x = a.x + dx AND b.instance = a.instance)) AS k FROM grd a) SELECT instance, sum(k)::DOUBLE AS perimeter FROM n GROUP BY 1"))
def shape_outlines(spark, d):
    return raster.shape_outlines(el.grid(spark, d)).select("instance", "perimeter")


@register("radii_and_axes", sql(f""", m AS (SELECT instance, var_samp(y) AS a, var_samp(x) AS b, covar_samp(y, x) AS c FROM lab WHERE instance <> 0 GROUP BY 1)
SELECT instance, {rsql(('sqrt((a + b + sqrt(pow(a - b, 2) + 4 * c * c)) / 2)', 'r0'), ('sqrt(greatest(0, (a + b - sqrt(pow(a - b, 2) + 4 * c * c)) / 2))', 'r1'))} FROM m"""))  # fmt: skip
def radii_and_axes(spark, d):
    return raster.radii_and_axes(el.labels(spark, d)).select("instance", F.get("radii", F.lit(0)).alias("r0"), F.get("radii", F.lit(1)).alias("r1")).select("instance", *rnd("r0", "r1"))


@register("instance_statistics", sql(f"SELECT instance, c, {rsql(('max(value) - min(value)', 'spread'))} FROM img JOIN lab USING (y, x) WHERE instance <> 0 GROUP BY instance, c"))
def instance_statistics(spark, d):
    out = raster.instance_statistics(el.image(spark, d), el.labels(spark, d), lambda v: np.ptp(v, axis=1))
    return out.select("instance", F.posexplode("stats").alias("c", "spread")).select("instance", "c", *rnd("spread"))


# masks

OVER = ", ovr AS (SELECT l.instance AS source, g.instance AS reference, count(*) AS n FROM lab l JOIN grd g USING (y, x) WHERE l.instance <> 0 AND g.instance <> 0 GROUP BY ALL), sa AS (SELECT instance AS source, count(*) AS a FROM lab WHERE instance <> 0 GROUP BY 1), ra AS (SELECT instance AS reference, count(*) AS b FROM grd WHERE instance <> 0 GROUP BY 1)"


@register("overlap_counts", sql(f"{OVER} SELECT * FROM ovr"))
def overlap_counts(spark, d):
    return masks.overlap_counts(el.labels(spark, d), el.grid(spark, d))


@register("majority_vote", sql(f"{OVER} SELECT source, reference, n FROM ovr QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, reference) = 1"))
def majority_vote(spark, d):
    return masks.majority_vote(el.labels(spark, d), el.grid(spark, d))


def _match(metric: str, expr: str):
    @register(f"match_{metric}", sql(f"""{OVER}, b AS (SELECT source, reference, {expr} AS score FROM ovr JOIN sa USING (source) JOIN ra USING (reference) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, reference) = 1)
    SELECT sa.source AS instance, coalesce(CASE WHEN score > 0.05 THEN reference END, 0)::BIGINT AS grid FROM sa LEFT JOIN b USING (source)"""))
    def match(spark, d):
        return masks.match_to_reference(el.labels(spark, d), {"grid": el.grid(spark, d)}, metric, 0.05)


_match("source_fraction", "n / a")
_match("reference_fraction", "n / b")
_match("iou", "n / (a + b - n)")


@register("filter_by_size", sql(", s AS (SELECT instance, count(*) AS n FROM lab GROUP BY 1) SELECT y, x, CASE WHEN n BETWEEN 40 AND 50 THEN instance ELSE 0 END::BIGINT AS instance FROM lab JOIN s USING (instance)"))
def filter_by_size(spark, d):
    return masks.filter_by_size(el.labels(spark, d), 40, 50).select("y", "x", F.col("instance").cast("long"))


@register("align_labels", sql(f"{OVER}, b AS (SELECT source AS instance, reference FROM ovr JOIN sa USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, reference) = 1 AND n / a >= 0.08) SELECT y, x, coalesce(reference, 0)::BIGINT AS instance FROM lab LEFT JOIN b USING (instance)"))
def align_labels(spark, d):
    return masks.align_labels(el.labels(spark, d), el.grid(spark, d), 0.08)


@register("merge_labels", sql(""", pri AS (SELECT y, x, CASE WHEN instance IN (1, 2, 3) THEN instance ELSE 0 END AS instance FROM lab),
a AS (SELECT instance, count(*) AS area FROM grd GROUP BY 1), c AS (SELECT g.instance, count(*) AS n FROM grd g JOIN pri p USING (y, x) WHERE p.instance <> 0 GROUP BY 1),
k AS (SELECT a.instance, row_number() OVER (ORDER BY a.instance) + 3 AS new FROM a LEFT JOIN c USING (instance) WHERE coalesce(n, 0) <= 0.3 * area)
SELECT y, x, CASE WHEN p.instance <> 0 THEN p.instance ELSE coalesce(new, 0) END::BIGINT AS instance FROM pri p JOIN grd g USING (y, x) LEFT JOIN k ON k.instance = g.instance"""))
def merge_labels(spark, d):
    lab = el.labels(spark, d)
    return masks.merge_labels(el.grid(spark, d), lab.withColumn("instance", F.when(F.col("instance").isin(1, 2, 3), F.col("instance")).otherwise(0)), 0.3)


@register("coverage", sql("SELECT count(DISTINCT nullif(instance, 0)) AS n_instances, count(*) * 0.25::DOUBLE AS area, count(nullif(instance, 0)) * 0.25::DOUBLE AS covered, round(100.0::DOUBLE * count(nullif(instance, 0)) / count(*), 6) AS percentage FROM lab"))
def coverage(spark, d):
    return masks.coverage(el.labels(spark, d), 0.5).select("n_instances", "area", "covered", *rnd("percentage"))


@register("bounding_box_query", sql(", k AS (SELECT DISTINCT instance FROM lab WHERE x >= 3 AND x < 5 AND y >= 2 AND y < 4 AND instance <> 0) SELECT instance, 'r' AS region FROM (SELECT DISTINCT instance FROM lab WHERE instance <> 0) SEMI JOIN k USING (instance) UNION ALL SELECT 99::BIGINT, 'q'"))
def bounding_box_query(spark, d):
    lab = el.labels(spark, d)
    obs = lab.where("instance <> 0").select("instance").distinct().withColumn("region", F.lit("r")).unionByName(spark.createDataFrame([(99, "q")], "instance long, region string"))
    return masks.bounding_box_query(lab, obs, (3, 5, 2, 4), "r")[1]


@register("square_grid", sql(", n AS (SELECT (max(y) + 1 - 1) // 4 AS r, (25 - 2) // 4 AS k FROM lab) SELECT y, x, CASE WHEN y >= 1 AND x >= 2 AND (y - 1) // 4 < r AND (x - 2) // 4 < k THEN ((y - 1) // 4) * k + (x - 2) // 4 + 1 ELSE 0 END::BIGINT AS instance FROM lab, n"))
def square_grid(spark, d):
    lab = el.labels(spark, d)
    height = lab.agg(F.max("y")).first()[0] + 1
    return lab.select("y", "x", masks.square_grid(height, el.WIDTH, 4, (1, 2))[0].alias("instance"))


HEX = f""", b AS (SELECT max(y) + 1 AS height FROM lab), r AS (SELECT j, 3 + 4.5 * j AS cy FROM b, range(0, height) r(j) WHERE 3 + 4.5 * j + 3 <= height),
h AS (SELECT row_number() OVER (ORDER BY j, i) AS label, cy, sqrt(3) * (1.5 + 3 * i + CASE WHEN j % 2 = 1 THEN 1.5 ELSE 0 END) AS cx FROM r, range(0, {el.WIDTH}) c(i) WHERE sqrt(3) * (3 + 3 * i + CASE WHEN j % 2 = 1 THEN 1.5 ELSE 0 END) <= {el.WIDTH})
SELECT y, x, coalesce(min(label), 0) AS instance FROM lab LEFT JOIN h ON abs(x + 0.5 - cx) <= 1.5 * sqrt(3) AND abs(y + 0.5 - cy) <= 3 - abs(x + 0.5 - cx) / sqrt(3) GROUP BY y, x"""


@register("hexagon_grid", sql(HEX))
def hexagon_grid(spark, d):
    lab = el.labels(spark, d)
    return masks.hexagon_grid(lab.select("y", "x"), lab.agg(F.max("y")).first()[0] + 1, el.WIDTH, 3)


@register("mode_per_cell", sql("SELECT y // 4 AS gy, x // 4 AS gx, instance FROM (SELECT y, x, instance FROM lab) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY y // 4, x // 4 ORDER BY count(*) DESC, instance) = 1"))
def mode_per_cell(spark, d):
    return masks.mode_per_cell(el.labels(spark, d), 4)


EXPAND = ", s AS (SELECT y, x, CASE WHEN instance > 2 THEN 0 ELSE instance END AS instance FROM lab)"


@register("expand_labels", sql(f"{EXPAND}, n AS (SELECT a.y, a.x, b.instance, pow(a.y - b.y, 2) + pow(a.x - b.x, 2) AS d FROM s a JOIN s b ON a.instance = 0 AND b.instance <> 0 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2), w AS (SELECT y, x, instance FROM n WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY d, instance) = 1) SELECT s.y, s.x, CASE WHEN s.instance <> 0 THEN s.instance ELSE coalesce(w.instance, 0) END::BIGINT AS instance FROM s LEFT JOIN w USING (y, x)"))
def expand_labels(spark, d):
    return masks.expand_labels(el.labels(spark, d).withColumn("instance", F.when(F.col("instance") > 2, 0).otherwise(F.col("instance"))), 2)


@register("boundary_edges", sql(", e AS (SELECT a.instance, v.* FROM grd a, (VALUES (-1, 0), (0, 1), (1, 0), (0, -1)) v(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM grd b WHERE b.y = a.y + dy AND b.x = a.x + dx AND b.instance = a.instance)) SELECT instance, count(*) AS n FROM e GROUP BY 1"))
def boundary_edges(spark, d):
    return masks.boundary_edges(el.grid(spark, d)).groupBy("instance").agg(F.count("*").alias("n"))


@register("vectorize_rasterize", sql("SELECT y, x, instance FROM lab WHERE instance <> 0"))
def vectorize_rasterize(spark, d):
    """Outlines of the labels and back: an instance's rings and those of its holes count together, so that parity gives the pixels again."""
    return masks.rasterize_rings(masks.vectorize(el.labels(spark, d))).select("y", "x", "instance")


# points

ALLOC = ", al AS (SELECT g.instance, p.gene, round_even(p.x, 0)::BIGINT AS px, round_even(p.y, 0)::BIGINT AS py FROM pts p JOIN grd g ON g.x = round_even(p.x, 0)::BIGINT AND g.y = round_even(p.y, 0)::BIGINT WHERE g.instance <> 0)"


@register("allocate", sql(f"{ALLOC} SELECT instance, gene, count(*) AS count FROM al GROUP BY ALL"))
def allocate(spark, d):
    return points.allocate(el.points(spark, d), el.grid(spark, d))["x"]


@register("allocate_obs", sql(f"{ALLOC} SELECT instance, {rsql(('avg(px)', 'x'), ('avg(py)', 'y'))} FROM al GROUP BY 1"))
def allocate_obs(spark, d):
    return points.allocate(el.points(spark, d), el.grid(spark, d))["obs"].select("instance", *rnd("x", "y"))


@register("bin_counts", sql(", sp AS (SELECT c_custkey AS barcode, c_custkey % 25 AS x, (c_custkey // 25) % 20 AS y FROM customer), j AS (SELECT g.instance, c.gene, sum(c.value) AS count FROM cnt c JOIN sp ON c.instance = sp.barcode JOIN grd g ON g.x = sp.x AND g.y = sp.y GROUP BY ALL) SELECT instance, gene, count FROM j"))
def bin_counts(spark, d):
    spots = el.table(spark, d, "customer").select(F.col("c_custkey").alias("barcode"), (F.col("c_custkey") % 25).alias("x"), F.expr("(c_custkey div 25) % 20").alias("y"))
    return points.bin_counts(spots, el.counts(spark, d).select(F.col("instance").alias("barcode"), "gene", F.col("value").alias("count")), el.grid(spark, d))["x"]


@register("append_table", sql(f"{ALLOC} SELECT r AS region, instance FROM (SELECT DISTINCT instance FROM al), (VALUES ('a'), ('b')) v(r)"))
def append_table(spark, d):
    one = points.allocate(el.points(spark, d), el.grid(spark, d))["obs"].select("instance")
    return points.append_table(one.withColumn("region", F.lit("a")), one.withColumn("region", F.lit("b"))).select("region", "instance")


@register("transcript_density", sql(f", b AS (SELECT floor((y - 2) / 2.0)::BIGINT AS y, floor((x - 1) / 2.0)::BIGINT AS x, count(*) AS n FROM pts WHERE x >= 1 AND x < 20 AND y >= 2 AND y < 40 GROUP BY 1, 2) SELECT y, x, n, {rsql(('n / max(n) OVER ()', 'value'))} FROM b"))
def transcript_density(spark, d):
    return points.density(el.points(spark, d), (1, 20, 2, 40), bin_size=2.0).select("y", "x", "n", *rnd("value"))


@register("genes_left_out", sql(f"{ALLOC}, r AS (SELECT gene, count(*) AS raw FROM pts WHERE x >= 0 AND x < 25 AND y >= 0 AND y < 20 GROUP BY 1), k AS (SELECT gene, count(*) AS kept FROM al GROUP BY 1) SELECT gene, coalesce(kept, 0) AS kept, raw, {rsql(('coalesce(kept, 0) / raw', 'proportion'), ('ln(raw)', 'log_raw'))} FROM r LEFT JOIN k USING (gene)"))
def genes_left_out(spark, d):
    p = el.points(spark, d)
    return points.genes_left_out(p, points.allocate(p, el.grid(spark, d))["x"], (0, 25, 0, 20)).select("gene", "kept", "raw", *rnd("proportion", "log_raw"))


@register("left_out_correlation", sql(f"{ALLOC}, r AS (SELECT gene, count(*) AS raw FROM pts WHERE x >= 0 AND x < 25 AND y >= 0 AND y < 20 GROUP BY 1), k AS (SELECT gene, count(*) AS kept FROM al WHERE instance % 3 <> 0 GROUP BY 1) SELECT count(*) AS n, {rsql(('covar_samp(kept / raw, ln(raw)) / nullif(stddev_samp(kept / raw) * stddev_samp(ln(raw)), 0)', 'pearson'))} FROM r JOIN k USING (gene)"))
def left_out_correlation(spark, d):
    p = el.points(spark, d)
    some = el.grid(spark, d).where("instance % 3 <> 0")
    return points.left_out_correlation(p, points.allocate(p, some)["x"], (0, 25, 0, 20)).select("n", *rnd("pearson"))


@register("read_transcripts", sql(f"SELECT {rsql(('2 * x + 1', 'x'), ('3 * y - 2', 'y'))}, gene FROM pts, range(0, 2) WHERE gene NOT LIKE '%Brand#1%' AND 2 * x + 1 >= 5 AND 2 * x + 1 < 30 AND 3 * y - 2 >= 0 AND 3 * y - 2 < 60"))
def read_transcripts(spark, d):
    raw = el.points(spark, d).select("x", "y", "gene", F.lit(2).alias("n"))
    return transform_points(raw, ((2, 0, 1), (0, 3, -2), (0, 0, 1)), column_gene=2, column_repeat=3, box=(5, 30, 0, 60), filter_genes=["brand#1"]).select(*rnd("x", "y"), "gene")


# tiles, windows, graphs


#: Both passes of the blur with sigma 1, mirrored at the image's ends.
BLUR = """, b AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM img), o AS (SELECT d, exp(-0.5 * d * d) AS e FROM range(-4, 5) r(d)), k AS (SELECT d, e / (SELECT sum(e) FROM o) AS e FROM o),
py AS (SELECT y, CASE WHEN m < h THEN m ELSE 2 * h - 1 - m END AS sy, e FROM (SELECT y, h, e, ((y + d) % (2 * h) + 2 * h) % (2 * h) AS m FROM b, range(0, h) r(y), k)),
px AS (SELECT x, CASE WHEN m < w THEN m ELSE 2 * w - 1 - m END AS sx, e FROM (SELECT x, w, e, ((x + d) % (2 * w) + 2 * w) % (2 * w) AS m FROM b, range(0, w) r(x), k)),
v AS (SELECT c, py.y, i.x, sum(e * value) AS value FROM py JOIN img i ON i.y = py.sy GROUP BY ALL)
SELECT c, v.y, px.x, round(sum(e * value) + 0.0, 6) AS value FROM px JOIN v ON v.x = px.sx GROUP BY ALL"""


@register("gaussian_tiled", sql(BLUR))
def gaussian_tiled(spark, d):
    return tiles.gaussian_filter(el.image(spark, d), 1.0, 8).select("c", "y", "x", *rnd("value"))


@register("top_hat_tiled", sql(", e AS (SELECT a.c, a.y, a.x, any_value(a.value) AS v, min(b.value) AS lo FROM img a JOIN img b ON a.c = b.c AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT a.c, a.y, a.x, round(any_value(a.v) - max(b.lo) + 0.0, 6) AS value FROM e a JOIN e b ON a.c = b.c AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL"))
def top_hat_tiled(spark, d):
    return tiles.min_max_filter(el.image(spark, d), 3, 6).select("c", "y", "x", *rnd("value"))


@register("map_tiled", sql("SELECT c, y, x, round(2 * value + 1, 6) AS value FROM img"))
def map_tiled(spark, d):
    t = tiles.to_tiles(el.image(spark, d), 7)
    return tiles.from_tiles(tiles.map_tiles(t, lambda a: 2 * a + 1, 2, 7)).select("c", "y", "x", *rnd("value"))


@register("segment_tiled")
def segment_tiled(spark, d):
    from ..shared import keeper

    # the model takes one value a pixel: the sum over all channels
    summed = el.image(spark, d).groupBy("y", "x").agg(F.sum("value").alias("value"))
    return tiles.segment(summed, tiles.threshold_model(0.05), 8, 4, 0.3, keeper(spark))


@register("extract_instances", sql(f""", k AS (SELECT instance, round_even(avg(y), 0)::BIGINT AS cy, round_even(avg(x), 0)::BIGINT AS cx FROM grd GROUP BY 1)
SELECT k.instance, c, count(*) AS n, {rsql(('sum(value)', 'sum'))} FROM k JOIN grd g ON g.instance = k.instance AND g.y BETWEEN cy - 1 AND cy + 1 AND g.x BETWEEN cx - 1 AND cx + 1 JOIN img i ON i.y = g.y AND i.x = g.x GROUP BY ALL"""))  # fmt: skip
def extract_instances(spark, d):
    p = patches.extract_instances(el.image(spark, d), el.grid(spark, d), 3)
    return p.groupBy("instance", "c").agg(F.count("*").alias("n"), F.sum("value").alias("sum")).select("instance", "c", "n", *rnd("sum"))


@register("featurize", sql(f""", k AS (SELECT instance, round_even(avg(y), 0)::BIGINT AS cy, round_even(avg(x), 0)::BIGINT AS cx FROM grd GROUP BY 1)
SELECT k.instance, {rsql(('sum(value)', 'total'))} FROM k JOIN grd g ON g.instance = k.instance AND g.y BETWEEN cy - 1 AND cy + 1 AND g.x BETWEEN cx - 1 AND cx + 1 JOIN img i ON i.y = g.y AND i.x = g.x GROUP BY 1"""))  # fmt: skip
def featurize(spark, d):
    vectors = patches.patch_vectors(patches.extract_instances(el.image(spark, d), el.grid(spark, d), 3), el.CHANNELS, 3)
    out = patches.featurize(vectors, lambda a: a.reshape(len(a), -1).sum(1, keepdims=True), el.CHANNELS, 3)
    return out.select("instance", F.get("embedding", F.lit(0)).alias("total")).select("instance", *rnd("total"))


def grid_cells(spark, d):
    return masks.mode_per_cell(el.labels(spark, d), 1).select((F.col("gy") * el.WIDTH + F.col("gx")).alias("node"), "gy", "gx", F.col("instance").alias("label"))


NB = f", nd AS (SELECT y * {el.WIDTH} + x AS node, y, x, instance AS label FROM lab), ed AS (SELECT a.node AS src, b.node AS dst, a.label AS a, b.label AS b FROM nd a JOIN nd b ON abs(a.y - b.y) + abs(a.x - b.x) = 1)"


@register("lattice", sql(f"{NB} SELECT src, dst FROM ed"))
def lattice(spark, d):
    return graph.lattice(grid_cells(spark, d)).select("src", "dst")


@register("nearest_neighbors", sql(f", nd AS (SELECT y * {el.WIDTH} + x AS node, y, x FROM lab), p AS (SELECT a.node AS src, b.node AS dst, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS distance FROM nd a JOIN nd b ON a.node <> b.node AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3) SELECT src, dst, {rsql(('distance', 'distance'))} FROM p WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 6"))
def nearest_neighbors(spark, d):
    return graph.nearest(grid_cells(spark, d).select("node", F.col("gy").alias("y"), F.col("gx").alias("x")), 6, 3.0).select("src", "dst", *rnd("distance"))


@register("neighbor_composition", sql(f"{NB} SELECT src AS node, b AS label, {rsql(('count(*) / sum(count(*)) OVER (PARTITION BY src)', 'share'))} FROM ed GROUP BY src, b"))
def neighbor_composition(spark, d):
    c = grid_cells(spark, d)
    return graph.neighbor_composition(graph.lattice(c), c.select("node", "label")).select("node", "label", *rnd("share"))


@register("observed_pairs", sql(f"{NB} SELECT a, b, count(*) AS n FROM ed GROUP BY ALL"))
def observed_pairs(spark, d):
    c = grid_cells(spark, d)
    return graph.observed_pairs(graph.lattice(c), c.select("node", "label"))


@register("nhood_enrichment", sql(f"""{NB}, o AS (SELECT a, b, count(*) AS n FROM ed GROUP BY ALL),
rk AS (SELECT run, node, label, row_number() OVER (PARTITION BY run ORDER BY node) AS r, row_number() OVER (PARTITION BY run ORDER BY md5('0-' || run || '-' || node), node) AS h FROM nd, range(1, 101) p(run)),
dl AS (SELECT x.run, x.node, z.label FROM rk x JOIN rk z ON x.run = z.run AND x.r = z.h),
s AS (SELECT run, a.label AS a, b.label AS b, count(*) AS n FROM ed JOIN dl a ON a.node = ed.src JOIN dl b USING (run) WHERE b.node = ed.dst GROUP BY ALL),
m AS (SELECT a, b, sum(n) / 100 AS mean, sum(n * n) / 100 AS square FROM s GROUP BY ALL),
j AS (SELECT a, b, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(square, 0) AS square FROM o FULL JOIN m USING (a, b))
SELECT a, b, n, {rsql(('(n - mean) / nullif(sqrt(greatest(0, square - mean * mean)), 0)', 'z'))} FROM j"""))  # fmt: skip
def nhood_enrichment(spark, d):
    c = grid_cells(spark, d)
    return graph.enrichment(graph.lattice(c), c.select("node", "label")).select("a", "b", "n", *rnd("z"))


@register("connected_components", sql(f""", nd AS (SELECT y * {el.WIDTH} + x AS node, y, x, instance AS label FROM lab)
SELECT node, component FROM (WITH RECURSIVE r(node, component) AS (SELECT node, node FROM nd UNION SELECT b.node, r.component FROM r JOIN nd a ON a.node = r.node JOIN nd b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label = b.label) SELECT node, min(component) AS component FROM r GROUP BY node)"""))
def connected_components(spark, d):
    from ..shared import keeper

    c = grid_cells(spark, d)
    label = lambda n: c.select(F.col("node").alias(n), F.col("label").alias(f"l{n}"))
    same = graph.lattice(c).join(label("src"), "src").join(label("dst"), "dst").where("lsrc = ldst").select("src", "dst")
    return graph.connected_components(same, c.select("node"), keeper(spark))


@register("nhood_kmeans")
def nhood_kmeans(spark, d):
    c = grid_cells(spark, d)
    return graph.neighborhood_kmeans(graph.lattice(c), c.select("node", "label"), 4)


@register("nhood_lda")
def nhood_lda(spark, d):
    c = grid_cells(spark, d)
    return graph.neighborhood_lda(graph.lattice(c), c.select("node", "label"), 3).select("node", "niche")


def _propagation(rounds: int = 10) -> str:
    """The rounds of label propagation, one after another: rounds after the last change change nothing."""
    votes = "SELECT e.src, l.community, 1.0 AS w FROM eg e JOIN l{0} l ON l.node = e.dst UNION ALL SELECT node, community, 0.5 FROM l{0}"
    step = "l{1} AS MATERIALIZED (SELECT src AS node, arg_max(community, (w, -community)) AS community FROM (SELECT src, community, sum(w) AS w FROM (" + votes + ") GROUP BY ALL) GROUP BY src)"
    start = f", nd AS (SELECT y * {el.WIDTH} + x AS node, y, x FROM lab), eg AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM nd a JOIN nd b ON a.node <> b.node AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), l0 AS (SELECT node, node AS community FROM nd)"
    return start + "".join(", " + step.format(i, i + 1) for i in range(rounds)) + f" SELECT node, community FROM l{rounds}"


@register("label_propagation", sql(_propagation()))
def label_propagation(spark, d):
    from ..shared import keeper

    c = grid_cells(spark, d)
    return graph.label_propagation(graph.lattice(c, diagonal=True), c.select("node"), keep=keeper(spark))


@register("modularity", sql(f"{NB}, s AS (SELECT a, sum(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS i, count(*) AS k FROM ed GROUP BY a) SELECT {rsql(('sum(i) / sum(k) - sum(k * k) / pow(sum(k), 2)', 'modularity'))} FROM s"))
def modularity(spark, d):
    c = grid_cells(spark, d)
    return graph.modularity(graph.lattice(c), c.select("node", F.col("label").alias("community"))).select(*rnd("modularity"))


@register("modularity_communities")
def modularity_communities(spark, d):
    c = grid_cells(spark, d)
    return graph.modularity_communities(graph.lattice(c, diagonal=True), c.select("node"))


@register("k_nearest", f"WITH p AS (SELECT c_custkey AS node, c_acctbal::DOUBLE AS y, ((c_custkey % 10) * c_custkey)::DOUBLE AS x FROM customer), d AS (SELECT a.node AS src, b.node AS dst, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS distance FROM p a JOIN p b ON a.node <> b.node) SELECT src, dst, {rsql(('distance', 'distance'))} FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 6")
def k_nearest(spark, d):
    places = el.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").cast("double").alias("y"), ((F.col("c_custkey") % 10) * F.col("c_custkey")).alias("x"))
    return graph.k_nearest(places, 6).select("src", "dst", *rnd("distance"))


@register("map_labels", sql("SELECT l.y, l.x, g.instance FROM lab l JOIN grd g USING (y, x) WHERE l.instance <> 0 AND g.instance <> 0"))
def map_labels(spark, d):
    """Labels of the second mask where the first has any."""
    return tiles.map_labels([el.labels(spark, d), el.grid(spark, d)], lambda a, b: np.where(a > 0, b, 0), size=8, depth=2, relabel=False)


@register("tiling_correction", sql(f", f AS (SELECT c, y % 5 AS ty, x % 5 AS tx, quantile_cont(abs(value), 0.5) AS m FROM img GROUP BY ALL), g AS (SELECT *, m / avg(m) OVER (PARTITION BY c) AS flat FROM f) SELECT c, y, x, {rsql(('coalesce(abs(value) / nullif(flat, 0), abs(value))', 'value'))} FROM img JOIN g USING (c) WHERE ty = y % 5 AND tx = x % 5"))
def tiling_correction(spark, d):
    return tiles.tiling_correction(el.image(spark, d).withColumn("value", F.abs("value")), 5, ragged=True).select("c", "y", "x", *rnd("value"))


# quality-control data


@register("size_summary", sql(f", s AS (SELECT instance, count(*) AS size FROM lab WHERE instance <> 0 GROUP BY 1) SELECT count(*) AS n, {rsql(('quantile_cont(size, 0.5)', 'median'), ('avg(size)', 'mean'), ('stddev_samp(size)', 'std'))} FROM s"))
def size_summary(spark, d):
    return qc.size_summary(raster.instance_size(el.labels(spark, d))).select("n", *rnd("median", "mean", "std"))


@register("metric_histogram", "SELECT least(floor((value - 0.0) / 10.0), 19)::INTEGER AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1")
def metric_histogram(spark, d):
    return qc.metric_histogram(el.table(spark, d, "events"), "value", 20, 0.0, 200.0)


@register("metrics_histogram", "SELECT 'l_quantity' AS metric, least(floor(l_quantity / 5.0), 9)::INTEGER AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL UNION ALL SELECT 'l_suppkey', least(floor(l_suppkey / 10.0), 9)::INTEGER, count(*) FROM lineitem WHERE l_suppkey BETWEEN 0 AND 100 GROUP BY ALL")
def metrics_histogram(spark, d):
    return qc.metrics_histogram(el.table(spark, d, "lineitem"), {"l_quantity": (10, 0.0, 50.0), "l_suppkey": (10, 0.0, 100.0)})


@register("scatter_histogram", "SELECT least(floor(l_quantity / 5.0), 9)::INTEGER AS bx, least(floor(l_suppkey / 10.0), 9)::INTEGER AS by, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_suppkey BETWEEN 0 AND 100 GROUP BY ALL")
def scatter_histogram(spark, d):
    return qc.scatter_histogram(el.table(spark, d, "lineitem"), "l_quantity", "l_suppkey", 10, (0.0, 50.0), (0.0, 100.0))


# composites


@register("spatial_pixel_neighbors", sql(", m AS (SELECT y // 4 AS gy, x // 4 AS gx, instance AS label FROM lab GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY y // 4, x // 4 ORDER BY count(*) DESC, instance) = 1), k AS (SELECT * FROM m WHERE label <> 0) SELECT a.label AS a, b.label AS b, count(*) AS n FROM k a JOIN k b ON abs(a.gy - b.gy) + abs(a.gx - b.gx) = 1 GROUP BY ALL"))
def spatial_pixel_neighbors(spark, d):
    return composites.spatial_pixel_neighbors(el.labels(spark, d), 4)["enrichment"].where("n > 0").select("a", "b", F.col("n").cast("long"))


@register("density_image", sql(f", b AS (SELECT floor(y)::BIGINT AS y, floor(x)::BIGINT AS x, count(*) AS n FROM pts WHERE x >= 0 AND x < 20 AND y >= 0 AND y < 30 GROUP BY 1, 2), p AS (SELECT i // 20 AS y, i % 20 AS x FROM range(600) r(i)) SELECT 0 AS c, p.y, p.x, {rsql(('coalesce(n / (SELECT max(n) FROM b), 0)', 'value'))} FROM p LEFT JOIN b USING (y, x)"))
def density_image(spark, d):
    return composites.density_image(el.points(spark, d), 30, 20, 0.0, 16).select("c", "y", "x", *rnd("value"))


@register("signal_table", sql(f", sig AS (SELECT y % 2 AS odd, c, abs(value) AS value FROM img){OTSU.format(keys='odd, c')} SELECT c, {rsql(('coalesce(avg(snr) FILTER (odd = 0), 0)', 'even'), ('coalesce(avg(snr) FILTER (odd = 1), 0)', 'odd'))} FROM snr GROUP BY c"))
def signal_table(spark, d):
    rows = el.image(spark, d).withColumn("value", F.abs("value"))
    images = rows.withColumn("image", F.when(F.col("y") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))
    return composites.signal_table(images, ["even", "odd"]).select("c", *rnd("even", "odd"))


@register("regionprops_table", sql("SELECT 'r' AS region, instance, count(*) AS area FROM lab WHERE instance <> 0 GROUP BY ALL"))
def regionprops_table(spark, d):
    lab = el.labels(spark, d)
    obs = lab.where("instance <> 0").select(F.lit("r").alias("region"), "instance").distinct()
    return composites.regionprops_table(lab, obs, "r").select("region", "instance", "area")


@register("spots_to_mask", sql(", s AS (SELECT c_custkey AS barcode, (c_custkey % 20) * 5.0 + 2.5 AS x, (c_custkey // 20) * 5.0 + 2.5 AS y, row_number() OVER (ORDER BY c_custkey) AS instance FROM customer), g AS (SELECT instance, floor(y)::BIGINT + dy AS py, floor(x)::BIGINT + dx AS px, x, y FROM s, range(-3, 4) a(dy), range(-3, 4) b(dx)) SELECT py AS y, px AS x, min(instance) AS instance FROM g WHERE pow(py + 0.5 - y, 2) + pow(px + 0.5 - x, 2) <= 4 GROUP BY 1, 2"))
def spots_to_mask(spark, d):
    spots = el.table(spark, d, "customer").select(F.col("c_custkey").alias("barcode"), ((F.col("c_custkey") % 20) * 5.0 + 2.5).alias("x"), (F.expr("c_custkey div 20") * 5.0 + 2.5).alias("y"))
    return instruments.spots_to_mask(spots, 2.0)
