"""Queries of table analysis, annotation and clustering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, cluster, masks, table
from . import elements as el
from . import register
from .spatial import N, rnd, rsql

sql = el.sql
TOT = ", tot AS (SELECT instance, sum(value) AS t FROM cnt GROUP BY 1)"


@register("qc_obs", sql(f""", r AS (SELECT instance, value, row_number() OVER (PARTITION BY instance ORDER BY value DESC, gene) AS r FROM cnt)
SELECT instance, sum(value) AS total_counts, count(*) AS n_genes_by_counts, {rsql(('100 * sum(value) FILTER (r <= 2) / sum(value)', 'pct_counts_in_top_2_genes'), ('100 * sum(value) FILTER (r <= 5) / sum(value)', 'pct_counts_in_top_5_genes'))} FROM r GROUP BY 1"""))  # fmt: skip
def qc_obs(spark, d):
    out = table.qc_metrics(el.counts(spark, d), el.cells(spark, d))["obs"]
    return out.select("instance", "total_counts", "n_genes_by_counts", *rnd("pct_counts_in_top_2_genes", "pct_counts_in_top_5_genes"))


@register("qc_var", sql(f"SELECT gene, count(*) AS n_cells_by_counts, sum(value) AS total_counts, {rsql(('sum(value) / (SELECT count(*) FROM cel)', 'mean_counts'))} FROM cnt GROUP BY 1"))
def qc_var(spark, d):
    return table.qc_metrics(el.counts(spark, d), el.cells(spark, d))["var"].select("gene", "n_cells_by_counts", "total_counts", *rnd("mean_counts"))


@register("filter_cells_genes", sql(f"{TOT}, a AS (SELECT * FROM cnt WHERE instance IN (SELECT instance FROM tot WHERE t >= 40)) SELECT * FROM a WHERE gene IN (SELECT gene FROM a GROUP BY 1 HAVING count(*) >= 30)"))
def filter_cells_genes(spark, d):
    return table.filter_genes(table.filter_cells(el.counts(spark, d), 40), 30)


@register("normalize_by_size", sql(f"SELECT instance, gene, {rsql(('value * 100 / size', 'value'))} FROM cnt JOIN cel USING (instance)"))
def normalize_by_size(spark, d):
    return table.normalize_by_size(el.counts(spark, d), el.cells(spark, d)).select("instance", "gene", *rnd("value"))


@register("normalize_by_total", sql(f"{TOT} SELECT instance, gene, {rsql(('value * (SELECT quantile_cont(t, 0.5) FROM tot) / t', 'value'))} FROM cnt JOIN tot USING (instance)"))
def normalize_by_total(spark, d):
    return table.normalize_by_total(el.counts(spark, d)).select("instance", "gene", *rnd("value"))


SCALED = """, g AS (SELECT gene, sum(value) / (SELECT count(*) FROM cel) AS m, sum(value) AS s, sum(value * value) AS q FROM lg GROUP BY 1),
h AS (SELECT gene, m, sqrt(greatest(0, (q - (SELECT count(*) FROM cel) * m * m) / ((SELECT count(*) FROM cel) - 1))) AS d FROM g),
sc AS (SELECT cel.instance, h.gene, greatest(-10.0, least(10.0, (coalesce(value, 0) - m) / CASE WHEN d > 0 THEN d ELSE 1 END)) AS value FROM cel, h LEFT JOIN lg ON lg.instance = cel.instance AND lg.gene = h.gene)"""
LOG = ", lg AS (SELECT instance, gene, ln(1 + value * 100 / size) AS value FROM cnt JOIN cel USING (instance))"


@register("scale", sql(f"{LOG}{SCALED} SELECT instance, gene, round(value + 0.0, 5) AS value FROM sc"))
def scale(spark, d):
    x = table.log1p(table.normalize_by_size(el.counts(spark, d), el.cells(spark, d)))
    return table.scale(x, el.cells(spark, d)).select("instance", "gene", F.round(F.col("value") + 0.0, 5).alias("value"))


@register("preprocess_transcriptomics", sql(f"{TOT}, a AS (SELECT * FROM cnt WHERE instance IN (SELECT instance FROM tot WHERE t >= 10)), b AS (SELECT * FROM a WHERE gene IN (SELECT gene FROM a GROUP BY 1 HAVING count(*) >= 5)) SELECT instance, gene, {rsql(('ln(1 + value * 100 / size)', 'value'))} FROM b JOIN cel USING (instance)"))
def preprocess_transcriptomics(spark, d):
    return table.preprocess_transcriptomics(el.counts(spark, d), el.cells(spark, d))["log"].select("instance", "gene", *rnd("value"))


@register("quantile_normalize", sql(f", p AS (SELECT gene, quantile_cont(value, 0.9) AS p FROM cnt WHERE value <> 0 GROUP BY 1) SELECT instance, gene, {rsql(('least(100.0, 100 * value / p)', 'value'))} FROM cnt JOIN p USING (gene)"))
def quantile_normalize(spark, d):
    return table.quantile_normalize(el.counts(spark, d), 0.9).select("instance", "gene", *rnd("value"))


@register("highly_variable", sql(f""", n AS (SELECT count(*) AS n FROM cel), s AS (SELECT gene, sum(value) / any_value(n) AS mean, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1) AS var FROM cnt, n GROUP BY 1),
b AS (SELECT gene, mean, var / mean AS dispersion, ntile(5) OVER (ORDER BY mean, gene) AS bin FROM s),
z AS (SELECT gene, dispersion, coalesce((dispersion - avg(dispersion) OVER (PARTITION BY bin)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY bin), 0), 0) AS score FROM b)
SELECT gene, {rsql(('dispersion', 'dispersion'), ('score', 'score'))} FROM z ORDER BY z.score DESC, gene LIMIT 10"""))  # fmt: skip
def highly_variable(spark, d):
    return table.highly_variable(el.counts(spark, d), el.cells(spark, d), 10, 5).select("gene", *rnd("dispersion", "score"))


@register("preprocess_proteomics", sql(f", v AS (SELECT instance, gene, ln(1 + value * 100 / size) AS value FROM cnt JOIN cel USING (instance)), q AS (SELECT gene, quantile_cont(value, 0.99) AS p FROM v WHERE value <> 0 GROUP BY 1) SELECT instance, gene, {rsql(('least(100.0, coalesce(100 * value / nullif(p, 0), 0))', 'value'))} FROM v LEFT JOIN q USING (gene)"))
def preprocess_proteomics(spark, d):
    return table.preprocess_proteomics(el.counts(spark, d), el.cells(spark, d), q=0.99).select("instance", "gene", *rnd("value"))


@register("table_subset", sql(", k AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM (SELECT DISTINCT gene FROM cnt)), w AS (SELECT gene, CASE i WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS place FROM k WHERE i IN (4, 1, 2)) SELECT instance, gene, value, place FROM cnt JOIN w USING (gene) WHERE instance IN (SELECT instance FROM cel WHERE region IN (0, 3, 7))"))
def table_subset(spark, d):
    return table.subset(el.counts(spark, d), el.cells(spark, d), regions=[0, 3, 7], positions=[4, 1, 2])["x"]


@register("filter_on_size", sql("SELECT instance, region, size FROM cel WHERE size > 20 AND size < 60"))
def filter_on_size(spark, d):
    return table.filter_on_size(el.cells(spark, d), 20, 60)


@register("cluster_intensity", sql(f"SELECT region AS cluster, gene, {rsql(('sum(value * size) / sum(size)', 'value'))} FROM cnt JOIN cel USING (instance) GROUP BY ALL"))
def cluster_intensity(spark, d):
    cells = el.cells(spark, d)
    return table.cluster_intensity(el.counts(spark, d), cells, cells.select("instance", F.col("region").alias("cluster"))).select("cluster", "gene", *rnd("value"))


@register("som_intensity", sql(f", s AS (SELECT instance AS cluster, count(*) AS size FROM clu GROUP BY 1), i AS (SELECT instance AS cluster, c, sum(value) AS s FROM img JOIN clu USING (y, x) GROUP BY ALL), r AS (SELECT cluster, (cluster % 2)::BIGINT AS metacluster, c, size, 100 * s / size AS value FROM i JOIN s USING (cluster)) SELECT metacluster, c, {rsql(('sum(value * size) / sum(size)', 'value'))} FROM r GROUP BY ALL"))
def som_intensity(spark, d):
    mapping = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "cluster long, metacluster long")
    raster = el.cluster_raster(spark, d)
    return table.som_intensity(el.image(spark, d), raster.withColumn("instance", F.col("instance").cast("long")), mapping)["metaclusters"].select("metacluster", "c", *rnd("value"))


@register("group_mean", sql(f", n AS (SELECT region AS cluster, count(*) AS n FROM cel GROUP BY 1), s AS (SELECT region AS cluster, gene, sum(value) AS s FROM cnt JOIN cel USING (instance) GROUP BY ALL) SELECT cluster, gene, {rsql(('s / n', 'value'))} FROM s JOIN n USING (cluster) UNION ALL SELECT 99, gene, 0.0::DOUBLE FROM (SELECT DISTINCT gene FROM cnt)"))
def group_mean(spark, d):
    clusters = el.cells(spark, d).select("instance", F.col("region").alias("cluster"))
    names = [r.cluster for r in clusters.select("cluster").distinct().collect()] + [99]
    return table.group_mean(el.counts(spark, d), clusters, names).where("value <> 0 or cluster = 99").select("cluster", "gene", *rnd("value"))


@register("cell_cluster_counts", sql("SELECT 'a' AS region, l.instance, c.instance::BIGINT AS cluster, count(*) AS n FROM lab l JOIN clu c USING (y, x) WHERE l.instance <> 0 GROUP BY ALL"))
def cell_cluster_counts(spark, d):
    named = lambda df: df.withColumn("region", F.lit("a"))
    clusters = el.cluster_raster(spark, d).select("y", "x", F.col("instance").cast("long").alias("cluster"))
    return table.cell_cluster_counts(named(el.labels(spark, d)), named(clusters))


@register("weighted_channel_expression", sql(f", k AS (SELECT l.instance, c.instance AS cluster, count(*) AS n FROM lab l JOIN clu c USING (y, x) WHERE l.instance <> 0 GROUP BY ALL), v AS (SELECT instance AS cluster, c, avg(value) AS value FROM img JOIN clu USING (y, x) GROUP BY ALL), z AS (SELECT instance, count(*) AS size FROM lab GROUP BY 1) SELECT instance, c, {rsql(('sum(n * value) / any_value(size)', 'value'))} FROM k JOIN v USING (cluster) JOIN z USING (instance) GROUP BY instance, c"))
def weighted_channel_expression(spark, d):
    lab, clu = el.labels(spark, d), el.cluster_raster(spark, d).select("y", "x", F.col("instance").cast("long").alias("cluster"))
    counts = lab.where("instance <> 0").join(clu, ["y", "x"]).groupBy("instance", "cluster").agg(F.count("*").alias("n"))
    intensity = el.image(spark, d).join(clu, ["y", "x"]).groupBy("cluster", "c").agg(F.avg("value").alias("value"))
    sizes = lab.groupBy("instance").agg(F.count("*").alias("size"))
    return table.weighted_channel_expression(counts, intensity, sizes).select("instance", "c", *rnd("value"))


@register("cluster_mapping", sql("SELECT DISTINCT region AS cluster, region % 3 AS metacluster FROM cel"))
def cluster_mapping(spark, d):
    return table.cluster_mapping(el.cells(spark, d).select(F.col("region").alias("cluster"), (F.col("region") % 3).alias("metacluster")))


@register("asinh_scores", sql(f", b AS (SELECT gene, CASE WHEN quantile_cont(value, 0.2) <> 0 THEN quantile_cont(value, 0.2) ELSE max(value) END AS p FROM cnt GROUP BY 1), a AS (SELECT instance, gene, asinh(value / (5 * p)) AS value FROM cnt JOIN b USING (gene)) SELECT instance, gene, {rsql(('coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0)', 'value'))} FROM a WINDOW w AS (PARTITION BY gene)"))
def asinh_scores(spark, d):
    return table.asinh_scores(el.counts(spark, d)).select("instance", "gene", *rnd("value"))


@register("z_scores", sql(f"SELECT instance, gene, {rsql(('greatest(-3.0, least(3.0, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0)))', 'value'))} FROM cnt WINDOW w AS (PARTITION BY gene)"))
def z_scores(spark, d):
    return table.z_scores(el.counts(spark, d)).select("instance", "gene", *rnd("value"))


@register("correct_marker_genes", sql(f"{TOT} SELECT instance, CASE WHEN t > 50 THEN t / 2 ELSE t END AS t0, t AS t1 FROM tot"))
def correct_marker_genes(spark, d):
    totals = el.counts(spark, d).groupBy("instance").agg(F.sum("value").alias("t0")).withColumn("t1", F.col("t0"))
    return table.correct_marker_genes(totals, {"t0": (50, 2), "t9": (1, 1)})


# annotation

SCORES = ", mean AS (SELECT gene, sum(value) / (SELECT count(*) FROM cel) AS m FROM cnt GROUP BY 1), sft AS (SELECT type, sum(m) AS shift, count(*) AS k FROM mrk JOIN mean USING (gene) GROUP BY 1), scr AS (SELECT c.instance, s.type, coalesce(v, 0) - shift AS score FROM cel c CROSS JOIN sft s LEFT JOIN (SELECT instance, type, sum(value) AS v FROM cnt JOIN mrk USING (gene) GROUP BY ALL) x ON x.instance = c.instance AND x.type = s.type)"


def scores(spark, d):
    return annotate.weighted_scores(el.counts(spark, d), el.cells(spark, d), el.markers(spark, d))


@register("weighted_scores", sql(f"{SCORES} SELECT instance, type, {rsql(('score', 'score'))} FROM scr"))
def weighted_scores(spark, d):
    return scores(spark, d).select("instance", "type", *rnd("score"))


SCALE_SQL = {
    "MinMax": "coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0)",
    "ZeroMax": "coalesce(score / nullif(max(score) OVER w, 0), 0)",
    "Nmarkers": "score / (SELECT count(*) FROM mrk WHERE mrk.type = scr.type)",
    "Robust": "coalesce((score - (SELECT quantile_cont(s.score, 0.05) FROM scr s WHERE s.type = scr.type)) / nullif((SELECT quantile_cont(s.score, 0.95) - quantile_cont(s.score, 0.05) FROM scr s WHERE s.type = scr.type), 0), 0)",
    "Rank": "(rank() OVER (PARTITION BY type ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY type, round(score, 6)) - 1) / 2.0) / count(*) OVER w",
}


def _scaling(name: str):
    @register(f"scale_scores_{name.lower()}", sql(f"{SCORES} SELECT instance, type, {rsql((SCALE_SQL[name], 'score'))} FROM scr WINDOW w AS (PARTITION BY type)"))
    def scaled(spark, d):
        own = scores(spark, d)
        own = own.withColumn("score", F.round("score", 6)) if name == "Rank" else own
        return annotate.scale_scores(own, name, el.markers(spark, d)).select("instance", "type", *rnd("score"))


for _name in SCALE_SQL:
    _scaling(_name)


ANNOTATED = f"""{SCORES}, q AS (SELECT instance, type, round(score, 6) AS score FROM scr),
b AS (SELECT instance, arg_max(type, (score, -ascii(substr(type, 2)))) AS type, max(score) AS s1 FROM q GROUP BY 1), n AS (SELECT instance, score AS s2 FROM q QUALIFY row_number() OVER (PARTITION BY instance ORDER BY score DESC, type) = 2)"""


@register("annotate", sql(f"{ANNOTATED} SELECT instance, CASE WHEN s1 > 0 THEN type ELSE 'unknown' END AS annotation, s1 AS score_max, round(CASE WHEN s1 <= 0 THEN 0 WHEN s1 + s2 = 0 THEN 'inf'::DOUBLE ELSE (s1 - s2) / ((s1 + s2) / 2) END + 0.0, 4) AS cleanliness FROM b JOIN n USING (instance)"))
def annotate_cells(spark, d):
    out = annotate.annotate(scores(spark, d).withColumn("score", F.round("score", 6)), el.TYPES)
    return out.select("instance", "annotation", "score_max", F.round(F.col("cleanliness") + 0.0, 4).alias("cleanliness"))


@register("annotation_by_cluster", sql(f"{ANNOTATED}, a AS (SELECT instance, CASE WHEN s1 > 0 THEN CASE WHEN type IN ('t0', 't1') THEN 'low' ELSE type END ELSE 'unknown' END AS annotation FROM b), k AS (SELECT region AS cluster, annotation, count(*) AS n FROM a JOIN cel USING (instance) GROUP BY ALL) SELECT cluster, annotation, n, {rsql(('n / sum(n) OVER (PARTITION BY cluster)', 'share'))} FROM k"))
def annotation_by_cluster(spark, d):
    named = annotate.merge_types(annotate.annotate(scores(spark, d).withColumn("score", F.round("score", 6)), el.TYPES), {"low": ["t0", "t1"]})
    clusters = el.cells(spark, d).select("instance", F.col("region").alias("cluster"))
    return annotate.composition_by_cluster(named, clusters).select("cluster", "annotation", "n", *rnd("share"))


@register("marker_scores", sql(f"""{TOT}, g AS (SELECT gene, ntile(5) OVER (ORDER BY mean, gene) AS bin FROM (SELECT gene, sum(value) / (SELECT count(*) FROM cel) AS mean FROM cnt GROUP BY 1)),
o AS (SELECT type, gene, bin FROM mrk JOIN g USING (gene)), u AS (SELECT DISTINCT type, bin FROM o),
t AS (SELECT u.type, g.gene FROM u JOIN g USING (bin) WHERE (u.type, g.gene) NOT IN (SELECT type, gene FROM o) QUALIFY row_number() OVER (PARTITION BY u.type, bin ORDER BY md5(g.gene), g.gene) <= 3),
w AS (SELECT type, gene, 1.0::DOUBLE / count(*) OVER (PARTITION BY type) AS w FROM o UNION ALL SELECT type, gene, -1.0::DOUBLE / count(*) OVER (PARTITION BY type) FROM t),
s AS (SELECT instance, type, sum(value * w) AS score FROM cnt JOIN w USING (gene) GROUP BY ALL)
SELECT instance, type, {rsql(('coalesce(score, 0)', 'score'))} FROM cel CROSS JOIN (SELECT DISTINCT type FROM o) LEFT JOIN s USING (instance, type)"""))  # fmt: skip
def marker_scores(spark, d):
    return annotate.marker_scores(el.counts(spark, d), el.cells(spark, d), el.markers(spark, d).select("gene", "type"), controls=3, bins=5).select("instance", "type", *rnd("score"))


@register("score_genes")
def score_genes(spark, d):
    x = table.log1p(el.counts(spark, d))
    return annotate.score_genes(x, el.cells(spark, d), el.markers(spark, d).select("gene", "type"), el.TYPES)


@register("score_genes_iter")
def score_genes_iter(spark, d):
    from ..shared import keeper

    x = table.log1p(el.counts(spark, d))
    return annotate.score_genes_iter(x, el.cells(spark, d), el.markers(spark, d), el.TYPES, 3, keep=keeper(spark))


# clustering


def vectors(spark, d):
    genes = [r.gene for r in el.markers(spark, d).select("gene").orderBy("gene").collect()]
    return cluster.wide_vectors(table.log1p(el.counts(spark, d)), genes)


@register("kmeans")
def kmeans(spark, d):
    return cluster.kmeans(vectors(spark, d), 5)


@register("pca")
def pca(spark, d):
    return cluster.pca(vectors(spark, d), 5)


@register("lloyd_step", sql(f", c AS (SELECT * FROM (VALUES (0, -0.1::DOUBLE), (1, 0.0), (2, 0.1)) v(cluster, center)), n AS (SELECT img.c AS channel, y, x, value, arg_min(cluster, (abs(value - center), cluster)) AS cluster FROM img, c GROUP BY ALL) SELECT cluster, {rsql(('avg(value)', 'center'))} FROM n GROUP BY 1"))
def lloyd_step(spark, d):
    centers = spark.createDataFrame([(0, -0.1), (1, 0.0), (2, 0.1)], "cluster int, center double")
    nodes = el.image(spark, d).select(F.struct("c", "y", "x").alias("node"), "value")
    return cluster.lloyd_step(nodes, centers).select("cluster", *rnd("center"))


@register("flowsom")
def flowsom(spark, d):
    wide = el.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(64)])
    return cluster.flowsom(wide, ["vec_id"], [f"c{i}" for i in range(64)], width=6, height=6, metaclusters=6)[0]


@register("rank_genes", sql(f""", v AS (SELECT c.instance, c.region, g.gene, coalesce(n.value, 0) AS value FROM cel c CROSS JOIN (SELECT DISTINCT gene FROM cnt) g LEFT JOIN cnt n ON n.instance = c.instance AND n.gene = g.gene),
t AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene) AS n FROM v),
z AS (SELECT gene, sum(pow(k, 3) - k) AS ties FROM (SELECT gene, count(*) AS k FROM v GROUP BY gene, value) GROUP BY 1),
s AS (SELECT region AS cluster, gene, sum(r) AS r, count(*) AS m, any_value(n) AS n FROM t GROUP BY ALL)
SELECT cluster, gene, round(coalesce((r - m * (n + 1) / 2.0) / nullif(sqrt(m * (n - m) / 12.0 * ((n + 1) - ties / (n * (n - 1)))), 0), 0) + 0.0, 4) AS z FROM s JOIN z USING (gene)"""))  # fmt: skip
def rank_genes(spark, d):
    clusters = el.cells(spark, d).select("instance", F.col("region").alias("cluster"))
    return cluster.rank_genes(el.counts(spark, d), el.cells(spark, d), clusters).select("cluster", "gene", F.round(F.col("z") + 0.0, 4).alias("z"))


@register("filter_shapes", sql("SELECT instance FROM (SELECT DISTINCT instance FROM grd) SEMI JOIN cel USING (instance)"))
def filter_shapes(spark, d):
    shapes = el.grid(spark, d).select("instance").distinct()
    return table.split_by_table(shapes, el.cells(spark, d))[0]


@register("align_features", sql("SELECT instance, n FROM (SELECT instance, count(*) AS n FROM lab WHERE instance <> 0 GROUP BY 1)"))
def align_features(spark, d):
    lab = el.labels(spark, d)
    obs = lab.where("instance <> 0").select("instance").distinct().withColumn("region", F.lit("a"))
    features = lab.groupBy("instance").agg(F.count("*").alias("n")).withColumn("region", F.lit("a"))
    return table.align_features(obs, features).select("instance", "n")


@register("merge_nuclei", sql(""", nuc AS (SELECT y, x, CASE WHEN y % 5 = 2 AND x % 5 = 2 THEN instance ELSE 0 END AS instance FROM grd), cl AS (SELECT y, x, CASE WHEN instance IN (1, 2) THEN instance ELSE 0 END AS instance FROM lab),
k AS (SELECT n.instance, row_number() OVER (ORDER BY n.instance) + 2 AS new FROM nuc n JOIN cl c USING (y, x) WHERE n.instance <> 0 AND c.instance = 0)
SELECT y, x, CASE WHEN c.instance <> 0 THEN c.instance ELSE coalesce(new, 0) END::BIGINT AS instance FROM cl c JOIN (SELECT * FROM grd) g USING (y, x) LEFT JOIN k ON k.instance = CASE WHEN abs(y % 5 - 2) <= 1 AND abs(x % 5 - 2) <= 1 THEN g.instance ELSE 0 END"""))
def merge_nuclei(spark, d):
    grid, lab = el.grid(spark, d), el.labels(spark, d)
    within = lambda k: (F.abs(F.col("y") % 5 - 2) <= k) & (F.abs(F.col("x") % 5 - 2) <= k)
    shape = lambda k: grid.withColumn("instance", F.when(within(k), F.col("instance")).otherwise(0))
    cells = lab.withColumn("instance", F.when(F.col("instance").isin(1, 2), F.col("instance")).otherwise(0))
    # nuclei in incomplete grid cells at the border have no center pixel
    centers = shape(0).where("instance <> 0").select("instance").distinct()
    expanded = shape(1).join(centers, "instance", "left_semi").select("y", "x", "instance")
    return masks.merge_nuclei(shape(0), expanded, cells, 0.5)
