"""Analysis of count and intensity tables in long form: x (instance, gene, value), obs (instance, ...).

Zeros aren't stored, but take part in means and deviations over cells: those use the number of cells, taken from obs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def qc_metrics(x: DataFrame, obs: DataFrame, top: Sequence[int] = (2, 5)) -> dict[str, DataFrame]:
    """obs: total_counts, n_genes_by_counts, pct_counts_in_top_k_genes; var: n_cells_by_counts, mean_counts over all cells, total_counts."""
    order = Window.partitionBy("instance").orderBy(F.desc("value"), "gene")
    ranked = x.where("value > 0").withColumn("_r", F.row_number().over(order))
    cells = ranked.groupBy("instance").agg(F.sum("value").alias("total_counts"), F.count("*").alias("n_genes_by_counts"), *[F.sum(F.when(F.col("_r") <= k, F.col("value"))).alias(f"_top{k}") for k in top])
    cells = obs.select("instance").join(cells, "instance", "left").select(
        "instance", F.coalesce("total_counts", F.lit(0.0)).alias("total_counts"), F.coalesce("n_genes_by_counts", F.lit(0)).cast("long").alias("n_genes_by_counts"),
        *[(100 * F.col(f"_top{k}") / F.col("total_counts")).alias(f"pct_counts_in_top_{k}_genes") for k in top],
    )
    n = obs.select("instance").distinct().count()
    genes = x.where("value > 0").groupBy("gene").agg(F.count("*").alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    return {"obs": cells, "var": genes.withColumn("mean_counts", F.col("total_counts") / F.lit(n))}


def filter_cells(x: DataFrame, min_counts: float) -> DataFrame:
    """Rows of cells whose total is at least ``min_counts``."""
    kept = x.groupBy("instance").agg(F.sum("value").alias("t")).where(F.col("t") >= min_counts).select("instance")
    return x.join(kept, "instance", "left_semi")


def filter_genes(x: DataFrame, min_cells: int) -> DataFrame:
    """Rows of genes present in at least ``min_cells`` of the remaining cells."""
    kept = x.where("value > 0").groupBy("gene").agg(F.count("*").alias("t")).where(F.col("t") >= min_cells).select("gene")
    return x.join(kept, "gene", "left_semi")


def normalize_by_size(x: DataFrame, sizes: DataFrame) -> DataFrame:
    """Values times 100 over the cell's size; ``sizes`` is (instance, size). Cells without a size stay, with null values."""
    return x.join(sizes.select("instance", "size"), "instance", "left").withColumn("value", F.col("value") * 100 / F.col("size")).drop("size").select(x.columns)


def normalize_by_total(x: DataFrame) -> DataFrame:
    """Values times the median of the cells' totals over the cell's total."""
    totals = x.groupBy("instance").agg(F.sum("value").alias("t"))
    median = totals.where("t > 0").agg(F.percentile("t", 0.5).alias("m"))
    return x.join(totals, "instance").join(F.broadcast(median)).withColumn("value", F.coalesce(F.try_divide(F.col("value") * F.col("m"), F.col("t")), F.lit(0.0))).select(x.columns)


def log1p(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.log1p("value"))


def scale(x: DataFrame, obs: DataFrame, max_value: float = 10.0) -> DataFrame:
    """Centre and scale each gene over all cells (sample deviation, 1 where it is 0), clipped at +-max_value; the result is dense.

    Mean and deviation come from sums of what is stored and the number of cells, so that only the output is dense.
    """
    n = obs.select("instance").distinct().count()
    sums = x.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - n * mean * mean) / max(1, n - 1)))
    genes = sums.select("gene", mean.alias("m"), F.when(deviation > 0, deviation).otherwise(1.0).alias("d"))
    dense = obs.select("instance").join(F.broadcast(genes)).join(x, ["instance", "gene"], "left")
    z = (F.coalesce("value", F.lit(0.0)) - F.col("m")) / F.col("d")
    return dense.select("instance", "gene", F.greatest(F.lit(-max_value), F.least(F.lit(max_value), z)).alias("value"))


def quantile_normalize(x: DataFrame, q: float = 0.999, max_value: float = 1.0) -> DataFrame:
    """Values over their gene's quantile of non-zero values, times 100, clipped at 100 * max_value."""
    tops = x.where("value <> 0").groupBy("gene").agg(F.percentile("value", q).alias("p"))
    scaled = F.least(F.lit(100 * max_value), F.coalesce(F.try_divide(100 * F.col("value"), F.col("p")), F.lit(0.0)))
    return x.join(tops, "gene", "left").withColumn("value", scaled).select(x.columns)


def highly_variable(x: DataFrame, obs: DataFrame, n_top: int, bins: int = 20) -> DataFrame:
    """(gene, mean, dispersion, score): genes ranked by dispersion within equal-count bins of the mean, the ``n_top`` first."""
    n = obs.select("instance").distinct().count()
    stats = x.groupBy("gene").agg((F.sum("value") / n).alias("mean"), ((F.sum(F.col("value") * F.col("value")) - F.sum("value") * F.sum("value") / n) / max(1, n - 1)).alias("var"))
    stats = stats.select("gene", "mean", F.try_divide("var", "mean").alias("dispersion")).withColumn("_bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))
    own = Window.partitionBy("_bin")
    score = F.try_divide(F.col("dispersion") - F.avg("dispersion").over(own), F.stddev_samp("dispersion").over(own))
    return stats.select("gene", "mean", "dispersion", F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "gene").limit(n_top)


def preprocess_transcriptomics(x: DataFrame, obs: DataFrame, min_counts: float = 10, min_cells: int = 5, size_norm: bool = True, max_value: float | None = 10.0) -> dict[str, DataFrame]:
    """Filter cells, then genes; normalise by size (obs.size) or by total; log1p; scale. ``raw`` keeps the counts that pass."""
    raw = filter_genes(filter_cells(x, min_counts), min_cells)
    cells = obs.join(raw.select("instance").distinct(), "instance", "left_semi")
    out = log1p(normalize_by_size(raw, cells) if size_norm else normalize_by_total(raw))
    return {"x": out if max_value is None else scale(out, cells, max_value), "raw": raw, "obs": cells, "log": out}


def preprocess_proteomics(x: DataFrame, obs: DataFrame, size_norm: bool = True, q: float | None = None, max_value: float | None = None, log: bool = True) -> DataFrame:
    """The same chain for intensities, without filters; scaling and quantile normalisation exclude each other."""
    if q is not None and max_value is not None:
        raise ValueError("scale or quantile normalisation, not both")
    out = normalize_by_size(x, obs) if size_norm else normalize_by_total(x)
    out = log1p(out) if log else out
    return quantile_normalize(out, q) if q is not None else scale(out, obs, max_value) if max_value is not None else out


def subset(x: DataFrame, obs: DataFrame, regions: Sequence | None = None, genes: Sequence[str] | None = None, positions: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """The table of some regions and genes: ``x`` with the gene's ``place`` in the choice, and ``obs``; None takes all.

    Genes are chosen by name, or by position among the sorted names, and stand in the order of the choice. Raises
    ``ValueError`` for names and positions that the table doesn't have, or where both are given.
    """
    if genes is not None and positions is not None:
        raise ValueError("genes by name or by position, not both")
    cells = obs if regions is None else obs.where(F.col("region").isin(list(regions)))
    known = [r.gene for r in x.select("gene").distinct().orderBy("gene").collect()]
    if positions is not None and any(not 0 <= i < len(known) for i in positions):
        raise ValueError("a position is outside the table")
    wanted = known if genes is None and positions is None else list(genes) if positions is None else [known[i] for i in positions]
    if set(wanted) - set(known):
        raise ValueError(f"the table has no {sorted(set(wanted) - set(known))}")
    order = x.sparkSession.createDataFrame([(g, i) for i, g in enumerate(dict.fromkeys(wanted))], "gene string, place int")
    # as long as the list that was asked for
    kept = x.join(F.broadcast(order), "gene").join(cells.select("instance").distinct(), "instance", "left_semi")
    return {"x": kept.select(*x.columns, "place"), "obs": cells}


def filter_on_size(obs: DataFrame, min_size: float, max_size: float) -> DataFrame:
    """Cells with min_size < size < max_size."""
    return obs.where((F.col("size") > min_size) & (F.col("size") < max_size))


def split_by_table(shapes: DataFrame, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shapes whose instance is in the table, and the others."""
    keys = obs.select("instance").distinct()
    return shapes.join(keys, "instance", "left_semi"), shapes.join(keys, "instance", "left_anti")


def correct_marker_genes(scores: DataFrame, corrections: dict[str, tuple[float, float]]) -> DataFrame:
    """In each named score column: a score over the first number is divided by the second; unknown columns are passed over."""
    return scores.select([F.when(F.col(c) > corrections[c][0], F.col(c) / corrections[c][1]).otherwise(F.col(c)).alias(c) if c in corrections else F.col(c) for c in scores.columns])


def weighted_mean(rows: DataFrame, keys: Sequence[str], value: str = "value", weight: str = "size") -> DataFrame:
    """Sum of value times weight over sum of weights for each key."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def cluster_intensity(x: DataFrame, obs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, gene, value): size-weighted mean of each cluster; clusters is (instance, cluster)."""
    return weighted_mean(x.join(obs.select("instance", "size"), "instance").join(clusters, "instance"), ["cluster", "gene"])


def som_intensity(image: DataFrame, cluster_mask: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Mean channel intensity (times 100) of each SOM cluster, and of each metacluster weighted by cluster sizes.

    ``mapping`` is (cluster, metacluster); a cluster without one raises ``ValueError``.
    """
    sizes = cluster_mask.where("instance <> 0").groupBy(F.col("instance").alias("cluster")).agg(F.count("*").alias("size"))
    if sizes.join(mapping, "cluster", "left_anti").limit(1).count():
        raise ValueError("a cluster has no metacluster")
    sums = image.join(cluster_mask.where("instance <> 0"), ["y", "x"]).groupBy(F.col("instance").alias("cluster"), "c").agg(F.sum("value").alias("s"))
    rows = sums.join(sizes, "cluster").join(F.broadcast(mapping), "cluster").select("cluster", "metacluster", "c", "size", (100 * F.col("s") / F.col("size")).alias("value"))
    return {"clusters": rows.select("cluster", "c", "size", "value"), "metaclusters": weighted_mean(rows, ["metacluster", "c"])}


def group_mean(x: DataFrame, clusters: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """(cluster, gene, value): unweighted mean over the cells of each cluster, zeros included; categories without cells get 0."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    out = x.join(clusters, "instance").groupBy("cluster", "gene").agg(F.sum("value").alias("s")).join(n, "cluster").select("cluster", "gene", (F.col("s") / F.col("n")).alias("value"))
    if categories is None:
        return out
    wanted = x.sparkSession.createDataFrame([(c,) for c in categories], f"cluster {dict(clusters.dtypes)['cluster']}")
    return F.broadcast(wanted).join(x.select("gene").distinct()).join(out, ["cluster", "gene"], "left").select("cluster", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def cell_cluster_counts(masks: DataFrame, pixels: DataFrame) -> DataFrame:
    """(region, instance, cluster, n): pixels of each cluster in each cell over several regions, without background on either side."""
    return masks.where("instance <> 0").join(pixels.where("cluster <> 0"), ["region", "y", "x"]).groupBy("region", "instance", "cluster").agg(F.count("*").alias("n"))


def weighted_channel_expression(counts: DataFrame, intensity: DataFrame, sizes: DataFrame) -> DataFrame:
    """(instance, c, value): sum over clusters of raw counts (instance, cluster, n) times cluster intensity (cluster, c, value), over cell size.

    Raises ``ValueError`` where the two sides' clusters differ.
    """
    a, b = counts.select("cluster").distinct(), intensity.select("cluster").distinct()
    if a.join(b, "cluster", "left_anti").limit(1).count() or b.join(a, "cluster", "left_anti").limit(1).count():
        raise ValueError("counts and intensities have different clusters")
    sums = counts.join(F.broadcast(intensity), "cluster").groupBy("instance", "c").agg(F.sum(F.col("n") * F.col("value")).alias("s"))
    return sums.join(sizes.select("instance", "size"), "instance").select("instance", "c", (F.col("s") / F.col("size")).alias("value"))


def cluster_mapping(obs: DataFrame, cluster: str = "cluster", metacluster: str = "metacluster") -> DataFrame:
    """Distinct pairs of cluster and metacluster, sorted."""
    return obs.select(cluster, metacluster).distinct().orderBy(cluster, metacluster)


def export_clusters(counts: DataFrame, path: str) -> None:
    """Cluster counts with ids from 1 as CSV."""
    counts.withColumn("cluster", F.col("cluster") + 1).withColumnRenamed("instance", "label").write.mode("overwrite").option("header", True).csv(path)


def asinh_scores(x: DataFrame) -> DataFrame:
    """asinh of values over five times the gene's 0.2 quantile (its maximum, where that is 0), then z-scores by sample deviation."""
    base = x.groupBy("gene").agg(F.percentile("value", 0.2).alias("p"), F.max("value").alias("m")).select("gene", F.when(F.col("p") != 0, F.col("p")).otherwise(F.col("m")).alias("p"))
    rows = x.join(F.broadcast(base), "gene").withColumn("value", F.asinh(F.coalesce(F.try_divide(F.col("value"), 5 * F.col("p")), F.lit(0.0)))).drop("p")
    stats = rows.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    return rows.join(F.broadcast(stats), "gene").select(*[c for c in x.columns if c != "value"], F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("d")), F.lit(0.0)).alias("value"))


def z_scores(rows: DataFrame, key: str = "gene", clip: float = 3.0) -> DataFrame:
    """Values as z-scores of their key (population deviation), clipped."""
    stats = rows.groupBy(key).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("d")), F.lit(0.0))
    return rows.join(F.broadcast(stats), key).withColumn("value", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).select(rows.columns)


def duplicate_keys(obs: DataFrame, keys: Sequence[str] = ("region", "instance")) -> DataFrame:
    """Keys that stand more than once."""
    return obs.groupBy(*keys).count().where("count > 1")


def align_features(obs: DataFrame, features: DataFrame, keys: Sequence[str] = ("region", "instance")) -> DataFrame:
    """obs with features; raises where a row of obs has none, drops features without a row."""
    if obs.join(features, list(keys), "left_anti").limit(1).count():
        raise ValueError("a row of the table has no features")
    return obs.join(features, list(keys))
