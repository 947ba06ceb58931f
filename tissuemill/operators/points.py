"""Transcript points (x, y, [z,] gene): allocation to instances, binning, density and coverage of genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_pixels(points: DataFrame, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Points with px, py (and pz): coordinates less the raster's offset (y, x), rounded half to even."""
    out = points.withColumn("px", F.rint(F.col("x") - offset[1]).cast("long")).withColumn("py", F.rint(F.col("y") - offset[0]).cast("long"))
    return out.withColumn("pz", F.rint("z").cast("long")) if "z" in points.columns else out


def points_in_mask(points: DataFrame, mask: DataFrame, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Points with the instance of their pixel; points outside the mask or on background drop out."""
    deep = "z" in mask.columns and "z" in points.columns
    pixels = mask.where("instance <> 0").select(F.col("y").cast("long").alias("py"), F.col("x").cast("long").alias("px"), *([F.col("z").cast("long").alias("pz")] if deep else []), "instance")
    return to_pixels(points, offset).join(pixels, ["py", "px", *(["pz"] if deep else [])])


def allocate(points: DataFrame, mask: DataFrame, offset: tuple[float, float] = (0.0, 0.0), gene: str = "gene") -> dict[str, DataFrame]:
    """The count table of points in a mask: ``x`` (instance, gene, count) and ``obs`` (instance, x, y, [z]: means of the rounded coordinates)."""
    found = points_in_mask(points, mask, offset)
    place = [F.avg("px").alias("x"), F.avg("py").alias("y")] + ([F.avg("pz").alias("z")] if "pz" in found.columns else [])
    return {"x": found.groupBy("instance", F.col(gene).cast("string").alias("gene")).agg(F.count("*").alias("count")), "obs": found.groupBy("instance").agg(*place)}


def bin_counts(spots: DataFrame, counts: DataFrame, grid: DataFrame) -> dict[str, DataFrame]:
    """Sum the count vectors of spots (barcode, x, y) over the grid label of their rounded place.

    ``counts`` is (barcode, gene, count). Returns ``x`` (instance, gene, count) without bins of total zero, and ``obs`` with the
    mean of the rounded places. A barcode that stands twice raises ``ValueError``.
    """
    if spots.groupBy("barcode").count().where("count > 1").limit(1).count():
        raise ValueError("a barcode stands more than once")
    placed = points_in_mask(spots, grid)
    rows = counts.join(placed.select("barcode", "instance"), "barcode").groupBy("instance", "gene").agg(F.sum("count").alias("count"))
    full = rows.groupBy("instance").agg(F.sum("count").alias("total")).where("total > 0").select("instance")
    obs = placed.groupBy("instance").agg(F.avg("px").alias("x"), F.avg("py").alias("y"))
    return {"x": rows.where("count <> 0").join(full, "instance", "left_semi"), "obs": obs.join(full, "instance", "left_semi")}


def append_table(table: DataFrame, more: DataFrame, keys: Sequence[str] = ("region", "instance")) -> DataFrame:
    """Rows of both tables on the columns they share; raises where the keys differ or a region is in both."""
    missing = [k for k in keys if k not in table.columns or k not in more.columns]
    if missing:
        raise ValueError(f"both tables need the keys {missing}")
    region = keys[0]
    if table.select(region).distinct().join(more.select(region).distinct(), region, "left_semi").limit(1).count():
        raise ValueError("a region is in the table already")
    shared = [c for c in table.columns if c in more.columns]
    return table.select(shared).unionByName(more.select(shared))


def crop(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points in the half-open box (xmin, xmax, ymin, ymax)."""
    xmin, xmax, ymin, ymax = box
    return points.where((F.col("x") >= xmin) & (F.col("x") < xmax) & (F.col("y") >= ymin) & (F.col("y") < ymax))


def density(points: DataFrame, box: tuple[float, float, float, float] | None = None, fraction: float | None = None, seed: int = 42, bin_size: float = 1.0) -> DataFrame:
    """(y, x, n, value): points per floored bin, and their share of the fullest bin; ``fraction`` samples by a hash of the row."""
    rows = points if box is None else crop(points, box)
    if fraction is not None:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1_000_000)) < int(fraction * 1_000_000))
    x0, y0 = (0.0, 0.0) if box is None else (box[0], box[2])
    counts = rows.groupBy(F.floor((F.col("y") - y0) / bin_size).alias("y"), F.floor((F.col("x") - x0) / bin_size).alias("x")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most)).select("y", "x", "n", (F.col("n") / F.col("most")).alias("value"))


def genes_left_out(points: DataFrame, counts: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(gene, kept, raw, proportion, log_raw): allocated counts against points in the mask's box; genes that were never kept count 0."""
    raw = crop(points, box).groupBy("gene").agg(F.count("*").alias("raw"))
    kept = counts.groupBy("gene").agg(F.sum("count").alias("kept"))
    return raw.join(kept, "gene", "left").select("gene", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "raw", (F.coalesce("kept", F.lit(0)) / F.col("raw")).alias("proportion"), F.ln("raw").alias("log_raw"))


def left_out_correlation(points: DataFrame, counts: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(n, pearson): genes, and the correlation of the kept proportion with the log count, null where either doesn't vary; raises where a gene of the box was never kept."""
    rows = genes_left_out(points, counts, box)
    if rows.where("kept = 0").limit(1).count():
        raise ValueError("a gene has no allocated point")
    pearson = F.try_divide(F.covar_samp("proportion", "log_raw"), F.stddev_samp("proportion") * F.stddev_samp("log_raw"))
    return rows.agg(F.count("*").alias("n"), pearson.alias("pearson"))
