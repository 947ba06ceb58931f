"""Operators put together from others: neighbours of pixels, boundaries by growth, density images, signal tables, halo merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, masks, points, raster, tiles


def spatial_pixel_neighbors(mask: DataFrame, size: int, mode: str = "most_frequent", permutations: int = 100, seed: int = 0) -> dict[str, DataFrame]:
    """Sample labels on a grid (the commonest of a cell, or its ``center`` pixel), join neighbouring cells, and test pairs of labels against permutations."""
    if mode == "most_frequent":
        cells = masks.mode_per_cell(mask, size)
    elif mode == "center":
        half = size // 2
        cells = mask.where((F.col("y") % size == half) & (F.col("x") % size == half)).select(F.floor(F.col("y") / size).alias("gy"), F.floor(F.col("x") / size).alias("gx"), "instance")
    else:
        raise ValueError("mode is most_frequent or center")
    nodes = cells.where("instance <> 0").select(F.xxhash64("gy", "gx").alias("node"), "gy", "gx", F.col("instance").alias("label"))
    edges = graph.lattice(nodes.select("node", "gy", "gx"))
    return {"cells": nodes, "edges": edges, "enrichment": graph.enrichment(edges, nodes.select("node", "label"), permutations, seed)}


def voronoi_boundaries(mask: DataFrame, radius: int) -> DataFrame:
    """(instance, ring_id, ring): outlines of the labels grown into the background by up to ``radius``, each pixel to the nearest label."""
    return masks.vectorize(masks.expand_labels(mask, radius))


def density_image(transcripts: DataFrame, height: int, width: int, sigma: float = 7.0, size: int = 1024, **more) -> DataFrame:
    """(c, y, x, value): share of the fullest pixel, blurred, over the whole image."""
    spark = transcripts.sparkSession
    counted = points.density(transcripts, (0, width, 0, height), **more)
    pixels = spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))
    whole = pixels.join(counted, ["y", "x"], "left").select(F.lit(0).alias("c"), "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"))
    return tiles.gaussian_filter(whole, sigma, size)


def signal_table(images: DataFrame, names: Sequence[str], groups: dict[str, str] | None = None, least_signal: float | None = None, fill: float = 0.0) -> DataFrame:
    """(c, one column per image or group): signal-to-noise ratios of images (image, c, y, x, value); a group has the mean of its images."""
    keyed = images.withColumn("c", F.struct("image", "c"))
    rows = raster.signal_to_noise(keyed)
    rows = rows if least_signal is None else rows.where(F.col("signal") >= least_signal)
    image = F.col("c.image")
    column = image if groups is None else F.element_at(F.create_map(*[F.lit(v) for kv in groups.items() for v in kv]), image)
    wanted = list(names) if groups is None else list(dict.fromkeys(groups.values()))
    return rows.select(F.col("c.c").alias("c"), column.alias("name"), "snr").groupBy("c").pivot("name", wanted).agg(F.avg("snr")).na.fill(fill, subset=wanted)


def merge_halos(seen: DataFrame, size: int) -> DataFrame:
    """(y, x, instance): each tile's own pixels; pixels that the tile left empty take the label of a neighbour that saw them, the first in reading order.

    ``seen`` is (ty, tx, y, x, instance), a tile's labels with its halo.
    """
    own = (F.floor(F.col("y") / size) == F.col("ty")) & (F.floor(F.col("x") / size) == F.col("tx"))
    best = seen.where("instance <> 0").groupBy("y", "x").agg(F.min(F.struct((~own).alias("foreign"), "ty", "tx", "instance")).alias("m"))
    return best.select("y", "x", F.col("m.instance").alias("instance"))


def regionprops_table(mask: DataFrame, obs: DataFrame, region: str) -> DataFrame:
    """``obs`` (region, instance, ...) with shape properties and ratios of the instances; raises where an instance of the region isn't in the mask."""
    own = obs.where(F.col("region") == region)
    if own.join(mask.select("instance").distinct(), "instance", "left_anti").limit(1).count():
        raise ValueError("an instance of the table isn't in the mask")
    properties = raster.shape_ratios(raster.shape_moments(mask).join(raster.shape_outlines(mask), "instance"))
    new = [c for c in properties.columns if c == "instance" or c not in obs.columns]
    return own.join(properties.select(new), "instance")


def top_pairs(scores: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k rows with the highest value of each key, ties by the other columns."""
    others = [c for c in scores.columns if c not in (key, value)]
    return scores.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), *others))).where(F.col("_r") <= k).drop("_r")
