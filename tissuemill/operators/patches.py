"""Windows around instances, embeddings of them, and batch iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_instances(image: DataFrame, mask: DataFrame, diameter: int, keep_others: bool = False) -> DataFrame:
    """(instance, c, dy, dx, value): the window of ``diameter`` around each rounded centroid; pixels of other instances are left out (0).

    The window is made from the centroid and joined to the pixels by place, so that no window is cut at a tile.
    """
    half = diameter // 2
    cells = mask.where("instance <> 0")
    centers = cells.groupBy("instance").agg(F.rint(F.avg("y")).cast("long").alias("cy"), F.rint(F.avg("x")).cast("long").alias("cx"))
    span = F.sequence(F.lit(-half), F.lit(diameter - half - 1))
    window = centers.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).select("instance", "dy", "dx", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"))
    if not keep_others:
        window = window.join(cells.select("y", "x", "instance"), ["y", "x", "instance"], "left_semi")
    return window.join(image, ["y", "x"]).select("instance", "c", (F.col("dy") + half).alias("dy"), (F.col("dx") + half).alias("dx"), "value")


def patch_vectors(patches: DataFrame, channels: int, diameter: int) -> DataFrame:
    """(instance, patch): windows as arrays in the order channel, row, column."""
    size = channels * diameter * diameter
    at = (F.col("c") * diameter + F.col("dy")) * diameter + F.col("dx")
    held = patches.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.col("value").cast("double")))).alias("m"))
    return held.select("instance", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("patch"))


def featurize(patches: DataFrame, model: Callable[[np.ndarray], np.ndarray], channels: int, diameter: int) -> DataFrame:
    """(instance, embedding): a model of (instances, channels, 1, rows, columns) run over Arrow batches of patch vectors."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                data = np.stack(f.patch.to_numpy()).reshape(len(f), channels, 1, diameter, diameter)
                yield pd.DataFrame({"instance": f.instance, "embedding": np.asarray(model(data), dtype=float).tolist()})

    return patches.select(F.col("instance").cast("long"), "patch").mapInPandas(work, "instance long, embedding array<double>")


def iterate(patches: DataFrame, rank: int = 0, world: int = 1, seed: int = 0, batch: int = 64, drop: tuple[int, ...] = ()) -> Iterator[list]:
    """Batches of rows of one of ``world`` readers, in an order shuffled by a seeded hash; every row goes to exactly one reader.

    Rows arrive partition by partition, so that the reader holds one partition at a time.
    """
    own = patches.where((F.pmod(F.xxhash64(F.lit(seed + 1), "instance"), F.lit(world)) == rank) & ~F.col("instance").isin(list(drop) or [-1]))
    held: list = []
    for row in own.orderBy(F.xxhash64(F.lit(seed), "instance")).toLocalIterator():
        held.append(row)
        if len(held) == batch:
            yield held
            held = []
    if held:
        yield held


def min_max(patches: DataFrame) -> DataFrame:
    """Values scaled per channel to [0, 1]."""
    bounds = patches.groupBy("c").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return patches.join(F.broadcast(bounds), "c").withColumn("value", F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).select(patches.columns)
