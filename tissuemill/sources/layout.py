"""Layouts on disk that save shuffles: rasters bucketed by pixel, and files that row groups' statistics can prune."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import YX


def save_bucketed(df: DataFrame, name: str, buckets: int, keys: Sequence[str] = YX) -> DataFrame:
    """Save as a table bucketed and sorted by ``keys``. Two rasters saved with the same keys and buckets join without a shuffle."""
    own = df
    for k in keys:  # both sides of a join need one type
        own = own.withColumn(k, F.col(k).cast("long"))
    own.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def save_by_tile(df: DataFrame, path: str, tile: int = 1024) -> None:
    """Write long pixels or points so that each file holds few tiles in order: a box query on (y, x) then reads few row groups."""
    ranged = df.withColumn("_ty", F.floor(F.col("y") / tile)).withColumn("_tx", F.floor(F.col("x") / tile))
    ranged.repartitionByRange("_ty", "_tx").sortWithinPartitions("_ty", "_tx", "y", "x").drop("_ty", "_tx").write.mode("overwrite").parquet(path)
