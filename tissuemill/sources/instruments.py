"""Tables of instruments: several samples in one, counts with metadata, channel lists, spots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import transform_points


def read_samples(spark: SparkSession, samples: dict[str, tuple[str, float]], columns: tuple[str, str, str] = ("x_location", "y_location", "feature_name"), filter_genes: Sequence[str] = ()) -> DataFrame:
    """Transcripts (sample, x, y, gene) of several samples, name -> (parquet path, pixel size); each sample has its own pixel size."""
    out = None
    for name, (path, pixel_size) in samples.items():
        raw = spark.read.parquet(path).select(*columns)
        rows = transform_points(raw, pixel_size=pixel_size, column_gene=2, filter_genes=filter_genes).withColumn("sample", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no samples")
    return out


def counts_with_metadata(counts: DataFrame, metadata: DataFrame, key: str = "cell", blank: str = "(?i)blank") -> dict[str, DataFrame]:
    """Wide counts (key, genes ...) and metadata (key, ...) to ``x`` (key, gene, value), ``blank`` (the same of control genes) and ``obs``.

    Raises where the two sides hold different keys.
    """
    a, b = counts.select(key), metadata.select(key)
    if a.join(b, key, "left_anti").limit(1).count() or b.join(a, key, "left_anti").limit(1).count():
        raise ValueError("counts and metadata have different cells")
    genes = [c for c in counts.columns if c != key]
    long = counts.unpivot([key], genes, "gene", "value").where("value <> 0")
    control = F.col("gene").rlike(blank)
    return {"x": long.where(~control), "blank": long.where(control), "obs": metadata}


def attach_shapes(obs: DataFrame, shapes: DataFrame, key: str = "cell") -> DataFrame:
    """Inner join of cells and shapes; raises where a shape stands twice or a cell has none."""
    if shapes.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a shape stands twice")
    if obs.join(shapes, key, "left_anti").limit(1).count():
        raise ValueError("a cell has no shape")
    return obs.join(shapes, key)


def renumber(shapes: DataFrame, key: str) -> DataFrame:
    """``shapes`` with ``instance`` from 1 in the order of ``key``."""
    from ..operators.masks import _numbered

    ids = _numbered(shapes.select(F.col(key).alias("instance")).distinct(), 0)
    return shapes.join(ids.select(F.col("instance").alias(key), F.col("new").alias("instance")), key)


def select_channels(channels: DataFrame, subset: Sequence[str] | None = None, remove_bleached: bool = True, remove_later_dapi: bool = True) -> DataFrame:
    """Rows (name, ...) of channels in the order of the cycle number that starts the name.

    Bleached channels (a B between the cycle and the marker) go, and so do DAPI channels after the first cycle's; ``subset``
    names markers in either case.
    """
    rows = channels.withColumn("cycle", F.expr("try_cast(nullif(regexp_extract(name, '^[^0-9]*([0-9]+)', 1), '') as int)"))
    if remove_bleached:
        rows = rows.where(~F.col("name").rlike(r"(^|_)B(_|$)"))
    if remove_later_dapi:
        first = rows.where(F.lower("name").contains("dapi")).agg(F.min("cycle").alias("m")).first().m
        rows = rows.where(~F.lower("name").contains("dapi") | (F.col("cycle") == F.lit(first)))
    if subset is not None:
        rows = rows.where(F.lower(F.regexp_extract("name", r"([^_]+)$", 1)).isin([s.lower() for s in subset]))
    return rows.orderBy("cycle", "name")


def spots_to_mask(spots: DataFrame, radius: float | None = None) -> DataFrame:
    """(y, x, instance) of round spots (barcode, x, y, [radius]): instances from 1 in the order of the barcode, all with the mean radius; the smaller instance wins."""
    numbered = renumber(spots, "barcode")
    if radius is None:
        radius = spots.agg(F.avg("radius").alias("r")).first().r
    reach = int(radius) + 1
    span = F.sequence(F.lit(-reach), F.lit(reach))
    rows = numbered.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    pixel = rows.select("instance", (F.floor("y") + F.col("dy")).alias("py"), (F.floor("x") + F.col("dx")).alias("px"), "y", "x")
    inside = F.pow(F.col("py") + 0.5 - F.col("y"), 2) + F.pow(F.col("px") + 0.5 - F.col("x"), 2) <= radius * radius
    return pixel.where(inside).groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.min("instance").alias("instance"))
