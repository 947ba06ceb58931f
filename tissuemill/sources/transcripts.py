"""Readers of transcript tables: parquet or delimited text, with presets for instruments' column places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import crop

IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def read_transcripts(
    spark: SparkSession, path: str, matrix: Sequence[Sequence[float]] | None = None, pixel_size: float | None = None, column_x: int = 0, column_y: int = 1, column_z: int | None = None,
    column_gene: int = 3, column_repeat: int | None = None, delimiter: str = ",", header: bool = False, comment: str | None = None, box: tuple[float, float, float, float] | None = None,
    filter_genes: Sequence[str] = (), file_format: str | None = None,
) -> DataFrame:
    """Points (x, y, [z,] gene) in pixels; columns are addressed by place.

    Genes that contain one of the patterns ``filter_genes`` (regular expressions, either case) go; null genes stay. Rows are
    repeated by ``column_repeat``. The affine ``matrix`` or the inverse of ``pixel_size`` is applied to (x, y), then the half-open
    box crops. Giving a matrix other than the identity and a pixel size raises ``ValueError``.
    """
    if pixel_size is not None and matrix is not None and tuple(map(tuple, matrix)) != IDENTITY:
        raise ValueError("a matrix or a pixel size, not both")
    if (file_format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")) == "parquet":
        raw = spark.read.parquet(path)
    else:
        reader = spark.read.option("sep", delimiter).option("header", header)
        raw = (reader if comment is None else reader.option("comment", comment)).csv(path)
    return transform_points(raw, matrix, pixel_size, column_x, column_y, column_z, column_gene, column_repeat, box, filter_genes)


def transform_points(raw: DataFrame, matrix=None, pixel_size=None, column_x=0, column_y=1, column_z=None, column_gene=3, column_repeat=None, box=None, filter_genes=()) -> DataFrame:
    """The same on a frame that is read already."""
    at = lambda i: F.col(f"`{raw.columns[i]}`")
    rows = raw
    for pattern in filter_genes:
        rows = rows.where(~F.coalesce(at(column_gene).cast("string").rlike(f"(?i){pattern}"), F.lit(False)))
    if column_repeat is not None:
        rows = rows.withColumn("_again", F.explode(F.expr(f"array_repeat(0, cast(`{raw.columns[column_repeat]}` as int))")))
    x, y = at(column_x).cast("double"), at(column_y).cast("double")
    m = matrix or IDENTITY
    if pixel_size is not None:
        m = ((1 / pixel_size, 0.0, 0.0), (0.0, 1 / pixel_size, 0.0), (0.0, 0.0, 1.0))
    nx, ny = (x, y) if tuple(map(tuple, m)) == IDENTITY else (x * float(m[0][0]) + y * float(m[0][1]) + float(m[0][2]), x * float(m[1][0]) + y * float(m[1][1]) + float(m[1][2]))
    out = rows.select(nx.alias("x"), ny.alias("y"), *([at(column_z).cast("double").alias("z")] if column_z is not None else []), at(column_gene).cast("string").alias("gene"))
    return out if box is None else crop(out, box)


def read_resolve(spark: SparkSession, path: str, pixel_size: float = 0.138, **more) -> DataFrame:
    """Tab-separated without header: x, y, -, gene."""
    return read_transcripts(spark, path, pixel_size=pixel_size, delimiter="\t", **more)


def read_merscope(spark: SparkSession, path: str, matrix: Sequence[Sequence[float]], **more) -> DataFrame:
    """Comma-separated with header: x at 2, y at 3, gene at 8; the matrix goes from microns to pixels."""
    return read_transcripts(spark, path, matrix=matrix, column_x=2, column_y=3, column_gene=8, header=True, **more)


def read_stereoseq(spark: SparkSession, path: str, **more) -> DataFrame:
    """Tab-separated with header: gene, x, y, count of molecules."""
    return read_transcripts(spark, path, column_x=1, column_y=2, column_gene=0, column_repeat=3, delimiter="\t", header=True, **more)
