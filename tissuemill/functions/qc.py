"""The data behind quality-control plots: histograms, scatters and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_summary(sizes: DataFrame) -> DataFrame:
    """One row for (instance, size): n, median, mean and sample deviation, without label 0."""
    return sizes.where("instance <> 0").agg(F.count("*").alias("n"), F.percentile("size", 0.5).alias("median"), F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"))


def metric_range(table: DataFrame, column: str, quantiles: tuple[float, float] | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Rows whose value is in a closed range, given as such or by quantiles of the column."""
    if quantiles is not None and bounds is not None:
        raise ValueError("a range or quantiles, not both")
    if quantiles is not None:
        lo, hi = table.agg(F.percentile(column, F.array(*[F.lit(q) for q in quantiles])).alias("b")).first().b
        bounds = (lo, hi)
    return table if bounds is None else table.where(F.col(column).between(*bounds))


def metric_histogram(table: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) over [low, high], the last bin closed."""
    v, width = F.col(column).cast("double"), (high - low) / bins
    return table.where(v.between(low, high)).groupBy(F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def metrics_histogram(table: DataFrame, columns: dict[str, tuple[int, float, float]]) -> DataFrame:
    """(metric, bin, n) of several columns (bins, low, high) in one pass."""
    parts = []
    for name, (bins, low, high) in columns.items():
        v, width = F.col(name).cast("double"), (high - low) / bins
        parts.append(F.when(v.between(low, high), F.struct(F.lit(name).alias("metric"), F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))))
    return table.select(F.explode(F.array(*parts)).alias("p")).where("p is not null").groupBy("p.metric", "p.bin").agg(F.count("*").alias("n"))


def scatter_histogram(table: DataFrame, x: str, y: str, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """(bx, by, n): two-dimensional histogram of rows where both columns are present and in range."""

    def place(name: str, span: tuple[float, float]):
        return F.least(F.floor((F.col(name) - span[0]) / ((span[1] - span[0]) / bins)), F.lit(bins - 1)).cast("int")

    rows = table.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return rows.groupBy(place(x, x_range).alias("bx"), place(y, y_range).alias("by")).agg(F.count("*").alias("n"))


def resolve_column(name: str, obs: DataFrame, var: DataFrame) -> str:
    """'obs' or 'var', whichever has the column; raises where both or neither do."""
    there = [k for k, df in (("obs", obs), ("var", var)) if name in df.columns]
    if len(there) != 1:
        raise ValueError(f"{name} is in {there or 'neither obs nor var'}")
    return there[0]


def marker_sets(scores: DataFrame, least: float) -> DataFrame:
    """(image, markers): the sorted set of channels whose value is over ``least`` in each image."""
    return scores.where(F.col("value") > least).groupBy("image").agg(F.array_sort(F.collect_set("c")).alias("markers"))


def intersect_boxes(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> tuple[float, float, float, float] | None:
    """The common part of two boxes (xmin, xmax, ymin, ymax); None where they only touch or are apart."""
    box = (max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]))
    return box if box[0] < box[1] and box[2] < box[3] else None


def resolve_channels(wanted: list[int | str], names: list[str]) -> list[int]:
    """Positions of channels given by position or name, without repeats, in the order given."""
    out = []
    for w in wanted:
        if isinstance(w, str):
            if w not in names:
                raise ValueError(f"no channel {w}")
            w = names.index(w)
        if not 0 <= w < len(names):
            raise ValueError(f"no channel at {w}")
        if w not in out:
            out.append(w)
    return out
